"""All registered queries."""

from __future__ import annotations

from tessera.plans import answer_queries, form_queries, identity_queries, intake_queries, knowledge_queries, memory_queries, planning_queries, rule_queries, store_queries, stream_queries, text_queries, verify_queries, view_queries  # noqa: F401
from tessera.plans.registry import ORACLE, QUERIES  # noqa: F401

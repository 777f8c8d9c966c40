"""The life of a request: asked, waiting for its requester, waiting for the owner, answered or refused.

What an approval comes to depends on all before it: a credential copy is given once, and an answer that
the ledger lets through narrows what later ones may tell.  So the owner's decisions are walked in order,
group by group; a group is what shares copies and ledgers (a family of claims).

Requests: request_id, group, seq, requester, claim, proposed (ISSUER_PROOF, OWNER_ATTESTED, REFUSED or
CANNOT_CONFIRM), issuer_claim, threshold, width, result, agreeable, ts.  Pairings: requester, seq,
accept.  Decisions: request_id, seq, action.  Copies: cred_id, group, credential_type, copy, used,
claims (array of issuer claims).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rules import ATTESTED_DAYS, MOST_ATTESTED

# fixed values
AGREEING, OTHER = ["approve", "deny"], ["answer", "decline"]
LOW_COPIES = 3
DAY = 86_400_000_000


def processed(requests: DataFrame, pairings: DataFrame) -> DataFrame:
    """Requests with at (when they are taken up), status, answer_type and event: at once if the requester is paired by
    then, else when that is decided; a blocked requester's are refused, and those nobody decided on wait.

    For each request the state of its requester then and the first decision after it come from one window over
    the requester's decisions and requests in order."""
    asked = requests.select("request_id", "requester", "seq", F.lit(1).alias("kind"))
    told = pairings.select("requester", "seq", F.lit(0).alias("kind"), "accept")
    both = asked.unionByName(told, allowMissingColumns=True)
    line = Window.partitionBy("requester").orderBy("seq", "kind")
    known = F.last("accept", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    coming = F.first(F.when(F.col("kind") == 0, F.struct("seq", "accept")), ignorenulls=True).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    states = both.select("request_id", "kind", known.alias("known"), coming.alias("coming")).filter("kind = 1").drop("kind")
    rows = requests.join(states, "request_id")
    # a blocked requester is turned away when asking; one who is unknown waits
    paired = F.when(F.col("known").isNotNull(), F.col("known")).otherwise(F.col("coming.accept"))
    at = F.when(F.col("known").isNotNull(), F.col("seq")).otherwise(F.col("coming.seq"))
    ended = F.when(~paired, "REFUSED").when(paired & F.col("proposed").isin("REFUSED", "CANNOT_CONFIRM"), F.col("proposed"))
    status = F.when(paired.isNull(), "pending_pairing").when(ended.isNotNull(), "done").otherwise("pending")
    event = F.when(ended == "REFUSED", "request_auto_refused").when(ended == "CANNOT_CONFIRM", "request_cannot_confirm")
    return rows.withColumns({"at": at, "status": status, "answer_type": ended, "event": event}).drop("known", "coming")


OUT = [("group", pa.string()), ("request_id", pa.string()), ("seq", pa.int64()), ("answer_type", pa.string()), ("cred_id", pa.string()), ("events", pa.list_(pa.string()))]


class Group:
    """Ledgers and copies of one group, and which requests are decided."""

    def __init__(self) -> None:
        self.intervals: dict[str, tuple[float, float]] = {}
        self.attested: dict[str, dict[float, int]] = {}
        self.free: dict[str, list[tuple[str, int, str]]] = {}
        self.left: dict[str, int] = {}
        self.used: set[str] = set()
        self.done: set[str] = set()

    def add(self, row: dict[str, Any]) -> None:
        self.left[row["credential_type"]] = self.left.get(row["credential_type"], 0) + 1
        for claim in row["claims"] or ():
            heapq.heappush(self.free.setdefault(claim, []), (row["credential_type"], row["copy"], row["cred_id"]))

    def copy_for(self, claim: str | None) -> tuple[str, int, str] | None:
        heap = self.free.get(claim or "", [])
        while heap and heap[0][2] in self.used:
            heapq.heappop(heap)
        return heap[0] if heap else None

    def allowed(self, row: dict[str, Any], signed: bool) -> bool:
        """Check an answer with its claim's ledger, and record it if it passes."""
        t, claim, now = row["threshold"], row["claim"], row["ts"]
        if t is None or row["result"] is None:
            return True
        lo, hi = self.intervals.get(claim, (float("-inf"), float("inf")))
        lo, hi = (max(lo, t), hi) if row["result"] else (lo, min(hi, t))
        recent = {x: at for x, at in self.attested.get(claim, {}).items() if at >= now - ATTESTED_DAYS * DAY}
        if hi - lo < (row["width"] or 0) or not signed and t not in recent and len(recent) >= MOST_ATTESTED:
            return False
        self.intervals[claim] = (lo, hi)
        self.attested[claim] = recent if signed else recent | {t: now}
        return True

    def end(self, row: dict[str, Any]) -> None:
        if row["again"]:
            self.done.add(row["request_id"])


def decided(requests: DataFrame, decisions: DataFrame, copies: DataFrame) -> DataFrame:
    """group, request_id, seq, answer_type, cred_id, events of each decision on a pending request (of processed());
    answer_type is null and events say conflict where the request isn't waiting, the action isn't offered, or no
    copy is left (it goes on waiting then)."""
    pending = requests.filter("status = 'pending'").select("request_id", "group", "claim", "proposed", "issuer_claim", "threshold", "width", "result", "agreeable", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "at")
    joined = decisions.select("request_id", "seq", "action").join(pending, "request_id").filter(F.col("seq") > F.col("at")).drop("at")
    again = F.count(F.lit(1)).over(Window.partitionBy("request_id")) > 1  # only then need a request be remembered
    acts = joined.withColumns({"again": again, "kind": F.lit(1)})
    have = copies.filter("used = 0").select("group", "cred_id", "credential_type", "copy", "claims", F.lit(0).alias("kind"))
    ordered = acts.unionByName(have, allowMissingColumns=True).repartition("group").sortWithinPartitions("group", "kind", "seq", "credential_type", "copy", "cred_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, begun, state = None, False, Group()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["group"] != name:
                    name, begun, state = row["group"], True, Group()
                if row["kind"] == 0:
                    state.add(row)
                else:
                    kind, cred, events = settle(state, row)
                    out.append({"group": name, "request_id": row["request_id"], "seq": row["seq"], "answer_type": kind, "cred_id": cred, "events": events})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema(OUT))

    return ordered.mapInArrow(run, "group string, request_id string, seq long, answer_type string, cred_id string, events array<string>")


def settle(state: Group, row: dict[str, Any]) -> tuple[str | None, str | None, list[str]]:
    """What a decision does: answer_type, cred_id, audit events."""
    offered = AGREEING if row["agreeable"] else OTHER
    if row["request_id"] in state.done or row["action"] not in offered:
        return None, None, ["conflict"]
    if row["action"] in ("decline", "deny"):
        state.end(row)
        return "DECLINED", None, ["disclosure_declined" if row["action"] == "decline" else "disclosure_denied"]
    signed = row["proposed"] == "ISSUER_PROOF"
    copy = state.copy_for(row["issuer_claim"]) if signed else None
    if signed and copy is None or not signed and row["result"] is None:
        return None, None, ["conflict"]
    state.end(row)
    if not state.allowed(row, signed):
        return "REFUSED", None, ["request_refused_ledger"]
    events = []
    if copy is not None:
        kind, _, cred = copy
        state.used.add(cred)
        state.left[kind] -= 1
        events = ["wallet_low"] if state.left[kind] < LOW_COPIES else []
    return row["proposed"], copy[2] if copy else None, [*events, "disclosure_answered"]

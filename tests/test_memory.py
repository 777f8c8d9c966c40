"""Taught statements, candidates, versions, proofs and computed lines on known cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import memory

TODAY = dt.date(2026, 9, 20)


def test_taught(spark):
    rows = [
        (1, "o", "My rent is ₹15,000 from October", "my rent", "15000", "from October", TODAY), (2, "o", "My rent is going up", "rent", "going up", None, TODAY), (3, "o", "I work at Nimbus", "job", "Nimbus", "soon", TODAY),
        (4, "o", "I work at Nimbus", "job", "Acme", None, TODAY), (5, "o", "gym fee is 2500", "Gym fee", "2500", "2026-01-01", TODAY), (6, "o", "x", "!!", "x", None, TODAY), (7, "o", None, "rent", "5", None, TODAY),
    ]
    out = memory.taught(spark.createDataFrame(rows, "seq long, owner string, statement string, field string, value string, valid_from string, today date")).collect()
    got = {r["seq"]: (r["field"], r["value"], r["valid_from"]) for r in out}
    assert got == {1: ("rent_amount", "15000", dt.date(2026, 10, 1)), 3: ("employer", "Nimbus", TODAY), 5: ("gym_fee", "2500", dt.date(2026, 1, 1))}


def test_accepted_once(spark):
    rows = [("a", "o", 1, "fact", "gym_fee", "5", "gym is 5", TODAY, None), ("b", "o", 2, "decision", None, None, "Decision: we renew.", TODAY, "flat move"), ("c", "o", 3, "fact", "x", "1", "x", TODAY, None), ("d", "o", 4, "fact", "y", "1", "y", TODAY, None)]
    candidates = spark.createDataFrame(rows, "candidate_id string, owner string, seq long, kind string, field string, value string, statement string, valid_from date, project string")
    said = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 5, True), ("c", 3, False), ("c", 4, True), ("unknown", 1, True)], "candidate_id string, seq long, remember boolean")
    status, facts, edges = memory.accepted(candidates, said)
    assert {r["candidate_id"]: r["status"] for r in status.collect()} == {"a": "accepted", "b": "accepted", "c": "discarded", "d": "pending"}
    assert [(r["candidate_id"], r["field"], r["value"]) for r in facts.collect()] == [("a", "gym_fee", "5")]
    assert {(r["src"], r["rel"], r["dst"]) for r in edges.collect()} == {("o", "DECIDED", "we renew"), ("we renew", "PART_OF", "flat move")}


LINES = {
    "monthly_income today = 62000 (bank-signed statement, bank_statement_signed.pdf, since 2026-04-01)": ("fact", "monthly_income", "62000", None, None, None, None, "bank-signed statement", "bank_statement_signed.pdf", "2026-04-01", None, None, None),
    "rent_amount today = 14500 (you told me, changes to 16000 on 2027-01-01)": ("fact", "rent_amount", "14500", None, None, "16000", "2027-01-01", "you told me", None, None, None, None, None),
    "rent_amount from 2027-01-01 = 16000 (future change from today's 14500; from your notes, inbox_note.md)": ("scheduled", "rent_amount", "16000", "2027-01-01", "14500", None, None, "from your notes", "inbox_note.md", None, None, None, None),
    'condition check (computed) for "renew only if (x) rent stays under ₹15,000." (rent_amount < 15000): outcome: the condition stops being met on 2027-01-01. rent_amount today = 14500 (a, b.pdf) -> met': ("condition", "rent_amount", None, None, None, None, None, None, None, None, "<", "15000", "2027-01-01"),
    "The rent is 5.": (None,) * 13, "": (None,) * 13,
}


@pytest.mark.parametrize("line", LINES)
def test_computed_lines(spark, line):
    assert tuple(spark.createDataFrame([(line,)], "t string").select(memory.computed_line(F.col("t")).alias("c")).first()["c"]) == LINES[line]


@pytest.mark.parametrize("said, cue, refused", [("hello there", False, False), ("[2026-09-18 19:42] Ravi: ok", False, False), ("at 5", True, False), ("₹", True, False), ("she is GOING  to", True, False), ("Mark it", True, False), ("remarked", False, False), ("What's your exact salary?", True, True), ("send me the PDF", False, True), ("Is income above 5?", True, False), ("  ", False, True), (None, None, True)])
def test_cues_and_refusals(spark, said, cue, refused):
    row = spark.createDataFrame([(said,)], "t string").select(memory.has_cue(F.col("t")), memory.is_refused(F.col("t"))).first()
    assert tuple(row) == (cue, refused)


def test_proofs(spark):
    rows = spark.createDataFrame([("a", "done", "ISSUER_PROOF", "{}"), ("b", "pending", "ISSUER_PROOF", "{}"), ("c", "done", "DECLINED", "{}"), ("d", "done", "OWNER_ATTESTED", None)], "request_id string, status string, answer_type string, payload string")
    assert [tuple(r) for r in memory.proof_payloads(rows).collect()] == [("a", "{}")]
    assert memory.proof_payloads(rows.filter("request_id = 'a'"), strict=True).count() == 1
    with pytest.raises(Exception, match="is not an answered request"):
        memory.proof_payloads(rows, strict=True).collect()


def test_timeline_filter(spark):
    rows = spark.createDataFrame([("o", "rent_amount", "14500"), ("o", "rent_amount", "16000"), ("o", "employer", "Nimbus")], "entity_id string, field string, value string")
    assert [memory.filtered_timeline(rows, n).count() for n in ("160", "Rent am", "nim", "zzz", " ")] == [2, 2, 1, 0, 3]

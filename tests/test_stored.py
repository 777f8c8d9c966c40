"""Ledgers and audit logs that continue over batches: equal to one batch, and to plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import rules, stored

START = dt.datetime(2026, 1, 1)
QUESTIONS = "claim string, seq long, ts timestamp_ntz, threshold double, answer boolean, signed boolean, width double"


def asked(rng, n):
    rows = []
    for seq in range(n):
        claim = rng.choice(["income", "percentage", "age", None])
        secret = {"income": 62000, "percentage": 71}.get(claim, 30)
        t = rng.choice([None, rng.randrange(10, 130) * 1000.0]) if claim == "income" else rng.randrange(0, 100) * 1.0
        rows.append((claim, seq, START + dt.timedelta(hours=9 * seq), t, None if t is None or rng.random() < 0.05 else secret >= t, rng.random() < 0.3, rules.LEAST_WIDTH.get(claim)))
    return rows


def slow_ledger(rows):
    state, out = {}, {}
    for claim, seq, ts, t, yes, signed, width in sorted(rows, key=lambda r: r[1]):
        lo, hi, told = state.get(claim, (float("-inf"), float("inf"), []))
        if t is None or yes is None:
            out[seq] = True
            continue
        low, high = (max(lo, t), hi) if yes else (lo, min(hi, t))
        recent = {x for x, when in told if when >= ts - dt.timedelta(days=30)}
        out[seq] = high - low >= (width or 0) and (signed or t in recent or len(recent) < 3)
        if out[seq]:
            state[claim] = (low, high, told if signed else [*told, (t, ts)])
    return out


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/checkpoints")


@pytest.mark.parametrize("cuts", [[], [1], [90, 200], [40, 41, 300]])
def test_ledger_continues(spark, tmp_path, cuts):
    rows = asked(random.Random(5), 400)
    want = slow_ledger(rows)
    assert 20 < sum(want.values()) < 390
    store, ends = stored.LedgerStore(spark, str(tmp_path / "l")), [0, *cuts, 400]
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        batch = spark.createDataFrame(rows[a:b], QUESTIONS)
        store.decide(k, batch)
    store.decide(len(cuts), batch)  # the last batch once more
    assert {r["seq"]: r["allowed"] for r in store.decisions().collect()} == want and store.decisions().count() == 400
    whole = rules.walked_ledger(spark.createDataFrame(rows, QUESTIONS), "claim")
    assert sorted(map(str, whole.filter("seq is null").select("claim", "lo", "hi").collect())) == sorted(map(str, store.state().select("claim", "lo", "hi").collect()))


def test_signed_answers_are_exempt(spark):
    rows = [("income", k, START, 20000.0 + 1000 * k, True, k == 4, 1.0) for k in range(6)] + [("income", 9, START + dt.timedelta(days=31), 41000.0, True, False, 1.0)]
    out = rules.walked_ledger(spark.createDataFrame(rows, QUESTIONS), "claim").filter("seq is not null").orderBy("seq").collect()
    assert [r["allowed"] for r in out] == [True, True, True, False, True, False, True]
    assert out[3]["reason"] == "too many thresholds"
    narrow = [("income", 0, START, 50000.0, True, False, 25000.0), ("income", 1, START, 75000.0, False, False, 25000.0), ("income", 2, START, 60000.0, True, True, 25000.0)]
    out = rules.walked_ledger(spark.createDataFrame(narrow, QUESTIONS), "claim").filter("seq is not null").orderBy("seq").collect()
    assert [(r["allowed"], r["reason"]) for r in out] == [(True, None), (True, None), (False, "too narrow")]


def test_thresholds(spark):
    rows = [("income", "income_ge_50000", "ge", "60000"), ("income", None, "ge", "62000"), ("income", None, "lt", "62000"), ("age", None, "ge", "21"), ("percentage", "percentage_ge_75", "is", None), ("income", "other_ge_5", "ge", "x")]
    out = spark.createDataFrame(rows, "claim string, issuer string, op string, value string").select(stored.threshold(F.col("claim"), F.col("issuer"), F.col("op"), F.col("value"))).collect()
    assert [r[0] for r in out] == [50000.0, 62000.0, None, None, 75.0, None]


def test_audit_continues(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c"]), seq, f"entry {seq}") for seq in range(120)] + [("late", 119, "x")]
    want = sorted(map(tuple, rules.chained(spark.createDataFrame(rows, "log string, seq long, body string"), "log").collect()))
    for cuts in ([60], [1, 2, 100]):
        store, ends = stored.AuditStore(spark, str(tmp_path / f"a{cuts[0]}")), [0, *cuts, 121]
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            batch = spark.createDataFrame(rows[a:b], "log string, seq long, body string")
            store.append(k, batch)
        store.append(len(cuts), batch)
        assert sorted(map(tuple, store.entries().collect())) == want
        assert all(r["intact"] for r in rules.verified(store.entries(), "log").collect())
        store.append(9, spark.createDataFrame([("a", 0, "forged"), ("a", 500, "next")], "log string, seq long, body string"))
        assert [tuple(r) for r in store.refused().collect()] == [("a", 0, "forged")]
        assert all(r["intact"] for r in rules.verified(store.entries(), "log").collect()) and store.entries().count() == 122


def test_requests_equal_a_replay(spark):
    rng = random.Random(7)
    creds = [(f"c{i}", rng.choice(["x", "y"]), int(rng.random() < 0.3), rng.choice("pq"), rng.randrange(5)) for i in range(14)]
    requests = [(f"r{i:02}", i, rng.choice(["x", "y", "z"]), rng.random() < 0.6, rng.choice([True, False, None])) for i in range(40)]
    ledger = [(r[2], r[1], rng.random() < 0.7) for r in requests]
    used, want = set(), {}
    for (rid, seq, claim, proof, answer), (_, _, allowed) in zip(requests, ledger):
        free = sorted((c[3], c[4], c[0]) for c in creds if c[1] == claim and not c[2] and c[0] not in used)
        if proof and free:
            used.add(free[0][2])
            want[rid] = ("ISSUER_PROOF", free[0][2], answer, "answer_released")
        elif answer is None:
            want[rid] = ("CANNOT_CONFIRM", None, None, "not_confirmed")
        else:
            want[rid] = ("OWNER_ATTESTED", None, answer, "answer_released") if allowed else ("REFUSED", None, None, "ledger_refused")
    out = stored.settled(
        spark.createDataFrame(requests, "request_id string, seq long, claim string, proof boolean, answer boolean"),
        spark.createDataFrame(ledger, "claim string, seq long, allowed boolean"),
        spark.createDataFrame(creds, "cred_id string, claim string, used int, credential_type string, copy int"),
    )
    assert {r["request_id"]: (r["status"], r["cred_id"], r["answer"], r["event"]) for r in out.collect()} == want

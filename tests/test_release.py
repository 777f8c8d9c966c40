"""The life of requests against a plain replay of all events in order."""

import datetime as dt
import random

import pytest

from tessera.operators import release

START = dt.datetime(2026, 1, 1)
REQUESTS = "request_id string, group string, seq long, requester string, claim string, proposed string, issuer_claim string, threshold double, width double, result boolean, agreeable boolean, ts timestamp_ntz"


class Replay:
    """One mutable world, event by event."""

    def __init__(self, copies):
        self.copies, self.used = sorted(copies, key=lambda c: (c["type"], c["copy"], c["id"])), {c["id"] for c in copies if c["used"]}
        self.paired, self.status, self.row, self.ledger, self.told, self.out, self.took = {}, {}, {}, {}, {}, {}, {}

    def take_up(self, rid, seq):
        row = self.row[rid]
        self.took[rid] = seq
        self.status[rid] = "done" if row["proposed"] in ("REFUSED", "CANNOT_CONFIRM") else "pending"

    def ask(self, seq, row):
        self.row[row["id"]] = row
        known = self.paired.get(row["requester"])
        if known is None:
            self.status[row["id"]] = "pending_pairing"
        elif known:
            self.take_up(row["id"], seq)
        else:
            self.status[row["id"]] = "done"

    def pair(self, seq, who, accept):
        self.paired[who] = accept
        for rid, status in list(self.status.items()):
            if status == "pending_pairing" and self.row[rid]["requester"] == who:
                if accept:
                    self.take_up(rid, seq)
                else:
                    self.status[rid] = "done"

    def decide(self, seq, rid, action):
        if rid not in self.took or self.row[rid]["proposed"] in ("REFUSED", "CANNOT_CONFIRM"):
            return
        row = self.row[rid]
        self.out[seq] = (None, None, ["conflict"])
        if self.status[rid] != "pending" or action not in (["approve", "deny"] if row["agreeable"] else ["answer", "decline"]):
            return
        if action in ("deny", "decline"):
            self.status[rid] = "done"
            self.out[seq] = ("DECLINED", None, ["disclosure_denied" if action == "deny" else "disclosure_declined"])
            return
        signed = row["proposed"] == "ISSUER_PROOF"
        free = [c for c in self.copies if c["group"] == row["group"] and c["id"] not in self.used and row["issuer_claim"] in c["claims"]] if signed else []
        if signed and not free or not signed and row["result"] is None:
            return
        self.status[rid] = "done"
        events, key = ["disclosure_answered"], (row["group"], row["claim"])
        if row["threshold"] is not None and row["result"] is not None:
            lo, hi = self.ledger.get(key, (float("-inf"), float("inf")))
            lo, hi = (max(lo, row["threshold"]), hi) if row["result"] else (lo, min(hi, row["threshold"]))
            recent = {t for t, when in self.told.get(key, []) if when >= row["ts"] - dt.timedelta(days=30)}
            if hi - lo < (row["width"] or 0) or not signed and row["threshold"] not in recent and len(recent) >= 3:
                self.out[seq] = ("REFUSED", None, ["request_refused_ledger"])
                return
            self.ledger[key] = (lo, hi)
            if not signed:
                self.told.setdefault(key, []).append((row["threshold"], row["ts"]))
        if signed:
            self.used.add(free[0]["id"])
            if sum(c["type"] == free[0]["type"] and c["group"] == row["group"] and c["id"] not in self.used for c in self.copies) < release.LOW_COPIES:
                events.insert(0, "wallet_low")
        self.out[seq] = (row["proposed"], free[0]["id"] if signed else None, events)


@pytest.mark.parametrize("seed", [1, 2])
def test_life_cycle_equals_a_replay(spark, seed):
    rng = random.Random(seed)
    copies = [{"id": f"c{i}", "group": rng.choice("gh"), "type": rng.choice("xy"), "copy": rng.randrange(4), "used": int(rng.random() < 0.2), "claims": rng.sample(["a1", "a2", "b1"], 2)} for i in range(40)]
    world, events = Replay(copies), []
    for i in range(500):
        roll = rng.random()
        if roll < 0.35:
            group = rng.choice("gh")
            row = {"id": f"r{i}", "group": group, "requester": f"p{rng.randrange(12)}", "claim": group + rng.choice("12"), "proposed": rng.choice(["ISSUER_PROOF", "OWNER_ATTESTED", "OWNER_ATTESTED", "REFUSED", "CANNOT_CONFIRM"]), "issuer_claim": rng.choice(["a1", "a2", "b1", None]), "threshold": rng.choice([None, float(rng.randrange(60))]), "width": 20.0, "result": rng.choice([True, False, None]), "agreeable": rng.random() < 0.7, "ts": START + dt.timedelta(hours=i * 7)}
            events.append(("ask", i, row))
            world.ask(i, row)
        elif roll < 0.4:
            events.append(("pair", i, f"p{rng.randrange(12)}", rng.random() < 0.8))
            world.pair(i, *events[-1][2:])
        elif world.row:
            events.append(("decide", i, rng.choice(list(world.row)[-40:]), rng.choice(["approve", "approve", "answer", "deny", "decline"])))
            world.decide(i, *events[-1][2:])
    requests = spark.createDataFrame([(r["id"], r["group"], s, r["requester"], r["claim"], r["proposed"], r["issuer_claim"], r["threshold"], r["width"], r["result"], r["agreeable"], r["ts"]) for k, s, *x in events if k == "ask" for r in x], REQUESTS)
    pairings = spark.createDataFrame([(e[2], e[1], e[3]) for e in events if e[0] == "pair"], "requester string, seq long, accept boolean")
    decisions = spark.createDataFrame([(e[2], e[1], e[3]) for e in events if e[0] == "decide"], "request_id string, seq long, action string")
    wallet = spark.createDataFrame([(c["id"], c["group"], c["type"], c["copy"], c["used"], c["claims"]) for c in copies], "cred_id string, group string, credential_type string, copy int, used int, claims array<string>")
    taken = release.processed(requests, pairings)
    first = {r["request_id"]: (r["status"], r["at"]) for r in taken.collect()}
    for rid, (status, at) in first.items():
        if rid in world.took:
            assert at == world.took[rid] and status == ("done" if world.row[rid]["proposed"] in ("REFUSED", "CANNOT_CONFIRM") else "pending")
        else:
            assert status == world.status[rid]
    got = {r["seq"]: (r["answer_type"], r["cred_id"], r["events"]) for r in release.decided(taken, decisions, wallet).collect()}
    assert got == world.out and len({v[0] for v in got.values()}) >= 5

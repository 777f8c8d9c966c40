"""Resampling, line dedup and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_repair, line_dedup, queries, resampling

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(UPPER))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def slow_resample(docs, target, share=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    raw, goal = np.zeros(10000), np.zeros(10000)
    for counts, texts in ((raw, [t for _, t in docs]), (goal, target)):
        for t in texts:
            for f in features(t)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (raw.sum() + 10000) / ((s + 1) * (goal.sum() + 10000)))) for s, t in zip(raw, goal)]
    rows = []
    for doc_id, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    live = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = live[: share * len(live) // 100]
    for k, r in enumerate(drawn):
        r.append(k + 1)
    return sorted((tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in rows), key=str)


def texts_of(rng):
    letters = ["a", "B", "c1", "É", "東京", "xyz", "Zz"]
    texts = [None, "", "...", "A", "a b", "a-B c_d", "Ünïcode ÉCLAIR İ", "x" * 5000, "\x00a\x7fb c", "9" * 300 + " b"]
    return texts + [" ".join(rng.choice(letters) for _ in range(rng.randrange(60))) + rng.choice(["", "\n", ", "]) for _ in range(150)]


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_resampling_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    monkeypatch.setattr(resampling, "BYTES", 10 * piece)
    rng = random.Random(5)
    docs = [(i, t) for i, t in enumerate(texts_of(rng))]
    docs += [(None, docs[20][1]), (3, docs[30][1]), (3, docs[30][1])]
    target = ["a b c1 xyz xyz É", None, "Zz Zz a"]
    table = spark.createDataFrame([(i, t, "clash", "x") for i, t in docs], "doc_id long, text string, score string, other string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.resample(table, goal, share=30)
    assert out.columns == ["doc_id", "text", "other", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in out.select("doc_id", *resampling.MADE).collect()), key=str)
    assert got == slow_resample(docs, target, 30)


def test_resampling_of_the_tables(spark):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{DATA}/{t}.parquet").select(*c).collect()]
    out = queries.op11_resampling(spark, DATA)
    assert dict(out.dtypes) == dict.fromkeys(["doc_id", *resampling.MADE], "bigint")
    assert sorted((tuple(r) for r in out.collect()), key=str) == slow_resample(read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")])


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    assert [r["rank"] for r in resampling.resample(some, none, share=100).collect()] == [1]


def test_ranks_over_bins(spark, monkeypatch):
    monkeypatch.setattr(resampling, "ROWS", 3)
    rng = random.Random(1)
    rows = [(i if i % 50 else None, rng.randrange(10, 40), rng.randrange(60)) for i in range(600)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, score long")
    live = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[2], r[0] is None, r[0]))
    for share in (0, 1, 5, 100):
        got = [tuple(r) for r in resampling.ranked(scored, share).collect()]
        assert len(got) == 600 and sorted((r for r in got if r[3]), key=lambda r: r[3]) == [(*r, k + 1) for k, r in enumerate(live[: share * len(live) // 100])]


def test_states_of_a_run():
    rng = random.Random(2)
    for _ in range(50):
        a, b = bytes(rng.randrange(256) for _ in range(rng.randrange(40))), bytes(rng.randrange(256) for _ in range(rng.randrange(1, 700)))
        got = resampling.states_after(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]), np.array([zlib.crc32(b)], np.uint32))
        assert got[0] == zlib.crc32(a + b)
    assert resampling.read_words(pa.array(["Ab", None, "c", ""])).distinct == [b"ab", b"c"]


def slow_lines(rows):
    """Rows of doc_id and text, by the rule."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    name = lambda i, t: (i is not None, i or 0, 0 if i is not None else t)
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add((i, None if i is not None else t))
    out = []
    for i, t in rows:
        lines, left = (t or "").split("\n"), []
        for line in lines:
            docs = held.get(key(line), ())
            ids = [d[0] for d in docs if d[0] is not None]
            if len(docs) < 3 or (ids and i == max(ids)):
                left.append(line)
            elif not ids:
                return None  # among rows without id the hash decides
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    pool = [f"  The Line number {k} is long enough " for k in range(12)] + ["short", "", " \t", "É" * 20, "é" * 19 + "É", "İstanbul " * 3, "x" * 19, "the line NUMBER 3 is long enough\r"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n".join(pool * 400)), (5, pool[0]), (5, pool[0]), (6, pool[1] + "\n" + pool[1])]
    rows += [(None, pool[k] + "\nrow without an id, and long") for k in range(2)]
    docs = spark.createDataFrame([(i, t, "clash", "x") for i, t in rows], "doc_id long, text string, n_lines string, __gone string").drop("__gone").withColumn("pos", F.lit("own"))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "pos", "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in out.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str) == slow_lines(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_of_rows_without_id(spark):
    rows = [(None, f"a line that all of them hold\n{k}") for k in range(5)] * 2
    out = [r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(out) == 10 and sum("\n" in t for t in out) == 2


def test_runs_do_not_depend_on_batches(spark):
    rng = random.Random(8)
    rows = [(i, f"common line of number {rng.randrange(40)}\nline of {i} alone, no other") for i in range(150)]
    keys = line_dedup.line_keys(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    results = []
    for n in (1, 2, 3, 7):
        runs = line_dedup.LineRuns(spark)
        for k in range(n):
            runs.add(keys.filter(F.pmod("doc_id", F.lit(n)) == k))
        levels = [level for level, _ in runs.levels]
        assert levels == [p for p in range(3, -1, -1) if n >> p & 1]  # the binary digits of the number of batches
        results.append(sorted(map(tuple, runs.crowded().collect())))
        runs.erase()
    assert results[0] and all(r == results[0] for r in results)
    keys.unpersist()


def test_runs_are_not_shuffled(spark):
    keys = line_dedup.line_keys(spark.createDataFrame([(1, "a line that is long enough")], "doc_id long, text string"))
    runs = line_dedup.LineRuns(spark)
    runs.add(keys)
    a = spark.table(runs.levels[0][1])
    own = line_dedup.counted(keys).join(a.select(*line_dedup.HASH, F.lit(True).alias("known")).hint("merge"), line_dedup.HASH, "left")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # of the batch's own keys alone
    runs.erase()


def test_line_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({queries.ORACLE['op12_line_dedup']}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in queries.op12_line_dedup(spark, DATA).orderBy("doc_id").collect()] == want and any(r[2] for r in want)


SPACE = " \t\n\x0b\x0c\r"


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def slow_best(rows, faults):
    """Dijkstra over (rows read, initials written) with (cost, audit) as key; the grammar by its pattern."""
    import heapq

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, lines = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, "\n".join(lines)
        state = (at, initials[-1:], len(initials) > 1)
        if state in done or not re.fullmatch("(s?(ua)*u?)?", initials):
            continue
        done.add(state)
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", at, initials + name[0], (*lines, name + ":")))
        if at < len(rows):
            (_, role, text), fault = rows[at], faults[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, initials, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initials + role[0], (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, initials + name[0], (*lines, f"{name}:{text}")))


def slow_repair(rows):
    left, out = slow_damage(rows), []
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in left if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, turns = faults_of(own), {r[0] for r in own} - {None}
        cost, audit, text = slow_best(own, faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rng, n, longest):
    texts = ["Yes.", "No!", "And then?", "cut off", "  ", "", None, "Tail. \n", "é.", "B\x0b"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("assistant" if turn % 2 else "user")
            role = rng.choice(["system", None, "", "tool", "umpire"]) if rng.random() < 0.15 else role
            text = rng.choice(texts) if rng.random() < 0.5 else f"Text {conv} {turn}."
            rows.append((conv, None if rng.random() < 0.05 else turn + (rng.random() < 0.1), role, text))
    return rows


@pytest.mark.parametrize("block", [2, 128])
def test_repair_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rng = random.Random(block)
    rows = conversations(rng, 120, 14)
    rows += [(None, t, r, x) for _, t, r, x in rows[:30]] + [(999, None, None, None)] * 3 + [(1000, 4, "user", "One."), (1000, 4, "user", "One.")]
    dropped = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows.append((dropped, 1, "user", "Gone."))
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    damaged = conversation_repair.damaged(table)
    got = conversation_repair.repair(damaged).select(*conversation_repair.RESULT)
    want = slow_repair(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    lines = {}
    for r in conversation_repair.repair(damaged, "rows").orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(lines.get(w[0], [])).encode()).hexdigest() == w[8] for w in want)
    assert conversation_repair.repair(conversation_repair.damaged(table.limit(0))).count() == 0


def test_repair_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_conversation_repair(spark, DATA).collect()), key=str) == slow_repair(rows)


def test_blocks_join_to_the_same_path():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice("sua x") if rng.random() < 0.5 else "ua"[k % 2], rng.choice([0, 0, 0, 1, 2, 3])) for k in range(rng.randrange(12))]
        whole = conversation_repair.best_audit([{0: conversation_repair.composed(rows, 0)}])
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        cost, path = conversation_repair.best_audit([{s: conversation_repair.composed(p, s) for s in conversation_repair.GRAMMAR} for p in parts])
        assert cost == whole[0] and "".join(x for _, x in path) == whole[1][0][1]

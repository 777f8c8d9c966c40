"""Mixing, sharding, rules and archives on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, mixing, quality_rules, sharding, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\x0b\x0c\r\n", "a", "é#ñ |x| <b>", "a\nb\na\n\n \na", "w " * 500, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", " x y ​"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) + "\n" * rng.randrange(3) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    out = {r["doc_id"]: r for r in quality_rules.base_statistics(docs).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeats = base(t)
        assert tuple(out[i][c] for c in quality_rules.STATS) == (n, chars, symbols, lines, repeats), repr(t)
        assert out[i]["base_failed"] == (n < 20 or 100 * repeats > 30 * n)


def test_outliers(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(25, 400))), "en", "a" if i % 3 else None) for i in range(240)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(100)), "en", "a") for i in range(12)]
    rows += [(2000, None, None, None), (2001, rows[0][1], "xx", "yy"), (2001, rows[0][1], "xx", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = quality_rules.quality_rules(docs).collect()
    assert len(out) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert all(kept[i] for i in range(240)) and not any(kept[1000 + i] for i in range(12)) and not kept[2000] and kept[2001]
    assert {"text", "lang", "source", "distance2"} <= set(out[0].asDict())
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def slow_mcd(y, starts, half):
    """Least-determinant mean and covariance over concentration steps from given halves of the rows."""
    best = None
    for rows in starts:
        for _ in range(60):
            mean, cov = y[rows].mean(axis=0), np.cov(y[rows].T, bias=True)
            gap = y - mean
            rows = np.argsort((gap @ np.linalg.inv(cov) * gap).sum(axis=1))[:half]
        det = np.linalg.slogdet(np.cov(y[rows].T, bias=True))[1]
        if best is None or det < best[0]:
            best = (det, y[rows].mean(axis=0))
    return best


def test_estimate_is_a_least_determinant(spark, monkeypatch):
    """A quarter of outliers in one direction: the estimate is that of the clean rows, as plain numpy finds it."""
    monkeypatch.setattr(quality_rules, "FLOORS", (1e-3,) * 4)
    rng = np.random.default_rng(4)
    clean = rng.normal(0, 300, (300, 4)) @ rng.normal(0, 1, (4, 4))
    y = np.rint(np.concatenate([clean, rng.normal(9000, 600, (100, 4))])).astype(int)
    rows = spark.createDataFrame([("g", i, *map(int, r)) for i, r in enumerate(y)], "g string, __id long, __y0 long, __y1 long, __y2 long, __y3 long")
    out = quality_rules.least_determinant(rows, ["g"]).collect()
    assert len(out) == 1
    half = (400 + 4 + 2) // 2
    _, mean = slow_mcd(y, [rng.choice(400, 8, replace=False) for _ in range(60)], half)
    got = np.array([out[0][f"__m{i}"] for i in range(4)])
    assert np.abs(got - mean).max() < 0.2 * clean.std() and np.abs(got).max() < 400
    starts = quality_rules.elemental_starts(rows, ["g"]).collect()
    assert sorted(r["__start"] for r in starts) == [1, 2, 3] and all(r["__det"] is not None for r in starts)


def test_starts_are_of_distinct_vectors(spark):
    """Copies of one vector are no start; a group with fewer than five vectors has none of these starts."""
    rng = np.random.default_rng(6)
    rows = [("g", 0, 5, 5, 5, 5)] * 3000 + [("g", 0, *map(int, rng.integers(0, 900, 4))) for _ in range(30)] + [("h", 0, k, k, k, k) for k in (1, 2, 3)] * 50
    table = spark.createDataFrame(rows, "g string, __id long, __y0 long, __y1 long, __y2 long, __y3 long")
    starts = quality_rules.elemental_starts(table, ["g"]).collect()
    assert {(r["g"], r["__start"]) for r in starts} == {("g", 1), ("g", 2), ("g", 3)}
    assert len(quality_rules.least_determinant(table, ["g"]).collect()) == 2


def test_inverse_equals_numpy(spark):
    rng = np.random.default_rng(1)
    y = np.rint(rng.normal(0, 300, (200, 4)) @ rng.normal(0, 1, (4, 4))).astype(int)
    rows = spark.createDataFrame([("g", *map(int, r)) for r in y], "g string, __y0 long, __y1 long, __y2 long, __y3 long")
    sums = {"__n": F.count(F.lit(1))} | {f"__s{i}": F.sum(f"__y{i}") for i in range(4)} | {f"__q{i}{j}": F.sum(F.col(f"__y{i}") * F.col(f"__y{j}")) for i in range(4) for j in range(i + 1)}
    out = quality_rules.inverted(rows.groupBy("g").agg(*[v.alias(k) for k, v in sums.items()]), ["g"]).first()
    cov = quality_rules.consistency() * np.cov(y.T, bias=True) + np.diag([(f * quality_rules.SCALE) ** 2 for f in quality_rules.FLOORS])
    want = np.linalg.inv(cov)
    for i in range(4):
        for j in range(i + 1):
            assert out[f"__v{i}{j}"] == pytest.approx(want[i, j], rel=1e-6)


def test_many_groups_are_salted(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("b", 4)], "k string, v long")
    groups = spark.createDataFrame([(None, 10), ("a", 20)], "k string, g long")
    out = {(r["k"], r["v"]): r["g"] for r in common.join_group_values(rows, groups, ["k"], F.col("v")).collect()}
    assert out == {(None, 1): 10, ("a", 2): 20, ("a", 3): 20, ("b", 4): None}


def waterfill(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, goal = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit > 2 * sizes[s]}
        if not full:
            return goal | {s: weight[s] * unit for s in open_}
        for s in full:
            goal[s] = 2 * sizes[s]
            left -= goal[s]
        open_ -= full
    return goal


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(0, 90), rng.choice(["b", "a", "a", "a", "ä", None])) for i in range(900)]
    rows += [(5000, None, "a"), (5001, "", "empty"), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    goal = waterfill(sizes)
    taken = {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 180 for s in goal)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0
    nameless = docs.withColumn("doc_id", F.when(F.col("doc_id") > 50, F.col("doc_id"))).unionByName(docs.filter("doc_id < 40")).unionByName(docs.filter("doc_id < 40"))
    for table in (docs, nameless, docs.limit(0)):
        copies, rows = mixing.mixed_documents(table), mixing.mix(table).collect()
        count = lambda rows: sorted(Counter((r["source"], len((r["text"] or "").split())) for r in rows).items(), key=str)
        want = Counter()
        for r in rows:
            want[r["source"], r["size"]] += r["copies"]
        assert copies.columns == docs.columns and count(copies.collect()) == sorted((+want).items(), key=str)


def test_mix_equals_one_queue(spark):
    """Finish times and the cut against one sorted list of all copies."""
    rng = random.Random(11)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "a", "b", None])) for i in range(500)] + [(900, "w " * 50, "c")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    copies = []
    for source in {r["source"] for r in out}:
        queue = sorted((r for r in out if r["source"] == source and r["size"]), key=lambda r: r["first_finish"])
        done = 0
        for r in queue:
            done += r["size"]
            assert r["first_finish"] == pytest.approx(done / r["target"]) and r["second_finish"] == pytest.approx((r["source_size"] + done) / r["target"])
            copies += [(r["first_finish"], r["size"], r["copies"] >= 1), (r["second_finish"], r["size"], r["copies"] == 2)]
    copies.sort()
    kept = [c[2] for c in copies]
    n, budget = sum(kept), int(1.5 * sum(r["size"] for r in out))
    assert kept == [True] * n + [False] * (len(kept) - n)
    assert sum(c[1] for c in copies[:n]) <= budget < sum(c[1] for c in copies[: n + 1])


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(sharding.permuted(np.arange(n), n).tolist()) == list(range(n))
    assert sharding.permuted(np.arange(50), 1000).tolist() == sharding.permuted(np.arange(1000), 1000)[:50].tolist()


def test_shards(spark):
    import zlib

    rows = [(i, f"text é {i % 40}", 1) for i in range(333)] + [(None, None, 2), (None, "", 2), (3, "text é 3", 1), (3, "text é 3", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = sharding.shard_documents(docs).collect()
    counts = {}
    for r in out:
        counts.setdefault(r["shard"], []).append(r["slot"])
        text = (f"text é {r['doc_id'] % 40}" if r["doc_id"] is not None else "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "rows" and r["grown_shard"] is None
    assert len(counts) == 16 and all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert sorted(map(str, out)) == sorted(map(str, sharding.shard_documents(docs.repartition(9)).collect()))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_archive(spark, tmp_path):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "http://a/3", big), (1, "http://a/1\r\nX: y", big), (2, None, None), (4, "http://a/4", "tiny"), (5, "http://a/5", "tiny"), (6, "u", ""), (None, "n", big), (1, "http://a/1\r\nX: y", big), (7, "é", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    archive = warc.write_archive(pages, str(tmp_path / "a"))
    assert archive.payloads(spark).count() == 4
    out = warc.read_archive(spark, archive).collect()
    got = sorted(((r["page_id"] or 0), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out)
    assert got == sorted([(3, 207, "revisit", 1), (1, 207, "response", None), (1, 207, "response", None), (2, 0, "response", None), (4, 4, "response", None), (5, 4, "response", None), (6, 0, "response", None), (0, 207, "response", None), (7, 240, "response", None)], key=lambda r: r[:3])
    for r in out:
        html = {p: h for p, _, h in rows}[r["page_id"]] or ""
        assert r["url"] == {p: u for p, u, _ in rows}[r["page_id"]]
        assert r["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()
    for r in warc.reconstruct(spark, archive).collect():
        head, rest = bytes(r["record"]).split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        assert rest == block + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        http, body = block.split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 OK") and (body == bytes(r["payload"])) == (fields["WARC-Type"] == "response" or not r["payload"])
        assert "sha256:" + hashlib.sha256(bytes(r["payload"])).hexdigest() == fields["WARC-Payload-Digest"]
    none = warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, none).count() == 0


def test_damaged_payload(spark, tmp_path):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "a" * 150)], "page_id long, url string, html string"), str(tmp_path / "a"))
    for name, table in (("payloads", archive.payloads(spark)), ("records", archive.records(spark))):
        table.withColumn("payload_digest", F.lit("0" * 64)).write.parquet(str(tmp_path / "b" / name))
    with pytest.raises(Exception, match="damaged"):
        warc.reconstruct(spark, warc.Archive(str(tmp_path / "b"))).collect()

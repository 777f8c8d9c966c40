"""SimHash groups against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash


def slow_print(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def roots(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(set(prints))
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                parent[find(b)] = find(a)
    return {p: find(p) for p in prints}


def test_fingerprints():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        text = " ".join(rng.choice(["The", "Äpfel", "dog", "RUNS"]) for _ in range(n))
        assert simhash.fingerprint(text) == slow_print(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_pivots_never_discard_a_link(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63, 300)
    near = [int(b) ^ (1 << 5) ^ (1 << 40) for b in base[:100]]
    nodes = spark.createDataFrame([(int(x),) for x in {*map(int, base), *near}], "fp long")
    got = {tuple(sorted(r)) for r in simhash.links(nodes).collect()}
    assert got >= {tuple(sorted((int(b), n))) for b, n in zip(base[:100], near)}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in got)


def test_groups_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in prints[:10]:  # chains and a crowded ball
        x = p
        for _ in range(6):
            x ^= 1 << rng.randrange(64)
            prints.append(x)
    prints += [prints[0] ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(i)]
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    monkeypatch.setattr(simhash, "MOST", 4)  # most keys go the way of hubs
    rows = [(i, p) for i, p in enumerate(prints)] + [(i + 1000, p) for i, p in enumerate(prints[:20])]
    out = {r["doc_id"]: r["component_id"] for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    root = roots([p for _, p in rows])
    least = {}
    for i, p in rows:
        least[root[p]] = min(i, least.get(root[p], i))
    assert out == {i: least[root[p]] for i, p in rows}


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b c d", "y"), (3, None, "x"), (4, " ", "x"), (None, "a b c d", "x"), (2, "a b c d", "y"), (7, "q r s t u v", None)], "doc_id long, text string, fp string")
    out = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.simhash_groups(docs.select("doc_id", "text")).collect())
    assert out == [(0, 1), (1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (7, 7)]
    kept = simhash.near_dedup(docs).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [1, 3, 7] and kept[0].asDict().keys() == {"doc_id", "text", "fp"}
    # different texts of one id, and of none, are different documents; a null id stays if no other row has its text
    more = [(1, "quite another text", "x"), (None, "one of its own", "x"), (None, "and a second one", "x"), (None, "one of its own", "x")]
    kept = simhash.near_dedup(docs.union(spark.createDataFrame(more, docs.schema))).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in kept) == [(0, "and a"), (0, "one o"), (1, "a b c"), (1, "quite"), (3, ""), (7, "q r s")]
    assert simhash.near_dedup(docs.limit(0)).count() == 0
    clashing = docs.selectExpr("doc_id", "text", "fp", "1 as h", "2 as words", "3 as root", "4 as n", "5 as keys")
    assert simhash.near_dedup(clashing).columns == clashing.columns and simhash.near_dedup(clashing).count() == 3
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [4, 64])
def test_wide_fingerprints_find_near_copies(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(200)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    jaccards = []
    for i, w in enumerate(base[:30]):  # two changed words: similarity of five-word shingles over 0.8
        copy = list(w)
        for at in rng.sample(range(200), 2):
            copy[at] = word()
        rows.append((100 + i, " ".join(copy)))
        a, b = ({tuple(x[k : k + 5]) for k in range(196)} for x in (w, copy))
        jaccards.append(len(a & b) / len(a | b))
    rows += [(1000 + k, " ".join([*base[35][:-1], word()])) for k in range(60)]  # a crowd
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(jaccards) >= 0.8 and set(range(40)) <= kept and len(kept - set(range(40))) <= 2


def jaccard(a, b):
    a, b = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_only_similar_texts_are_linked(spark):
    """Similarities from 0.5 to 0.95 by changed words, and a repeated passage in texts that have little else in common."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(120):
        base = [word() for _ in range(200)]
        copy = list(base)
        for k in range(1 + i % 12):
            copy[5 + 15 * k] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    passage = [word() for _ in range(40)] * 8
    rows += [(1000 + k, " ".join([*passage, *[word() for _ in range(60)]])) for k in range(2)]
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    wanted = {i for i in texts if i % 2 == 0 or jaccard(texts[i - 1], texts[i]) < 0.8}
    assert kept == wanted and 20 < len(texts) - len(wanted) < 100


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """Copies of a text with edits of their own, so that many are similar to few others, against all pairs."""
    monkeypatch.setattr(simhash, "MOST", 4)
    monkeypatch.setattr(simhash, "LEADERS", 2)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for family in range(3):
        line = [[word() for _ in range(150)]]
        for _ in range(39):
            copy = list(rng.choice(line))
            for at in rng.sample(range(150), rng.randrange(1, 6)):
                copy[at] = word()
            line.append(copy)
        rows += [" ".join(w) for w in line]
    rng.shuffle(rows)
    edges = [(a, b) for b in range(len(rows)) for a in range(b) if jaccard(rows[a], rows[b]) >= 0.8]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.near_dedup(docs).collect()}
    assert kept == {i for i in range(len(rows)) if find(i) == i}


def test_members_of_a_fingerprint_group_have_links_of_their_own(spark, monkeypatch):
    """One fingerprint for two texts: only the second is similar to the third."""
    monkeypatch.setattr(simhash, "fingerprint_of", lambda words, *_: {b"same": 1, b"third": -2}.get(words[0], 0xF0F0F0))
    words = [f"w{i}" for i in range(200)]
    rows = [(1, "same a b c d e f g h"), (2, " ".join(["same", *words])), (3, " ".join(["third", *words])), (4, "z y x w v u t")]
    wide = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in wide.collect()) == [1, 4]

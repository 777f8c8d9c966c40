"""SimHash near-duplicates by pivot distance tables.

Fingerprints are computed once a document and made distinct, so exact copies are one node.  A table
holds each fingerprint's Hamming distances to PIVOTS fixed reference fingerprints.  By the triangle
inequality two fingerprints within the radius differ by at most the radius in every coordinate:
pairs are discarded by their largest coordinate difference and the survivors verified on the bits.

Pairs come from an equi-join, never from all pairs: with 64 bits in BANDS parts, fingerprints
within the radius agree in at least BANDS - RADIUS parts, and each choice of that many parts is a
key.  A key with more than MOST fingerprints isn't paired at all: its fingerprints go the exact way
of hubs, where each names the 65 words within one bit of it, and all that name the same word are
within two bits of each other and are linked to the least of them; that is linear in the group.

Groups are connected components by alternating large-star and small-star steps.

Defined cases: a null or blank text has fingerprint 0; a text of fewer than SHINGLE words has one
shingle; component_id is the smallest id of the component (null only if it has no other); rows with
a null id belong to their text's component; repeated rows are copies; an empty table gives an empty
table; further columns are ignored, or kept by near_dedup.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, erase, written

SHINGLE, SEED = 3, 42
BITS, RADIUS = 64, 2
PIVOTS = 16
BANDS = 5
MOST = 64


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set in over half of the XXH64 values of the shingles; as a signed long."""
    return fingerprint_of((text or "").encode("utf-8").lower().split(), shingle, seed)


def fingerprint_of(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    if not words:
        return 0
    if len(words) <= shingle:
        return _signed(xxhash.xxh64_intdigest(b" ".join(words), seed))
    digest = xxhash.xxh64_digest
    joined = b"".join([digest(b" ".join(s), seed) for s in zip(*[words[i:] for i in range(shingle)])])
    return _signed(int.from_bytes(majority(np.frombuffer(joined, np.uint8).reshape(-1, 8)), "big"))


def majority(hashes: np.ndarray) -> bytes:
    """Of rows of bytes: the bits set in over half of the rows."""
    counts = np.zeros(8 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[i : i + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, fp long")


def pivots() -> list[int]:
    """Fixed reference fingerprints: XXH64 of their numbers."""
    return [_signed(xxhash.xxh64_intdigest(str(i).encode(), SEED)) for i in range(PIVOTS)]


def pivot_table(nodes: DataFrame) -> DataFrame:
    """fp with its distances to the pivots, one byte each, in longs d0, d1 ..."""
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long") for p in pivots()]
    packed = []
    for k in range(0, PIVOTS, 8):
        long = F.lit(0).cast("long")
        for i, d in enumerate(distance[k : k + 8]):
            long = long.bitwiseOR(F.shiftleft(d, 8 * i))
        packed.append(long.alias(f"d{k // 8}"))
    return nodes.select("fp", *packed)


def within_pivots(radius: int) -> Column:
    """No coordinate of a and b differs by more than the radius."""
    ok = F.lit(True)
    for k in range(PIVOTS):
        one, other = (F.shiftright(F.col(f"{side}.d{k // 8}"), 8 * (k % 8)).bitwiseAND(F.lit(255)) for side in "ab")
        ok = ok & (F.abs(one - other) <= radius)
    return ok


def band_keys() -> Column:
    """For each choice of BANDS - RADIUS parts: its number and the fingerprint's bits there."""
    edges = [BITS * i // BANDS for i in range(BANDS + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    keys = []
    for k, chosen in enumerate(combinations(range(BANDS), BANDS - RADIUS)):
        mask = _signed(sum(masks[i] for i in chosen))
        keys.append(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")))
    return F.array(*keys)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Linked fingerprints a < b of distinct fp in nodes; hub links stand for all pairs around a hub."""
    table = pivot_table(nodes)
    keyed = table.select("fp", *[c for c in table.columns if c != "fp"], F.inline(band_keys()))
    sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least")).filter("n > 1")
    shared = written(keyed.join(cut(sizes), ["k", "v"]), "bands")
    a, b = shared.filter(F.col("n") <= MOST).alias("a"), shared.filter(F.col("n") <= MOST).alias("b")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.fp") < F.col("b.fp")) & within_pivots(radius))
    near = pairs.filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    crowded = shared.filter(F.col("n") > MOST).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    named = crowded.select("fp", F.explode(flips).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("word"))
    hubs = named.withColumn("least", F.min("fp").over(Window.partitionBy("word"))).filter("least < fp")
    return near.union(hubs.select(F.col("least").alias("a"), F.col("fp").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's least node) for every node of the edges a < b.

    A hub's neighbours are split by adaptive joins only; each half turn is one job over narrow edges.
    """
    edges, last = cut(edges), None
    while True:
        for large in (True, False):
            # large star: all neighbours; small star: from the greater node to the lesser ones
            both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
            if large:
                both = both.union(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            joined = both.join(least, "u")
            moved = joined.filter(F.col("v") > F.col("u")) if large else joined.filter(F.col("v") != F.col("m"))
            stars = moved.select(F.col("m").alias("a"), F.col("v").alias("b"))
            if not large:
                stars = stars.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
            edges = cut(stars.filter(F.col("a") < F.col("b")).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())


def groups(prints: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of stored fingerprints."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    found = components(links(nodes))
    linked = found.join(nodes, found["node"] == nodes["fp"]).select("fp", "root", "least")
    ids = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    of_linked = linked.join(ids, "root").select("fp", "component_id")
    alone = nodes.filter("n > 1").join(of_linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    named = cut(of_linked.union(alone))
    joined = prints.join(named, "fp", "left")
    return joined.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def simhash_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp, component_id."""
    return groups(written(fingerprints(docs, text), "fingerprints"))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


WIDE, WIDE_SHINGLE = 256, 5
#: Least Jaccard similarity of linked texts, as a fraction.
SIMILAR = (4, 5)
#: Bits in which candidates may differ.  Texts of similarity 0.8 differ in 39 (deviation 6) of WIDE; with under FEW
#: shingles a majority is too often a tie to tell, and the bits are not asked.
APART, FEW = 64, 32
#: Keys of a text, each of so many least shingles: two texts of Jaccard similarity 0.8 share one with probability 0.998.
KEYS, KEY_SHINGLES = 12, 4
#: Leaders of a crowded key; of those that a text may be similar to, so many nearest are tested; parts of the exact rest.
LEADERS, NEAREST, SPREAD = 32, 2, 4
_ODD = np.random.default_rng(64).integers(0, 1 << 63, 64 + KEYS * KEY_SHINGLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def stirred(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers after which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The distinct five-word shingles (fewer words: the whole sequence) as sorted 64-bit hashes, made of
    the XXH3 values of their words."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(w) for w in words], np.uint64)
    n = max(1, len(words) - WIDE_SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(WIDE_SHINGLE, len(words))):
        total += stirred(hashes[k : k + n]) * _ODD[k]
    return np.unique(stirred(total))


def wide_bits(shingles: np.ndarray) -> bytes:
    """Of WIDE bits those set in over half of the shingles."""
    counts = np.zeros(WIDE, np.int64)
    for i in range(0, len(shingles), 65_536):
        some = shingles[i : i + 65_536]
        rows = np.stack([stirred(some ^ _ODD[8 + k]) for k in range(WIDE // 64)], axis=1)
        counts += np.unpackbits(rows.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(shingles)).tobytes()


def least_keys(shingles: np.ndarray) -> np.ndarray:
    """KEYS longs: each folds the least values of KEY_SHINGLES orders of the shingles, and its own number."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    odd = _ODD[64:]
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 16_384):
        least = np.minimum(least, (shingles[i : i + 16_384, None] * odd).min(axis=0))
    rows = least.reshape(KEYS, KEY_SHINGLES)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64).view(np.int64)


LONGS = [f"w{k}" for k in range(WIDE // 64)]


def wide_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Of every row: doc_id, h (hash of the exact text), words (hash of its words in order), fp, the wide
    fingerprint as longs w0 .. w3, n (distinct shingles) and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                prints, wide, sizes, keys, names = [], [], [], [], []
                for t in part.column(2):
                    words = (t.as_py() or "").encode("utf-8").lower().split()
                    shingles = shingle_set(words)
                    prints.append(fingerprint_of(words))
                    wide.append(wide_bits(shingles))
                    sizes.append(len(shingles))
                    keys.append(least_keys(shingles))
                    names.append(xxhash.xxh3_128_digest(b" ".join(words)))
                longs = np.frombuffer(b"".join(wide), ">i8").reshape(-1, WIDE // 64).astype(np.int64)
                made = [pa.array(names, pa.binary()), pa.array(prints, pa.int64()), *[pa.array(longs[:, k]) for k in range(WIDE // 64)], pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["doc_id", "h", "words", "fp", *LONGS, "n", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{w} long" for w in LONGS)
    given = docs.select("doc_id", row_hash(text).alias("h"), text)
    return given.mapInArrow(run, f"doc_id {kind}, h long, words binary, fp long, {longs}, n long, keys array<long>")


def shingle_sets(docs: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """words and shingles of the texts (doc_id, h, words), stored.  Shingles are the upper 32 bits of their
    hashes: two texts of n shingles take some n * n / 2^32 different ones for equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = [np.unique((shingle_set((t.as_py() or "").encode("utf-8").lower().split()) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["words", "shingles"])

    wanted = texts.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "words")
    given = docs.select("doc_id", row_hash(text).alias("h"), F.col(text).alias("text"))
    joined = given.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")))
    return written(joined.select("words", "text").mapInArrow(run, "words binary, shingles array<int>"), "shingles")


def row_hash(text: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def apart(x, y) -> Column:
    return sum((F.bit_count(x(w).bitwiseXOR(y(w))) for w in LONGS), F.lit(0))


def candidates(x, y) -> Column:
    """May the texts be similar?  x and y give columns by name; sizes alone bound the similarity."""
    least, most = F.least(x("n"), y("n")), F.greatest(x("n"), y("n"))
    return (least * SIMILAR[1] >= most * SIMILAR[0]) & ((least < FEW) | (apart(x, y) <= APART))


def alike(one: Column, other: Column) -> Column:
    """Have two sets of shingles a Jaccard similarity of SIMILAR or more?"""
    both = F.size(F.array_intersect(one, other))
    return both * SIMILAR[1] >= (F.size(one) + F.size(other) - both) * SIMILAR[0]


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs a < b: those whose sets of shingles have a Jaccard similarity of SIMILAR or more."""
    joined = pairs.distinct()
    for side in "ab":
        joined = joined.join(sets.select(F.col("words").alias(side), F.col("shingles").alias(f"s{side}")).hint("merge"), side)
    return written(joined.filter(alike(F.col("sa"), F.col("sb"))).select("a", "b").distinct(), "links")


WIDE_ROW = ["words", "n", *LONGS]


def ordered_pair(x: Column, y: Column) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def led_pairs(large: DataFrame) -> DataFrame:
    """Pairs of the texts of crowded keys with the nearest of up to LEADERS texts of the key.  Leaders are
    the texts with most company over all their keys: that all copies come from keeps the most keys."""
    company = large.groupBy("words").agg(F.sum("many").alias("company"))
    ranked = large.join(company.hint("merge"), "words")
    first = F.max_by(F.struct(*WIDE_ROW), F.struct("company", "words"))
    slots = ranked.groupBy("key", F.pmod(F.xxhash64("words"), F.lit(LEADERS)).alias("slot")).agg(first.alias("leader"))
    heads = cut(slots.groupBy("key").agg(F.collect_list("leader").alias("leaders")))
    met = F.filter("leaders", lambda x: (x["words"] != F.col("words")) & candidates(lambda c: x[c], F.col))
    near = F.slice(F.sort_array(F.transform(met, lambda x: F.struct(apart(lambda c: x[c], F.col).alias("bits"), x["words"].alias("words")))), 1, NEAREST)
    ends = large.join(heads.hint("merge"), "key").select(F.col("words").alias("one"), F.explode(F.transform(near, lambda x: x["words"])).alias("other"))
    return ends.select(*ordered_pair(F.col("one"), F.col("other")))


def rest_links(large: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside crowded keys whose texts the links leave in several components.

    Once the texts of a key are one component, no further pair of it can change a group.  Every text
    outside the key's most frequent component is compared with all texts of other components, in blocks
    of SPREAD parts, so each pair of a key is compared or in one component.  The shingles are compared
    in the join itself, which makes no row of a pair that isn't similar.
    """
    roots = components(links).select(F.col("node").alias("words"), "root")
    rooted = written(large.join(roots.hint("merge"), "words", "left").withColumn("root", F.coalesce("root", "words")), "rooted")
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    tally = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("c", "root")).alias("main"))
    several = written(rooted.join(cut(tally.filter("roots > 1").select("key", "main")).hint("merge"), "key"), "several")
    held = several.select("key", "root", "main", *WIDE_ROW).join(sets.hint("merge"), "words")
    a = held.filter("root != main").withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(SPREAD))).alias("a")
    b = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).alias("b")
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.words") < F.col("b.words"))
    near = candidates(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")) & alike(F.col("a.shingles"), F.col("b.shingles"))
    pairs = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.root") != F.col("b.root")) & once & near)
    found = cut(pairs.select(*ordered_pair(F.col("a.words"), F.col("b.words"))).distinct())
    erase(rooted, several)
    return found


def similar(texts: DataFrame, known: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Links a < b of words that put texts whose five-word shingles have a Jaccard similarity of SIMILAR or
    more, and the ends of known links, into one component.

    Texts that share a key meet; what their sizes and wide fingerprints leave is tested on the shingles.
    Keys of up to MOST texts are compared pair by pair; in larger ones texts first meet leaders, and what
    that leaves apart is compared in blocks.
    """
    keyed = texts.select(*WIDE_ROW, F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    shared = written(keyed.join(cut(sizes).hint("merge"), "key"), "shared")
    small, large = shared.filter(F.col("many") <= MOST), shared.filter(F.col("many") > MOST)
    a, b = small.alias("a"), small.alias("b")
    near = candidates(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.words") < F.col("b.words")) & near)
    pairs = cut(pairs.select(F.col("a.words").alias("a"), F.col("b.words").alias("b")).union(led_pairs(large)).distinct())
    ends = pairs.select(F.col("a").alias("words")).union(pairs.select("b")).union(large.select("words")).distinct()
    sets = shingle_sets(docs, texts.select("doc_id", "h", "words").join(ends.hint("merge"), "words", "left_semi"), text)
    links = known.union(confirmed(pairs, sets))
    if not large.isEmpty():
        links = links.union(rest_links(large, links, sets))
    links = cut(links)
    erase(shared, sets)
    return links


def print_links(texts: DataFrame) -> DataFrame:
    """Links a < b of words whose 64-bit fingerprints are equal or within RADIUS bits."""
    named = cut(texts.groupBy("fp").agg(F.min("words").alias("least"), F.count(F.lit(1)).alias("many")))
    near = links(named.select("fp"))
    for side in "ab":
        near = near.join(named.select(F.col("fp").alias(side), F.col("least").alias(f"least_{side}")), side)
    equal = texts.select("fp", "words").join(named.filter("many > 1"), "fp").filter("words != least")
    return near.select(*ordered_pair(F.col("least_a"), F.col("least_b"))).union(equal.select("least", "words"))


def near_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one document of each group: that with the smallest id (null ids last), once if its rows
    repeat.  Rows of one id with different texts are different documents.

    Documents are of one group if their words are equal, their fingerprints link, or their distinct
    five-word shingles have a Jaccard similarity of SIMILAR or more; every distinct text takes that test.
    Texts of fewer words than a shingle are one shingle.
    """
    prints = written(wide_fingerprints(docs, text), "fingerprints")
    texts = written(prints.dropDuplicates(["words"]), "texts")
    roots = components(similar(texts, cut(print_links(texts)), docs, text))
    rows = prints.groupBy("doc_id", "h", "words").agg(F.count(F.lit(1)).alias("many"))
    grouped = written(rows.join(roots.withColumnsRenamed({"node": "words"}).hint("merge"), "words", "left").withColumn("root", F.coalesce("root", "words")), "groups")
    erase(prints, texts)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "words", "h")
    first = grouped.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("root", "first")
    dropped = grouped.join(first.hint("merge"), "root").filter(order != F.col("first")).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    # what is dropped grows with the corpus, so it is never broadcast, at no size
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (row_hash(text) == F.col("__h"))
    kept = docs.join(dropped.hint("merge"), same, "left_anti").select(*docs.columns)
    if grouped.filter("many > 1").isEmpty():
        return kept
    return kept.withColumn("__h", row_hash(text)).dropDuplicates(["doc_id", "__h"]).drop("__h")

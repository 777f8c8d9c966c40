"""Importance resampling towards a target distribution, by tries of words.

Features are the runs of one to three consecutive words; a feature's bucket is its CRC-32 modulo
BUCKETS.  Each task builds tries of the words it reads: a node of depth d is a run of d words and
holds its count and its CRC state, from which the state of a child follows without reading the run
again (a linear map of the parent's state by the child's length, and the child's own CRC).  Counts
go to bucket totals, which are merged over all tasks.  The totals of raw and target texts give each
bucket a gain; tries of a second pass carry on each node the gain of its whole path, so that a
document's weight is the sum over its words of the deepest node that can be reached from there.
Gumbel noise from the id is added and the highest scores are drawn.

A trie is flat: the nodes of a depth are sorted pairs (parent, word), found for all words at once.
A task holds one trie of at most PIECE words at a time; a long text is cut, and each cut sees the two
words after it.  Ranks come in two levels: bins of scores with about ROWS drawn rows (their bounds are
quantiles and only balance the work), then row numbers inside a bin.

Defined cases: a null or empty text has no feature and weight 0; a document without an id has the noise
of the string "42:" and comes after the others in ties; equal rows are interchangeable and each counts
as a document; an empty table gives an empty table, an empty target gives gains from counts of zero;
columns named like a result are replaced by it, others stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import written

BUCKETS = 10_000
DEPTH = 3
LEAST_WORDS = 20
SHARE = 5  # of 100 documents
SEED = 42
#: Words of one trie, and bytes of text that are cut into words at once.
PIECE = 1 << 18
BYTES = 2 << 20
#: Drawn rows of a bin of scores, and bins at most.
ROWS = 50_000
BINS = 4096
MADE = ["n_features", "weight", "score", "rank"]

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


@dataclass
class Words:
    """Words of some texts in order: the number of each, the text it is in, and the distinct words."""

    ids: np.ndarray
    text: np.ndarray
    distinct: list[bytes]
    per_text: np.ndarray


def read_words(texts: pa.Array) -> Words:
    """Lower-case A-Z and cut texts into words, on bytes: all bytes of a character beyond ASCII are of a word."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = FOLD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    inside = IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    begin = np.flatnonzero(first)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) - begin + 1)])
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inside])])
    coded = array.dictionary_encode()
    per_text = np.diff(np.searchsorted(begin, bounds))
    return Words(coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), per_text), coded.dictionary.to_pylist(), per_text)


@lru_cache(4096)
def shift_table(n: int) -> np.ndarray:
    """What n more bytes do to a CRC state, as tables of its four bytes: the part that is linear in the state."""
    zeros = bytes(n)
    none = zlib.crc32(zeros)
    table = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        byte, low = divmod(bit, 8)
        table[byte, 1 << low : 2 << low] = table[byte, : 1 << low] ^ np.uint32(zlib.crc32(zeros, 1 << bit) ^ none)
    return table


def states_after(states: np.ndarray, lengths: np.ndarray, own: np.ndarray) -> np.ndarray:
    """CRC states after further bytes, of which lengths and own CRCs are given."""
    kinds, at = np.unique(lengths, return_inverse=True)
    tables = np.stack([shift_table(int(n)) for n in kinds]) if len(kinds) else np.zeros((0, 4, 256), np.uint32)
    out = own.copy()
    for byte in range(4):
        out ^= tables[at, byte, (states >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


@dataclass
class Level:
    """The nodes of one depth: parent (a node of the depth above), count, CRC state; and for each word
    from which a run of this depth starts its place and node."""

    parent: np.ndarray
    count: np.ndarray
    state: np.ndarray
    start: np.ndarray
    node: np.ndarray


def trie(words: Words, lo: int, hi: int) -> list[Level]:
    """The trie of the runs that start at words lo to hi."""
    ids, text = words.ids[lo : hi + DEPTH - 1], words.text[lo : hi + DEPTH - 1]
    used, at = np.unique(ids, return_inverse=True)
    distinct = [words.distinct[i] for i in used]
    first = np.array([zlib.crc32(w) for w in distinct], np.uint32)
    further, lengths = np.array([zlib.crc32(b" " + w) for w in distinct], np.uint32), np.array([len(w) + 1 for w in distinct], np.int64)
    start = np.arange(hi - lo)
    levels = [Level(np.zeros(len(used), np.int64), np.bincount(at[: hi - lo], minlength=len(used)), first, start, at[: hi - lo])]
    for depth in range(1, DEPTH):
        above = levels[-1]
        goes_on = above.start + depth < len(ids)
        goes_on[goes_on] = text[above.start[goes_on] + depth] == text[above.start[goes_on]]
        start = above.start[goes_on]
        pairs, node, count = np.unique(above.node[goes_on] * max(1, len(used)) + at[start + depth], return_inverse=True, return_counts=True)
        parent, word = np.divmod(pairs, max(1, len(used)))
        levels.append(Level(parent, count, states_after(above.state[parent], lengths[word], further[word]), start, node))
    return levels


def buckets(level: Level) -> np.ndarray:
    return level.state.astype(np.int64) % BUCKETS


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words]]:
    """Rows of a batch with their words, as many as have BYTES of text (or one longer text)."""
    sizes = np.array([0 if n is None else n for n in pa.compute.binary_length(batch.column(column)).to_pylist()], np.int64)
    lo = 0
    while lo < len(sizes):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), BYTES, side="right")))
        yield lo, hi, read_words(batch.column(column).slice(lo, hi - lo))
        lo = hi


def spans(n: int) -> Iterator[tuple[int, int]]:
    return ((lo, min(lo + PIECE, n)) for lo in range(0, n, PIECE))


def bucket_totals(docs: DataFrame, text: str = "text") -> DataFrame:
    """bucket, total: features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, words in pieces(batch, 0):
                for lo, hi in spans(len(words.ids)):
                    for level in trie(words, lo, hi):
                        np.add.at(totals, buckets(level), level.count)
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(totals[held], pa.int64())], names=["bucket", "total"])

    return docs.select(text).mapInArrow(run, "bucket int, total long").groupBy("bucket").agg(F.sum("total").alias("total"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, as whole thousandths; an array of BUCKETS numbers."""
    both = bucket_totals(docs).withColumn("raw", F.lit(True)).unionByName(bucket_totals(target).withColumn("raw", F.lit(False)))
    have = np.zeros((2, BUCKETS))
    for r in both.collect():  # two rows a bucket at most
        have[int(r["raw"]), r["bucket"]] = r["total"]
    (t, s), (all_t, all_s) = have, have.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))).astype(np.int64)


def weights(words: Words, gain: np.ndarray) -> np.ndarray:
    """Sum of gains over the features of each text: each word's path, by the gain that its last node has from the root."""
    out = np.zeros(len(words.per_text), np.int64)
    for lo, hi in spans(len(words.ids)):
        path, reached = np.zeros(1, np.int64), np.zeros(hi - lo, np.int64)
        for level in trie(words, lo, hi):
            path = path[level.parent] + gain[buckets(level)]
            reached[level.start] = path[level.node]
        np.add.at(out, words.text[lo:hi], reached)
    return out


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_features and weight."""
    keep = [c for c in docs.columns if c not in (*MADE, "n_words") and (keep_text or c != text)]
    rows = docs.select(F.col(text).alias("__text"), *keep)
    made = ["n_words", "n_features", "weight"]
    schema = StructType([f for f in rows.schema if f.name != "__text"] + [StructField(c, LongType()) for c in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in pieces(batch, 0):
                n = words.per_text
                columns = [n, n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0), weights(words, gain)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[1:], *[pa.array(c, pa.int64()) for c in columns]], names=[*batch.schema.names[1:], *made])

    return rows.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths, from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, share: int) -> DataFrame:
    """scored (stored; n_words, score, doc_id and more) with rank, for the share of the documents with enough words."""
    live = F.col("n_words") >= LEAST_WORDS
    drawn = scored.filter(live).count() * share // 100
    if not drawn:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    n = min(BINS, 16 + drawn // ROWS)
    low = max(0.0, 1 - 1.05 * share / 100)  # the lowest bin takes what is below, and is only numbered if it must be
    bounds = scored.filter(live).agg(F.percentile_approx("score", [low + (1 - low) * i / n for i in range(n)], 20_000)).first()[0]
    edges = np.unique(np.array(bounds))

    @F.pandas_udf("int")
    def bin_of(score: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, score.to_numpy(), side="right"))

    binned = scored.withColumn("__bin", F.when(live, bin_of("score")).otherwise(F.lit(-1)))
    counts = dict(binned.filter("__bin >= 0").groupBy("__bin").count().collect())  # BINS + 1 rows at most
    above, offsets = 0, []
    for k in sorted(counts, reverse=True):
        if above < drawn:
            offsets.append((k, above))
        above += counts[k]
    known = scored.sparkSession.createDataFrame(offsets, "__bin int, __above long")
    inside = Window.partitionBy("__bin").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = binned.join(F.broadcast(known), "__bin").withColumn("rank", F.col("__above") + F.row_number().over(inside))
    rest = binned.filter(F.col("__bin") < offsets[-1][0]).withColumn("rank", F.lit(None).cast("long"))
    out = [*scored.columns, "rank"]
    return top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*out).unionByName(rest.select(*out))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, keep_text: bool = True) -> DataFrame:
    """docs with n_features, weight, score and rank: rows with a rank are drawn, in that order."""
    found = weighed(docs, gains(docs, target), keep_text=keep_text)
    scored = written(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    return ranked(scored, share).drop("n_words")

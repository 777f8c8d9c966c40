"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text gives one vector of statistics (letters, words, lines, repetition).  Trees are
grown on binned statistics of a bounded sample of labelled rows and flattened into arrays of
complete binary trees, which numpy walks for a batch of rows at once, one level at a time.

The sample is at most SAMPLE pairs of id and label, those with the least hash of the id; only their
vectors reach the driver.

Defined cases: null and empty texts have the vector of zeros and are scored as any other; without
labels of both kinds the score is the labelled share of 1 (0.5 without labels); repeated labels and
repeated rows of one id count once in the fit, an id with both labels once for each; rows are independent, so repeated rows, empty tables and further
columns need no rule (clashing columns are replaced).
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 64, 4, 60, 0.15, 1.0, 10
THRESHOLD = 0.3
STATISTICS = (
    "log_bytes log_words word_length word_length_sd longest_word lines words_a_line distinct_words upper digits spaces marks symbols stops "
    "exclamations other_ascii wide letters_entropy same_as_last distinct_pairs repeated_lines top_word short_words capital_words distinct_eights"
).split()
ROW = len(STATISTICS)
WINDOW_FACTORS = np.random.default_rng(8).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_classes() -> np.ndarray:
    """Class of each byte: upper, lower, digit, space, symbol, stop, exclamation, other ASCII, wide."""
    out = np.full(256, 7)
    for kind, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\v\f\r", "#*$%&|<>", ".,;:", "!?")):
        out[[ord(c) for c in chars]] = kind
    out[128:] = 8
    return out


CLASSES = np.eye(9)[byte_classes()]


def statistics(text: str | None) -> list[float]:
    text = text or ""
    if not text:
        return [0.0] * ROW
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    upper, lower, digit, space, symbol, stop, mark, other, wide = (counts @ CLASSES / len(data)).tolist()
    shares = counts[counts > 0] / len(data)
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not n:
        return [np.log1p(len(data)), *[0.0] * 7, upper, digit, space, mark + symbol + stop, symbol, stop, mark, other, wide, float(-(shares * np.log2(shares)).sum()), *[0.0] * 7]
    sizes = np.fromiter(map(len, words), np.int64, n)
    number: dict[str, int] = {}
    put = number.setdefault
    ids = np.array([put(w, len(number)) for w in words], np.uint64)
    kinds, top = len(number), int(np.bincount(ids.astype(np.int64)).max())
    same = int((ids[1:] == ids[:-1]).sum())
    pairs = len(np.unique(ids[:-1] << np.uint64(32) | ids[1:])) / max(1, n - 1)
    eights = 1.0
    if n >= 8:  # windows of eight words by a 64-bit hash of their numbers
        windows = np.zeros(n - 7, np.uint64)
        for k, odd in enumerate(WINDOW_FACTORS):
            windows += ids[k : n - 7 + k] * odd
        eights = len(np.unique(windows)) / (n - 7)
    return [
        np.log1p(len(data)), np.log1p(n), float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())), np.log1p(len(lines)), n / max(1, len(lines)), kinds / n,
        upper, digit, space, mark + symbol + stop, symbol, stop, mark, other, wide, float(-(shares * np.log2(shares)).sum()),
        same / n, pairs, 1 - len(set(lines)) / max(1, len(lines)), top / n, float((sizes <= 2).mean()), sum(map(str.istitle, words)) / n, eights,
    ]


class Trees:
    """Flattened trees: node i has children 2i+1 and 2i+2; a row goes right where its value is over
    the cut of the node."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float) -> None:
        self.feature, self.cut, self.leaf, self.base = feature, cut, leaf, base

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, feature=self.feature, cut=self.cut, leaf=self.leaf, base=self.base)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Trees:
        found = np.load(io.BytesIO(data))
        return cls(found["feature"], found["cut"], found["leaf"], float(found["base"]))


def grown(x: np.ndarray, y: np.ndarray) -> Trees:
    """Log-loss boosting with second-order gains on histograms of quantile bins."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = float(y.mean()) if len(y) else 0.5
    empty = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves))
    if not len(y) or share in (0.0, 1.0):
        return Trees(*empty, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log(share / (1 - share)))
    raw, features, cuts, values = np.full(len(y), base), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, many = 2**depth - 1, 2**depth
            local = node - first
            best = np.full(many, 1e-6)
            sum_g, sum_h, sum_n = (np.bincount(local, weights=w, minlength=many) for w in (g, h, np.ones(len(y))))
            chosen, place = np.zeros(many, np.int64), np.full(many, BINS)
            for j in range(x.shape[1]):
                if not len(edges[j]):
                    continue
                cell = local * BINS + binned[:, j]
                left_g, left_h, left_n = (np.bincount(cell, weights=w, minlength=many * BINS).reshape(many, BINS).cumsum(axis=1) for w in (g, h, np.ones(len(y))))
                right_g, right_h, right_n = sum_g[:, None] - left_g, sum_h[:, None] - left_h, sum_n[:, None] - left_n
                gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - (sum_g**2 / (sum_h + RIDGE))[:, None]
                gain[(left_n < LEAST) | (right_n < LEAST)] = -1
                gain[:, len(edges[j]) :] = -1
                at = gain.argmax(axis=1)
                better = gain[np.arange(many), at] > best
                best[better] = gain[np.arange(many), at][better]
                chosen[better], place[better] = j, at[better]
            for k in range(many):
                if place[k] < BINS:
                    feature[first + k], cut[first + k] = chosen[k], edges[chosen[k]][place[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        local = node - inner
        leaf = RATE * np.bincount(local, weights=g, minlength=leaves) / (np.bincount(local, weights=h, minlength=leaves) + RIDGE)
        raw = raw + leaf[local]
        features.append(feature)
        cuts.append(cut)
        values.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(values), base)


def remainder(column: str, divisor: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with its vector of statistics."""
    keep = [f for f in docs.schema.fields if f.name not in (text, "statistics")]
    passed = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = pa.array([statistics(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in passed] + [vectors], names=[*passed, "statistics"])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField("statistics", T.ArrayType(T.DoubleType()))]))


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most SAMPLE labelled documents that are usable, one row an id and label;
    of rows with one id but different texts that with the least hash."""
    known = labels.filter(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("__label")).distinct()
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "__label").limit(SAMPLE)
    joined = docs.select("doc_id", text).join(F.broadcast(some), "doc_id")  # at most SAMPLE rows of two numbers
    vectors = with_statistics(joined.withColumn("__hash", F.coalesce(F.xxhash64(text), F.lit(0))), text)
    found = vectors.groupBy("doc_id", "__label").agg(F.min(F.struct("__hash", "statistics"))["statistics"].alias("statistics")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["__label"]))
    return np.array([r["statistics"] for r in found]).reshape(-1, ROW), np.array([r["__label"] for r in found], float)


_LOADED: dict[str, Trees] = {}


def loaded(data: bytes) -> Trees:
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Trees.load(data)
    return _LOADED[key]


def scored(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """Add score of every whole text; the text itself isn't returned."""
    model = docs.sparkSession.sparkContext.broadcast(trees.save())
    keep = [f for f in docs.schema.fields if f.name not in (text, "score")]
    passed = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = loaded(model.value)
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]).reshape(-1, ROW)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in passed] + [pa.array(fitted.scores(x), pa.float64())], names=[*passed, "score"])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the text, with held_out, score and predicted; labels of held-out rows aren't used."""
    held_out = F.coalesce(remainder("doc_id", folds) == held, F.lit(False))
    trees = grown(*training_sample(docs, labels, ~held_out, text))
    out = scored(docs.withColumn("held_out", held_out), trees, text)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

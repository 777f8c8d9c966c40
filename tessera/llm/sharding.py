"""Sharding by a Feistel permutation of global row numbers with cycle walking.

Rows are numbered 0 .. n-1 by (leading digits of md5(doc_id), doc_id, text_crc32, size): the digits
make even buckets, whose counts give each bucket's first number, so no task sorts the whole table.
A keyed Feistel network permutes the least power of four that holds n; numbers that land outside
are walked on until they are inside.  Position p goes to shard p mod shards, slot p div shards, so
shard sizes differ by at most one row and the place of any row number can be computed alone.

Defined cases: a null text has size 1 and the checksum 0 of no bytes; null ids come first; equal
rows are interchangeable; equal texts (groups) are not held together under the law `rows`; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

SHARDS = 16
ROUNDS = 6
SEED = 2024
DIGITS = 4
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64's multipliers


def round_keys(seed: int) -> np.ndarray:
    return mixed_bits(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(ROUNDS + 1))


def mixed_bits(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The permutation of 0 .. n-1 applied to numbers (all below n)."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask, keys = (np.uint64(1) << half) - np.uint64(1), round_keys(seed)
    out = np.asarray(numbers).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for k in keys:
            with np.errstate(over="ignore"):
                left, right = right, left ^ (mixed_bits(right + k) & mask)
        out[todo] = x = (left << half) | right
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def row_numbers(rows: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """rows (stored) with row_number from 0, and their count.  The md5 of all columns of by spreads the
    rows, so different rows of one id, or without an id, are in different buckets."""
    known = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    digits = F.substring(F.md5(known.cast("binary")), 1, DIGITS)
    spread = rows.withColumn("__bucket", digits)
    counts = spread.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy("__bucket").orderBy(*[F.col(c).asc_nulls_first() for c in by])
    numbered = spread.join(offsets, "__bucket").withColumn("row_number", F.col("__before") + F.row_number().over(inside) - 1)
    return numbered.drop("__bucket", "__before"), rows.count()


def sharded(rows: DataFrame, by: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows (stored) with row_number, position, shard and slot."""
    numbered, n = row_numbers(rows, by)

    @F.pandas_udf("long")
    def position(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), n, seed))

    placed = numbered.withColumn("position", position("row_number"))
    return placed.withColumns({"shard": (F.col("position") % shards).cast("int"), "slot": F.expr(f"position div {shards}")})


def shard_documents(docs: DataFrame, text: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't `key`)."""
    data = F.col(text).cast("binary")
    sizes = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"))
    placed = sharded(written(sizes, "shards"), ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

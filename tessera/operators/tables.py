"""Changes to tables as derivations: the new state is a DataFrame made of the old one and the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key: upsert, replace, live row."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__r = 1").drop("__r")


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns of changes where the key has one; unknown keys are ignored."""
    new = changes.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(new, rows[key] == new["__k"], "left")
    return joined.withColumns({c: F.when(F.col("__k").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop("__k", *[f"__{c}" for c in columns])


def inserted_if_absent(rows: DataFrame, more: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first writer of a key wins, rows that are there before all."""
    return rows.unionByName(latest(more, by, order).join(rows.select(*by), by, "left_anti"))


def claimed(attempts: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Compare and set: won is true for the first attempt of a key only."""
    return attempts.withColumn("won", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)


def closed_with(rows: DataFrame, gone: DataFrame, key: str, when: str) -> DataFrame:
    """Open rows of documents that are gone get valid_to."""
    marks = gone.select(F.col(key).alias("__k")).distinct()
    joined = rows.join(marks, rows[key] == marks["__k"], "left")
    return joined.withColumn("valid_to", F.when(F.col("__k").isNotNull() & F.col("valid_to").isNull(), F.lit(when).cast("date")).otherwise(F.col("valid_to"))).drop("__k")


def changes(listing: DataFrame, documents: DataFrame) -> DataFrame:
    """What a rescan does with each path: listing (path, hash) against live documents (path, hash)."""
    there = documents.select(F.col("path").alias("__p"), F.col("hash").alias("__h"))
    joined = listing.join(there, listing["path"] == there["__p"], "full")
    kind = F.when(F.col("path").isNull(), "removed").when(F.col("__p").isNull(), "new").when(F.col("hash") == F.col("__h"), "unchanged").otherwise("changed")
    return joined.select(F.coalesce("path", "__p").alias("path"), kind.alias("change"))


def cursor_read(log: DataFrame, since: int, event: str, schema: str) -> DataFrame:
    """Entries of an event after a position whose details parse, and the position reached by all."""
    after = log.filter((F.col("event") == event) & (F.col("seq") > since))
    parsed = after.withColumn("detail", F.from_json("detail_json", schema)).filter(F.col("detail").isNotNull())
    return parsed.crossJoin(F.broadcast(after.agg(F.max("seq").alias("last_seq"))))


def fingerprint(rows: DataFrame, seq: str, text: str) -> DataFrame:
    """Cheap signature of a table: rows, greatest position, total length."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.max(seq).alias("last"), F.sum(F.length(text)).alias("total_length"))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a per-group table is broadcast; beyond it the join is salted.
BROADCAST_ROWS = 20_000
SALTS = 64
#: ASCII white space that separates words in every operator of this package.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only in a local session that names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write df as Parquet under a fresh name in the shared folder, in parts by columns if any, and read it back."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def erase(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again."""
    for df in tables:
        jvm, files = df.sparkSession._jvm, df.inputFiles()
        if files:
            path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            while "=" in path.getName():  # a part by a column's value
                path = path.getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), lambda w: w != "")


def are_few(groups: DataFrame) -> bool:
    """Has the table a size at which it may be broadcast?"""
    return groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def join_group_values(rows: DataFrame, groups: DataFrame, keys: list[str], spread: Column, few: bool | None = None) -> DataFrame:
    """Left-join the rows of a group (one, or a fixed number) to all rows, null keys being groups of their own.

    groups is counted first unless few is given: up to BROADCAST_ROWS rows it is broadcast; a larger one
    is repeated SALTS times and joined on the keys and a salt taken from spread, so that a hot group has
    SALTS tasks.
    """
    few = are_few(groups) if few is None else few
    right = groups.select(*[F.col(k).alias(f"__g_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    on = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"__g_{k}"))
        on = test if on is None else on & test
    drop = [f"__g_{k}" for k in keys]
    if few:
        return rows.join(F.broadcast(right), on, "left").drop(*drop)
    right = right.withColumn("__g_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return left.join(right, on & (F.col("__salt") == F.col("__g_salt")), "left").drop("__salt", "__g_salt", *drop)

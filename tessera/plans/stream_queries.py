"""Streaming operators run to the end over the events table, as queries."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import knowledge_queries
from tessera.plans.registry import query
from tessera.sources.shared import shared_folder
from tessera.sources.tables import read
from tessera.streaming import stateful


def streamed(spark: SparkSession, table: DataFrame, d: str, name: str) -> DataFrame:
    """A stream over one Parquet table of the folder."""
    return spark.readStream.schema(table.schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def finished(stream: DataFrame) -> DataFrame:
    """Run a stream until its input is used up and return what it wrote: Parquet files in the shared folder,
    beside the checkpoint that holds the state."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream, whether the table is a file of the folder or a folder of files."""
    table = read(spark, d, "events")
    files = {PurePosixPath(p).name for p in table.inputFiles()}
    if files == {"events.parquet"}:
        return streamed(spark, table, d, "events")
    return spark.readStream.schema(table.schema).parquet(f"{d}/events.parquet")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, props FROM events)")
def stream_replay_guard(spark: SparkSession, d: str) -> DataFrame:
    kept = stateful.once(event_stream(spark, d), "ts", ["user_id", "props"], "60 days")
    return finished(kept.select("event_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {knowledge_queries.LEDGER} SELECT user_id, seq, allowed FROM f WHERE n > 0")
def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The same decisions as ledger_fold."""
    secret, t = F.col("user_id") * 700 + 20000, (F.col("event_id") % 97 * 1000 + 5000).cast("double")
    asked = event_stream(spark, d).select("user_id", F.col("event_id").alias("seq"), "ts", t.alias("threshold"), (secret >= t).alias("answer"))
    return finished(stateful.ledger_stream(asked, "user_id", 25000.0))


@query("SELECT user_id, event_id AS seq FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def stream_versions(spark: SparkSession, d: str) -> DataFrame:
    facts = event_stream(spark, d).select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    return finished(stateful.version_stream(facts, "user_id")).select("user_id", "seq")


@query("SELECT count(*) AS n_fresh, (SELECT count(*) FROM events) - count(*) AS n_stale FROM events WHERE event_id % 400 <= 120")
def stream_freshness(spark: SparkSession, d: str) -> DataFrame:
    sent = event_stream(spark, d).withColumn("arrived", F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") % 400)).withColumn("ts", F.date_trunc("second", "ts"))
    fresh, stale = stateful.fresh_and_stale(sent, "ts", "arrived", 120)
    n = finished(fresh.select("event_id")).agg(F.count(F.lit(1)).alias("n_fresh"))
    return n.crossJoin(F.broadcast(finished(stale.select("event_id")).agg(F.count(F.lit(1)).alias("n_stale"))))

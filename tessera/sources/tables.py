"""The driver's tables as the engine's model: facts, graph, requests, credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of facts: the entity is the user, the field the event type, the value its
    rounded number, in force from its day."""
    e = read(spark, sf_dir, "events")
    kind = F.element_at(F.array(F.lit("issuer_doc"), F.lit("extracted"), F.lit("owner_stated")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("f_"), F.col("event_id")).alias("fact_id"),
        F.concat(F.lit("u_"), F.col("user_id")).alias("entity_id"),
        F.col("event_type").alias("field"),
        F.floor(F.col("value") / 50).cast("long").cast("string").alias("value"),
        kind.alias("source_type"),
        F.when(F.col("event_id") % 10 == 0, "low").otherwise("high").alias("confidence"),
        F.to_date("ts").alias("valid_from"),
        F.when(F.col("event_id") % 7 == 0, F.date_add(F.to_date("ts"), 3)).alias("valid_to"),
        F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("f_"), F.col("event_id") + 1)).alias("superseded_by"),
    )


FACTS = """facts AS (SELECT event_id AS seq, 'f_' || event_id AS fact_id, 'u_' || user_id AS entity_id, event_type AS field,
  CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS value, (['issuer_doc','extracted','owner_stated'])[event_id % 3 + 1] AS source_type,
  CASE WHEN event_id % 10 = 0 THEN 'low' ELSE 'high' END AS confidence, CAST(ts AS DATE) AS valid_from,
  CASE WHEN event_id % 7 = 0 THEN CAST(ts AS DATE) + 3 END AS valid_to, CASE WHEN event_id % 11 = 0 THEN 'f_' || (event_id + 1) END AS superseded_by FROM events)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers, nations and regions as a graph with provenance: edges are closed where the order is."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    node = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    placed = o.select(
        node("c", "o_custkey").alias("src"),
        F.concat(F.lit("PLACED_"), F.substring("o_orderpriority", 1, 1)).alias("rel"),
        F.concat(F.lit("m"), F.date_format("o_orderdate", "yyyyMM")).alias("dst"),
        node("o", "o_orderkey").alias("source_id"),
        (F.col("o_orderstatus") == "F").alias("closed"),
    )
    lives = c.select(node("c", "c_custkey").alias("src"), F.lit("LIVES_IN").alias("rel"), node("n", "c_nationkey").alias("dst"), node("d", "c_custkey").alias("source_id"), F.lit(False).alias("closed"))
    part = n.select(node("n", "n_nationkey").alias("src"), F.lit("PART_OF").alias("rel"), node("r", "n_regionkey").alias("dst"), node("d", "n_nationkey").alias("source_id"), F.lit(False).alias("closed"))
    return placed.unionByName(lives).unionByName(part)


EDGES = """edges AS (SELECT 'c' || o_custkey AS src, 'PLACED_' || substr(o_orderpriority, 1, 1) AS rel, 'm' || strftime(o_orderdate, '%Y%m') AS dst, 'o' || o_orderkey AS source_id, o_orderstatus = 'F' AS closed FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'LIVES_IN', 'n' || c_nationkey, 'd' || c_custkey, false FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'PART_OF', 'r' || n_regionkey, 'd' || n_nationkey, false FROM nation),
groups AS (SELECT src, rel, dst, count(*) AS n_edges, count(DISTINCT source_id) AS n_sources, bool_and(closed) AS closed FROM edges GROUP BY ALL)"""

"""Queries of proofs, owners' words and credential batches, checked by who receives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import rules, verify
from tessera.plans.registry import query
from tessera.sources.tables import read

NOW = "1996-06-01"
# orders are credentials whose lines are signed claims; a line discloses its quantity, at times one more than it has
LINES = """ln AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT) AS id, ((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + l_quantity::BIGINT AS copy, l.*, l_quantity::BIGINT + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS told,
  EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_linestatus = l.l_linestatus AND m.l_returnflag = l.l_returnflag AND m.l_quantity::BIGINT = l.l_quantity::BIGINT + CASE WHEN l.l_suppkey % 5 = 0 THEN 1 ELSE 0 END) AS right_ FROM lineitem l),
  io AS (SELECT o_orderkey AS l_orderkey, o_custkey, n_name AS iss, n_regionkey <> 3 AS trusted FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def issuers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders with the customer and the issuer (the customer's nation), and the trusted issuers."""
    n = read(spark, d, "nation")
    home = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("iss"))
    issued = read(spark, d, "orders").join(home, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "iss")
    return issued, n.filter("n_regionkey <> 3").select(F.col("n_name").alias("iss"))


def credentials(spark: SparkSession, d: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Orders as lists of lines, with their issuer and the digests of their lines, and the trusted issuers.

    Lines are dealt once, as they are stored; what is longer than they are is worked out where an order's lines are."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag", F.col("l_quantity").cast("long").alias("true"), *more)
    issued, trust = issuers(spark, d)
    held = read(spark, d, "lineitem").filter("l_orderkey is not null").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    claims = F.array_distinct(F.transform("lines", lambda x: F.struct(x["l_linestatus"].alias("s"), x["l_returnflag"].alias("c"), x["true"].cast("string").alias("v"))))
    signed = F.array_compact(F.transform(claims, lambda c: rules.digest(c["s"], c["c"], c["v"])))
    # before the join: beside what reads them, Spark would work the digests out again for each line
    return held.withColumn("digests", signed).join(issued, "l_orderkey"), trust


def line_id() -> F.Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"))


def told(line) -> F.Column:
    """What a line discloses."""
    value = line["true"] + (line["l_suppkey"] % 5 == 0).cast("int")
    return F.struct(line["l_linestatus"].alias("salt"), line["l_returnflag"].alias("claim"), value.cast("string").alias("value"))


def day(column: str) -> F.Column:
    return F.concat(F.date_format(column, "yyyy-MM-dd"), F.lit("T00:00:00Z"))


@query(f"""WITH {LINES}, t AS (SELECT id, CASE WHEN l_suppkey % 19 = 0 OR l_linenumber = 6 THEN NULL ELSE trusted AND l_suppkey % 11 <> 0 END AS a, right_ AS b, l_partkey % 23 <> 0 AS c, l_linenumber <> 5 AS e,
  CASE WHEN l_suppkey % 13 = 0 THEN false ELSE l_shipdate::DATE > DATE '{NOW}' END AS f, l_returnflag AS claim, told, l_linenumber FROM ln JOIN io USING (l_orderkey))
SELECT id AS request_id, CASE WHEN l_linenumber = 7 THEN 'unsupported' ELSE claim END AS claim, l_linenumber <> 7 AND coalesce(a AND b AND c AND e AND f, false) AS all_ok, CASE WHEN l_linenumber <> 7 AND a AND b AND c AND e AND f THEN CAST(told AS VARCHAR) END AS result,
CASE WHEN a IS NULL OR l_linenumber = 7 THEN 'Issuer signature,Disclosure digest,Holder binding,Nonce and audience,Not expired' ELSE concat_ws(',', CASE WHEN NOT a THEN 'Issuer signature' END, CASE WHEN NOT b THEN 'Disclosure digest' END, CASE WHEN NOT c THEN 'Holder binding' END, CASE WHEN NOT e THEN 'Nonce and audience' END, CASE WHEN NOT f THEN 'Not expired' END) END AS failed FROM t""")
def verified_presentations(spark: SparkSession, d: str) -> DataFrame:
    held, trust = credentials(spark, d, "l_shipdate")
    lines = held.select("l_orderkey", "o_custkey", "iss", "digests", F.inline("lines"))
    lines = lines.withColumns({"id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "true"), "told": told({c: F.col(c) for c in lines.columns})})
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    disclosed = F.when(n == 6, F.array("told", "told")).when(n == 7, F.filter(F.array("told"), lambda x: F.lit(False))).otherwise(F.array("told"))
    proofs = lines.select(
        F.col("id").alias("request_id"), "iss", (s % 11 != 0).alias("signature_ok"), "digests", disclosed.alias("disclosures"), (F.col("l_partkey") % 23 != 0).alias("binding_ok"),
        F.when(s % 19 != 0, F.col("l_partkey")).alias("nonce"), F.col("o_custkey").alias("aud"), F.when(s % 13 == 0, "soon").otherwise(day("l_shipdate")).alias("exp"),
    )
    asked = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", line_id().alias("id")).join(issuers(spark, d)[0], "l_orderkey")
    requests = asked.select(F.col("id").alias("request_id"), F.when(n == 5, -1).otherwise(F.col("l_partkey")).alias("nonce"), F.col("o_custkey").alias("aud"), F.lit(NOW).cast("timestamp").alias("now"))
    out = verify.verified_presentations(proofs, requests, trust)
    failed = F.transform(F.filter("checks", lambda c: ~c["ok"]), lambda c: c["name"])
    return out.select("request_id", "claim", "all_ok", "result", F.array_join(failed, ",").alias("failed"))


@query(f"""SELECT o_orderkey AS request_id, 'total >= ' || o_orderpriority AS claim, o_custkey % 4 <> 0 AND c_nationkey % 5 <> 0 AND o_custkey % 9 <> 0 AND o_orderkey % 6 <> 0 AND o_orderdate::DATE > DATE '{NOW}' AS all_ok,
CASE WHEN o_custkey % 4 <> 0 AND c_nationkey % 5 <> 0 AND o_custkey % 9 <> 0 AND o_orderkey % 6 <> 0 AND o_orderdate::DATE > DATE '{NOW}' THEN o_totalprice >= 100000 END AS result,
CASE WHEN c_nationkey % 5 = 0 THEN 'no owner key received at pairing' WHEN o_custkey % 4 = 0 THEN 'not the owner key received at pairing' WHEN o_custkey % 9 = 0 THEN 'signature does not verify' ELSE 'signed with the owner''s key for me (owner-attested, not the issuer''s word)' END AS why,
CASE WHEN o_orderdate::DATE > DATE '{NOW}' THEN 'valid until ' ELSE 'expired on ' END || strftime(o_orderdate::DATE, '%-d %b %Y') AS until FROM orders JOIN customer ON c_custkey = o_custkey""")
def verified_attestations(spark: SparkSession, d: str) -> DataFrame:
    k, w = F.col("o_orderkey"), F.col("o_custkey")
    orders = read(spark, d, "orders")
    key = lambda part: F.concat(F.lit("key"), part)
    words = orders.select(
        k.alias("request_id"), F.lit("total").alias("claim"), F.lit(">=").alias("op"), F.col("o_orderpriority").alias("value"), (F.col("o_totalprice") >= 100000).alias("answer"), k.alias("nonce"), w.alias("aud"), day("o_orderdate").alias("exp"),
        F.when(w % 4 == 0, "another").otherwise(key(w)).alias("owner_key"), (w % 9 != 0).alias("signature_ok"),
    )
    paired = read(spark, d, "customer").select(F.col("c_custkey").alias("requester"), F.when(F.col("c_nationkey") % 5 == 0, "pending").otherwise("paired").alias("status"), key(F.col("c_custkey")).alias("owner_key"))
    pinned = verify.pairwise_keys(paired).withColumnRenamed("owner_key", "pinned")
    requests = orders.join(pinned, F.col("requester") == w, "left").select(k.alias("request_id"), F.when(k % 6 == 0, -1 - k).otherwise(k).alias("nonce"), w.alias("aud"), F.lit(NOW).cast("timestamp").alias("now"), "pinned")
    out = verify.verified_attestations(words, requests)
    return out.select("request_id", "claim", "all_ok", "result", F.col("checks")[0]["detail"].alias("why"), F.col("checks")[2]["detail"].alias("until"))


IMPORT = f"""{LINES}, c AS (SELECT ln.*, io.iss, CASE WHEN trusted AND l_suppkey % 11 = 0 THEN 'issuer signature does not verify' WHEN NOT right_ THEN 'disclosure ' || l_returnflag || ' does not match a digest' END AS reason FROM ln JOIN io USING (l_orderkey)),
s AS (SELECT l_orderkey, min(copy) AS stop FROM c WHERE reason IS NOT NULL GROUP BY 1), r AS (SELECT c.*, stop FROM c LEFT JOIN s USING (l_orderkey))"""


def batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    held, trust = credentials(spark, d)

    def copy(x: F.Column) -> F.Column:
        number = ((x["l_linenumber"].cast("long") * 1_000_000 + x["l_partkey"]) * 100_000 + x["l_suppkey"]) * 100 + x["true"]
        return F.struct(
            number.alias("copy"), F.col("iss"), x["l_linestatus"].alias("credential_type"), F.concat(F.lit("p"), x["l_partkey"]).alias("holder_key"), (x["l_suppkey"] % 11 != 0).alias("signature_ok"), F.col("digests"), F.array(told(x)).alias("disclosures"),
        )

    rows = held.select(F.col("l_orderkey").alias("batch_id"), F.array_sort(F.transform("lines", copy)).alias("copies"), F.col("l_orderkey").alias("seq"))
    pending = read(spark, d, "part").filter(F.col("p_size") % 2 == 0).select(F.concat(F.lit("p"), "p_partkey").alias("holder_key"))
    return rows, trust, pending


@query(f"""WITH {IMPORT} SELECT 'stored' AS what, l_orderkey AS batch_id, copy, 'p' || l_partkey AS detail FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, copy) AS n FROM r JOIN part ON p_partkey = l_partkey
  WHERE (stop IS NULL OR copy < stop) AND p_size % 2 = 0) WHERE n = 1
UNION ALL SELECT 'stopped', l_orderkey, copy, 'copy ' || copy || ': ' || reason FROM r WHERE copy = stop""")
def imported_copies(spark: SparkSession, d: str) -> DataFrame:
    told = verify.import_outcomes(*batches(spark, d))
    stopped = F.col("what") == "stopped"
    number = F.when(stopped, F.regexp_extract("reason", "^copy (\\d+)", 1)).otherwise(F.col("copy")).cast("long")
    return told.select("what", "batch_id", number.alias("copy"), F.when(stopped, F.col("reason")).otherwise(F.col("holder_key")).alias("detail"))

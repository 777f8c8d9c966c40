"""Queries of intake, grounding and state operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import name_key
from tessera.operators import intake, rules
from tessera.plans.registry import query
from tessera.sources.tables import FACTS, facts, read


@query(
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'note' WHEN 2 THEN 'chat' END AS source, 'd/' || p_partkey || (['.pdf','.MD','.txt','.doc'])[p_partkey % 4 + 1] AS path, p_partkey % 4 <> 3 AND p_partkey % 5 <> 0 AS watched FROM part"
)
def file_routing(spark: SparkSession, d: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".MD", ".txt", ".doc")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/base/d/"), F.col("p_partkey").cast("string"), ending)
    seen = F.concat(F.lit("/base/d/"), F.when(F.col("p_partkey") % 5 == 0, ".").otherwise(""), F.col("p_partkey").cast("string"), ending)
    return read(spark, d, "part").select("p_partkey", intake.source_of(path).alias("source"), intake.relative(path, "/base").alias("path"), intake.watched(seen, "/base/d").alias("watched"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 7 = 0")
def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = F.when(F.col("vec_id") % 3 == 0, None).when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    return intake.missing_vectors(read(spark, d, "embeddings").select("vec_id", e.alias("embedding")), 64).select("vec_id")


@query("SELECT vec_id, vec_id % 3 <> 0 OR vec_id % 2 = 0 AS has_vector FROM embeddings")
def vector_backfill(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    holes = e.withColumn("embedding", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")))
    return intake.backfilled(holes, e.filter("vec_id % 2 = 0"), "vec_id").select("vec_id", F.col("embedding").isNotNull().alias("has_vector"))


@query(
    "WITH v AS (SELECT o_custkey AS path, o_orderkey AS version, o_orderstatus = 'F' AS gone FROM orders), live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC) AS r FROM v) WHERE r = 1 AND NOT gone) SELECT l_orderkey AS version, l_linenumber AS n, l_partkey FROM lineitem JOIN live ON version = l_orderkey"
)
def document_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", F.lit("2024")).alias("removed_at"))
    paths = docs.select("path", "version")
    chunks = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("version"), F.col("l_linenumber").alias("n"), "l_partkey").join(paths, "version")
    return intake.live_chunks(docs, chunks).select("version", "n", "l_partkey")


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '2023' WHEN doc_id % 4 = 0 THEN '2024-02-01' END AS removed_at FROM documents")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 9 == 0, F.lit("2023")).alias("removed_at"))
    return intake.removed(docs, docs.filter("doc_id % 4 = 0"), "2024-02-01").select("doc_id", "removed_at")


@query("SELECT s_suppkey, s_suppkey = (SELECT max(s_suppkey) FROM supplier) AS live, CASE WHEN s_suppkey = (SELECT max(s_suppkey) FROM supplier) THEN s_name END AS name FROM supplier")
def identity_swap(spark: SparkSession, d: str) -> DataFrame:
    return intake.swapped_identity(read(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"))).select(F.col("seq").alias("s_suppkey"), "live", "name")


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN DATE '2020-01-01' ELSE CAST(ts AS DATE) END AS reference FROM events")
def reference_dates(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("event_id") % 3, F.date_format("ts", "yyyy-MM-dd")
    source = F.when(k == 0, "chat").when(k == 1, "note").otherwise("pdf")
    found = intake.reference_date(source, F.concat(F.lit("Written on "), day, F.lit(".")), F.concat(F.lit("chat: "), day, F.lit(" 10:00")), F.lit("2020-01-01").cast("date"))
    return read(spark, d, "events").select("event_id", found.alias("reference"))


@query(
    "SELECT doc_id, field, min(seq) AS seq FROM (SELECT o_custkey AS doc_id, o_orderkey AS seq, (['rent_amount','landlord','board'])[o_orderkey % 3 + 1] AS field FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 2) GROUP BY 1, 2"
)
def fact_grounding(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("o_orderkey") % 3, F.col("o_orderkey")
    field = F.when(k == 0, "rent_amount").when(k == 1, "landlord").otherwise("board")
    value = F.when(k == 0, F.concat(F.lit("Rs "), (n + 1).cast("string"))).otherwise("Asha Rao")
    quote = F.when(k == 0, F.concat(F.lit("the  rent is "), (n + 1).cast("string"))).otherwise("landlord Asha Rao")
    body = F.concat(F.lit("Agreed: The rent is "), (n + 1).cast("string"), F.lit("; landlord Asha Rao."))
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), n.alias("seq"), F.lit("rent_agreement").alias("doc_type"), field.alias("field"), value.alias("value"), F.when(n % 5 == 0, "never said 1").otherwise(quote).alias("quote"), body.alias("text"))
    return intake.grounded_facts(rows).select("doc_id", "field", "seq")


@query("SELECT l_orderkey AS fact_id, min(l_linenumber) AS n FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1")
def quote_chunk(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    chunks = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), F.when(F.col("l_partkey") % 2 == 0, "It is Even  here").otherwise("odd").alias("text"))
    wanted = li.select(F.col("l_orderkey").alias("fact_id")).distinct().select("fact_id", F.col("fact_id").alias("doc_id"), F.lit("even here").alias("quote"))
    return intake.quote_chunks(wanted, chunks)


@query(
    "SELECT c_custkey AS question_id, p.key AS id FROM customer JOIN (SELECT DISTINCT p_name AS key FROM part) p ON contains(' what about the ' || (SELECT p_name FROM part WHERE p_partkey = c_custkey % 50) || ' and the red bolt ', ' ' || p.key || ' ')"
)
def entities_in_question(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    some = part.filter("p_partkey < 50").select(F.col("p_partkey").alias("k"), "p_name")
    q = read(spark, d, "customer").withColumn("k", F.col("c_custkey") % 50).join(some, "k").select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("What about the "), "p_name", F.lit(" and the Red Bolt?")).alias("text"))
    known = part.select(F.col("p_name").alias("id"), name_key(F.col("p_name")).alias("key")).distinct()
    return intake.named_in(q, known).select("question_id", "id")


@query(
    f"WITH RECURSIVE {FACTS}, up AS (SELECT a.fact_id, b.fact_id AS next FROM facts a JOIN facts b ON a.superseded_by = b.fact_id AND a.value = b.value), walk AS (SELECT fact_id, fact_id AS root, 0 AS n FROM facts UNION ALL SELECT w.fact_id, u.next, n + 1 FROM walk w JOIN up u ON w.root = u.fact_id WHERE n < 4) SELECT fact_id, arg_max(root, n) AS root FROM walk GROUP BY 1"
)
def support_roots(spark: SparkSession, d: str) -> DataFrame:
    return intake.support_roots(facts(spark, d).select("fact_id", "superseded_by", "value"), 4)


@query("SELECT user_id, coalesce(arg_min(event_type, event_id) FILTER (WHERE event_type IN ('purchase', 'error')), arg_max(event_type, event_id)) AS state FROM events GROUP BY 1")
def request_states(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("state"))
    return intake.states(e, "user_id", "event_id", ["purchase", "error"])


@query("""SELECT s_suppkey, sha256('{"a":' || s_suppkey || ',"b":"' || s_name || '","c":null}') AS hash FROM supplier""")
def canonical_details(spark: SparkSession, d: str) -> DataFrame:
    body = intake.canonical_json({"b": F.col("s_name"), "c": F.lit(None).cast("string"), "a": F.col("s_suppkey")})
    return read(spark, d, "supplier").select("s_suppkey", F.sha2(body.cast("binary"), 256).alias("hash"))


@query("SELECT c_custkey, 'income_ge_' || t AS claim, c_acctbal >= t AS holds FROM customer, (SELECT unnest([1000, 5000, 9000]) AS t)")
def issuer_claims(spark: SparkSession, d: str) -> DataFrame:
    return intake.threshold_claims(read(spark, d, "customer"), "c_custkey", "c_acctbal", "income", [1000, 5000, 9000])


@query("SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS status, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS priority FROM orders GROUP BY 1")
def attribute_merge(spark: SparkSession, d: str) -> DataFrame:
    status = F.create_map(F.lit("status"), F.col("o_orderstatus"))
    both = F.map_concat(status, F.create_map(F.lit("priority"), F.col("o_orderpriority")))
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, both).otherwise(status).alias("attrs"))
    out = intake.merged_attributes(rows, "o_custkey", "o_orderkey", "attrs")
    return out.select("o_custkey", F.try_element_at("attrs", F.lit("status")).alias("status"), F.try_element_at("attrs", F.lit("priority")).alias("priority"))


@query(
    f"WITH {FACTS}, v AS (SELECT field, valid_from, CAST(min(value) AS BIGINT) AS value FROM facts GROUP BY 1, 2) SELECT field AS id, arg_max(value < 1, valid_from) FILTER (WHERE valid_from <= DATE '2024-01-10') AS met, min(valid_from) FILTER (WHERE valid_from > DATE '2024-01-10' AND NOT value < 1) AS stops FROM v GROUP BY 1"
)
def condition_outcomes(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    versions = f.groupBy("field", "valid_from").agg(F.min("value").alias("value"))
    asked = f.select("field").distinct().select(F.col("field").alias("id"), "field", F.lit("<").alias("op"), F.lit(1).alias("amount"))
    return intake.condition_outcomes(asked, versions, "2024-01-10")


@query("SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS ago FROM (SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-02-01' - date_trunc('second', ts))) AS BIGINT) AS s FROM events)")
def relative_times(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_seconds(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return read(spark, d, "events").select("event_id", intake.time_ago(s).alias("ago"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'monthly income ≥ ₹' || CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) ELSE (n // 1000) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') END WHEN 1 THEN 'age ≥ 21' WHEN 2 THEN 'the exam result' ELSE 'your exam board' END AS words FROM (SELECT c_custkey, c_custkey * 7 + 1 AS n FROM customer)")
def claim_words(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    claim = F.when(k == 0, "income").when(k == 1, "age").when(k == 2, "result").otherwise("board")
    value = F.when(k == 0, (F.col("c_custkey") * 7 + 1).cast("string")).when(k == 1, "21").when(k == 2, "pass")
    return read(spark, d, "customer").select("c_custkey", rules.described(claim, F.when(k < 2, "ge").otherwise("is"), value).alias("words"))

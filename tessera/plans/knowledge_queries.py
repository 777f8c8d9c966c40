"""Queries of facts, graph, rules, tables, sessions and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import name_key
from tessera.operators import explode, graph, rules, tables, temporal
from tessera.plans.registry import query
from tessera.sources.tables import EDGES, FACTS, edges, facts, read

AS_OF = "2024-01-20"
NOW = "2024-01-15 00:00:00"
KEY = ["entity_id", "field"]
CURRENT = f"""{FACTS}, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY valid_from DESC, seq) AS r
  FROM facts WHERE valid_to IS NULL AND superseded_by IS NULL AND valid_from <= DATE '{AS_OF}') WHERE r = 1)"""


@query(f"WITH {CURRENT} SELECT entity_id, field, value, valid_from, seq FROM cur")
def current_facts(spark: SparkSession, d: str) -> DataFrame:
    return temporal.current(facts(spark, d), AS_OF, KEY).select(*KEY, "value", "valid_from", "seq")


@query(f"WITH {FACTS} SELECT fact_id, entity_id, field, valid_from FROM facts WHERE valid_to IS NULL AND superseded_by IS NULL AND valid_from > DATE '{AS_OF}'")
def scheduled_facts(spark: SparkSession, d: str) -> DataFrame:
    return temporal.scheduled(facts(spark, d), AS_OF).select("fact_id", *KEY, "valid_from")


@query(f"WITH {FACTS} SELECT fact_id FROM facts WHERE valid_to IS NULL AND superseded_by IS NULL AND (valid_from IS NULL OR valid_from <= DATE '{AS_OF}')")
def listed_facts(spark: SparkSession, d: str) -> DataFrame:
    return temporal.listed(facts(spark, d), AS_OF).select("fact_id")


@query(f"WITH {CURRENT} SELECT f.entity_id, f.field, f.seq, c.seq IS NOT NULL AS current FROM facts f LEFT JOIN cur c ON f.seq = c.seq")
def fact_timeline(spark: SparkSession, d: str) -> DataFrame:
    return temporal.timeline(facts(spark, d), AS_OF, KEY).select(*KEY, "seq", "current")


@query(
    f"""WITH {FACTS}, o AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS new FROM facts WINDOW w AS (PARTITION BY entity_id, field ORDER BY valid_from, seq)),
i AS (SELECT *, sum(new) OVER (PARTITION BY entity_id, field ORDER BY valid_from, seq) AS island FROM o),
g AS (SELECT entity_id, field, island, min(value) AS value, min(valid_from) AS valid_from, count(*) AS n_support FROM i GROUP BY 1, 2, 3)
SELECT entity_id, field, value, valid_from, lead(valid_from) OVER (PARTITION BY entity_id, field ORDER BY island) AS valid_to, n_support FROM g"""
)
def fact_islands(spark: SparkSession, d: str) -> DataFrame:
    return temporal.islands(facts(spark, d), KEY).select(*KEY, "value", "valid_from", "valid_to", "n_support")


@query()
def fact_fold(spark: SparkSession, d: str) -> DataFrame:
    """Sequential by key; tests hold it against the cases of the supersession rules."""
    return temporal.fold(facts(spark, d), AS_OF)


@query(
    f"""WITH {FACTS}, d AS (SELECT DISTINCT seq AS n, 'd_' || seq % 50 AS doc_id FROM facts), docs AS (SELECT 'd_' || i AS doc_id, i % 5 = 0 AS gone, CASE i % 4 WHEN 0 THEN 'invalid' ELSE 'issuer_signed' END AS st FROM range(50) t(i)),
s AS (SELECT f.*, 'd_' || (seq % 50) AS doc_id FROM facts f), j AS (SELECT c.fact_id AS closed_id, s.fact_id, row_number() OVER (PARTITION BY c.fact_id ORDER BY (CASE WHEN s.confidence = 'high' THEN 10 ELSE 0 END) + (CASE s.source_type WHEN 'issuer_doc' THEN 2 WHEN 'extracted' THEN 1 ELSE 0 END) DESC, s.valid_from, s.seq) AS r
FROM s c JOIN s ON s.superseded_by = c.fact_id AND s.value = c.value JOIN docs ON docs.doc_id = s.doc_id WHERE s.doc_id <> c.doc_id AND NOT gone AND st <> 'invalid') SELECT closed_id, fact_id FROM j WHERE r = 1"""
)
def supporter_promotion(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).withColumn("doc_id", F.concat(F.lit("d_"), F.col("seq") % 50))
    docs = spark.range(50).select(F.concat(F.lit("d_"), "id").alias("doc_id"), F.when(F.col("id") % 5 == 0, F.lit("2024-02-01")).alias("removed_at"), F.when(F.col("id") % 4 == 0, "invalid").otherwise("issuer_signed").alias("signature_status"))
    return temporal.promoted(f.select("fact_id", "value", "doc_id"), f, docs)


@query("SELECT l_orderkey, l_linenumber, l_shipdate, o_orderkey AS as_of_order FROM lineitem l ASOF LEFT JOIN (SELECT o_orderdate, max(o_orderkey) AS o_orderkey, o_custkey % 7 AS k FROM orders GROUP BY o_orderdate, o_custkey % 7) o ON l.l_partkey % 7 = o.k AND l.l_shipdate >= o.o_orderdate")
def asof_orders(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").groupBy("o_orderdate", (F.col("o_custkey") % 7).alias("k")).agg(F.max("o_orderkey").alias("as_of_order"))
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_partkey") % 7).alias("k"))
    return temporal.as_of(li, o, ["k"], "l_shipdate", "o_orderdate", ["as_of_order"]).select("l_orderkey", "l_linenumber", "l_shipdate", "as_of_order")


@query(
    f"WITH {FACTS} SELECT seq, CAST(greatest(date_diff('day', valid_from, least(coalesce(lead(valid_from) OVER (PARTITION BY entity_id, field ORDER BY valid_from, seq), DATE '2024-02-01'), coalesce(valid_to, DATE '2024-02-01'))), 0) AS BIGINT) AS days FROM facts"
)
def timeline_segments(spark: SparkSession, d: str) -> DataFrame:
    return temporal.segments(facts(spark, d), KEY, "2024-02-01").select("seq", F.col("days").cast("long").alias("days"))


SESSION = "SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(p) <= 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)"


@query(f"SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS started FROM ({SESSION}) GROUP BY 1, 2")
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = temporal.sessions(read(spark, d, "events"), ["user_id"], "ts", 6 * 3600, ["event_id"])
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"))


@query("SELECT event_id FROM (SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) - epoch_us(ts) AS wait FROM events) WHERE wait IS NULL OR wait >= 3600000000")
def debounced_events(spark: SparkSession, d: str) -> DataFrame:
    return temporal.debounced(read(spark, d, "events"), ["user_id", "event_type"], "ts", 3600, ["event_id"]).select("event_id")


@query(f"WITH {EDGES} SELECT src, rel, dst, n_edges, n_sources, closed FROM groups")
def edge_groups(spark: SparkSession, d: str) -> DataFrame:
    return graph.grouped_edges(edges(spark, d))


@query(f"WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM groups WHERE NOT closed UNION ALL SELECT dst FROM groups WHERE NOT closed) GROUP BY 1")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(graph.grouped_edges(edges(spark, d)))


@query(f"WITH {EDGES} SELECT id FROM (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier) x WHERE id NOT IN (SELECT src FROM groups WHERE NOT closed UNION SELECT dst FROM groups WHERE NOT closed)")
def unlinked_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")).union(read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey")))
    return graph.unlinked(nodes, graph.grouped_edges(edges(spark, d)))


@query(f"WITH {EDGES} SELECT rel, dst AS id, true AS outgoing FROM groups WHERE src = 'n3' AND NOT closed UNION ALL SELECT rel, src, false FROM groups WHERE dst = 'n3' AND src <> 'n3' AND NOT closed")
def node_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(graph.grouped_edges(edges(spark, d)), "n3")


@query(
    f"WITH RECURSIVE {EDGES}, both_ways AS (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT DISTINCT dst, src FROM edges), walk AS (SELECT 'r0' AS id, 0 AS hop UNION SELECT b, hop + 1 FROM walk JOIN both_ways ON a = id WHERE hop < 3) SELECT id, min(hop) AS hop FROM walk GROUP BY 1"
)
def khop_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(edges(spark, d), ["r0"], 3)


@query(f"WITH {EDGES} SELECT source_id, count(DISTINCT id) AS n FROM (SELECT source_id, src AS id FROM edges UNION ALL SELECT source_id, dst FROM edges) GROUP BY 1")
def document_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.touched(edges(spark, d)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT key, min(seq) AS first_seq, count(*) AS n_mentions, arg_min(type, seq) AS type, arg_max(name, (r, -seq)) AS name FROM (SELECT p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN 'ORG' ELSE 'PERSON' END AS type, p_name AS key, CASE p_partkey % 4 WHEN 0 THEN 'Mr. ' || p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' Pvt Ltd' ELSE upper(p_name[1]) || p_name[2:] END AS name, CASE p_partkey % 4 WHEN 0 THEN 10000 + length(p_name) + 4 WHEN 1 THEN 1000 + length(p_name) WHEN 2 THEN 11000 + length(p_name) + 8 ELSE 11000 + length(p_name) END AS r FROM part) GROUP BY key"
)
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("p_name"), F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Mr. "), n)).when(k == 1, F.upper(n)).when(k == 2, F.concat(n, F.lit(" Pvt Ltd"))).otherwise(F.concat(F.upper(F.substring(n, 1, 1)), F.substr(n, F.lit(2))))
    mentions = read(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 3 == 0, "ORG").otherwise("PERSON").alias("type"), name.alias("name"))
    return graph.resolved(mentions).select("key", "first_seq", "n_mentions", "type", "name")


@query(
    "WITH p AS (SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'name' || s_suppkey // 3 ELSE 'name' || s_suppkey // 2 || ' family' || s_suppkey END AS key FROM supplier), f AS (SELECT split_part(key, ' ', 1) AS first, count(*) AS n, min(id) AS full_id FROM p WHERE key LIKE '% %' GROUP BY 1) SELECT p.id AS one_id, full_id FROM p JOIN f ON p.key = f.first WHERE n = 1 AND p.key NOT LIKE '% %'"
)
def first_name_merge(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    key = F.when(s % 3 == 0, F.concat(F.lit("name"), F.expr("s_suppkey div 3"))).otherwise(F.concat(F.lit("name"), F.expr("s_suppkey div 2"), F.lit(" family"), s))
    return graph.first_name_merges(read(spark, d, "supplier").select(F.concat(F.lit("s"), s).alias("id"), name_key(key).alias("key")))


ASKED = "q AS (SELECT c_custkey, (['income','percentage','age','loan_default_12m','result','board','secret'])[c_custkey % 7 + 1] AS claim, c_acctbal FROM customer)"


def claims(spark: SparkSession, d: str) -> DataFrame:
    """A claim of each kind for every customer, with what is known about it."""
    n = F.col("c_custkey")
    names = ["income", "percentage", "age", "loan_default_12m", "result", "board", "secret"]
    claim = F.element_at(F.array(*[F.lit(x) for x in names]), (n % 7 + 1).cast("int"))
    level = F.when(claim == "income", F.when(n % 2 == 0, "50000").otherwise("62000")).when(claim == "percentage", "75").when(claim == "age", "21").when(claim == "loan_default_12m", "true").when(claim == "result", "pass")
    fact = F.when(claim == "income", F.floor(F.col("c_acctbal") * 10).cast("long").cast("string")).when(claim == "percentage", F.concat((n % 100).cast("string"), F.lit(".5"))).when(claim == "age", F.lit("2003-01-20")).when(claim == "loan_default_12m", F.when(n % 2 == 0, "No").otherwise("perhaps")).when(claim == "result", "Passed")
    return read(spark, d, "customer").select(
        "c_custkey", claim.alias("claim"), F.when(claim.isin("loan_default_12m", "result", "board"), "is").otherwise("ge").alias("op"), level.alias("value"), fact.alias("fact"),
        F.when(n % 5 == 0, True).alias("signed"), (n % 11 != 0).alias("ledger_ok"), F.lit(AS_OF).cast("date").alias("today"),
    )


@query(
    """WITH c AS (SELECT c_custkey AS n, (['income','percentage','age','loan_default_12m','result','board','secret'])[c_custkey % 7 + 1] AS claim, CAST(floor(c_acctbal * 10) AS BIGINT) AS inc FROM customer),
a AS (SELECT *, CASE claim WHEN 'income' THEN inc >= CASE WHEN n % 2 = 0 THEN 50000 ELSE 62000 END WHEN 'percentage' THEN n % 100 + 0.5 >= 75 WHEN 'age' THEN true WHEN 'loan_default_12m' THEN CASE WHEN n % 2 = 0 THEN false END WHEN 'result' THEN true END AS answer,
  CASE claim WHEN 'income' THEN n % 2 = 0 WHEN 'secret' THEN false ELSE true END AS exact FROM c),
k AS (SELECT *, CASE WHEN claim = 'secret' THEN 'REFUSED' WHEN exact AND n % 5 = 0 THEN 'ISSUER_PROOF' WHEN claim = 'board' OR answer IS NULL THEN 'CANNOT_CONFIRM' WHEN n % 11 = 0 THEN 'REFUSED' ELSE 'OWNER_ATTESTED' END AS answer_type FROM a),
r AS (SELECT *, CASE answer_type WHEN 'ISSUER_PROOF' THEN true WHEN 'OWNER_ATTESTED' THEN answer END AS result FROM k)
SELECT n AS c_custkey, answer_type, result, CASE WHEN claim NOT IN ('board', 'secret') THEN result = (claim <> 'loan_default_12m') END AS favourable FROM r"""
)
def decide_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.decided(claims(spark, d)).select("c_custkey", "answer_type", "result", "favourable")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Threshold questions about a user's hidden value, asked over time."""
    secret = F.col("user_id") * 700 + 20000
    t = (F.col("event_id") % 97 * 1000 + 5000).cast("double")
    return read(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.col("ts"), t.alias("threshold"), (secret >= t).alias("answer"))


ANSWERS = "answers AS (SELECT user_id, event_id AS seq, ts, (event_id % 97 * 1000 + 5000)::DOUBLE AS threshold, user_id * 700 + 20000 >= event_id % 97 * 1000 + 5000 AS answer FROM events)"


@query(f"WITH {ANSWERS} SELECT user_id, max(threshold) FILTER (WHERE answer) AS lo, min(threshold) FILTER (WHERE NOT answer) AS hi, count(DISTINCT threshold) AS n_thresholds FROM answers GROUP BY 1")
def ledger_interval(spark: SparkSession, d: str) -> DataFrame:
    return rules.intervals(answers(spark, d), ["user_id"])


@query(f"WITH {ANSWERS} SELECT user_id, count(DISTINCT threshold) AS n_recent FROM answers WHERE ts >= TIMESTAMP '2024-01-28' - INTERVAL 7 DAY GROUP BY 1")
def ledger_recent_distinct(spark: SparkSession, d: str) -> DataFrame:
    return rules.recent_thresholds(answers(spark, d), ["user_id"], "2024-01-28 00:00:00", 7)


LEDGER = f"""{ANSWERS}, q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM answers),
f AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::BOOLEAN AS allowed, '-inf'::DOUBLE AS lo, 'inf'::DOUBLE AS hi, []::STRUCT(t DOUBLE, w TIMESTAMP)[] AS seen FROM (SELECT DISTINCT user_id FROM q)
  UNION ALL SELECT user_id, n, seq, ok, CASE WHEN ok THEN low ELSE lo END, CASE WHEN ok THEN high ELSE hi END, CASE WHEN ok THEN list_append(list_filter(seen, lambda x: x.t <> threshold), {{'t': threshold, 'w': ts}}) ELSE seen END
  FROM (SELECT *, high - low >= 25000 AND (len(list_filter(seen, lambda x: x.t = threshold AND x.w >= ts - INTERVAL 30 DAY)) > 0 OR len(list_filter(seen, lambda x: x.w >= ts - INTERVAL 30 DAY)) < 3) AS ok
    FROM (SELECT q.*, f.lo, f.hi, f.seen, CASE WHEN q.answer THEN greatest(f.lo, q.threshold) ELSE f.lo END AS low, CASE WHEN q.answer THEN f.hi ELSE least(f.hi, q.threshold) END AS high FROM f JOIN q ON q.user_id = f.user_id AND q.n = f.n + 1)))"""


@query(f"WITH RECURSIVE {LEDGER} SELECT user_id, seq, allowed, nullif(lo, '-inf'::DOUBLE) AS lo, nullif(hi, 'inf'::DOUBLE) AS hi FROM f WHERE n > 0")
def ledger_fold(spark: SparkSession, d: str) -> DataFrame:
    """Refused questions leave no trace, so prefix sums are wrong; the SQL is recursive."""
    return rules.ledger(answers(spark, d), "user_id", rules.LEAST_WIDTH["income"])


@query("SELECT o_orderpriority AS credential_type, count(*) FILTER (WHERE o_orderstatus = 'O') AS unused, count(*) AS total FROM orders GROUP BY 1")
def wallet_status(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("credential_type"), (F.col("o_orderstatus") != "O").cast("int").alias("used"))
    return rules.wallet_status(o, ["credential_type"])


@query("WITH c AS (SELECT o_orderkey AS cred_id, o_orderpriority AS credential_type, o_custkey AS copy, 'claim' || o_orderkey % 40 AS claim FROM orders WHERE o_orderstatus = 'O') SELECT 'claim' || i AS claim, arg_min(cred_id, (credential_type, copy, cred_id)) AS cred_id FROM range(60) t(i) JOIN c ON c.claim = 'claim' || i GROUP BY 1")
def found_copies(spark: SparkSession, d: str) -> DataFrame:
    shown = F.array(F.struct(F.concat(F.lit("claim"), F.col("o_orderkey") % 40).alias("claim"), F.lit("true").alias("value")))
    creds = read(spark, d, "orders").select(F.col("o_orderkey").alias("cred_id"), F.col("o_orderpriority").alias("credential_type"), F.col("o_custkey").alias("copy"), (F.col("o_orderstatus") != "O").cast("int").alias("used"), shown.alias("disclosures"))
    return rules.found_copies(spark.range(60).select(F.concat(F.lit("claim"), "id").alias("claim")), creds).select("claim", "cred_id")


@query("SELECT p_partkey, rtrim(translate(base64(unhex(sha256(p_brand || '|' || p_type || '|' || 'true'))), '+/', '-_'), '=') AS digest FROM part")
def disclosure_digests(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", rules.digest(F.col("p_brand"), F.col("p_type"), F.lit("true")).alias("digest"))


@query("SELECT s_suppkey, substr(sha256(s_name), 1, 16) AS fingerprint FROM supplier")
def key_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    key = F.rtrim(F.translate(F.base64(F.col("s_name").cast("binary")), "+/", "-_"), F.lit("="))
    return read(spark, d, "supplier").select("s_suppkey", rules.fingerprint(key).alias("fingerprint"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id") % 10
    return read(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("requester"), F.when(u == 0, None).when(u == 1, "blocked").when(u == 2, "pending").otherwise("paired").alias("status"),
        F.col("props").alias("nonce"), "ts", F.repeat(F.lit("x"), (F.col("event_id") % 600).cast("int")).alias("question"),
    )


@query(
    "SELECT seq, CASE WHEN seq % 600 > 500 THEN 'too_long' WHEN abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) > 120000000 THEN 'stale_ts' WHEN user_id % 10 = 0 THEN 'unknown' WHEN user_id % 10 = 1 THEN 'blocked' WHEN user_id % 10 = 2 THEN 'pending_pairing' WHEN r > 1 THEN 'replay' END AS reason FROM (SELECT event_id AS seq, ts, user_id, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) AS r FROM events)"
)
def request_intake(spark: SparkSession, d: str) -> DataFrame:
    return rules.intake(requests(spark, d), NOW).select("seq", "reason")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) AS r FROM events) WHERE r = 1")
def replay_guard(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest(read(spark, d, "events"), ["user_id", "props"], [F.col("event_id")]).select("event_id")


@query("SELECT event_id FROM events WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) <= 86400000000")
def fresh_requests(spark: SparkSession, d: str) -> DataFrame:
    gap = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(NOW).cast("timestamp")))
    return read(spark, d, "events").filter(gap <= 86_400_000_000).select("event_id")


def log_entries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.concat_ws("", "event_type", "props").alias("body"))


CHAIN = """WITH l AS (SELECT user_id, list(event_id ORDER BY event_id) AS s, list(event_type || props ORDER BY event_id) AS b FROM events GROUP BY 1),
h AS (SELECT user_id, s, list_transform(range(1, len(b) + 1), lambda i: list_reduce(list_prepend(repeat('0', 64), b[1:i]), lambda p, x: sha256(p || x))) AS h FROM l)"""


@query(f"{CHAIN} SELECT user_id, unnest(s) AS seq, unnest(h) AS entry_hash FROM h")
def audit_chain_build(spark: SparkSession, d: str) -> DataFrame:
    return rules.chained(log_entries(spark, d), "user_id").select("user_id", "seq", "entry_hash")


@query("SELECT user_id, NOT bool_or(event_id % 1000 = 7) AS intact, min(event_id) FILTER (WHERE event_id % 1000 = 7) AS broken_at, count(*) AS entries FROM events GROUP BY 1")
def audit_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    chain = rules.chained(log_entries(spark, d), "user_id")
    edited = chain.withColumn("body", F.when(F.col("seq") % 1000 == 7, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return rules.verified(edited, "user_id")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest(read(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def keyed_update(spark: SparkSession, d: str) -> DataFrame:
    new = read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return tables.updated(read(spark, d, "customer"), new, "c_custkey", ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query("SELECT c_nationkey AS k, min(c_custkey) AS id FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 5) GROUP BY 1 UNION ALL SELECT s_nationkey, s_suppkey FROM supplier WHERE s_suppkey < 5")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    there = read(spark, d, "supplier").filter("s_suppkey < 5").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    more = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"))
    return tables.inserted_if_absent(there, more, ["k"], [F.col("id")])


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS won FROM orders")
def compare_and_set(spark: SparkSession, d: str) -> DataFrame:
    return tables.claimed(read(spark, d, "orders"), ["o_custkey"], [F.col("o_orderkey")]).select("o_orderkey", "won")


@query(f"WITH {FACTS} SELECT seq, CASE WHEN seq % 5 = 0 AND valid_to IS NULL THEN DATE '2024-02-01' ELSE valid_to END AS valid_to FROM facts")
def document_close(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).withColumn("doc_id", F.col("seq") % 5)
    return tables.closed_with(f, spark.range(1).select(F.col("id").alias("doc_id")), "doc_id", "2024-02-01").select("seq", "valid_to")


@query(
    "SELECT coalesce(l.path, d.path) AS path, CASE WHEN l.path IS NULL THEN 'removed' WHEN d.path IS NULL THEN 'new' WHEN l.hash = d.hash THEN 'unchanged' ELSE 'changed' END AS change FROM (SELECT 'p' || doc_id AS path, md5(text) AS hash FROM documents WHERE doc_id % 10 <> 0) l FULL JOIN (SELECT 'p' || doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE md5(text) END AS hash FROM documents WHERE doc_id % 7 <> 0) d ON l.path = d.path"
)
def rescan_changes(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.concat(F.lit("p"), "doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("hash"))
    old = docs.filter("doc_id % 7 != 0").withColumn("hash", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("hash")))
    return tables.changes(docs.filter("doc_id % 10 != 0").drop("doc_id"), old.drop("doc_id"))


@query("WITH a AS (SELECT * FROM events WHERE event_type = 'view' AND event_id > 5000) SELECT event_id AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k, (SELECT max(event_id) FROM a) AS last_seq FROM a")
def cursor_read(spark: SparkSession, d: str) -> DataFrame:
    log = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.col("props").alias("detail_json"))
    return tables.cursor_read(log, 5000, "view", "k long").select("seq", "detail.k", "last_seq")


@query("SELECT count(*) AS n_rows, max(doc_id) AS last, CAST(sum(length(text)) AS BIGINT) AS total_length FROM documents")
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return tables.fingerprint(read(spark, d, "documents"), "doc_id", "text")


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS n_good, median(n_chars) FILTER (WHERE toxic = 0) AS median_chars FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.median(F.when(F.col("toxic") == 0, F.col("n_chars"))).alias("median_chars"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'user') DESC, turn DESC) AS r FROM conversations) WHERE r <= 2")
def budget_chunks(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").withColumn("cue", (F.col("role") == "user").cast("int"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("cue"), F.desc("turn")))
    return turns.withColumn("r", rank).filter("r <= 2").select("conv_id", "turn")


@query("SELECT l_orderkey, l_linenumber, round(100 + sum(l_quantity * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING), 6) AS balance FROM lineitem")
def running_balance(spark: SparkSession, d: str) -> DataFrame:
    signed = F.col("l_quantity") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    li = read(spark, d, "lineitem").withColumn("amount", signed)
    return explode.running_balance(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "amount", 100.0).select("l_orderkey", "l_linenumber", F.round("balance", 6).alias("balance"))


@query("SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 2) AS amount, 'NAME ' || o_custkey AS party, o_orderkey % 2 = 0 AS outgoing FROM orders")
def bank_rows(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.tables import latest

    o = read(spark, d, "orders")
    name = F.concat(F.lit("NAME "), "o_custkey")
    what = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("UPI/RENT/"), name)).otherwise(F.concat(F.lit("SALARY CREDIT "), name))
    row = F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM-dd"), what, F.format_number("o_totalprice", 2), F.lit("1,000.00"))
    flat = o.select(F.struct("o_custkey", "o_orderkey").alias("k"), row.alias("text"))
    rows = explode.statement_rows(flat, "k")
    return latest(rows, ["k"], [F.col("n")]).select("k.o_custkey", "k.o_orderkey", "day", F.col("amount").cast("double").alias("amount"), "party", "outgoing")


@query()
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """Sentences need look-behind; tests hold the flags."""
    turns = read(spark, d, "conversations").filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat("text", F.lit(" [1] [9].")).alias("text"))
    return explode.citation_checks(turns, turns.select("id", F.lit(1).alias("n")), "id")


@query("SELECT path, 'chat: ' || strftime(min(ts), '%Y-%m-%d %H:%M') AS locator, count(*) AS n FROM (SELECT 'u' || user_id AS path, session, ts FROM (" + SESSION.replace("FROM events)", "FROM (SELECT event_id, user_id, date_trunc('minute', ts) AS ts FROM events))") + ")) GROUP BY path, session")
def chat_windows(spark: SparkSession, d: str) -> DataFrame:
    """Chat exports made of events, parsed back and cut at silences (no size limit here)."""
    e = read(spark, d, "events")
    line = F.concat(F.date_format("ts", "dd/MM/yy, HH:mm"), F.lit(" - U"), "user_id", F.lit(": "), "event_type", F.lit(" "), "event_id")
    files = e.select(F.concat(F.lit("u"), "user_id").alias("path"), F.struct("event_id", line.alias("l")).alias("x")).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["l"]), "\n").alias("text"))
    windows = explode.conversation_windows(explode.messages(files), size=1 << 30)
    return windows.select("path", "locator", F.size(F.split("text", "\n")).cast("long").alias("n"))

"""Queries of grounding and of what is stored by batches: graph, ledger, audit log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph_store, grounding, rules, stored
from tessera.plans.registry import query
from tessera.plans.stream_queries import event_stream
from tessera.sources.shared import kept, shared_folder, spread
from tessera.sources.tables import read

OWNER = "sam rao"


def pick(values: list, index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run's tables."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- grounding: a chunk for each customer, and proposals of which some aren't in it

FLAT = "' ' || trim(regexp_replace(lower(%s), '[^a-z0-9]+', ' ', 'g')) || ' '"
CHUNKS = f"""c AS (SELECT c_custkey AS doc_id, c_custkey AS k, c_nationkey AS nk, lower(c_mktsegment) AS seg, c_name, 'customer ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS ckey FROM customer),
ch AS (SELECT *, ['My landlord is Ann' || k || ' Lee', 'We talk to ' || c_name || CASE WHEN k % 4 = 0 THEN ' and Ann' || k ELSE '' END, 'On ' || (nk + 1) || ' May 2024 I decided to keep the ' || seg || ' plan'] AS parts FROM c),
tx AS (SELECT *, parts[1] || '. ' || parts[2] || '.' || chr(10) || parts[3] || '.' AS text FROM ch),
nm AS (SELECT doc_id, u.pos, u.type, u.name, u.key, {FLAT % 'text'} AS flat FROM tx, LATERAL (SELECT unnest([{{'pos': 0, 'type': 'PERSON', 'name': 'Ann' || k || ' LEE', 'key': 'ann' || k || ' lee'}}, {{'pos': 1, 'type': 'ORG', 'name': c_name, 'key': ckey}},
  {{'pos': 2, 'type': 'PERSON', 'name': 'Ann' || (k + 1) || ' Lee', 'key': 'ann' || (k + 1) || ' lee'}}, {{'pos': 3, 'type': 'PERSON', 'name': 'the Landlord', 'key': 'the landlord'}}, {{'pos': 4, 'type': 'CONCEPT', 'name': c_name, 'key': ckey}},
  {{'pos': 5, 'type': 'PERSON', 'name': 'Sam', 'key': 'sam'}}, {{'pos': 6, 'type': 'CONCEPT', 'name': seg, 'key': seg}}, {{'pos': 7, 'type': 'ORG', 'name': '', 'key': ''}}]) AS u)),
st AS (SELECT *, key = '' OR key = 'sam' OR key = 'the landlord' AS early, contains(flat, ' ' || key || ' ') AS inside FROM nm),
sn AS (SELECT doc_id, pos, type, name, key, CASE WHEN key = '' THEN 'empty name' WHEN key = 'sam' THEN 'owner' WHEN key = 'the landlord' THEN 'role word, not a name' WHEN NOT inside THEN 'name not in text'
  WHEN min(pos) FILTER (inside AND NOT early) OVER (PARTITION BY doc_id, key) < pos THEN 'listed' ELSE 'kept' END AS state FROM st),
dp AS (SELECT doc_id, 0 AS pos, 'I decided to keep the ' || seg || ' plan.' AS quote, '2024-05-' || lpad(CAST(nk + 1 + k % 2 AS VARCHAR), 2, '0') AS date, text FROM tx UNION ALL SELECT doc_id, 1, 'We talk to ' || c_name, '2024-05-01', text FROM tx
  UNION ALL SELECT doc_id, 2, 'I decided to keep it if', '2024-05-01', text FROM tx),
sd AS (SELECT *, CASE WHEN NOT contains(lower(text), lower(quote)) THEN 'decision quote not in text' WHEN NOT regexp_matches(lower(quote), '\\b(decid|if)') THEN 'decision states no choice'
  WHEN NOT (list_contains(nums, day(date::DATE)) AND list_contains(nums, 2024)) THEN 'decision without a date in the text' ELSE 'kept' END AS state FROM (SELECT *, list_transform(regexp_extract_all(text, '[0-9]+'), lambda n: n::INT) AS nums FROM dp))"""


def customer_chunks(spark: SparkSession, d: str, wanted: str) -> dict[str, DataFrame]:
    """The wanted table and those before it; what several of the next ones read is worked out once."""
    c = spread(read(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("n"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"), F.lower("c_mktsegment").alias("seg"), "c_name")
    ann = F.concat(F.lit("Ann"), "k")
    also = F.when(F.col("k") % 4 == 0, F.concat(F.lit(" and "), ann)).otherwise("")
    day = F.concat(F.lit(".\nOn "), F.col("nk") + 1, F.lit(" May 2024 I decided to keep the "), "seg", F.lit(" plan."))
    chunks = c.select("doc_id", "n", F.concat(F.lit("My landlord is "), ann, F.lit(" Lee. We talk to "), "c_name", also, day).alias("text"))

    def proposals(names: list[str], *rows) -> DataFrame:
        cells = [F.struct(F.lit(i).alias("pos"), *[v.alias(a) for a, v in zip(names, row)]) for i, row in enumerate(rows)]
        return c.select("doc_id", "n", F.inline(F.array(*cells)))

    lit = F.lit
    names = proposals(
        ["type", "name"], (lit("PERSON"), F.concat(ann, lit(" LEE"))), (lit("ORG"), F.col("c_name")), (lit("PERSON"), F.concat(lit("Ann"), F.col("k") + 1, lit(" Lee"))), (lit("PERSON"), lit("the Landlord")),
        (lit("CONCEPT"), F.col("c_name")), (lit("PERSON"), lit("Sam")), (lit("CONCEPT"), F.col("seg")), (lit("ORG"), lit("")),
    )
    date = F.concat(lit("2024-05-"), F.lpad((F.col("nk") + 1 + F.col("k") % 2).cast("string"), 2, "0"))
    decided = proposals(["quote", "date"], (F.concat(lit("I decided  to keep the "), "seg", lit(" plan.")), date), (F.concat(lit("We talk to "), "c_name"), lit("2024-05-01")), (lit("I decided to keep it if"), lit("2024-05-01")))
    linked = proposals(["src", "rel", "dst"], (F.concat(ann, lit(" Lee")), lit("RELATES_TO"), F.col("c_name")), (lit("me"), lit("WORKS_ON"), F.col("c_name")), (F.col("c_name"), lit("RELATES_TO"), F.concat(ann, lit(" Lee"))), (F.concat(ann, lit(" Lee")), lit("RELATES_TO"), F.col("c_name")), (lit("Sam"), lit("RELATES_TO"), F.col("seg")))
    found = grounding.names(names, chunks, OWNER)
    if wanted == "names":
        return {"names": found}
    found = kept(found)
    decisions = grounding.decisions(decided, chunks, found.filter("state = 'kept'"))
    if wanted == "decisions":
        return {"names": found, "decisions": decisions}
    held = kept(grounding.entities(found, decisions))
    listed = grounding.listed_relations(linked, chunks, held, OWNER)
    return {"kept": held, "relations": grounding.relations(listed, chunks, held)}


@query(f"WITH {CHUNKS} SELECT doc_id, pos, key, state FROM sn")
def grounded_names(spark: SparkSession, d: str) -> DataFrame:
    return customer_chunks(spark, d, "names")["names"].select("doc_id", "pos", "key", "state")


@query(f"WITH {CHUNKS} SELECT doc_id, pos, rtrim(quote, '.') AS name, state FROM sd")
def grounded_decisions(spark: SparkSession, d: str) -> DataFrame:
    return customer_chunks(spark, d, "decisions")["decisions"].select("doc_id", "pos", "name", "state")


RELATIONS = f"""rl AS (SELECT doc_id, '@owner' AS src, 'DECIDED' AS rel, 'i decided to keep the ' || seg || ' plan' AS dst, date::DATE AS valid_from FROM sd JOIN c USING (doc_id) WHERE state = 'kept'
  UNION ALL SELECT doc_id, 'i decided to keep the ' || seg || ' plan', 'ABOUT', sn.key, date::DATE FROM sd JOIN c USING (doc_id) JOIN sn USING (doc_id) WHERE sd.state = 'kept' AND sn.state = 'kept' AND sn.type = 'CONCEPT'
  UNION ALL SELECT doc_id, 'ann' || k || ' lee', 'LANDLORD_OF', '@owner', NULL FROM c
  UNION ALL SELECT doc_id, '@owner', 'RELATES_TO', seg, NULL FROM c
  UNION ALL SELECT doc_id, unnest(['ann' || k || ' lee', ckey]), 'RELATES_TO', unnest([ckey, 'ann' || k || ' lee']), NULL FROM tx
    WHERE len(list_filter(parts, lambda p: contains({FLAT % 'p'}, ' ' || ckey || ' ') AND contains({FLAT % 'p'}, ' ann' || k || ' '))) > 0)"""


@query(f"WITH {CHUNKS}, {RELATIONS} SELECT * FROM rl")
def grounded_relations(spark: SparkSession, d: str) -> DataFrame:
    return customer_chunks(spark, d, "relations")["relations"].select("doc_id", "src", "rel", "dst", "valid_from")


@query("""WITH p AS (SELECT o_orderkey % 50 AS doc_id, o_orderkey AS n, o_custkey, o_orderkey % 2 = 0 AS out FROM orders), k AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 3 <> 0)
SELECT doc_id, CASE WHEN out THEN '@owner' ELSE id END AS src, CASE WHEN out THEN id ELSE '@owner' END AS dst, min(n) AS n, 'PAID' AS rel FROM p JOIN k ON c_custkey = o_custkey GROUP BY ALL""")
def paid_edges(spark: SparkSession, d: str) -> DataFrame:
    paid = read(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("doc_id"), F.col("o_orderkey").alias("n"), F.when(F.col("o_orderkey") % 2 == 0, "debit").otherwise("credit").alias("direction"), F.concat(F.lit("Mr ANN"), "o_custkey", F.lit("  LEE")).alias("party"))
    c = F.col("c_custkey")
    graph = read(spark, d, "customer").select(c.alias("id"), c.alias("seq"), F.when(c % 3 == 0, "PLACE").otherwise("PERSON").alias("type"), F.concat(F.lit("ann"), c, F.lit(" lee")).alias("key"))
    return grounding.paid_edges(paid, graph)


# ---- the stored graph: the customers' chunks in three batches, the last of them written twice

def stored_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parts = customer_chunks(spark, d, "relations")
    mentions, relations = graph_store.named_mentions(parts["kept"]), graph_store.named_edges(parts["relations"])
    c = spread(read(spark, d, "customer"), "c_custkey")
    text = F.concat(F.lit("Project: [["), F.initcap(F.lower("c_mktsegment")), F.lit("]]\nSee [[Ann"), "c_custkey", F.lit("  lee|her]].\nRelated: [[File "), F.col("c_custkey") % 7, F.lit("]]"))
    notes = c.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("n/file_"), F.col("c_custkey") % 10, F.lit(".md")).alias("path"), F.lit(0).alias("n"), text.alias("text"))
    linked, edges = graph_store.note_rows(notes)
    mentions = mentions.unionByName(graph_store.fitted(linked, graph_store.MENTIONS), allowMissingColumns=True)
    relations = graph_store.fitted(relations, graph_store.EDGES).unionByName(edges)
    store = graph_store.GraphStore(spark, folder(spark, "graph"))
    mentions, relations = mentions.checkpoint(), relations.checkpoint()
    for batch in (0, 1, 2, 2):
        mine = F.col("doc_id").cast("long") % 3 == batch
        store.write(batch, mentions.filter(mine), relations.filter(mine))
    return store.graph()


@query(f"""WITH {CHUNKS}, m AS (SELECT key, 'named' AS kind, type FROM sn WHERE state = 'kept' UNION ALL SELECT 'i decided to keep the ' || seg || ' plan', 'named', 'DECISION' FROM sd JOIN c USING (doc_id) WHERE state = 'kept'
  UNION ALL SELECT 'file ' || c_custkey % 10, 'note', 'DOCUMENT' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT unnest([lower(c_mktsegment), lower(c_mktsegment), 'ann' || c_custkey || ' lee', 'file ' || c_custkey % 7]), 'link', NULL FROM customer WHERE c_custkey % 5 = 0),
g AS (SELECT key, count(*) FILTER (kind = 'named') AS nn, count(*) FILTER (kind = 'note') AS nd, count(*) FILTER (kind = 'link') AS nl, min(type) FILTER (kind = 'named') AS t FROM m GROUP BY 1)
SELECT key, CASE WHEN nn > 0 THEN t ELSE 'CONCEPT' END AS type, CASE WHEN nn > 0 THEN nn + nl ELSE nl END AS n_mentions FROM g WHERE nn > 0 OR nd = 0
UNION ALL SELECT key, 'DOCUMENT', CASE WHEN nn > 0 THEN nd ELSE nd + nl END FROM g WHERE nd > 0""")
def stored_entities(spark: SparkSession, d: str) -> DataFrame:
    return stored_graph(spark, d)[0].select("key", "type", "n_mentions")


@query(f"""WITH {CHUNKS}, {RELATIONS}, e AS (SELECT DISTINCT doc_id, src, rel, dst FROM rl WHERE src <> dst
  UNION SELECT c_custkey, unnest([lower(c_mktsegment), 'ann' || c_custkey || ' lee', 'file ' || c_custkey % 7]), 'MENTIONED_IN', 'file ' || c_custkey % 10 FROM customer WHERE c_custkey % 5 = 0
  UNION SELECT c_custkey, CASE WHEN c_custkey % 7 IN (0, 5) THEN 'file ' || c_custkey % 7 END, 'PART_OF', lower(c_mktsegment) FROM customer WHERE c_custkey % 5 = 0
  UNION SELECT c_custkey, CASE WHEN c_custkey % 7 NOT IN (0, 5) THEN 'file ' || c_custkey % 7 END, 'PART_OF', lower(c_mktsegment) FROM customer WHERE c_custkey % 5 = 0)
SELECT rel, count(*) AS n_edges, count(DISTINCT (src, dst)) AS n_pairs FROM e WHERE src IS NOT NULL AND src <> dst GROUP BY 1""")
def stored_edges(spark: SparkSession, d: str) -> DataFrame:
    entities, edges = stored_graph(spark, d)
    return edges.filter("not closed").groupBy("rel").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src", "dst").alias("n_pairs"))


# ---- the stored ledger and audit log

LEDGER = """q AS (SELECT CAST(user_id AS VARCHAR) AS claim, event_id AS seq, ts, CASE WHEN event_id % 9 <> 0 THEN (event_id % 97 * 1000 + 5000)::DOUBLE END AS t, user_id * 700 + 20000 >= event_id % 97 * 1000 + 5000 AS yes, event_id % 5 = 0 AS signed,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT claim, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::BOOLEAN AS allowed, '-inf'::DOUBLE AS lo, 'inf'::DOUBLE AS hi, []::STRUCT(t DOUBLE, w TIMESTAMP)[] AS seen FROM (SELECT DISTINCT claim FROM q)
  UNION ALL SELECT claim, n, seq, ok, CASE WHEN ok AND t IS NOT NULL THEN low ELSE lo END, CASE WHEN ok AND t IS NOT NULL THEN high ELSE hi END, CASE WHEN ok AND t IS NOT NULL AND NOT signed THEN list_append(list_filter(seen, lambda x: x.t <> t), {'t': t, 'w': ts}) ELSE seen END
  FROM (SELECT *, t IS NULL OR (high - low >= 25000 AND (signed OR len(list_filter(seen, lambda x: x.t = t AND x.w >= ts - INTERVAL 30 DAY)) > 0 OR len(list_filter(seen, lambda x: x.w >= ts - INTERVAL 30 DAY)) < 3)) AS ok
    FROM (SELECT q.*, f.lo, f.hi, f.seen, CASE WHEN q.yes THEN greatest(f.lo, q.t) ELSE f.lo END AS low, CASE WHEN q.yes THEN f.hi ELSE least(f.hi, q.t) END AS high FROM f JOIN q ON q.claim = f.claim AND q.n = f.n + 1)))"""


def ledger_questions(events: DataFrame) -> DataFrame:
    t = (F.col("event_id") % 97 * 1000 + 5000).cast("double")
    return events.select(
        F.col("user_id").cast("string").alias("claim"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_id") % 9 != 0, t).alias("threshold"), (F.col("user_id") * 700 + 20000 >= t).alias("answer"),
        (F.col("event_id") % 5 == 0).alias("signed"), F.lit(rules.LEAST_WIDTH["income"]).alias("width"),
    )


@query(f"WITH RECURSIVE {LEDGER} SELECT claim, seq, allowed, nullif(lo, '-inf'::DOUBLE) AS lo, nullif(hi, 'inf'::DOUBLE) AS hi FROM f WHERE n > 0")
def stored_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Three batches of questions by time, the last one decided twice."""
    store = stored.LedgerStore(spark, folder(spark, "ledger"))
    asked = ledger_questions(read(spark, d, "events"))
    ends = asked.agg(F.max("seq")).first()[0] or 0
    cuts = [-1, ends // 3, ends // 2, ends]
    for batch in (0, 1, 2, 2):
        store.decide(batch, asked.filter((F.col("seq") > cuts[batch]) & (F.col("seq") <= cuts[batch + 1])))
    return store.decisions().select("claim", "seq", "allowed", "lo", "hi")


@query(f"WITH RECURSIVE {LEDGER} SELECT claim, count(*) FILTER (allowed) AS n_allowed, count(*) AS n FROM f WHERE n > 0 GROUP BY 1")
def streamed_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The stored ledger as the sink of a stream: each micro-batch is decided on what the ones before it left."""
    path = folder(spark, "ledger")
    store = stored.LedgerStore(spark, f"{path}/store")
    stream = ledger_questions(event_stream(spark, d))
    run = stream.writeStream.foreachBatch(lambda rows, batch: store.decide(batch, rows) and None).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return store.decisions().groupBy("claim").agg(F.count_if("allowed").alias("n_allowed"), F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE e AS (SELECT 'u' || user_id AS log, event_id AS seq, event_type || value AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT log, 0::BIGINT AS n, NULL::BIGINT AS seq, '' AS prev_hash, repeat('0', 64) AS entry_hash FROM (SELECT DISTINCT log FROM e) UNION ALL SELECT e.log, e.n, e.seq, c.entry_hash, sha256(c.entry_hash || e.body) FROM c JOIN e ON e.log = c.log AND e.n = c.n + 1)
SELECT log, seq, prev_hash, entry_hash FROM c WHERE n > 0""")
def stored_audit(spark: SparkSession, d: str) -> DataFrame:
    """Three batches onto stored heads, the last one appended twice."""
    store = stored.AuditStore(spark, folder(spark, "audit"))
    entries = read(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("log"), F.col("event_id").alias("seq"), F.concat("event_type", F.col("value").cast("string")).alias("body"))
    ends = entries.agg(F.max("seq")).first()[0] or 0
    cuts = [-1, ends // 4, ends // 2, ends]
    for batch in (0, 1, 2, 2):
        store.append(batch, entries.filter((F.col("seq") > cuts[batch]) & (F.col("seq") <= cuts[batch + 1])))
    return store.entries().select("log", "seq", "prev_hash", "entry_hash")


@query("""WITH r AS (SELECT event_id AS request_id, event_type AS claim, event_id AS seq, event_id % 3 = 0 AS proof, CASE WHEN event_id % 7 <> 0 THEN value > 50 END AS answer, event_id % 4 <> 0 AS allowed FROM events),
cr AS (SELECT p_partkey AS cred_id, (['view','signup','purchase','error'])[p_size % 4 + 1] AS claim, row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_brand, p_size, p_partkey) AS n FROM part WHERE p_partkey % 3 <> 0),
w AS (SELECT request_id, claim, row_number() OVER (PARTITION BY claim ORDER BY seq, request_id) AS n FROM r WHERE proof), g AS (SELECT request_id, cred_id FROM w JOIN cr USING (claim, n)),
s AS (SELECT r.*, cred_id, CASE WHEN cred_id IS NOT NULL THEN 'ISSUER_PROOF' WHEN answer IS NULL THEN 'CANNOT_CONFIRM' WHEN NOT allowed THEN 'REFUSED' ELSE 'OWNER_ATTESTED' END AS status FROM r LEFT JOIN g USING (request_id))
SELECT request_id, status, cred_id, CASE status WHEN 'REFUSED' THEN 'ledger_refused' WHEN 'CANNOT_CONFIRM' THEN 'not_confirmed' ELSE 'answer_released' END AS event, CASE WHEN status IN ('ISSUER_PROOF', 'OWNER_ATTESTED') THEN answer END AS answer FROM s""")
def settled_requests(spark: SparkSession, d: str) -> DataFrame:
    e, p = read(spark, d, "events"), read(spark, d, "part")
    requests = e.select(F.col("event_id").alias("request_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("claim"), (F.col("event_id") % 3 == 0).alias("proof"), F.when(F.col("event_id") % 7 != 0, F.col("value") > 50).alias("answer"))
    ledger = e.select(F.col("event_type").alias("claim"), F.col("event_id").alias("seq"), (F.col("event_id") % 4 != 0).alias("allowed"))
    creds = p.select(F.col("p_partkey").alias("cred_id"), pick(["view", "signup", "purchase", "error"], F.col("p_size") % 4).alias("claim"), (F.col("p_partkey") % 3 == 0).cast("int").alias("used"), F.col("p_brand").alias("credential_type"), F.col("p_size").alias("copy"))
    return stored.settled(requests, ledger, creds).select("request_id", "status", "cred_id", "event", "answer")

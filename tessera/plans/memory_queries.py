"""Queries of what is taught and accepted, of versions, proofs, contacts and computed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import known, memory, release
from tessera.plans.answer_queries import AS_OF, KNOWN, known_tables
from tessera.plans.registry import query
from tessera.sources.tables import read


def pick(values: list, index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


@query("""WITH t AS (SELECT c_custkey AS k, CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) AS bal, c_mktsegment AS seg FROM customer),
s AS (SELECT k, CASE k % 4 WHEN 0 THEN 'rent_amount' WHEN 1 THEN 'monthly_income' WHEN 2 THEN 'hobby' ELSE 'employer' END AS field, CASE k % 4 WHEN 0 THEN CASE WHEN bal::BIGINT > 0 THEN bal END WHEN 1 THEN CASE WHEN bal::BIGINT > 0 AND k % 8 = 1 THEN bal END WHEN 2 THEN seg ELSE seg END AS value,
  CASE WHEN k % 5 = 0 THEN DATE '2024-06-01' WHEN k % 5 = 1 THEN DATE '2024-03-05' ELSE DATE '2024-02-01' END AS valid_from FROM t)
SELECT 't_' || k AS fact_id, field, value, valid_from FROM s WHERE value IS NOT NULL""")
def taught_facts(spark: SparkSession, d: str) -> DataFrame:
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    bal, seg = F.col("c_acctbal").cast("long").cast("string"), F.col("c_mktsegment")
    field = pick(["My rent", "current salary now", " Hobby! ", "job"], k % 4)
    value = F.when(k % 4 == 0, bal).when(k % 4 == 1, bal).otherwise(seg)
    said = F.when(k % 8 == 5, "I earn enough").otherwise(F.concat(F.lit("So it is "), F.when(k % 4 < 2, bal).otherwise(F.lower(seg)), F.lit(" I work for")))
    rows = c.select(k.alias("seq"), k.alias("owner"), said.alias("statement"), field.alias("field"), value.alias("value"), F.when(k % 5 == 0, "from June").when(k % 5 == 1, "2024-03-05").otherwise("whenever").alias("valid_from"), F.lit("2024-02-01").cast("date").alias("today"))
    return memory.taught(rows).select("fact_id", "field", "value", "valid_from")


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderkey % 2 = 0 AS is_fact, o_orderdate::DATE AS day, o_orderpriority AS p FROM orders), f AS (SELECT l_orderkey AS id, arg_min(l_suppkey % 3 <> 0, (l_linenumber, l_suppkey)) AS keep FROM lineitem GROUP BY 1),
s AS (SELECT c.*, CASE WHEN keep IS NULL THEN 'pending' WHEN keep THEN 'accepted' ELSE 'discarded' END AS status FROM c LEFT JOIN f USING (id))
SELECT 'candidate' AS what, id, status AS a, NULL AS b FROM s UNION ALL SELECT 'fact', id, 'field', p FROM s WHERE status = 'accepted' AND is_fact
UNION ALL SELECT 'edge', id, 'DECIDED', 'we keep order ' || id FROM s WHERE status = 'accepted' AND NOT is_fact UNION ALL SELECT 'edge', id, 'PART_OF', 'project ' || owner FROM s WHERE status = 'accepted' AND NOT is_fact AND id % 3 = 0""")
def accepted_candidates(spark: SparkSession, d: str) -> DataFrame:
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(
        k.alias("candidate_id"), F.concat(F.lit("c"), "o_custkey").alias("owner"), k.alias("seq"), F.when(k % 2 == 0, "fact").otherwise("decision").alias("kind"), F.lit("field").alias("field"), F.col("o_orderpriority").alias("value"),
        F.concat(F.lit("Decision: we keep order "), k, F.lit(".")).alias("statement"), F.to_date("o_orderdate").alias("valid_from"), F.when(k % 3 == 0, F.concat(F.lit("project "), "o_custkey")).alias("project"),
    )
    said = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_suppkey")).alias("seq"), (F.col("l_suppkey") % 3 != 0).alias("remember"))
    candidates, facts, edges = memory.accepted(rows, said)
    out = candidates.select(F.lit("candidate").alias("what"), F.col("candidate_id").alias("id"), F.col("status").alias("a"), F.lit(None).cast("string").alias("b"))
    out = out.union(facts.select(F.lit("fact"), "candidate_id", "field", "value"))
    return out.union(edges.select(F.lit("edge"), "candidate_id", "rel", "dst"))


VISIBLE = f"{KNOWN}, hid AS (SELECT doc_id FROM dc WHERE sig = 'issuer_signed' AND holder IN ('mismatch', 'unknown')), cnt AS (SELECT entity_id, field, count(*) AS n FROM kf WHERE doc_id IN (SELECT doc_id FROM hid) GROUP BY ALL)"


@query(f"WITH {VISIBLE} SELECT fact_id, coalesce(n, 0) AS hidden FROM kf LEFT JOIN cnt USING (entity_id, field) WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM hid)")
def owners_versions(spark: SparkSession, d: str) -> DataFrame:
    tables = known_tables(spark, d)
    return memory.owners_versions(tables["facts"], tables["documents"]).select("fact_id", "hidden")


@query(f"""WITH {KNOWN} SELECT entity_id, field, fact_id FROM (SELECT kf.*, row_number() OVER (PARTITION BY entity_id, field ORDER BY valid_from DESC, seq DESC) AS r FROM kf JOIN dc USING (doc_id)
WHERE source_type = 'issuer_doc' AND sig = 'issuer_signed' AND holder = 'verified' AND valid_to IS NULL AND valid_from <= DATE '{AS_OF}' AND seq % 10 <> 0) WHERE r = 1""")
def proving_facts(spark: SparkSession, d: str) -> DataFrame:
    tables = known_tables(spark, d)
    facts = tables["facts"].withColumn("confidence", F.when(F.col("seq") % 10 == 0, "low").otherwise("high"))
    return memory.proving_facts(facts, tables["documents"], AS_OF).select("entity_id", "field", "fact_id")


@query("""SELECT c_custkey, CASE WHEN w IS NULL THEN NULL ELSE r IS NOT DISTINCT FROM (w = 'YES') END AS favourable, CASE WHEN CASE WHEN w IS NULL THEN r IS DISTINCT FROM false ELSE r IS NOT DISTINCT FROM (w = 'YES') END THEN 'approve,deny' ELSE 'answer,decline' END AS actions
FROM (SELECT c_custkey, ([true, false, NULL])[c_custkey % 3 + 1] AS r, (['YES', 'NO', NULL])[c_nationkey % 3 + 1] AS w FROM customer)""")
def proposal_actions(spark: SparkSession, d: str) -> DataFrame:
    found = memory.proposal_actions(pick([True, False, None], F.col("c_custkey") % 3), pick(["YES", "NO", None], F.col("c_nationkey") % 3))
    return read(spark, d, "customer").select("c_custkey", found["favourable"].alias("favourable"), F.array_join(found["actions"], ",").alias("actions"))


@query("""WITH n AS (SELECT o_custkey AS q, l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1 GROUP BY ALL),
l AS (SELECT o_custkey AS q, l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber > 1 GROUP BY ALL),
u AS (SELECT q, id, 0 AS part, w FROM n UNION ALL SELECT q, id, 1, w FROM l WHERE (q, id) NOT IN (SELECT (q, id) FROM n))
SELECT q AS question_id, id, row_number() OVER (PARTITION BY q ORDER BY part, w, id) AS place FROM u""")
def entities_used(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("question_id")), "l_orderkey")
    named = rows.filter("l_linenumber = 1").select("question_id", F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + 1).alias("rank"))
    linked = rows.filter("l_linenumber > 1").select("question_id", F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("rank"), F.col("l_linenumber").alias("pos"))
    return memory.entities_used(named, linked)


PEOPLE = """e AS (SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'PLACE' WHEN s_suppkey % 4 = 1 THEN 'ORG' ELSE 'PERSON' END AS type, CASE WHEN s_suppkey % 3 = 0 THEN ' S' || s_suppkey % 10 || '@Mail.example ' END AS mail FROM supplier),
g AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey ELSE 'me' END AS src, CASE WHEN s_suppkey % 2 = 0 THEN 'LANDLORD_OF' WHEN s_suppkey % 5 = 0 THEN 'BANKS_WITH' ELSE 'EMPLOYED_BY' END AS rel, CASE WHEN s_suppkey % 2 = 0 THEN 'me' ELSE 's' || s_suppkey END AS dst, s_nationkey % 3 = 0 AS shut FROM supplier)"""


def people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s, k = read(spark, d, "supplier"), F.col("s_suppkey")
    own = F.concat(F.lit("s"), k)
    mail = F.when(k % 3 == 0, F.concat(F.lit(" S"), k % 10, F.lit("@Mail.example "))).otherwise("none")
    entities = s.select(own.alias("id"), F.when(k % 4 == 0, "PLACE").when(k % 4 == 1, "ORG").otherwise("PERSON").alias("type"), F.create_map(F.lit("phone"), F.lit("1"), F.lit("mail"), mail).alias("attrs"))
    edges = s.select(
        F.when(k % 2 == 0, own).otherwise("me").alias("src"), F.when(k % 2 == 0, "LANDLORD_OF").when(k % 5 == 0, "BANKS_WITH").otherwise("EMPLOYED_BY").alias("rel"), F.when(k % 2 == 0, F.lit("me")).otherwise(own).alias("dst"),
        F.when(F.col("s_nationkey") % 3 == 0, F.lit("2024-01-01").cast("date")).alias("valid_to"),
    )
    return entities, edges


@query(f"""WITH {PEOPLE}, r AS (SELECT CASE WHEN src = 'me' THEN dst ELSE src END AS id, rel FROM g WHERE NOT shut) SELECT e.id, trim(mail) AS email, coalesce(rel, '') AS rels FROM e LEFT JOIN r USING (id) WHERE type <> 'PLACE' AND (mail IS NOT NULL OR rel IS NOT NULL)""")
def contacts(spark: SparkSession, d: str) -> DataFrame:
    return memory.contacts(*people(spark, d), "me").withColumn("rels", F.array_join("rels", ","))


@query(f"WITH {PEOPLE} SELECT DISTINCT lower(trim(mail)) AS email FROM e WHERE mail IS NOT NULL")
def known_emails(spark: SparkSession, d: str) -> DataFrame:
    return memory.known_emails(people(spark, d)[0])


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type || value ELSE event_id || 'x' END AS payload FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 2 AND event_id % 5 <> 1""")
def proof_payloads(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    payload = F.when(k % 5 == 0, F.concat("event_type", F.col("value").cast("string"))).when(k % 5 == 1, "").otherwise(F.concat(k, F.lit("x")))
    rows = read(spark, d, "events").select(k.alias("request_id"), F.when(k % 2 == 0, "done").otherwise("pending").alias("status"), pick(["ISSUER_PROOF", "OWNER_ATTESTED", "DECLINED"], k % 3).alias("answer_type"), payload.alias("payload"))
    return memory.proof_payloads(rows).select(F.col("request_id").alias("event_id"), "payload")


@query("SELECT p_partkey AS cred_id, 'b' AS claim FROM part WHERE p_partkey % 4 = 1")
def undisclosed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    digest = lambda claim: F.sha2(F.concat(F.lit(claim), k), 256)
    shown = F.array(F.struct(F.lit("a").alias("claim"), digest("a").alias("digest")), F.struct(F.lit("b").alias("claim"), F.when(k % 4 == 1, digest("x")).otherwise(digest("b")).alias("digest")))
    return memory.undisclosed(read(spark, d, "part").select(k.alias("cred_id"), F.array(digest("b"), digest("a")).alias("digests"), shown.alias("disclosed")))


LINE = "kind field value on now next next_on label file since".split()


@query(f"""WITH {KNOWN} SELECT ln.fact_id, CASE WHEN scheduled THEN 'scheduled' ELSE 'fact' END AS kind, ln.field, ln.value, CASE WHEN scheduled THEN strftime(ln.valid_from, '%Y-%m-%d') END AS "on", CASE WHEN scheduled THEN cur.value END AS now,
CASE WHEN NOT scheduled THEN v2 END AS next, CASE WHEN NOT scheduled THEN strftime(d2, '%Y-%m-%d') END AS next_on, ln.label, ln.file, CASE WHEN NOT scheduled THEN strftime(ln.valid_from, '%Y-%m-%d') END AS since
FROM ln LEFT JOIN cur ON cur.entity_id = ln.entity_id AND cur.field = ln.field LEFT JOIN nxt ON nxt.entity_id = ln.entity_id AND nxt.field = ln.field""")
def computed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of known facts, read back."""
    tables = known_tables(spark, d)
    lines = known.known_facts(tables["facts"], tables["documents"], AS_OF).select("fact_id", memory.computed_line(F.col("line")).alias("c"))
    return lines.select("fact_id", *[F.col(f"c.{c}").alias(c) for c in LINE])


@query(r"""SELECT conv_id, turn, regexp_matches(s, '[0-9]|₹') OR regexp_matches(lower(s), '\b(rent|board|going\s+to|will|plan\w*|mar\w*|jan\w*)\b') AS cue, trim(text) = '' OR regexp_matches(lower(text), '\b(name|born|file|pan|copy|how\s+much)\b') AS refused
FROM (SELECT *, regexp_replace(text, '\[[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}\]', ' ', 'g') AS s FROM (SELECT conv_id, turn, (['rent is fine', '[2024-01-01 10:00] hello there', '5 things', 'we are going  to plan', 'Marvel', 'so what', 'your name?', 'how  much', 'a pan', '  '])[(conv_id + turn) % 10 + 1] || ' ' || turn % 1 AS full_,
  (['rent is fine', '[2024-01-01 10:00] hello there', '5 things', 'we are going  to plan', 'Marvel', 'so what', 'your name?', 'how  much', 'a pan', '  '])[(conv_id + turn) % 10 + 1] AS text FROM conversations))""")
def cues_and_refusals(spark: SparkSession, d: str) -> DataFrame:
    said = pick(["rent is fine", "[2024-01-01 10:00] hello there", "5 things", "we are going  to plan", "Marvel", "so what", "your name?", "how  much", "a pan", "  "], (F.col("conv_id") + F.col("turn")) % 10)
    return read(spark, d, "conversations").select("conv_id", "turn", memory.has_cue(said).alias("cue"), memory.is_refused(said).alias("refused"))


REQUESTS = """rq AS (SELECT event_id AS id, user_id AS who, event_id AS seq, (['ISSUER_PROOF','OWNER_ATTESTED','REFUSED','CANNOT_CONFIRM'])[event_id % 4 + 1] AS proposed FROM events), pr AS (SELECT user_id AS who, event_id AS seq, event_id % 4 <> 0 AS accept FROM events WHERE event_id % 13 = 0),
k AS (SELECT rq.*, (SELECT arg_max(accept, pr.seq) FROM pr WHERE pr.who = rq.who AND pr.seq <= rq.seq) AS known, (SELECT arg_min(accept, pr.seq) FROM pr WHERE pr.who = rq.who AND pr.seq > rq.seq) AS later, (SELECT min(pr.seq) FROM pr WHERE pr.who = rq.who AND pr.seq > rq.seq) AS lseq FROM rq),
p AS (SELECT *, coalesce(known, later) AS paired, CASE WHEN known IS NOT NULL THEN seq ELSE lseq END AS taken FROM k)"""


def asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e, k = read(spark, d, "events"), F.col("event_id")
    group = F.concat(F.lit("g"), F.col("user_id") % 20)
    requests = e.select(
        k.cast("string").alias("request_id"), group.alias("group"), k.alias("seq"), F.col("user_id").alias("requester"), F.concat(group, F.lit(":"), "event_type").alias("claim"), pick(["ISSUER_PROOF", "OWNER_ATTESTED", "REFUSED", "CANNOT_CONFIRM"], k % 4).alias("proposed"),
        pick(["a", "b"], k % 2).alias("issuer_claim"), F.when(k % 9 != 0, (k % 60).cast("double")).alias("threshold"), F.lit(10.0).alias("width"), (k % 60 < 30).alias("result"), (k % 5 != 0).alias("agreeable"), "ts",
    )
    return requests, e.filter(k % 13 == 0).select(F.col("user_id").alias("requester"), k.alias("seq"), (k % 4 != 0).alias("accept")), e


@query(f"""WITH {REQUESTS} SELECT CAST(id AS VARCHAR) AS request_id, taken, CASE WHEN paired IS NULL THEN 'pending_pairing' WHEN NOT paired OR proposed IN ('REFUSED', 'CANNOT_CONFIRM') THEN 'done' ELSE 'pending' END AS status,
CASE WHEN NOT paired THEN 'REFUSED' WHEN paired AND proposed IN ('REFUSED', 'CANNOT_CONFIRM') THEN proposed END AS answer_type FROM p""")
def requests_taken_up(spark: SparkSession, d: str) -> DataFrame:
    requests, pairings, _ = asked(spark, d)
    return release.processed(requests, pairings).select("request_id", F.col("at").alias("taken"), "status", "answer_type")


@query()
def requests_decided(spark: SparkSession, d: str) -> DataFrame:
    """An ordered fold over ledgers and copies; tests hold it against a replay of all events."""
    requests, pairings, e = asked(spark, d)
    k = F.col("event_id")
    decisions = e.select((k - k % 50).cast("string").alias("request_id"), (k + 3).alias("seq"), pick(["approve", "answer", "deny", "approve", "decline"], k % 5).alias("action"))
    p = F.col("p_partkey")
    copies = read(spark, d, "part").select(p.cast("string").alias("cred_id"), F.concat(F.lit("g"), p % 20).alias("group"), F.col("p_type").alias("credential_type"), F.col("p_size").alias("copy"), (p % 7 == 0).cast("int").alias("used"), F.when(p % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("claims"))
    return release.decided(release.processed(requests, pairings), decisions, copies).withColumn("events", F.array_join("events", ","))

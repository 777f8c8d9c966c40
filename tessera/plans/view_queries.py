"""Queries of the views and of what leads from hits and facts to a checked answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import parse, text
from tessera.operators import answers, known, views
from tessera.plans.registry import query
from tessera.plans.text_queries import STOPS
from tessera.sources.tables import EDGES, FACTS, edges, facts, read

AS_OF = "2024-01-20"
DOCS = """docs AS (SELECT doc_id, source, CASE WHEN doc_id % 13 = 0 THEN DATE '2024-02-01' END AS removed_at,
  (['invalid','issuer_signed','unsigned','issuer_signed'])[doc_id % 4 + 1] AS signature_status, (['verified','mismatch',NULL])[doc_id % 3 + 1] AS holder_status FROM documents)"""
TOKS = f"list_filter(regexp_extract_all(lower(%s), '[\\p{{L}}\\p{{N}}]+'), lambda t: t NOT IN ({STOPS}))"


def pick(values: list, index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(
        "doc_id", "source", F.when(F.col("doc_id") % 13 == 0, F.lit("2024-02-01").cast("date")).alias("removed_at"),
        pick(["invalid", "issuer_signed", "unsigned", "issuer_signed"], F.col("doc_id") % 4).alias("signature_status"),
        pick(["verified", "mismatch", None], F.col("doc_id") % 3).alias("holder_status"),
    )


@query(f"WITH {DOCS} SELECT doc_id FROM docs WHERE removed_at IS NULL AND signature_status = 'issuer_signed'")
def signed_documents(spark: SparkSession, d: str) -> DataFrame:
    return views.signed(docs(spark, d)).select("doc_id")


@query(f"WITH {DOCS} SELECT doc_id, signature_status = 'issuer_signed' AND (holder_status IS NULL OR holder_status = 'verified') AS own FROM docs WHERE signature_status = 'issuer_signed' AND (holder_status IS NULL OR holder_status IS NOT NULL)")
def holder_documents(spark: SparkSession, d: str) -> DataFrame:
    all_docs = docs(spark, d)
    return views.of_owner(all_docs).select("doc_id", F.lit(True).alias("own")).union(views.not_of_owner(all_docs).select("doc_id", F.lit(False)))


@query(f"""WITH {DOCS}, k AS (SELECT *, (['issuer_doc','extracted','owner_stated'])[doc_id % 3 + 1] AS kind, (['bank_statement','marksheet','id_card','letter'])[doc_id % 4 + 1] AS doc_type, (['note','chat','pdf','mail'])[doc_id % 5 % 4 + 1] AS src FROM docs)
SELECT doc_id, CASE WHEN kind = 'issuer_doc' THEN CASE doc_type WHEN 'bank_statement' THEN 'bank-signed statement' WHEN 'marksheet' THEN 'board-signed marksheet' WHEN 'id_card' THEN 'government-signed ID card' ELSE 'issuer-signed document' END
WHEN signature_status = 'issuer_signed' AND holder_status <> 'verified' THEN 'signed document in someone else''s name' WHEN kind = 'owner_stated' THEN 'you told me'
ELSE CASE src WHEN 'note' THEN 'from your notes' WHEN 'chat' THEN 'from your WhatsApp chat' WHEN 'pdf' THEN 'from an unsigned document' ELSE 'from your files' END END AS label FROM k""")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    kind, doc_type = pick(["issuer_doc", "extracted", "owner_stated"], i % 3), pick(["bank_statement", "marksheet", "id_card", "letter"], i % 4)
    label = known.source_label(kind, F.lit(True), pick(["note", "chat", "pdf", "mail"], i % 5 % 4), doc_type, F.col("signature_status"), F.col("holder_status"))
    return docs(spark, d).select("doc_id", label.alias("label"))


@query("SELECT c_custkey, min(o_orderkey) AS position FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def listed_keys(spark: SparkSession, d: str) -> DataFrame:
    wanted = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("position"))
    return views.looked_up(read(spark, d, "customer"), wanted, "c_custkey").select("c_custkey", "position")


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")
def requests_with_partner(spark: SparkSession, d: str) -> DataFrame:
    who = read(spark, d, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    asked = views.by_status(read(spark, d, "orders"), "O", "o_orderstatus")
    return views.with_partner(asked, who, "o_custkey").select("o_orderkey", "o_custkey", "c_mktsegment")


@query(f"WITH {EDGES} SELECT DISTINCT src, rel, dst, source_id, closed FROM edges WHERE (src IN ('c1','c7','n3') OR dst IN ('c1','c7','n3')) AND source_id IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 'd' || c_custkey FROM customer)")
def existing_evidence(spark: SparkSession, d: str) -> DataFrame:
    chunks = read(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(F.concat(F.lit("o"), "o_orderkey").alias("source_id")).union(read(spark, d, "customer").select(F.concat(F.lit("d"), "c_custkey")))
    nodes = spark.createDataFrame([("c1",), ("c7",), ("n3",)], "id string")
    return views.existing_evidence(edges(spark, d), chunks, nodes).select("src", "rel", "dst", "source_id", "closed")


@query("SELECT event_id FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100)")
def audit_tail(spark: SparkSession, d: str) -> DataFrame:
    return views.tail(read(spark, d, "events").select(F.col("event_id").alias("seq")), 100).select(F.col("seq").alias("event_id"))


@query(f"""WITH {FACTS}, g AS (SELECT entity_id, field, max(valid_from) AS last_learned, bool_or(valid_from > DATE '{AS_OF}') AS scheduled FROM facts GROUP BY ALL)
SELECT entity_id, field, last_learned, row_number() OVER (PARTITION BY entity_id ORDER BY scheduled DESC, last_learned DESC, field) AS rank FROM g""")
def field_groups(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).withColumn("learned", F.col("valid_from"))
    known = f.groupBy("entity_id", "field").agg(F.bool_or(F.col("valid_from") > F.lit(AS_OF).cast("date")).alias("scheduled"))
    return views.ordered_fields(views.last_learned(f, ["entity_id", "field"]).join(known, ["entity_id", "field"])).select("entity_id", "field", "last_learned", "rank")


@query("""WITH o AS (SELECT user_id, event_type, CAST(floor(value / 50) AS BIGINT) AS v, max(event_id) AS seq FROM events GROUP BY ALL)
SELECT user_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM o) WHERE r <= 12""")
def merged_events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_type", F.floor(F.col("value") / 50).alias("v"), F.col("event_id").alias("seq"))
    return views.merged_events(e, ["user_id"], ["event_type", "v"]).select("user_id", "seq")


@query("""SELECT doc_id, CAST(count(*) FILTER (WHERE k = 'c') AS BIGINT) AS chunks_added, CAST(count(*) FILTER (WHERE k = 'f') AS BIGINT) AS facts_added FROM (SELECT l_orderkey AS doc_id, 'c' AS k FROM lineitem UNION ALL SELECT o_orderkey, 'f' FROM orders) GROUP BY 1""")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    parts = {"chunks": read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")), "facts": read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))}
    return views.ingest_counters(parts, "doc_id")


@query(f"""WITH {FACTS}, {DOCS}, v AS (SELECT *, seq % 200 AS doc_id FROM facts), j AS (SELECT v.entity_id, v.field, d.signature_status = 'issuer_signed' AND d.holder_status = 'mismatch' AS bad FROM v LEFT JOIN docs d USING (doc_id))
SELECT entity_id, field, count(*) FILTER (WHERE NOT coalesce(bad, false)) AS shown, count(*) FILTER (WHERE coalesce(bad, false)) AS hidden FROM j GROUP BY ALL""")
def owned_versions(spark: SparkSession, d: str) -> DataFrame:
    return views.owned_versions(facts(spark, d).withColumn("doc_id", F.col("seq") % 200), docs(spark, d))


@query("""SELECT 'requester' AS kind, 'c' || c_custkey AS id, c_mktsegment AS status FROM customer UNION ALL SELECT 'request', 'o' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'task', 'p' || p_partkey, 'planned' FROM part WHERE p_size < 10""")
def owner_queue(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("status"))
    o = read(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"))
    p = read(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.when(F.col("p_size") < 10, "planned").otherwise("done").alias("status"))
    return views.queue(c, o, p)


@query("""SELECT c_custkey AS id, CASE WHEN max(o_orderkey) IS NULL THEN 'pending' WHEN arg_max(o_orderkey % 3 <> 0, o_orderkey) THEN 'paired' ELSE 'blocked' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def pairing_states(spark: SparkSession, d: str) -> DataFrame:
    decisions = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3 != 0).alias("accept"))
    return views.paired(read(spark, d, "customer").select(F.col("c_custkey").alias("id")), decisions)


@query("""SELECT seq, 'ask_rejected' AS event, 'u' || user_id AS ref, '{"reason":"' || reason || '"}' AS detail_json, CASE reason WHEN 'stale_ts' THEN 400 WHEN 'blocked' THEN 403 ELSE 404 END AS code
FROM (SELECT event_id AS seq, user_id, CASE event_id % 5 WHEN 0 THEN 'stale_ts' WHEN 1 THEN 'blocked' WHEN 2 THEN 'unknown' WHEN 3 THEN 'replay' END AS reason FROM events) WHERE reason IS NOT NULL""")
def rejection_audit(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), "user_id").alias("requester"), pick(["stale_ts", "blocked", "unknown", "replay", None], F.col("event_id") % 5).alias("reason"))
    audit = views.rejected_as_audit(asked)
    return audit.withColumn("code", views.reject_status(F.get_json_object("detail_json", "$.reason")))


ANCHORS = """ids AS (SELECT o_custkey AS owner, o_orderkey AS seq, (['ekyc','signed_id','config'])[o_orderkey % 3 + 1] AS source, o_orderstatus = 'F' AS gone, 'name ' || o_orderkey % 4 AS name_key FROM orders),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY CASE source WHEN 'ekyc' THEN 0 WHEN 'signed_id' THEN 1 ELSE 2 END, seq DESC) AS r FROM ids WHERE NOT gone) WHERE r = 1)"""


def anchors(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("seq"), pick(["ekyc", "signed_id", "config"], F.col("o_orderkey") % 3).alias("source"), F.when(F.col("o_orderstatus") == "F", 1).alias("removed_at"), F.concat(F.lit("name "), F.col("o_orderkey") % 4).alias("name_key"))
    return views.anchor(rows)


@query(f"WITH {ANCHORS} SELECT owner, seq, source FROM a")
def identity_anchors(spark: SparkSession, d: str) -> DataFrame:
    return anchors(spark, d).select("owner", "seq", "source")


@query(f"""WITH {ANCHORS}, d AS (SELECT o_orderkey AS doc_id, o_custkey AS owner, 'name ' || o_orderkey % 3 AS name_key, o_orderkey % 2 = 0 AS signed FROM orders)
SELECT doc_id, CASE WHEN signed THEN CASE WHEN a.owner IS NULL THEN 'unknown' WHEN d.name_key = a.name_key THEN 'verified' ELSE 'mismatch' END END AS holder_status FROM d LEFT JOIN a ON a.owner = d.owner""")
def holder_recheck(spark: SparkSession, d: str) -> DataFrame:
    held = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("owner"), F.concat(F.lit("name "), F.col("o_orderkey") % 3).alias("name_key"), F.when(F.col("o_orderkey") % 2 == 0, "issuer_signed").alias("signature_status"))
    return views.recompute_holders(held, anchors(spark, d)).select("doc_id", "holder_status")


@query("SELECT event_id, user_id % 7 = arg_min(user_id % 7, event_id) OVER (PARTITION BY event_type) AS trusted FROM events")
def pinned_answers(spark: SparkSession, d: str) -> DataFrame:
    given = read(spark, d, "events").select("event_id", F.col("event_id").alias("seq"), F.col("event_type").alias("partner"), (F.col("user_id") % 7).alias("key"))
    return views.pinned_key(given).select("event_id", "trusted")


BUDGET = """c AS (SELECT conv_id AS doc_id, turn AS n, conv_id % 2 = 0 AS is_chat, regexp_matches(lower(text), '\\b(?:rent|the|de)\\b') AS cue FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS f, row_number() OVER (PARTITION BY doc_id ORDER BY cue DESC, n DESC) AS b FROM c)"""


@query(f"WITH {BUDGET} SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS position FROM r WHERE CASE WHEN is_chat THEN b <= 16 ELSE f <= 8 END")
def budget_selection(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    marked = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("n"), (F.col("conv_id") % 2 == 0).alias("is_chat"), answers.has_cue(F.col("text"), ["rent", "the", "de"]).alias("cue"))
    return answers.within_budget(marked).select("doc_id", "n", "position")


@query(f"SELECT conv_id, turn, coalesce(list_has_any({TOKS % 'text'}, {TOKS % 'q'}), false) AS relevant FROM (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations)")
def relevant_turns(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    return c.join(first, "conv_id").select("conv_id", "turn", F.coalesce(answers.relevant(F.col("q"), F.col("text")), F.lit(False)).alias("relevant"))


@query(f"""WITH {FACTS} SELECT fact_id, replace(field, '_', ' ') || ': ' || value || CASE WHEN valid_from > DATE '{AS_OF}' THEN ' (from ' ELSE ' (since ' END || strftime(valid_from, '%Y-%m-%d') || ')' AS line, valid_from > DATE '{AS_OF}' AS scheduled
FROM facts WHERE valid_to IS NULL AND superseded_by IS NULL""")
def known_fact_lines(spark: SparkSession, d: str) -> DataFrame:
    return answers.known_facts(facts(spark, d), AS_OF).select("fact_id", "line", "scheduled")


@query("""WITH c AS (SELECT DISTINCT ON (conv, field, op, amount) * FROM (SELECT user_id AS conv, event_type AS field, '<' AS op, CAST(floor(value / 100) AS BIGINT) AS amount, event_id AS seq FROM events) ORDER BY conv, field, op, amount, seq)
SELECT conv, field, op, amount, seq FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY seq) AS r FROM c) WHERE r <= 2""")
def oldest_checks(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("user_id").alias("conv"), F.col("event_type").alias("field"), F.lit("<").alias("op"), F.floor(F.col("value") / 100).alias("amount"), F.col("event_id").alias("seq"))
    return answers.oldest_checks(e, "conv").select("conv", "field", "op", "amount", "seq")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'not met' WHEN o_orderkey % 2 = 0 THEN 'met, stops on ' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'met' END AS line FROM orders""")
def condition_lines(spark: SparkSession, d: str) -> DataFrame:
    stops = F.when(F.col("o_orderkey") % 2 == 0, F.to_date("o_orderdate"))
    return read(spark, d, "orders").select("o_orderkey", answers.condition_line(F.col("o_orderkey") % 3 != 0, stops).alias("line"))


@query()
def best_sentences(spark: SparkSession, d: str) -> DataFrame:
    """No look-behind in DuckDB; tests hold it against plain Python."""
    return answers.best_sentence(read(spark, d, "documents"), "doc_id", F.lit("the house of the landlord and the rent"))


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN 'I don''t have that.' WHEN 1 THEN 'There is no record of it.' ELSE 'Rent is due' END AS answer, (conv_id + turn) % 3 = 0 AS not_found,
CASE (conv_id + turn) % 3 WHEN 0 THEN 'I don''t have that.' WHEN 1 THEN 'There is no record of it [1, 3].' ELSE 'Rent is due [2].' END AS checked FROM conversations""")
def denials(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    said = pick(["I don't have that.", "There is no record of it.", "Rent is due"], (F.col("conv_id") + F.col("turn")) % 3)
    cited = pick(["I don't have that [1].", "There is no record of it [1, 3].", "Rent is due [2]."], (F.col("conv_id") + F.col("turn")) % 3)
    return c.select("conv_id", "turn", said.alias("answer"), answers.says_not_found(cited).alias("not_found"), answers.citations_of_denials_dropped(cited).alias("checked"))


@query(f"SELECT conv_id, 0 AS pos, turn AS n, coalesce(list_has_any({TOKS % 'text'}, {TOKS % 'q'}), false) AS related FROM (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q, regexp_replace(text, '\\s+', ' ', 'g') AS flat FROM conversations)")
def related_citations(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"), F.array_join(F.sort_array(F.collect_list(F.col("turn").cast("int"))), ", ").alias("ns"))
    one = F.regexp_replace("q", "[.!?\\n\"'(\\[\\])]", " ")
    given = first.select("conv_id", F.concat(one, F.lit(" ["), "ns", F.lit("]")).alias("text"))
    chunks = c.select("conv_id", F.col("turn").cast("int").alias("n"), F.col("text").alias("chunk"))
    found = answers.unrelated_citations(given, chunks, "conv_id")
    return found.select("conv_id", "pos", F.col("n").cast("long").alias("n"), F.coalesce("related", F.lit(False)).alias("related"))


@query("SELECT o_custkey, string_agg('[' || r || '] ' || o_orderpriority, chr(10) ORDER BY r) AS context FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1")
def assembled_context(spark: SparkSession, d: str) -> DataFrame:
    return answers.assembled(read(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS history, count(*) AS n_turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 AND role = 'user' GROUP BY 1")
def user_history(spark: SparkSession, d: str) -> DataFrame:
    return answers.history(read(spark, d, "conversations"))


@query("""WITH s AS (SELECT user_id, event_id AS seq, CAST(ts AS DATE) AS day, event_type, value FROM events), p AS (SELECT user_id, arg_max(value, (day, seq)) AS v, arg_max(day, (day, seq)) AS dd FROM s WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, 'rent_amount' AS field, CAST(CAST(trunc(v) AS BIGINT) AS VARCHAR) AS value FROM p UNION ALL SELECT user_id, 'rent_day', CAST(day(dd) AS VARCHAR) FROM p""")
def statement_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.to_date("ts").alias("day"), F.col("event_type").alias("description"), F.col("value").alias("amount"))
    return answers.newest_matching(rows, "user_id", {"rent": ("^purchase$", "rent_amount", "rent_day")})


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'user' || c_custkey || '@mail.example' END AS email FROM customer")
def emails(spark: SparkSession, d: str) -> DataFrame:
    attributes = F.create_map(F.lit("phone"), F.col("c_custkey").cast("string"), F.lit("mail"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("User"), "c_custkey", F.lit("@Mail.example"))).otherwise("none"))
    return read(spark, d, "customer").select("c_custkey", answers.email_of(attributes).alias("email"))


@query("SELECT o_custkey, arg_min('a' || o_orderkey, (o_orderkey % 3, o_orderkey)) AS address FROM orders GROUP BY 1")
def recipients(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "orders").select("o_custkey", F.concat(F.lit("a"), "o_orderkey").alias("address"), pick(["typed", "role", "name"], F.col("o_orderkey") % 3).alias("how"), F.col("o_orderkey").alias("seq"))
    return answers.recipient(c, "o_custkey")


@query("SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) > DATE '1996-06-01' AND o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, o_orderkey % 4 = 0 AS refused FROM orders")
def future_dates(spark: SparkSession, d: str) -> DataFrame:
    typed = F.when(F.col("o_orderkey") % 4 == 0, "what is your PIN?").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read(spark, d, "orders").select("o_orderkey", answers.future_date(typed, F.lit("1996-06-01").cast("date")).alias("day"), answers.refused(typed, ["pin", "password"]).alias("refused"))


@query("SELECT conv_id, sha256(string_agg(trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g')), ' ' ORDER BY turn)) AS hash FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY 1")
def document_hash(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "conversations").filter("text is not null and trim(text) <> ''")
    return text.document_hash(pages, "conv_id", "turn").select("conv_id", "hash")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true ELSE false END AS role, p_partkey % 4 = 1 AS contact, p_name || ',' AS shown FROM part")
def name_tests(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("p_partkey") % 3 == 0, "My  Landlord").otherwise(F.concat("p_name", F.lit(" x")))
    line = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Phone no: "), "p_partkey")).otherwise("nothing here")
    return read(spark, d, "part").select("p_partkey", text.is_role_word(n).alias("role"), text.is_contact_line(line).alias("contact"), F.concat("p_name", F.lit(",")).alias("shown"))


@query("SELECT p_partkey, 'Flat move ' || p_partkey AS title, 'Keep the ' || p_name AS decision, ['a', 'b c'] AS links, regexp_replace(p_name, 'zz', 'zz') || '\\, \\; \\n' AS ics FROM part")
def note_parts(spark: SparkSession, d: str) -> DataFrame:
    title = text.note_title(F.concat(F.lit("/notes/flat_move-"), "p_partkey", F.lit(".md")))
    decision = text.decision_label(F.concat(F.lit("Decision: keep the "), "p_name", F.lit(".")))
    return read(spark, d, "part").select("p_partkey", title.alias("title"), decision.alias("decision"), text.links(F.lit("[[a|x]] [[b  c#d]] [[a]]")).alias("links"), text.ics_text(F.concat("p_name", F.lit(", ; \n"))).alias("ics"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'bank_statement' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN '1,62,000' ELSE '999' END AS grouped FROM part")
def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("p_partkey") % 3 == 0, "note").otherwise("pdf")
    opening = F.when(F.col("p_partkey") % 3 == 1, "Statement of Account").otherwise("letter")
    number = F.when(F.col("p_partkey") % 2 == 0, 162000).otherwise(999)
    return read(spark, d, "part").select("p_partkey", parse.document_type(source, F.col("p_name"), opening).alias("kind"), text.indian_grouping(number).alias("grouped"))

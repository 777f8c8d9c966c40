"""Queries of names in questions, known facts, conditions and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, name_key
from tessera.operators import citations, known, matching
from tessera.plans.registry import query
from tessera.sources.tables import read

AS_OF = "2024-01-20"
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def toks(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda t: t NOT IN ({STOPS}))"


def stems(text: str) -> str:
    return f"list_distinct(list_transform(list_filter({toks(text)}, lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+')), lambda t: t[1:5]))"


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


# ---- names in questions

ENTITIES = """ent AS (SELECT c_custkey AS id, c_custkey AS seq, CASE WHEN c_custkey % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS type,
  CASE WHEN c_custkey % 2 = 0 THEN 'ann' || c_custkey || ' lee' ELSE 'customer ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS key FROM customer),
vec AS (SELECT e.key, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN ent e ON e.id = vec_id),
q AS (SELECT vec_id AS question_id, 'Does Ann' || (vec_id + 2) || ' pay Customer#' || lpad(CAST(vec_id + 1 AS VARCHAR), 9, '0') || ' or Ann' || (vec_id + 4) || ' Lee?' AS text, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0)"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    person = F.col("c_custkey") % 2 == 0
    name = F.when(person, F.concat(F.lit("Mr. Ann"), "c_custkey", F.lit(" LEE"))).otherwise(F.concat("c_name", F.lit(" Pvt. Ltd")))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("seq"), F.when(person, "PERSON").otherwise("ORG").alias("type"), name_key(name).alias("key"))


def name_vectors(spark: SparkSession, d: str) -> DataFrame:
    known_names = entities(spark, d).select(F.col("id").alias("vec_id"), "key")
    return read(spark, d, "embeddings").join(known_names, "vec_id").select("key", F.col("embedding").alias("vector"))


@query(f"""WITH {ENTITIES}, al AS (SELECT id, seq, key AS alias FROM ent UNION SELECT id, seq, split_part(key, ' ', 1) FROM ent WHERE type = 'PERSON'),
w AS (SELECT question_id, id, seq, max(length(alias)) AS n FROM q JOIN al ON contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || alias || ' ') GROUP BY ALL),
s AS (SELECT question_id, id, seq, round(list_cosine_similarity(q.v, vec.v), 9) AS cos FROM q CROSS JOIN ent JOIN vec USING (key) WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.question_id = q.question_id AND w.id = ent.id)),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cos DESC, seq) AS r FROM s WHERE cos >= 0.72) WHERE r <= 3),
u AS (SELECT question_id, id, seq, 0 AS how, CAST(-n AS DOUBLE) AS by_ FROM w UNION ALL SELECT question_id, id, seq, 1, -cos FROM m)
SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY how, by_, seq) AS rank FROM u""")
def entity_matches(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100, against all names."""
    asked = read(spark, d, "embeddings").filter("vec_id % 100 = 0")
    text = F.concat(F.lit("Does Ann"), F.col("vec_id") + 2, F.lit(" pay Customer#"), F.lpad((F.col("vec_id") + 1).cast("string"), 9, "0"), F.lit(" or Ann"), F.col("vec_id") + 4, F.lit(" Lee?"))
    questions = asked.select(F.col("vec_id").alias("question_id"), text.alias("text"), F.col("embedding").alias("vector"))
    return matching.entities_in(questions, entities(spark, d), name_vectors(spark, d))


@query(f"WITH {ENTITIES} SELECT key FROM ent WHERE key NOT IN (SELECT key FROM vec)")
def names_to_embed(spark: SparkSession, d: str) -> DataFrame:
    return matching.missing_names(entities(spark, d), name_vectors(spark, d))


# ---- known facts and conditions

KNOWN = f"""kf AS (SELECT event_id AS seq, 'f_' || event_id AS fact_id, 'u_' || user_id AS entity_id,
  CASE event_type WHEN 'purchase' THEN 'rent_amount' WHEN 'view' THEN 'monthly_income' ELSE event_type END AS field, CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS value,
  (['issuer_doc','extracted','owner_stated'])[event_id % 3 + 1] AS source_type, CASE WHEN event_id % 11 <> 0 THEN event_id // 5 END AS doc_id,
  event_type || ' number ' || event_id || ' gave it' AS quote, CAST(ts AS DATE) AS valid_from, CASE WHEN event_id % 7 = 0 THEN CAST(ts AS DATE) + 3 END AS valid_to FROM events),
dc AS (SELECT DISTINCT event_id // 5 AS doc_id, 'n' || (event_id // 5) || '.md' AS file, (['note','chat','pdf','mail'])[(event_id // 5) % 4 + 1] AS source, (['bank_statement','marksheet','id_card','letter'])[(event_id // 5) % 4 + 1] AS doc_type,
  (['issuer_signed','unsigned','invalid'])[(event_id // 5) % 3 + 1] AS sig, (['verified','mismatch',NULL])[(event_id // 5) % 3 + 1 - (event_id // 5) % 2] AS holder FROM events),
ch AS (SELECT event_id // 5 AS doc_id, event_id % 5 AS n, lower('On that day ' || event_type || '  number ' || event_id || ' gave it.') AS body FROM events WHERE event_id % 13 <> 0),
src AS (SELECT kf.*, dc.file, CASE WHEN source_type = 'issuer_doc' THEN CASE doc_type WHEN 'bank_statement' THEN 'bank-signed statement' WHEN 'marksheet' THEN 'board-signed marksheet' WHEN 'id_card' THEN 'government-signed ID card' ELSE 'issuer-signed document' END
  WHEN dc.doc_id IS NOT NULL AND sig = 'issuer_signed' AND holder <> 'verified' THEN 'signed document in someone else''s name'
  WHEN source_type = 'extracted' AND dc.doc_id IS NOT NULL THEN CASE source WHEN 'note' THEN 'from your notes' WHEN 'chat' THEN 'from your WhatsApp chat' WHEN 'pdf' THEN 'from an unsigned document' ELSE 'from your files' END
  WHEN source_type = 'owner_stated' THEN 'you told me' ELSE 'from your files' END AS label FROM kf LEFT JOIN dc USING (doc_id)),
cur AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY valid_from DESC, seq) AS r FROM src WHERE valid_to IS NULL AND valid_from <= DATE '{AS_OF}') WHERE r = 1),
sch AS (SELECT * FROM src WHERE valid_to IS NULL AND valid_from > DATE '{AS_OF}'),
nxt AS (SELECT entity_id, field, arg_min(value, (valid_from, seq)) AS v2, min(valid_from) AS d2 FROM sch GROUP BY ALL),
ln AS (SELECT cur.*, false AS scheduled, field || ' today = ' || value || ' (' || concat_ws(', ', label, file, 'since ' || strftime(valid_from, '%Y-%m-%d'), 'changes to ' || v2 || ' on ' || strftime(d2, '%Y-%m-%d')) || ')' AS line FROM cur LEFT JOIN nxt USING (entity_id, field)
  UNION ALL SELECT sch.*, true, sch.field || ' from ' || strftime(sch.valid_from, '%Y-%m-%d') || ' = ' || sch.value || ' (future change' || coalesce(' from today''s ' || cur.value, '') || '; ' || concat_ws(', ', sch.label, sch.file) || ')'
  FROM sch LEFT JOIN cur USING (entity_id, field)),
fc AS (SELECT fact_id, min(n) AS n FROM kf JOIN ch USING (doc_id) WHERE contains(regexp_replace(body, '\\s+', ' ', 'g'), lower(quote)) GROUP BY 1),
asked AS (SELECT user_id AS question_id, 'u_' || user_id AS owner, (['What is my rent amount?','Does my renewal condition still hold?','Should I keep the garden after the click?','What did the signup give?','Is my plan fine?'])[user_id % 5 + 1] AS text,
  min(event_id) FILTER (event_type = 'signup') AS first_signup FROM events GROUP BY ALL)"""
TEXTS = ["What is my rent amount?", "Does my renewal condition still hold?", "Should I keep the garden after the click?", "What did the signup give?", "Is my plan fine?"]


def known_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Events as facts with documents and chunks that hold their quotes; not each chunk is there."""
    e = read(spark, d, "events").withColumn("doc", F.floor(F.col("event_id") / 5))
    kind = F.when(F.col("event_type") == "purchase", "rent_amount").when(F.col("event_type") == "view", "monthly_income").otherwise(F.col("event_type"))
    facts = e.select(
        F.concat(F.lit("f_"), "event_id").alias("fact_id"), F.col("event_id").alias("seq"), F.concat(F.lit("u_"), "user_id").alias("entity_id"), kind.alias("field"),
        F.floor(F.col("value") * 100).cast("long").cast("string").alias("value"), pick(["issuer_doc", "extracted", "owner_stated"], F.col("event_id") % 3).alias("source_type"),
        F.when(F.col("event_id") % 11 != 0, F.col("doc")).alias("doc_id"), F.concat("event_type", F.lit(" number "), "event_id", F.lit(" gave it")).alias("quote"), F.to_date("ts").alias("valid_from"),
        F.when(F.col("event_id") % 7 == 0, F.date_add(F.to_date("ts"), 3)).alias("valid_to"), F.lit(None).cast("string").alias("superseded_by"),
    )
    documents = e.select(F.col("doc").alias("doc_id")).distinct().select(
        "doc_id", F.concat(F.lit("in/n"), "doc_id", F.lit(".md")).alias("path"), pick(["note", "chat", "pdf", "mail"], F.col("doc_id") % 4).alias("source"), pick(["bank_statement", "marksheet", "id_card", "letter"], F.col("doc_id") % 4).alias("doc_type"),
        pick(["issuer_signed", "unsigned", "invalid"], F.col("doc_id") % 3).alias("signature_status"), pick(["verified", "mismatch", None], F.col("doc_id") % 3 - F.col("doc_id") % 2).alias("holder_status"),
    )
    body = F.concat(F.lit("On that day "), F.upper("event_type"), F.lit("  number "), "event_id", F.lit(" gave it."))
    chunks = e.filter("event_id % 13 <> 0").select(F.col("doc").alias("doc_id"), (F.col("event_id") % 5).alias("n"), body.alias("text"))
    return {"facts": facts, "documents": documents, "chunks": chunks}


def questions(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("first"))
    linked = F.array_compact(F.array(F.when(F.col("user_id") % 5 == 3, F.concat(F.lit("e_"), "first"))))
    return e.select(F.col("user_id").alias("question_id"), F.concat(F.lit("u_"), "user_id").alias("owner"), pick(TEXTS, F.col("user_id") % 5).alias("text"), linked.alias("used"))


RELEVANT = f"list_has_any({toks('asked.text')}, {toks('''field || ' ' || quote''')})"


@query(f"""WITH {KNOWN} SELECT question_id, fact_id, doc_id, n, line FROM asked JOIN ln ON entity_id = owner JOIN fc USING (fact_id) WHERE source_type <> 'owner_stated' AND {RELEVANT}""")
def known_fact_rows(spark: SparkSession, d: str) -> DataFrame:
    return known.known_fact_rows(questions(spark, d), **known_tables(spark, d), as_of=AS_OF)


@query(f"""WITH {KNOWN} SELECT question_id, 'The owner has also told you: ' || string_agg(line, '; ' ORDER BY scheduled, CASE WHEN NOT scheduled THEN field END, valid_from, seq) || '.' AS context
FROM asked JOIN ln ON entity_id = owner WHERE source_type = 'owner_stated' AND {RELEVANT} GROUP BY 1""")
def owner_stated_lines(spark: SparkSession, d: str) -> DataFrame:
    tables = known_tables(spark, d)
    return known.owner_stated_lines(questions(spark, d), tables["facts"], tables["documents"], AS_OF)


QUOTES = ["Renewal only if rent stays under ", "Keep the garden unless my salary goes above ", "Renewal as long as the rent is at most ", "We move in January "]
HOLDS = "CASE op WHEN '<' THEN %s < amount WHEN '<=' THEN %s <= amount WHEN '>' THEN %s > amount ELSE %s >= amount END"


def holds(value: str) -> str:
    return HOLDS.replace("%s", f"CAST({value} AS BIGINT)")


DECISIONS = f"""dq AS (SELECT 'e_' || event_id AS decision_id, 'u_' || user_id AS owner, event_id AS seq, ({QUOTES!r})[event_id % 4 + 1] || CAST(floor(value * 50) AS BIGINT) || '.' AS quote, event_id // 5 AS doc_id, event_id % 5 AS n FROM events WHERE event_type IN ('signup', 'error')),
cd AS (SELECT *, CASE subject WHEN 'rent' THEN 'rent_amount' ELSE 'monthly_income' END AS field, CASE WHEN lead = 'unless' THEN CASE cmp WHEN 'under' THEN '>=' WHEN 'above' THEN '<=' ELSE '>' END ELSE CASE cmp WHEN 'under' THEN '<' WHEN 'above' THEN '>' ELSE '<=' END END AS op
  FROM (SELECT *, regexp_extract(quote, '(if|as long as|unless) (?:the |my )?(rent|salary) .*?(under|above|at most) ([0-9]+)', 1) AS lead, regexp_extract(quote, '(if|as long as|unless) (?:the |my )?(rent|salary)', 2) AS subject,
    regexp_extract(quote, '(under|above|at most) [0-9]+', 1) AS cmp, TRY_CAST(regexp_extract(quote, '([0-9]+)[.]$', 1) AS BIGINT) AS amount FROM dq) WHERE lead <> ''),
ab AS (SELECT question_id, owner, decision_id, seq, cd.field, op, amount FROM asked JOIN cd USING (owner) WHERE (question_id % 5 = 3 AND decision_id = 'e_' || first_signup) OR regexp_matches(lower(asked.text), '\\b(decision|decided|decide|condition|plan|planned)\\b')
  OR list_has_any(list_filter({stems('asked.text')}, lambda s: s NOT IN (CASE subject WHEN 'rent' THEN 'rent' ELSE 'salar' END, CASE subject WHEN 'rent' THEN 'rent' ELSE 'incom' END)), {stems('quote')})),
on_ AS (SELECT question_id, owner, field, op, amount, arg_min(decision_id, (seq, decision_id)) AS decision_id, min(seq) AS seq FROM ab GROUP BY ALL),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seq, decision_id) AS r FROM on_) WHERE r <= 2)"""


@query(f"""WITH {KNOWN}, {DECISIONS} SELECT question_id, decision_id, seq, field, op, amount FROM tk""")
def asked_conditions(spark: SparkSession, d: str) -> DataFrame:
    return known.asked_conditions(questions(spark, d), decisions(spark, d)).select("question_id", "decision_id", "seq", "field", "op", "amount")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").filter("event_type in ('signup', 'error')")
    quote = F.concat(pick(QUOTES, F.col("event_id") % 4), F.floor(F.col("value") * 50).cast("long").cast("string"), F.lit("."))
    return e.select(F.concat(F.lit("e_"), "event_id").alias("decision_id"), F.concat(F.lit("u_"), "user_id").alias("owner"), F.col("event_id").alias("seq"), quote.alias("quote"), F.floor(F.col("event_id") / 5).alias("doc_id"), (F.col("event_id") % 5).alias("n"))


@query(f"""WITH {KNOWN}, {DECISIONS},
st AS (SELECT question_id, tk.decision_id, tk.owner, tk.field, tk.op, tk.amount, dq.quote, CASE WHEN ch.doc_id IS NOT NULL THEN (dq.doc_id, dq.n) END AS own FROM tk JOIN dq USING (decision_id) LEFT JOIN ch ON ch.doc_id = dq.doc_id AND ch.n = dq.n),
vs AS (SELECT entity_id AS owner, field, false AS later, valid_from, seq, value, value || ' (' || concat_ws(', ', label, file) || ')' AS brief, CASE WHEN fc.n IS NOT NULL THEN (doc_id, fc.n) END AS place FROM cur LEFT JOIN fc USING (fact_id)
  UNION ALL SELECT entity_id, field, true, valid_from, seq, value, value || ' (' || concat_ws(', ', label, file) || ')', CASE WHEN fc.n IS NOT NULL THEN (doc_id, fc.n) END FROM sch LEFT JOIN fc USING (fact_id)),
ev AS (SELECT st.*, later, valid_from, seq, brief, place, {holds('value')} AS ok FROM st LEFT JOIN vs USING (owner, field)),
rs AS (SELECT question_id, decision_id, op, field, amount, quote, own, bool_and(ok) FILTER (NOT later) AS met, min(valid_from) FILTER (later AND NOT ok) AS breaks, coalesce(own, arg_min(place, (later, valid_from, seq)) FILTER (place IS NOT NULL)) AS place,
  string_agg(brief, '') FILTER (NOT later) AS now, string_agg('; from ' || strftime(valid_from, '%Y-%m-%d') || ' = ' || brief || ' -> ' || CASE WHEN ok THEN 'met' ELSE 'NOT met' END, '' ORDER BY valid_from, seq) FILTER (later) AS rest FROM ev GROUP BY question_id, decision_id, op, field, amount, quote, own)
SELECT question_id, decision_id, met, CASE WHEN coalesce(met, true) THEN breaks END AS stops, place[1] AS doc_id, place[2] AS n, 'condition check (computed) for "' || quote || '" (' || field || ' ' || op || ' ' || amount || '): outcome: '
  || CASE WHEN coalesce(met, true) AND breaks IS NOT NULL THEN 'the condition stops being met on ' || strftime(breaks, '%Y-%m-%d') WHEN met THEN 'the condition is met' WHEN NOT met THEN 'the condition is NOT met today' ELSE 'can''t tell' END || '. '
  || CASE WHEN now IS NULL THEN 'no current ' || field ELSE field || ' today = ' || now || ' -> ' || CASE WHEN met THEN 'met' ELSE 'NOT met' END END || coalesce(rest, '') AS line FROM rs WHERE place IS NOT NULL""")
def condition_rows(spark: SparkSession, d: str) -> DataFrame:
    return known.condition_rows(questions(spark, d), decisions(spark, d), **known_tables(spark, d), as_of=AS_OF)


# ---- citations

SAID = """an AS (SELECT c_custkey, 'The balance is ' || c_acctbal AS s1, ' I don''t have that number' AS c1, ' but the ' || lower(c_mktsegment) || ' of ' || c_custkey || ' is known' AS c2,
  CASE WHEN c_nationkey % 2 = 0 THEN 'balance of ' || c_acctbal ELSE 'nothing' END AS t1, 'segment: ' || c_mktsegment AS t2 FROM customer)"""


def cited_answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, d, "customer")
    said = F.concat(F.lit("The balance is "), "c_acctbal", F.lit(" [1][2]. I don't have that number [1, 2], but the "), F.lower("c_mktsegment"), F.lit(" of "), "c_custkey", F.lit(" is known [2,7].\n[1]"))
    first = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("balance of "), "c_acctbal")).otherwise("nothing")
    chunks = c.select("c_custkey", F.inline(F.array(F.struct(F.lit(1).alias("n"), first.alias("text")), F.struct(F.lit(2).alias("n"), F.concat(F.lit("segment: "), "c_mktsegment").alias("text")))))
    return c.select("c_custkey", said.alias("text")), chunks


@query(f"WITH {SAID} SELECT c_custkey, s1 || ' [1][2].' || c1 || ',' || c2 || ' [2,7].' AS text FROM an")
def denied_citations(spark: SparkSession, d: str) -> DataFrame:
    answers, _ = cited_answers(spark, d)
    return answers.select("c_custkey", citations.without_citations_of_denials(F.col("text")).alias("text"))


CONTENT = "list_filter(%s, lambda t: length(t) > 1 OR regexp_full_match(t, '[0-9]'))"


@query(f"""WITH {SAID}, v AS (SELECT *, {CONTENT % toks('s1')} AS w1, {CONTENT % toks("c1 || c2")} AS w2, {CONTENT % toks('t1')} AS k1, {CONTENT % toks('t2')} AS k2 FROM an),
r AS (SELECT *, list_has_any(w1, k1) AS a1, list_has_any(w1, k2) AS a2, list_has_any(w2, k1) AS b1, list_has_any(w2, k2) AS b2 FROM v)
SELECT c_custkey, s1 || CASE WHEN a1 OR a2 THEN ' ' ELSE '' END || CASE WHEN a1 THEN '[1]' ELSE '' END || CASE WHEN a2 THEN '[2]' ELSE '' END || '.' || c1 || CASE WHEN b1 AND b2 THEN ' [1, 2]' WHEN b1 THEN ' [1]' WHEN b2 THEN ' [2]' ELSE '' END
  || ',' || c2 || CASE WHEN b2 THEN ' [2,7]' ELSE ' [7]' END || '.' || CASE WHEN b1 THEN chr(10) || '[1]' ELSE '' END AS text,
  (NOT a1)::INT + (NOT a2)::INT + 2 * (NOT b1)::INT + 2 * (NOT b2)::INT AS n_dropped FROM r""")
def unrelated_dropped(spark: SparkSession, d: str) -> DataFrame:
    answers, chunks = cited_answers(spark, d)
    return citations.without_unrelated(answers, chunks, "c_custkey").withColumn("n_dropped", F.col("n_dropped").cast("int"))


@query("""WITH b AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' '), lambda w: w <> '') AS w FROM conversations WHERE text IS NOT NULL),
c AS (SELECT conv_id, turn, 'One ' || array_to_string(w[1:40], ' ') || '.' AS p1, 'Two ' || array_to_string(w[41:50], ' ') || ' end.' AS p2, 'See ' || array_to_string(w[41:44], ' ') AS said FROM b),
t AS (SELECT *, len(list_intersect(list_distinct(TS), list_distinct(T1))) AS n1, len(list_intersect(list_distinct(TS), list_distinct(T2))) AS n2 FROM c),
x AS (SELECT *, CASE WHEN n2 > n1 THEN p2 ELSE p1 END AS best FROM t)
SELECT conv_id, turn, CASE WHEN length(best) <= 200 THEN best ELSE regexp_extract(best[1:200], '^(.*) ', 1) END AS quote FROM x""".replace("TS", toks("said")).replace("T1", toks("p1")).replace("T2", toks("p2")))
def cited_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as a chunk of two sentences, and an answer that cites it with words of the second."""
    c = read(spark, d, "conversations").filter("text is not null")
    words = F.filter(F.split(F.regexp_replace("text", "[^a-zA-Z ]", ""), " "), lambda w: w != "")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    chunk = F.concat(F.lit("One "), part(1, 40), F.lit(". Two "), part(41, 10), F.lit(" end."))
    rows = c.select("conv_id", "turn", F.struct("conv_id", "turn").alias("key"), chunk.alias("text"), F.concat(F.lit("See "), part(41, 4), F.lit(" [1]")).alias("said"))
    found = citations.cited_quotes(rows.select("key", F.col("said").alias("text")), rows.select("key", F.lit(1).alias("n"), "text"), "key")
    return found.select("key.conv_id", "key.turn", "quote")

"""Queries of the text, parsing and search operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import parse, text
from tessera.operators import explode, search
from tessera.plans.registry import query
from tessera.sources.shared import spread
from tessera.sources.tables import read

QUESTION = "the house and that thing with edin"
STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TOKENS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: t NOT IN ({STOPS}))"
SQUEEZED = "trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g'))"
#: Amounts in several forms made of a part's price: what parse_amount reads.
FORMS = "CASE p_partkey % 8 WHEN 0 THEN 'Rs. ' || n || '/-' WHEN 1 THEN '₹' || n WHEN 2 THEN n || 'k' WHEN 3 THEN n || '.50' WHEN 4 THEN (n // 10) || '.5 lakh' WHEN 5 THEN 'about ' || n WHEN 6 THEN 'INR ' || n || '.00' ELSE n || ' crore' END"


def query_terms(question: str) -> list[str]:
    return sorted({w for w in question.lower().split() if w not in text.STOP_WORDS})


TERMS = query_terms(QUESTION)
BM25 = f"""toks AS (SELECT doc_id, {TOKENS} AS terms FROM documents),
counted AS (SELECT doc_id, len(terms) AS dl, {', '.join(f"len(list_filter(terms, lambda t: t = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))} FROM toks),
stats AS (SELECT count(*) AS n, coalesce(nullif(avg(dl), 0), 1) AS avgdl, {', '.join(f'count(*) FILTER (WHERE tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM counted),
bm25 AS (SELECT doc_id, {' + '.join(f'ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))' for i in range(len(TERMS)))} AS bm25
  FROM counted, stats WHERE greatest({', '.join(f'tf{i}' for i in range(len(TERMS)))}, 0) > 0)"""
COSINE = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), cosine AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], q) AS cos FROM embeddings, q)"
HYBRID = f"""{BM25}, {COSINE},
filled AS (SELECT d.doc_id, coalesce(b.bm25, 0) AS k, c.cos FROM documents d LEFT JOIN bm25 b USING (doc_id) LEFT JOIN cosine c USING (doc_id)),
ends AS (SELECT min(k) AS klo, max(k) AS khi, min(cos) AS clo, max(cos) AS chi FROM filled),
hits AS (SELECT doc_id, 0.7::DOUBLE * CASE WHEN chi - clo > 1e-9 AND cos IS NOT NULL THEN (cos - clo) / (chi - clo) ELSE 0 END + 0.3::DOUBLE * CASE WHEN khi - klo > 1e-9 THEN (k - klo) / (khi - klo) ELSE 0 END AS score FROM filled, ends WHERE cos IS NOT NULL OR k > 0)"""


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = search.term_lists(read(spark, d, "documents"), "doc_id")
    return t.select("doc_id", F.size("terms").cast("long").alias("n_tokens"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, sha256({SQUEEZED}) AS hash FROM documents")
def text_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.text_hash(F.col("text")).alias("hash"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || '__' || p_brand), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM part")
def flatten_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", text.flat(F.concat("p_name", F.lit("__"), "p_brand")).alias("key"))


@query(
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '[ \t\f\x0B]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS hash FROM documents"""
)
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(text.clean_lines(F.col("text")).cast("binary"), 256).alias("hash"))


@query(
    r"""SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '\d|\p{L}+|[^\p{L}\p{N}_\s]'), lambda p: ceil(length(p) / 5))), 0) AS BIGINT) AS n_tokens FROM documents"""
)
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("n_tokens"))


@query("SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS BIGINT) AS n_links, min(u) AS first_link FROM (SELECT page_id, html, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS u FROM pages) GROUP BY page_id, html")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    found = read(spark, d, "pages").select("page_id", text.hrefs(F.col("html")).alias("h")).filter(F.size("h") > 0)
    return found.select("page_id", F.size("h").cast("long").alias("n_links"), F.array_min("h").alias("first_link"))


@query("SELECT c_custkey, 'C' || '.' AS initials, 'customer-' || regexp_extract(c_name, '\\d+') AS slug, CASE WHEN c_mktsegment IN ('HOUSEHOLD') THEN 'household' ELSE lower(c_mktsegment) END AS field FROM customer")
def names_and_slugs(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select("c_custkey", text.initials(F.col("c_name")).alias("initials"), text.slug(F.col("c_name")).alias("slug"), text.canonical_field(text.field_name(F.col("c_mktsegment"))).alias("field"))


@query(
    "SELECT conv_id, turn, q AS is_question, NOT q AND length(trim(text)) > 0 AS is_statement FROM (SELECT conv_id, turn, text, trim(text) LIKE '%?' OR regexp_matches(regexp_replace(trim(text), '(?i)^(?:so|well|hey|btw|also|and|but|oh|ok|okay)[\\s,]+', ''), '(?i)^(?:who|what|when|where|why|how|which|whom|whose|is|are|was|were|do|does|did|can|could|will|would|should|shall|have|has|had|may|might)\\b') AS q FROM conversations WHERE role = 'user')"
)
def question_flags(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "conversations").filter("role = 'user'")
    q = text.is_question(F.col("text"))
    return t.select("conv_id", "turn", q.alias("is_question"), (~q & (F.length(F.trim("text")) > 0)).alias("is_statement"))


@query()
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Look-behind has no form in DuckDB; tests hold it against Python."""
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(text.sentences(F.col("text"))).alias("n_sentences"))


@query(f"SELECT conv_id, turn, CAST(len(list_distinct(list_transform(list_filter({TOKENS}, lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^\\d+$')), lambda t: substr(t, 1, 5)))) AS BIGINT) AS n_stems FROM conversations")
def stem_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(text.stems(F.col("text"))).cast("long").alias("n_stems"))


def price_forms(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor("p_retailprice").cast("long").cast("string")
    k = F.col("p_partkey") % 8
    form = (
        F.when(k == 0, F.concat(F.lit("Rs. "), n, F.lit("/-"))).when(k == 1, F.concat(F.lit("₹"), n)).when(k == 2, F.concat(n, F.lit("k"))).when(k == 3, F.concat(n, F.lit(".50")))
        .when(k == 4, F.concat(F.floor(n.cast("long") / 10).cast("string"), F.lit(".5 lakh"))).when(k == 5, F.concat(F.lit("about "), n)).when(k == 6, F.concat(F.lit("INR "), n, F.lit(".00"))).otherwise(F.concat(n, F.lit(" crore")))
    )
    return read(spark, d, "part").select("p_partkey", n.cast("long").alias("n"), form.alias("form"))


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n * 1000 WHEN 4 THEN (n // 10) * 100000 + 50000 WHEN 6 THEN n WHEN 7 THEN n * 10000000 END AS amount FROM (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS n FROM part)")
def parse_amounts(spark: SparkSession, d: str) -> DataFrame:
    return price_forms(spark, d).select("p_partkey", parse.parse_amount(F.col("form")).alias("amount"))


@query()
def normalized_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Replacement under a condition for each match: Python in Spark, no SQL form."""
    return price_forms(spark, d).select("p_partkey", parse.normalize_amounts(F.concat(F.lit("pays "), "form", F.lit(" or 50-60k"))).alias("text"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN '>=' WHEN 2 THEN '<=' WHEN 3 THEN NULL ELSE '<' END AS op, CASE WHEN c_custkey % 4 <> 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 'rent_amount' ELSE 'monthly_income' END END AS field, CASE WHEN c_custkey % 4 <> 3 THEN c_custkey * 10 END AS amount, CASE c_custkey % 4 WHEN 1 THEN 5000 >= c_custkey * 10 WHEN 2 THEN 5000 <= c_custkey * 10 WHEN 0 THEN 5000 < c_custkey * 10 END AS holds FROM customer")
def condition_checks(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("c_custkey") * 10).cast("string")
    k = F.col("c_custkey") % 4
    quote = (
        F.when(k == 0, F.concat(F.lit("I renew only if the rent stays under Rs. "), n))
        .when(k == 1, F.concat(F.lit("I stay as long as my salary is at least "), n))
        .when(k == 2, F.concat(F.lit("Renew unless rent goes above "), n))
        .otherwise(F.concat(F.lit("Salary is "), n, F.lit(" below market.")))
    )
    c = spread(read(spark, d, "customer"), "c_custkey").select("c_custkey", parse.condition(quote).alias("c"))
    return c.select("c_custkey", "c.op", "c.field", "c.amount", parse.holds(F.col("c.op"), F.lit(5000), F.col("c.amount")).alias("holds"))


@query("SELECT o_orderkey, CAST(age AS BIGINT) AS age, age >= 3 AS of_age FROM (SELECT o_orderkey, 2001 - year(o_orderdate) - CAST((month(o_orderdate), day(o_orderdate)) > (6, 15) AS INT) AS age FROM orders)")
def age_claims(spark: SparkSession, d: str) -> DataFrame:
    years = parse.age(F.to_date("o_orderdate"), F.lit("2001-06-15").cast("date"))
    return read(spark, d, "orders").select("o_orderkey", years.cast("long").alias("age"), (years >= 3).alias("of_age"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN CAST(CAST(ts AS DATE) + 5 AS DATE) WHEN 2 THEN CASE WHEN DATE '2024-03-01' <= CAST(ts AS DATE) THEN DATE '2025-03-01' ELSE DATE '2024-03-01' END END AS valid_from FROM events")
def resolved_dates(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.to_date("ts"), F.col("event_id") % 4
    raw = F.when(k == 0, " ").when(k == 1, F.date_add(day, 5).cast("string")).when(k == 2, "from March").otherwise("someday")
    return read(spark, d, "events").select("event_id", parse.resolve_valid_from(raw, day).alias("valid_from"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size > 0 THEN CAST(p_size AS VARCHAR) END WHEN 1 THEN CASE WHEN p_size BETWEEN 1 AND 100 THEN CAST(p_size AS VARCHAR) END WHEN 2 THEN 'pass' WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'yes' END ELSE p_name END AS clean FROM part")
def clean_values(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    field = F.when(k == 0, "rent_amount").when(k == 1, "percentage").when(k == 2, "result").when(k == 3, "loan_default_12m").otherwise("employer")
    value = F.when(k == 0, F.concat(F.lit("Rs "), size)).when(k == 1, F.concat(size, F.lit(" %"))).when(k == 2, "PASSED").when(k == 3, F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("maybe")).otherwise(F.concat(F.lit(" "), F.col("p_name")))
    return read(spark, d, "part").select("p_partkey", parse.clean_value(field, value).alias("clean"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN 'high' ELSE 'low' END AS grounding FROM orders")
def grounding_levels(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    doc = F.concat(F.lit("Order  "), key, F.lit(" was\nplaced by "), F.col("o_custkey").cast("string"), F.lit(" urgently"))
    k = F.col("o_orderkey") % 3
    quote = F.when(k == 0, F.concat(F.lit("order "), key, F.lit(" WAS placed"))).when(k == 1, F.lit("urgently")).otherwise(F.lit("never said"))
    return read(spark, d, "orders").select("o_orderkey", parse.grounding(doc, quote, F.when(k == 1, "Urgently").otherwise(key)).alias("grounding"))


@query(f"WITH {BM25} SELECT doc_id, round(bm25, 6) AS score FROM bm25 ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = search.bm25(read(spark, d, "documents").select("doc_id", "text"), "doc_id", TERMS)
    return scored.select("doc_id", F.round("bm25", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return read(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]


@query(f"WITH {COSINE} SELECT doc_id AS vec_id, round(cos, 6) AS score FROM cosine ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = search.cosine_to(read(spark, d, "embeddings"), "vec_id", query_vector(spark, d))
    return scored.select("vec_id", F.round("cos", 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


def hybrid_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    cosine = search.cosine_to(read(spark, d, "embeddings"), "vec_id", query_vector(spark, d)).withColumnRenamed("vec_id", "doc_id")
    return search.hybrid(docs, "doc_id", cosine, search.bm25(docs.select("doc_id", "text"), "doc_id", TERMS))


@query(f"WITH {HYBRID} SELECT doc_id, round(score, 6) AS score FROM hits")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return hybrid_hits(spark, d).select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"WITH {HYBRID}, few AS (SELECT h.doc_id, score, source, row_number() OVER (PARTITION BY source ORDER BY score DESC, h.doc_id) AS dr FROM hits h JOIN documents USING (doc_id)), top AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM few WHERE dr <= 2) SELECT doc_id, source, round(score, 6) AS score, rank FROM top WHERE rank <= 6 AND (score >= 0.3 OR rank <= 2)"
)
def hybrid_capped(spark: SparkSession, d: str) -> DataFrame:
    hits = hybrid_hits(spark, d).join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return search.capped(hits, "doc_id", "source").select("doc_id", "source", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("WITH s AS (SELECT c_custkey, c_acctbal AS x FROM customer), e AS (SELECT min(x) AS lo, max(x) AS hi FROM s) SELECT c_custkey, round(CASE WHEN hi - lo > 1e-9 THEN (x - lo) / (hi - lo) ELSE 0 END, 6) AS score FROM s, e")
def minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    return search.minmax(read(spark, d, "customer"), "c_acctbal", "m").select("c_custkey", F.round("m", 6).alias("score"))


@query("SELECT l_partkey AS id, max(score) AS score FROM (SELECT l_partkey, l_quantity AS score FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey, l_quantity + 1 FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def best_of_merge(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    a = li.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("score"))
    b = li.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), (F.col("l_quantity") + 1).alias("score"))
    return search.best_of([a, b], "id")


@query("WITH h AS (SELECT c_custkey AS id, c_acctbal / 10000 AS score FROM customer WHERE c_acctbal > 5000), l AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority LIKE '1%') SELECT id, round(coalesce(score, 0) + CASE WHEN l.id IS NOT NULL THEN 0.3 ELSE 0 END, 6) AS score FROM (SELECT coalesce(h.id, l.id) AS id, h.score, l.id AS lid FROM h FULL JOIN l ON h.id = l.id) x LEFT JOIN l USING (id)")
def graph_boost(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("score"))
    linked = read(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("id"))
    return search.boosted(hits, linked, "id").select("id", F.round("score", 6).alias("score"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER w AS s, row_number() OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE s <= 800 OR r = 1")
def context_fit(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"), (-F.col("turn")).alias("rank"))
    return search.fitting(turns, ["conv_id"], "rank", "size", 800).select("conv_id", "turn")


@query(
    f"SELECT conv_id, turn, p IS NOT NULL AND (regexp_matches(text, '(?i)^\\s*(?:and|also|what about|how about)\\b') OR regexp_matches(text, '(?i)\\b(?:it|its|that|this|they|them|those|these)\\b') AND len({TOKENS}) <= 4) AS leans FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role = 'user' AND trim(text) <> '')"
)
def follow_up_turns(spark: SparkSession, d: str) -> DataFrame:
    return search.follow_ups(read(spark, d, "conversations")).select("conv_id", "turn", "leans")


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """A chunk's start depends on the end before it; tests hold cover, size and overlap."""
    return explode.chunks(read(spark, d, "documents").select("doc_id", "text"))


@query(
    f"WITH b AS (SELECT item_id, list_distinct({TOKENS}) AS q FROM benchmark), p AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS token FROM documents), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1) SELECT item_id, count(*) AS n_known, min(df.df) AS rarest FROM (SELECT item_id, unnest(q) AS token FROM b) x JOIN df USING (token) GROUP BY 1"
)
def document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    df = search.postings(read(spark, d, "documents"), "doc_id").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    asked = search.term_lists(read(spark, d, "benchmark"), "item_id").select("item_id", F.explode(F.array_distinct("terms")).alias("token"))
    return df.join(asked, "token").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_known"), F.min("df").alias("rarest"))

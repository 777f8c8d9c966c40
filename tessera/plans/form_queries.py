"""Queries of the forms of names, notes, questions and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import forms, parse, text
from tessera.operators import graph, views
from tessera.plans.registry import query
from tessera.plans.text_queries import TOKENS
from tessera.sources.shared import spread
from tessera.sources.tables import read

#: Part names with company suffixes, whole and cut short.
ENDINGS = [" Pvt L", " PRIVATE LIMITED", " pte", " P", " P. Limit", ""]
ENDED = f"p_name || ([{', '.join(repr(e) for e in ENDINGS)}])[p_partkey % {len(ENDINGS)} + 1]"


def ended(column: str = "p_name") -> F.Column:
    return F.concat(column, F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("p_partkey") % len(ENDINGS) + 1).cast("int")))


@query(
    f"""SELECT p_partkey, CASE WHEN regexp_matches(n, {(one := "'(?i)\\S (pvt|pte|private|p)[^\\p{L}\\p{N}\\s]* (l|lt|li|lim|limi|limit|limite)[^\\p{L}\\p{N}\\s]*$'")})
    THEN regexp_replace(n, '(?i) \\S+ \\S+$', '') ELSE regexp_replace(n, '(?i) (pvt|pte|private)[^\\p{{L}}\\p{{N}}\\s]*$', '') END AS name FROM (SELECT p_partkey, {ENDED} AS n FROM part)"""
)
def cut_suffixes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", forms.without_cut_suffix(ended()).alias("name"))


@query(
    """WITH w AS (SELECT p_partkey, p_partkey % 3 AS k, upper(p_name) || ' ltd SBI' AS n, string_split(lower(p_name), ' ') AS ws FROM part),
    t AS (SELECT p_partkey, k, array_to_string(list_transform(ws, lambda x: upper(x[1]) || x[2:]), ' ') AS title, array_to_string(list_transform(ws, lambda x: CASE WHEN length(x) <= 3 OR NOT regexp_matches(x, '[aeiouy]') THEN upper(x) ELSE upper(x[1]) || x[2:] END), ' ') AS kept FROM w)
    SELECT p_partkey, CASE k WHEN 0 THEN title || ' Ltd Sbi' WHEN 1 THEN kept || ' Ltd SBI' ELSE kept || ' LTD SBI' END AS shown FROM t"""
)
def shown_names(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("PERSON"), F.lit("ORG"), F.lit("PROJECT")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", forms.shown_name(kind, F.upper(F.concat("p_name", F.lit("  ltd sbi")))).alias("shown"))


@query()
def text_segments(spark: SparkSession, d: str) -> DataFrame:
    """Look-behind has no form in DuckDB; tests hold known cases."""
    return read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(forms.segments(F.col("text"))).alias("n", "segment"))


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS project, CASE p_partkey % 2 WHEN 0 THEN [split_part(p_brand, '#', 1), p_type, 'x y'] ELSE [split_part(p_brand, '#', 1), p_type] END AS related FROM part"
)
def note_layouts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    note = F.concat(
        F.when(k % 3 == 0, F.lit("Project: none yet\n")).otherwise(F.concat(F.lit("- project: [["), "p_name", F.lit("#plan|the plan]]\n"))),
        F.lit("text [[elsewhere]]\n## Related:\n* [["), "p_brand", F.lit("]] and [["), "p_type", F.lit("|t]]\n"),
        F.when(k % 2 == 0, F.lit("2. [[x  y]]\n")).otherwise(F.lit("\n- [[x y]]\n")), F.lit("end\n- [[after]]"),
    )
    return read(spark, d, "part").select("p_partkey", forms.note_structure(note).alias("s")).select("p_partkey", "s.project", "s.related")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'document' ELSE array_to_string(list_transform(list_filter(regexp_split_to_array(lower(p_name || '-' || p_type) || '_pan', '[_\\-\\s]+'), lambda w: w <> ''), lambda w: CASE WHEN w = 'pan' THEN 'PAN' ELSE w END), ' ') END AS document,
    'Mock ' || upper(p_brand[1]) || lower(p_brand[2:]) || ' PAN' AS issuer FROM part"""
)
def spoken_names(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("p_partkey") % 4 == 0, "/docs/a/Signed.pdf").otherwise(F.concat(F.lit("docs/x.y/"), "p_name", F.lit("-"), "p_type", F.lit("_PAN_signed.v2.pdf")))
    path = F.regexp_replace(path, "\\.v2", "")
    return read(spark, d, "part").select("p_partkey", forms.document_words(path).alias("document"), forms.words_of(F.lower(F.concat(F.lit("mock_"), "p_brand", F.lit("_pan"))), True).alias("issuer"))


@query("SELECT p_partkey, 'Is pay ' || CASE p_partkey % 3 WHEN 0 THEN n * 1000 ELSE n END || ' and share ' || p_size || '?' AS question FROM (SELECT *, CAST(floor(p_retailprice) AS BIGINT) AS n FROM part)")
def question_forms(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.floor("p_retailprice").cast("long").cast("string"), F.col("p_partkey") % 3
    pay = F.when(k == 0, F.concat(n, F.lit("k per month"))).when(k == 1, F.concat(F.lit("₹"), n, F.lit("/month"))).otherwise(F.concat(F.lit("Rs. "), n, F.lit(" p.m.")))
    asked = F.concat(F.lit("Is pay "), pay, F.lit(" and share "), "p_size", F.when(k == 1, " percent?").otherwise("%?"))
    return read(spark, d, "part").select("p_partkey", forms.question_form(asked).alias("question"))


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(CAST(ts AS DATE) + 40 AS DATE) WHEN 1 THEN CASE WHEN DATE '2024-03-01' <= CAST(ts AS DATE) THEN DATE '2025-03-01' ELSE DATE '2024-03-01' END WHEN 2 THEN CAST(CAST(ts AS DATE) - 3 AS DATE) ELSE CAST(ts AS DATE) END AS valid_from FROM events"
)
def starts_in_quotes(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.to_date("ts"), F.col("event_id") % 4
    quote = (
        F.when(k == 0, F.concat(F.lit("on 2020-01-02 we said effective "), F.date_format(F.date_add(day, 40), "dd-MM-yyyy")))
        .when(k == 1, F.lit("rent goes up from March"))
        .when(k == 2, F.concat(F.lit("paid "), F.date_format(F.date_sub(day, 3), "d MMMM yyyy"), F.lit(" and 2001-01-01")))
        .otherwise(F.lit("in 31/02/2024 nothing, maybe"))
    )
    return spread(read(spark, d, "events"), "event_id").select("event_id", forms.valid_from_in(quote, day).alias("valid_from"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(ts AS DATE) END AS day, CASE WHEN event_id % 2 = 0 THEN CAST(ts AS DATE) END AS grounded FROM events")
def leading_dates(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.to_date("ts"), F.col("event_id") % 5
    stated = F.when(k == 0, F.date_format(day, "yyyy-M-d")).when(k == 1, F.date_format(day, "d.MM.yyyy")).when(k == 2, F.date_format(day, "d'th' MMM, yyyy")).when(k == 3, F.date_format(day, "MMMM d, yyyy")).otherwise("31/02/2024")
    body = F.when(F.col("event_id") % 2 == 0, F.date_format(day, "'on' dd 'of' yy")).otherwise("on no day of 1999")
    found = forms.grounded_date(day.cast("string"), body)
    return read(spark, d, "events").select("event_id", forms.leading_date(F.concat(F.lit(" "), stated, F.lit(" at noon"))).alias("day"), found.alias("grounded"))


@query(
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(year(ts) AS VARCHAR) WHEN 1 THEN strftime(ts, '%Y-%m-%d') END AS born, CASE WHEN event_id % 3 > 0 THEN strftime(date_trunc('second', ts) - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') END AS generated FROM events"
)
def record_times(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    born = F.when(k == 0, F.date_format("ts", "yyyy")).when(k == 1, F.date_format("ts", "d/M/yyyy")).otherwise("40-01-2003")
    reference = F.concat(F.lit("1234"), F.date_format("ts", "yyyyMMddHHmmss"), F.when(k == 0, "12").otherwise("123"))
    return read(spark, d, "events").select("event_id", forms.birth(born).alias("born"), forms.generated_at(reference).alias("generated"))


@query("SELECT c_custkey, c_custkey % 4 IN (0, 1) AS found FROM customer")
def holder_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    said = (
        F.when(k == 0, "Account of RAVI kumar, Ravi!").when(k == 1, "Kumar (son of) Ravi Ravi").when(k == 2, "Ravi Kumar lives here").otherwise("Ravi Ravi and all others with Kumar")
    )
    words = read(spark, d, "customer").select("c_custkey", forms.letters(said).alias("words"), forms.letters(F.lit("Ravi Ravi Kumar")).alias("name"))
    return words.select("c_custkey", forms.names_holder(F.col("words"), F.col("name")).alias("found"))


@query(
    f"WITH b AS (SELECT item_id, list_distinct({TOKENS}) AS q FROM benchmark), t AS (SELECT conv_id, turn, list_distinct({TOKENS}) AS w FROM conversations) SELECT conv_id, turn, item_id, CAST(len(list_intersect(q, w)) AS BIGINT) AS shared FROM t JOIN b ON conv_id = item_id"
)
def shared_tokens(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("q"))
    said = read(spark, d, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("w"))
    both = F.size(F.array_intersect("q", "w")).cast("long")
    return said.join(asked, F.col("conv_id") == F.col("item_id")).select("conv_id", "turn", "item_id", both.alias("shared"))


@query("SELECT lower(regexp_replace(p_name, ' .*', '')) AS segment, count(*) AS n FROM part GROUP BY 1")
def compacted_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompt forms of a padded name: rules, bars and blanks collapse to one row each."""
    padded = F.concat(F.lit("\n\n-----\n"), "p_name", F.lit("   |  | x\n \n\n"))
    body = F.regexp_extract(text.compacted(padded), "^-\n(\\S+) \\S+ \\| x$", 1)
    return read(spark, d, "part").groupBy(F.lower(body).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT e.event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS allowed FROM events e"""
)
def allowed_relations(spark: SparkSession, d: str) -> DataFrame:
    def pick(*values: str) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % 4 + 1).cast("int"))

    ok = graph.relation_allowed(pick("EMPLOYED_BY", "EMPLOYED_BY", "RELATES_TO", "MENTIONED_IN"), pick("PERSON", "ORG", "EVENT", "ORG"), pick("ORG", "ORG", "PLACE", "PERSON"))
    return read(spark, d, "events").select("event_id", ok.alias("allowed"))


@query("""SELECT c_custkey, 'see ' || CASE WHEN c_custkey % 3 = 0 THEN '‹/' || 'Chunk' WHEN c_custkey % 3 = 1 THEN '‹' || 'context' ELSE '<b' END || '> ' || c_name AS safe FROM customer""")
def escaped_tags(spark: SparkSession, d: str) -> DataFrame:
    """Marks of a prompt's own parts made harmless; other marks stay."""
    tag = F.when(F.col("c_custkey") % 3 == 0, "</Chunk").when(F.col("c_custkey") % 3 == 1, "<context").otherwise("<b")
    return read(spark, d, "customer").select("c_custkey", text.escaped(F.concat(F.lit("see "), tag, F.lit("> "), "c_name")).alias("safe"))


@query("""WITH s AS (SELECT p_partkey, 'we saw ' || CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN split_part(p_name, ' ', 1) || ' alone' ELSE 'x' || p_name || 'x' END || ' today' AS segment, p_name AS key, p_partkey % 2 = 0 AS person FROM part)
SELECT p_partkey, contains(' ' || segment || ' ', ' ' || key || ' ') OR (person AND contains(key, ' ') AND contains(' ' || segment || ' ', ' ' || split_part(key, ' ', 1) || ' ')) AS named FROM s""")
def segment_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Is a key named in a segment as whole words, a person's by the first name too?"""
    said = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.substring_index("p_name", " ", 1), F.lit(" alone"))).otherwise(F.concat(F.lit("x"), "p_name", F.lit("x")))
    segment = F.concat(F.lit("we saw "), said, F.lit(" today"))
    return read(spark, d, "part").select("p_partkey", text.mentions(segment, F.col("p_name"), F.col("p_partkey") % 2 == 0).alias("named"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_id % 3 = 0 THEN 'mcp' ELSE 'direct' END AS channel FROM events")
def request_channels(spark: SparkSession, d: str) -> DataFrame:
    header = F.when(F.col("event_id") % 3 == 0, "mcp").when(F.col("event_id") % 3 == 1, "web")
    return read(spark, d, "events").select("event_id", views.channel(F.col("user_id") % 2 == 0, header).alias("channel"))


@query("""WITH t AS (SELECT o_orderkey, 'paid ' || strftime(o_orderdate, '%-d %B %Y') || ', due ' || strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') || ' or 31/02/2020' AS text, o_orderdate::DATE AS a FROM orders)
SELECT o_orderkey, 2 AS n, a AS first, a + 40 AS last FROM t""")
def dates_in_texts(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    said = F.concat(F.lit("paid "), F.date_format(day, "d MMMM yyyy"), F.lit(", due "), F.date_format(F.date_add(day, 40), "yyyy-MM-dd"), F.lit(" or 31/02/2020"))
    found = spread(read(spark, d, "orders"), "o_orderkey").select("o_orderkey", parse.explicit_dates(said).alias("f"))
    return found.select("o_orderkey", F.size("f").alias("n"), F.get("f", 0)["day"].alias("first"), F.element_at("f", -1)["day"].alias("last"))

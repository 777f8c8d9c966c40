"""Queries of holders, anchors and their cascade, of reminders and of stated values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import identity, planning
from tessera.plans.registry import query
from tessera.sources.tables import read

NAMES = ["Asha Rao", "Bela Iyer", "Chitra Shah", "Dev Nair"]
TODAY = "1996-06-01"


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


HOLDERS = f"""h AS (SELECT c_custkey AS k, ({NAMES!r})[c_custkey % 4 + 1] AS name, CASE WHEN c_custkey % 6 = 0 THEN '2003' WHEN c_custkey % 6 < 5 THEN '2003-05-14' END AS dob,
  (['Father''s name: Dev Nair' || chr(10), 'Statement of account ', ''])[c_custkey % 3 + 1] || 'Account holder: ' || (['', 'Mr. ', chr(10) || ' ', 'A B C '])[c_custkey % 4 + 1] || upper(({NAMES!r})[(c_custkey + c_nationkey % 2) % 4 + 1]) || chr(10)
  || (['DOB: 14/05/2003', 'Date of birth: 2001-01-01', 'no date', 'D.O.B. soon', 'Birth date: May 14, 2003'])[c_custkey % 5 + 1] AS text FROM customer),
v AS (SELECT *, regexp_extract_all(lower(regexp_extract(text, 'Account holder:[ \\n]*([^\\n]*)', 1)), '[a-z]+')[1:4] AS words, string_split(lower(name), ' ') AS want,
  CASE k % 5 WHEN 0 THEN '2003-05-14' WHEN 1 THEN '2001-01-01' WHEN 4 THEN '2003-05-14' END AS told FROM h)"""


@query(f"""WITH {HOLDERS} SELECT k AS c_custkey, CASE WHEN NOT list_has_all(words, want) THEN 'mismatch' WHEN dob IS NULL THEN 'verified' WHEN told IS NOT NULL AND told[1:length(dob)] <> dob THEN 'mismatch'
WHEN k % 5 = 3 THEN 'unknown' ELSE 'verified' END AS holder_status FROM v""")
def holder_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = read(spark, d, "customer")
    text = F.concat(
        pick(["Father's name: Dev Nair\n", "Statement of account ", ""], k % 3), F.lit("Account holder: "), pick(["", "Mr. ", "\n ", "A B C "], k % 4), F.upper(pick(NAMES, (k + F.col("c_nationkey") % 2) % 4)), F.lit("\n"),
        pick(["DOB: 14/05/2003", "Date of birth: 2001-01-01", "no date", "D.O.B. soon", "Birth date: May 14, 2003"], k % 5),
    )
    dob = F.when(k % 6 == 0, "2003").when(k % 6 < 5, "2003-05-14")
    rows = c.select("c_custkey", F.lit("bank_statement").alias("doc_type"), pick(NAMES, k % 4).alias("name"), dob.alias("dob"), text.alias("text"))
    return identity.checked(rows).select("c_custkey", "holder_status")


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 1 THEN ({NAMES!r})[c_custkey % 4 + 1] || ' ' || c_mktsegment END AS name, CASE WHEN c_custkey % 3 <> 1 AND c_nationkey > 0 THEN '2003-05-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS dob FROM customer""")
def read_cards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(pick(NAMES, k % 4), F.lit("  "), "c_mktsegment")
    label = pick(["Identity card\nName: ", "Mother's name: ", "Identity card Name:\n"], k % 3)
    born = F.concat(F.lit(" Date of birth: "), "c_nationkey", F.lit(" May 2003 ID number: "), k)
    cards = read(spark, d, "customer").select("c_custkey", F.concat(label, name, born).alias("text"))
    return identity.id_cards(cards).select("c_custkey", "name", "dob")


def held_documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as signed documents of customers, and the customers' anchors before and after a change of half of them."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    documents = o.select(
        F.concat(F.lit("d"), k).alias("doc_id"), F.col("o_custkey").alias("owner"), k.alias("seq"), F.lit("bank_statement").alias("doc_type"), F.lit("bank").alias("iss"), F.when(k % 5 == 0, "unsigned").otherwise("issuer_signed").alias("signature_status"),
        F.lit(None).cast("string").alias("holder_status"), F.when(k % 11 == 0, "then").alias("removed_at"), F.concat(F.lit("Account holder: "), pick(NAMES, k % 4), F.lit("\n")).alias("text"),
    )
    c, w = read(spark, d, "customer"), F.col("c_custkey")
    anchors = [c.select(w.alias("owner"), pick(NAMES, n).alias("name"), F.lit(None).cast("string").alias("dob")) for n in (w % 4, (w + w % 2) % 4)]
    return identity.all_checked(documents, anchors[0]), *anchors


CASCADE = """dc AS (SELECT 'd' || o_orderkey AS doc_id, o_orderkey AS k, o_orderkey % 4 = c_custkey % 4 AS was, o_orderkey % 4 = (c_custkey + c_custkey % 2) % 4 AS now FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0),
mv AS (SELECT * FROM dc WHERE was <> now)"""


@query(f"WITH {CASCADE} SELECT doc_id, CASE WHEN was THEN 'verified' ELSE 'mismatch' END AS was, CASE WHEN now THEN 'verified' ELSE 'mismatch' END AS holder_status FROM mv")
def changed_holders(spark: SparkSession, d: str) -> DataFrame:
    return identity.changed_holders(*held_documents(spark, d))


@query(f"""WITH {CASCADE}, f AS (SELECT 'f' || o_orderkey AS fact_id, 'd' || o_orderkey AS doc_id, o_orderkey % 7 = 0 AS shut, NULL AS by_ FROM orders UNION ALL SELECT 'g' || o_orderkey, NULL, true, 'f' || o_orderkey FROM orders),
t AS (SELECT f.*, mv.was AS lost, mv.now AS won, o.was IS NOT NULL AS heir FROM f LEFT JOIN mv USING (doc_id) LEFT JOIN mv o ON f.by_ = 'f' || o.k AND o.was AND o.k % 7 <> 0 AND o.k % 2 = 0)
SELECT fact_id, CASE WHEN lost AND NOT shut THEN DATE '1999-01-01' WHEN heir OR (won AND shut AND by_ IS NULL) THEN NULL WHEN shut THEN DATE '1998-01-01' END AS valid_to, CASE WHEN NOT heir THEN by_ END AS superseded_by,
  CASE WHEN lost AND NOT shut THEN true WHEN won AND shut AND by_ IS NULL THEN false WHEN shut AND by_ IS NULL THEN true END AS withdrawn FROM t""")
def holder_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Facts of documents that changed hands close or reopen, and the closed ones' supporters take over."""
    documents, before, now = held_documents(spark, d)
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    shut = k % 7 == 0
    day = F.lit("1998-01-01").cast("date")
    own = o.select(
        F.concat(F.lit("f"), k).alias("fact_id"), k.alias("seq"), F.concat(F.lit("d"), k).alias("doc_id"), k.cast("string").alias("value"), F.lit("high").alias("confidence"), F.lit("issuer_doc").alias("source_type"), F.to_date("o_orderdate").alias("valid_from"),
        F.when(shut, day).alias("valid_to"), F.lit(None).cast("string").alias("superseded_by"), F.when(shut, True).alias("withdrawn"),
    )
    other = o.select(
        F.concat(F.lit("g"), k).alias("fact_id"), k.alias("seq"), F.lit(None).cast("string").alias("doc_id"), F.when(k % 2 == 0, k).otherwise(-k).cast("string").alias("value"), F.lit("high").alias("confidence"), F.lit("owner_stated").alias("source_type"),
        F.to_date("o_orderdate").alias("valid_from"), day.alias("valid_to"), F.concat(F.lit("f"), k).alias("superseded_by"), F.lit(None).cast("boolean").alias("withdrawn"),
    )
    _, facts = identity.cascade(documents, own.unionByName(other), before, now, "1999-01-01")
    return facts.select("fact_id", "valid_to", "superseded_by", "withdrawn")


@query(f"""SELECT c_custkey, shown, source FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'signed_id' ELSE 'config' END AS source, CASE WHEN c_custkey % 3 = 0 THEN ({NAMES!r})[(SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = 0) % 4 + 1] END AS card FROM customer) t,
LATERAL (SELECT CASE WHEN card IS NOT NULL THEN card[1:1] || '. ' || string_split(card, ' ')[2][1:1] || '.' ELSE 'C.' END AS shown) WHERE NOT (source = 'signed_id' AND card IS NULL)
UNION ALL SELECT c_custkey, 'C.', 'config' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)""")
def pinned_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Of a third of the customers the oldest verified card counts; the others only have a configured name."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    documents = o.select(
        F.concat(F.lit("d"), k).alias("doc_id"), F.col("o_custkey").alias("owner"), k.alias("seq"), F.lit("id_card").alias("doc_type"), F.lit("mock_govt").alias("iss"), F.lit("issuer_signed").alias("signature_status"),
        F.when((k % 2 == 0) & (F.col("o_custkey") % 3 == 0), "verified").otherwise("mismatch").alias("holder_status"), F.lit(None).cast("string").alias("removed_at"), F.concat(F.lit("Name: "), pick(NAMES, k % 4), F.lit("\n")).alias("text"),
    )
    owners = read(spark, d, "customer").select(F.col("c_custkey").alias("owner"), F.lit("Customer").alias("name"))
    old = documents.filter(F.col("owner") < 0).select("owner", "seq", F.lit("ekyc").alias("source"), F.lit("x").alias("name"), F.lit(None).cast("string").alias("dob"), "doc_id", "removed_at")
    return identity.anchors(old, documents, owners).select(F.col("owner").alias("c_custkey"), "shown", "source")


@query(f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN DATE '{TODAY}' + CAST(o_custkey % 90 AS INT) WHEN 1 THEN o_orderdate::DATE WHEN 2 THEN o_orderdate::DATE - CASE WHEN o_custkey % 3 = 0 THEN 7 ELSE CAST(o_custkey % 3 AS INT) END
WHEN 3 THEN DATE '{TODAY}' + 7 END AS day FROM orders""")
def reminder_days(spark: SparkSession, d: str) -> DataFrame:
    o, k, w = read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    said = F.when(k % 5 == 0, F.concat(F.lit("in "), w % 90, F.lit(" days"))).when(k % 5 == 1, F.concat(F.lit("on "), F.date_format("o_orderdate", "d MMMM yyyy"))).when(k % 5 == 3, "next week")
    instruction = F.concat(F.lit("Remind me "), F.coalesce(said, F.when(k % 5 == 2, "before the lease ends").otherwise("some day")))
    steps = o.select("o_orderkey", k.alias("owner"), instruction.alias("instruction"), said.alias("date_text"), F.lit("agreement_end_date").alias("relative_to"), (w % 3).cast("int").alias("days_before"), F.lit(TODAY).cast("date").alias("today"))
    facts = o.select(k.alias("owner"), F.lit("agreement_end_date").alias("field"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"))
    return planning.reminder_days(steps, facts).select("o_orderkey", "day")


@query("""WITH t AS (SELECT c_custkey AS owner, 'The balance ' || CAST(trunc(c_acctbal) AS BIGINT) || ' of AB ' || (c_custkey * 7) || ', not ' || (c_custkey + 1) || '9' AS text FROM customer),
v AS (SELECT c_custkey AS owner, unnest(['balance', 'code', 'next']) AS field, unnest([CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR), 'AB ' || (c_custkey * 7), CAST(c_custkey + 1 AS VARCHAR)]) AS value FROM customer)
SELECT owner AS c_custkey, field FROM t JOIN v USING (owner) WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) >= 3 AND regexp_matches(text, '(^|[^0-9])' || value || '([^0-9]|$)')""")
def stated_values(spark: SparkSession, d: str) -> DataFrame:
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    balance = F.col("c_acctbal").cast("long").cast("string")
    texts = c.select(k.alias("text_id"), k.alias("owner"), F.concat(F.lit("The balance "), balance, F.lit(" of AB "), k * 7, F.lit(", not "), k + 1, F.lit("9")).alias("text"))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("balance", balance), ("code", F.concat(F.lit("AB "), k * 7)), ("next", (k + 1).cast("string")))])
    return planning.stated_values(texts, c.select(k.alias("owner"), F.inline(cells))).select(F.col("owner").alias("c_custkey"), "field")


@query("""WITH p AS (SELECT p_partkey, CAST(p_retailprice * 100 AS BIGINT) AS n, p_name FROM part), s AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'costs ' || format('{:,}', n) WHEN 1 THEN p_name || ' at ' || n ELSE 'costs nothing' END AS passage FROM p)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 6 WHEN 1 THEN length(p_name) + 4 END AS first, CASE p_partkey % 3 WHEN 0 THEN length(passage) WHEN 1 THEN length(passage) END AS last FROM s""")
def highlights(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("p_retailprice") * 100).cast("decimal(20,0)").cast("long")
    k = F.col("p_partkey")
    passage = F.when(k % 3 == 0, F.concat(F.lit("costs "), F.regexp_replace(n.cast("string"), "(?<=\\d)(?=(?:\\d{3})+$)", ","))).when(k % 3 == 1, F.concat("p_name", F.lit(" at "), n)).otherwise("costs nothing")
    found = planning.highlight(passage, n.cast("string"))
    return read(spark, d, "part").select("p_partkey", found["start"].alias("first"), found["end"].alias("last"))

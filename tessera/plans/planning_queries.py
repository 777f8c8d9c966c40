"""Queries of planned tool calls and of the check before they run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import planning
from tessera.plans.registry import query
from tessera.sources.tables import read

TODAY = "1996-06-01"
SAID = ["Write to Zed@b.example, remind me; fill the form and save a note", "Remind me", "Please think", "Send proof by mail, log it", "The application form and an alarm"]
STEPS = """b AS (SELECT o_custkey AS c, o_orderkey AS k, (['draft_email', 'create_reminder', 'fill_rental_form', 'save_note'])[o_orderkey % 4 + 1] AS tool, c_name AS owner_name, o_orderdate::DATE AS d, o_orderpriority AS subject,
  CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) AS bal, CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment END AS job, CASE o_orderkey % 3 WHEN 0 THEN 'zed@B.example' WHEN 1 THEN 's' || o_custkey || '@mail.example' END AS address,
  (['Write to Zed@b.example, remind me; fill the form and save a note', 'Remind me', 'Please think', 'Send proof by mail, log it', 'The application form and an alarm'])[o_custkey % 5 + 1] AS said FROM orders JOIN customer ON c_custkey = o_custkey),
x AS (SELECT *, CASE c % 5 WHEN 0 THEN true WHEN 1 THEN tool = 'create_reminder' WHEN 2 THEN false WHEN 3 THEN tool IN ('draft_email', 'save_note') ELSE tool IN ('fill_rental_form', 'create_reminder') END AS asked,
  c % 5 = 3 OR k % 13 = 0 AS wants, c % 3 = 0 AS has, length(regexp_replace(bal, '[^0-9]', '', 'g')) >= 3 AS long_, CASE WHEN k % 11 <> 0 THEN d END AS day,
  CASE WHEN k % 5 = 0 THEN 'My income is ' || bal ELSE 'Hi,' END || chr(10) || chr(10) || 'Thanks,' || chr(10) || owner_name AS body, CASE WHEN k % 7 = 0 THEN 'Keep ' || bal ELSE said END AS note,
  CASE WHEN regexp_matches(bal, '^[0-9]+$') THEN '₹' || format('{:,}', bal::BIGINT) ELSE bal END AS money FROM b),
y AS (SELECT *, CASE WHEN k % 2 = 0 THEN concat_ws(', ', 'Monthly income: ' || money, 'Employer: ' || job) ELSE concat_ws(', ', 'Full name: ' || owner_name, 'Employer: ' || job) END AS form,
  CASE WHEN tool = 'draft_email' AND address IS NULL OR tool = 'create_reminder' AND day IS NULL THEN 'unbuilt' WHEN tool = 'draft_email' AND NOT (k % 3 = 1 AND c % 2 = 0 OR k % 3 = 0 AND c % 5 = 0) OR tool = 'create_reminder' AND day <= DATE '1996-06-01' THEN 'invalid' END AS bad,
  asked AND count(*) FILTER (WHERE asked) OVER (PARTITION BY c ORDER BY k) <= 4 AS taken FROM x),
z AS (SELECT *, CASE tool WHEN 'draft_email' THEN address || subject || body || (wants AND has) WHEN 'create_reminder' THEN 'T' || k % 2 || day WHEN 'fill_rental_form' THEN form ELSE note END AS argument FROM y),
w AS (SELECT *, CASE WHEN NOT asked THEN 'unasked' WHEN NOT taken THEN 'beyond' WHEN bad IS NOT NULL THEN bad WHEN row_number() OVER (PARTITION BY c, tool, argument, taken, bad ORDER BY k) > 1 THEN 'repeat' ELSE 'call' END AS state FROM z)"""


def proposed(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Orders as proposed steps, customers as owners with their facts, addresses and proofs."""
    c = read(spark, d, "customer")
    k, w, tool = F.col("o_orderkey"), F.col("o_custkey"), F.array(*[F.lit(t) for t in planning.TOOL_WORDS])
    day = F.to_date("o_orderdate")
    bal = F.col("c_acctbal").cast("long").cast("string")
    rows = read(spark, d, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), bal.alias("bal")), "o_custkey")
    none = F.lit(None).cast("string")
    address = F.when(k % 3 == 0, "zed@B.example").when(k % 3 == 1, F.concat(F.lit("s"), w, F.lit("@mail.example")))
    steps = rows.select(
        w.alias("task_id"), k.alias("seq"), w.alias("owner"), F.get(tool, (k % 4).cast("int")).alias("tool"), F.get(F.array(*[F.lit(s) for s in SAID]), (w % 5).cast("int")).alias("instruction"), F.lit(TODAY).cast("date").alias("today"), F.when(k % 2 == 0, "my aunt").alias("recipient"),
        F.when(k % 3 == 0, "Zed").otherwise(address).alias("name"), address.alias("address"), F.col("o_orderpriority").alias("subject"), F.when(k % 5 == 0, F.concat(F.lit("My income is "), "bal")).otherwise("  ").alias("body"), (k % 13 == 0).alias("attach_proof"),
        F.when(k % 4 == 1, F.concat(F.lit("T"), k % 2)).otherwise(none).alias("title"), F.when(k % 11 != 0, day).alias("day"), F.lit("agreement_end_date").alias("relative_to"), F.when(k % 3 == 0, F.date_add(day, 7)).when(k % 3 == 1, day).alias("base_day"),
        F.when(k % 2 == 0, F.array(F.lit("monthly_income"), F.lit("employer"), F.lit("hobby"), F.lit("employer"))).alias("form_fields"), F.when(k % 7 == 0, F.concat(F.lit("Keep "), "bal")).alias("markdown"),
    )
    owner = F.col("c_custkey").alias("owner")
    facts = c.select(owner, F.lit("monthly_income").alias("field"), bal.alias("value")).unionByName(c.filter("c_nationkey % 3 <> 0").select(owner, F.lit("employer").alias("field"), F.col("c_mktsegment").alias("value")))
    emails = c.filter("c_custkey % 2 = 0").select(owner, F.concat(F.lit("s"), "c_custkey", F.lit("@mail.example")).alias("email"))
    proofs = c.filter("c_custkey % 3 = 0").select(owner, F.explode(F.array(F.lit(2), F.lit(1))).alias("at")).withColumn("request_id", F.concat_ws("-", F.lit("q"), "owner", "at"))
    return steps, facts, emails, proofs, c.select(owner, F.col("c_name").alias("owner_name"))


@query(f"""WITH {STEPS} SELECT c AS task_id, k AS seq, state, CASE WHEN state <> 'call' THEN NULL ELSE CASE tool
WHEN 'draft_email' THEN 'Email to ' || CASE WHEN k % 3 = 0 THEN 'Zed <' || address || '>' ELSE address END || ': “' || subject || '”' || CASE WHEN wants AND has THEN ' + 1 proof attachment' ELSE '' END || chr(10) || chr(10) || body
WHEN 'create_reminder' THEN 'Reminder on ' || strftime(day, '%-d %b %Y') || CASE WHEN k % 3 = 0 THEN ' (7 days before agreement end date ' || strftime(d + 7, '%-d %b %Y') || ')' ELSE '' END || ': T' || k % 2
WHEN 'fill_rental_form' THEN 'Rental form with ' || form ELSE 'Save note “Note” to your vault' || chr(10) || chr(10) || note END END AS preview,
CASE WHEN NOT taken THEN '' ELSE concat_ws('|', CASE WHEN tool = 'draft_email' AND address IS NULL THEN 'No email address for “' || CASE WHEN k % 2 = 0 THEN 'my aunt' ELSE 'the recipient' END || '” in your vault; type the address in the instruction to use it.' END,
  CASE WHEN tool = 'draft_email' AND address IS NOT NULL AND wants AND NOT has THEN 'No answered proof to attach yet; the email is drafted without one.' END, CASE WHEN tool = 'draft_email' AND address IS NOT NULL AND k % 5 = 0 AND long_ THEN 'The email states your monthly income; a proof shares less.' END,
  CASE WHEN tool = 'draft_email' AND bad = 'invalid' THEN 'Left out draft email: ' || address || ' is not a known contact and was not typed by you.' END,
  CASE WHEN tool = 'create_reminder' AND bad = 'unbuilt' THEN 'Couldn''t tell when to remind you about “T' || k % 2 || '”; add a date to the instruction.' WHEN tool = 'create_reminder' AND bad = 'invalid' THEN 'Left out create reminder: ' || day || ' is not in the future.' END,
  CASE WHEN tool = 'fill_rental_form' AND job IS NULL THEN 'No employer in your documents; left off the form.' END, CASE WHEN tool = 'save_note' AND k % 7 = 0 AND long_ THEN 'The note states your monthly income.' END) END AS warnings FROM w""")
def planned_calls(spark: SparkSession, d: str) -> DataFrame:
    calls, _ = planning.planned(*proposed(spark, d))
    return calls.select("task_id", "seq", "state", "preview", F.array_join("warnings", "|").alias("warnings"))


@query("SELECT DISTINCT o_custkey AS task_id FROM orders WHERE o_custkey % 5 = 2 OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 5 = 0 OR o_custkey % 5 = 1 AND o_orderkey % 4 = 1 OR o_custkey % 5 = 3 AND o_orderkey % 4 IN (0, 3) OR o_custkey % 5 = 4 AND o_orderkey % 4 IN (1, 2))")
def tasks_without_steps(spark: SparkSession, d: str) -> DataFrame:
    return planning.planned(*proposed(spark, d))[1]


@query(f"""WITH {STEPS} SELECT c AS task_id, k AS seq, CASE WHEN c % 7 = 0 THEN 'unknown task' WHEN c % 7 = 1 THEN 'task is rejected, not approved' WHEN tool = 'draft_email' AND NOT (k % 3 = 1 AND c % 4 = 0 OR k % 3 = 0 AND c % 5 = 0) THEN address || ' is not a known contact and was not typed by the owner'
WHEN tool = 'draft_email' AND wants AND has AND c % 9 = 0 THEN 'q-' || c || '-2 is not an answered request with a proof' WHEN tool = 'create_reminder' AND day <= DATE '1997-01-01' THEN day || ' is not in the future' END AS reason FROM w WHERE state = 'call'""")
def runnable_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the plan, checked again on a later day, with fewer addresses and proofs than when they were planned."""
    steps, facts, emails, proofs, owners = proposed(spark, d)
    calls, _ = planning.planned(steps, facts, emails, proofs, owners)
    tasks = steps.select("task_id", F.when(F.col("task_id") % 7 == 1, "rejected").otherwise("approved").alias("status"), "instruction", F.lit("1997-01-01").cast("date").alias("today")).filter("task_id % 7 <> 0").distinct()
    return planning.runnable(calls.filter("state = 'call'").withColumn("owner", F.col("task_id")), tasks, emails.filter("owner % 4 = 0"), proofs.filter("owner % 9 <> 0"))


@query(f"""WITH f AS (SELECT c_custkey AS owner, o_orderpriority AS field, o_orderkey AS seq, o_orderdate::DATE AS s, 'v' || o_orderkey AS value, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE + 400 END AS e FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0),
g AS (SELECT *, s <= DATE '{TODAY}' AND (e IS NULL OR e > DATE '{TODAY}') AS now FROM f)
SELECT owner, field, coalesce(arg_max(value, (s, seq)) FILTER (WHERE now), arg_min(value, (s, seq)) FILTER (WHERE s > DATE '{TODAY}')) AS value FROM g WHERE now OR s > DATE '{TODAY}' GROUP BY ALL""")
def plannable_facts(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    facts = read(spark, d, "orders").select(
        F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("field"), k.alias("seq"), F.concat(F.lit("v"), k).alias("value"), day.alias("valid_from"), F.when(k % 4 == 0, F.date_add(day, 400)).alias("valid_to"),
        F.when(k % 6 == 0, "low").otherwise("high").alias("confidence"), F.when(k % 5 == 0, "owner_stated").otherwise("extracted").alias("source_type"),
    )
    return planning.plannable_facts(facts, TODAY)


@query("""WITH p AS (SELECT s_suppkey % 3 AS owner, s_suppkey AS pos, (['Ravi', 'Asha', 'Meera', 'Jon'])[s_suppkey % 4 + 1] || ' ' || (['Rao', 'Shah', 'Bank'])[s_suppkey // 4 % 3 + 1] AS name, s_suppkey % 2 = 0 AS person, 's' || s_suppkey || '@mail.example' AS email, (['LANDLORD_OF', 'EMPLOYED_BY', 'BANKS_WITH'])[s_suppkey % 5 + 1] AS rel FROM supplier WHERE s_suppkey % 7 <> 1),
r AS (SELECT owner, rel, arg_min(name, pos) AS name, arg_min(email, pos) AS email FROM p WHERE rel IS NOT NULL GROUP BY ALL), a AS (SELECT owner, lower(name) AS alias, pos, name, email FROM p UNION ALL SELECT owner, lower(regexp_extract(name, '^[A-Za-z]+')), pos, name, email FROM p WHERE person),
s AS (SELECT o_custkey % 3 AS owner, o_orderkey AS k, (['my landlord', 'Ravi!', 'To Asha  RAO please', 'HR', 'w' || o_custkey || '@x.example', NULL, 'Jon, my bank manager'])[o_orderkey % 7 + 1] AS said, o_orderkey % 4 AS m, o_custkey AS c FROM orders),
n AS (SELECT k, min(a.pos) AS pos FROM s JOIN a ON a.owner = s.owner AND contains(' ' || trim(regexp_replace(lower(said), '[^a-z]+', ' ', 'g')) || ' ', ' ' || alias || ' ') GROUP BY 1)
SELECT s.k AS seq, CASE WHEN k % 7 = 4 AND m = 0 THEN 'W' || c || '@x.example' ELSE coalesce(r.name, p.name, CASE m WHEN 0 THEN 'W' || c || '@x.example' WHEN 3 THEN 'a@x.example' END) END AS name, CASE WHEN k % 7 = 4 AND m = 0 THEN 'W' || c || '@x.example' ELSE coalesce(r.email, p.email, CASE m WHEN 0 THEN 'W' || c || '@x.example' WHEN 3 THEN 'a@x.example' END) END AS address
FROM s LEFT JOIN r ON r.owner = s.owner AND r.rel = CASE k % 7 WHEN 0 THEN 'LANDLORD_OF' WHEN 3 THEN 'EMPLOYED_BY' WHEN 6 THEN 'BANKS_WITH' END LEFT JOIN n USING (k) LEFT JOIN p ON p.pos = n.pos""")
def resolved_recipients(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as contacts of three owners."""
    s, i = read(spark, d, "supplier"), F.col("s_suppkey")
    pick = lambda listed, at: F.get(F.array(*[F.lit(x) if isinstance(x, str) or x is None else x for x in listed]), at.cast("int"))
    name = F.concat_ws(" ", pick(["Ravi", "Asha", "Meera", "Jon"], i % 4), pick(["Rao", "Shah", "Bank"], F.floor(i / 4) % 3))
    rels = F.array_compact(F.array(pick(["LANDLORD_OF", "EMPLOYED_BY", "BANKS_WITH"], i % 5)))
    contacts = s.select((i % 3).alias("owner"), i.alias("pos"), F.when(i % 2 == 0, "PERSON").otherwise("ORG").alias("type"), name.alias("name"), F.lower(name).alias("key"), F.when(i % 7 != 1, F.concat(F.lit("s"), i, F.lit("@mail.example"))).alias("email"), rels.alias("rels"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = pick(["my landlord", "Ravi!", "To Asha  RAO please", "HR", F.concat(F.lit("w"), c, F.lit("@x.example")), None, "Jon, my bank manager"], k % 7)
    typed = pick([F.concat(F.lit("write to W"), c, F.lit("@x.example")), "write", "a@x.example and b@x.example", "tell A@x.example or a@x.example"], k % 4)
    steps = read(spark, d, "orders").select(c.alias("task_id"), k.alias("seq"), (c % 3).alias("owner"), said.alias("recipient"), typed.alias("instruction"))
    return planning.resolved_recipients(steps, contacts).select("seq", "name", "address")

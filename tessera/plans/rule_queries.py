"""Queries of text rules over whole texts; their SQL works each rule out from the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import parse, text
from tessera.plans.registry import query
from tessera.sources.tables import read

LABELS = "|".join(text.CONTACT_LABELS)


@query(rf"""SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE contains(line, '@') OR regexp_matches(line, '[0-9](?:[ \t\n\x0B\f\r().-]*[0-9]){{9}}') OR regexp_matches(lower(line), '\b(?:{LABELS})(?:\s*(?:number|no\.?))? *[:=]')) AS n_contacts
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""")
def contact_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(text.is_contact_line(F.col("line"))).alias("n_contacts"))


@query(r"""SELECT page_id, upper(substr(t, 1, 1)) || substr(t, 2) AS title FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)""")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.note_title(F.col("url")).alias("title"))


@query(r"""WITH n AS (SELECT conv_id, turn, role, trim(regexp_replace(trim(text), '\.+$', '')) AS n FROM conversations WHERE text IS NOT NULL), c AS (SELECT *, CASE WHEN length(n) <= 80 THEN n ELSE coalesce(nullif(regexp_extract(substr(n, 1, 80), '^(.*) ', 1), ''), substr(n, 1, 80)) || '…' END AS s FROM n)
SELECT conv_id, turn, role, upper(substr(s, 1, 1)) || substr(s, 2) AS label FROM c""")
def decision_labels(spark: SparkSession, d: str) -> DataFrame:
    said = read(spark, d, "conversations").filter("text is not null")
    return said.select("conv_id", "turn", "role", text.decision_label(F.concat(F.lit("Decision : "), "text")).alias("label"))


def rules_shortened(column: str) -> str:
    """SQL that leaves one of three or more equal rule characters in a row."""
    for c in "-=_.*~·•":
        column = f"regexp_replace({column}, '[{c}]{{3,}}', '{c}', 'g')"
    return column


@query(rf"""WITH p AS (SELECT doc_id, '  ' || chr(10) || '----- ' || replace(text, ', ', ' |  |') || chr(10) || chr(9) || chr(10) || '=====..' || replace(text, ' d', '... ') || '  ' AS body FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace({rules_shortened("body")}, '[ \t]*\|(?:[ \t]*\|)*[ \t]*', ' | ', 'g'), '[ \t\x{{A0}}]{{2,}}', ' ', 'g') AS body FROM p)
SELECT doc_id, sha256(regexp_replace(regexp_replace(body, '\n[ \t]*(?:\n[ \t]*)+', chr(10), 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS hash FROM a WHERE body IS NOT NULL""")
def compacted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts between planted rules, bars and blank lines."""
    body = F.concat(F.lit("  \n----- "), F.replace("text", F.lit(", "), F.lit(" |  |")), F.lit("\n\t\n=====.."), F.replace("text", F.lit(" d"), F.lit("... ")), F.lit("  "))
    rows = read(spark, d, "documents").filter("text is not null")
    return rows.select("doc_id", F.sha2(text.compacted(body), 256).alias("hash"))


OPENINGS = ["Statement  of account", "STATEMENT OF ACCOUNT for May", "this rental agreement and the grade card", "Grade Card", "a letter", "Leave and Licence", "your ID card copy", "bank_statement"]


@query(r"""WITH o AS (SELECT o_orderkey AS k, CAST(CAST(trunc(o_totalprice) AS BIGINT) * CAST(power(10, o_orderkey % 5) AS BIGINT) // 100 AS VARCHAR) AS n, CASE o_orderkey % 9 WHEN 0 THEN 'note' WHEN 1 THEN 'chat' ELSE 'pdf' END AS source,
  lower(CASE WHEN o_orderkey % 10 = 0 THEN 'my_rent_agreement.pdf' ELSE 'scan ' || o_orderpriority END || chr(10) || (['Statement  of account', 'STATEMENT OF ACCOUNT for May', 'this rental agreement and the grade card', 'Grade Card', 'a letter', 'Leave and Licence', 'your ID card copy', 'bank_statement'])[o_orderkey % 8 + 1]) AS hay FROM orders)
SELECT k AS o_orderkey, CASE WHEN source IN ('note', 'chat') THEN source WHEN regexp_matches(hay, 'bank statement|statement of account|account statement|bank_statement') THEN 'bank_statement' WHEN regexp_matches(hay, 'rent(al)? agreement|lease agreement|leave and licen[cs]e|rent_agreement') THEN 'rent_agreement'
  WHEN regexp_matches(hay, 'mark ?sheet|statement of marks|grade card') THEN 'marksheet' WHEN regexp_matches(hay, 'identity card|id[ _]card') THEN 'id_card' END AS kind,
CASE WHEN length(n) <= 3 THEN n ELSE ltrim(reverse(regexp_replace(reverse(left(n, length(n) - 3)), '(..)', '\1,', 'g')), ',') || ',' || right(n, 3) END AS grouped FROM o""")
def kinds_and_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    number = F.floor(F.floor("o_totalprice") * F.pow(F.lit(10), k % 5).cast("long") / 100).cast("long")
    source = F.when(k % 9 == 0, "note").when(k % 9 == 1, "chat").otherwise("pdf")
    name = F.when(k % 10 == 0, "my_rent_agreement.pdf").otherwise(F.concat(F.lit("scan "), "o_orderpriority"))
    opening = F.get(F.array(*[F.lit(o) for o in OPENINGS]), (k % 8).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", parse.document_type(source, name, opening).alias("kind"), text.indian_grouping(number).alias("grouped"))

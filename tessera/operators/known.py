"""What is known when a question is asked: facts as lines with their source, and the conditions of decisions.

Facts: fact_id, seq, entity_id, field, value, source_type, doc_id, quote, valid_from, valid_to,
superseded_by.  Documents: doc_id, path, source, doc_type, signature_status, holder_status.  Chunks:
doc_id, n, text.  Questions: question_id, owner, text.  The lines' wording is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import parse, text
from tessera.functions.parse import lookup
from tessera.operators import temporal
from tessera.sources.shared import kept, spread

# fixed values
EXTRACTED_FROM = {"note": "from your notes", "chat": "from your WhatsApp chat", "pdf": "from an unsigned document"}
SIGNED_BY = {"bank_statement": "bank-signed statement", "marksheet": "board-signed marksheet", "id_card": "government-signed ID card"}
ASKS_FOR_DECISIONS = "decision decided decide condition plan planned".split()
MOST_CHECKS = 2


def source_label(source_type: Column, has_document: Column, source: Column, doc_type: Column, signature: Column, holder: Column) -> Column:
    """Where a fact comes from, by its document's kind and signature."""
    of_another = has_document & (signature == "issuer_signed") & F.coalesce(holder != "verified", F.lit(False))
    return (
        F.when(source_type == "issuer_doc", F.coalesce(lookup(SIGNED_BY, doc_type), F.lit("issuer-signed document")))
        .when(F.coalesce(of_another, F.lit(False)), "signed document in someone else's name")
        .when((source_type == "extracted") & has_document, F.coalesce(lookup(EXTRACTED_FROM, source), F.lit("from your files")))
        .when(source_type == "owner_stated", "you told me")
        .otherwise("from your files")
    )


def with_source(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts with label and file (null without a document)."""
    docs = documents.select(F.col("doc_id").alias("__doc"), "path", "source", "doc_type", "signature_status", "holder_status")
    joined = facts.join(docs, facts["doc_id"] == docs["__doc"], "left")
    label = source_label(F.col("source_type"), F.col("__doc").isNotNull(), F.col("source"), F.col("doc_type"), F.col("signature_status"), F.col("holder_status"))
    return joined.withColumns({"label": label, "file": F.substring_index("path", "/", -1)}).drop("__doc", "path", "source", "doc_type", "signature_status", "holder_status")


def day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def told(*parts: Column) -> Column:
    """Parts as "a, b", null ones left out."""
    return F.concat_ws(", ", *parts)


def known_facts(facts: DataFrame, documents: DataFrame, as_of: str) -> DataFrame:
    """Each field's fact of today and all that are scheduled, with a line: value, source, what is to come."""
    by = ["entity_id", "field"]
    now = temporal.current(facts, as_of, by)
    later = temporal.scheduled(facts, as_of)
    following = later.groupBy(*by).agg(F.min_by(F.struct("value", "valid_from"), F.struct("valid_from", "seq")).alias("__next"))
    today = with_source(now, documents).join(following, by, "left")
    change = F.concat(F.lit("changes to "), F.col("__next.value"), F.lit(" on "), day("__next.valid_from"))
    brackets = told(F.col("label"), F.col("file"), F.concat(F.lit("since "), day("valid_from")), change)
    today = today.withColumns({"scheduled": F.lit(False), "line": F.concat("field", F.lit(" today = "), "value", F.lit(" ("), brackets, F.lit(")"))}).drop("__next")
    present = now.select(*by, F.col("value").alias("__now"))
    coming = with_source(later, documents).join(present, by, "left")
    note = F.concat(F.lit("future change"), F.coalesce(F.concat(F.lit(" from today's "), F.col("__now")), F.lit("")))
    line = F.concat("field", F.lit(" from "), day("valid_from"), F.lit(" = "), "value", F.lit(" ("), note, F.lit("; "), told(F.col("label"), F.col("file")), F.lit(")"))
    coming = coming.withColumns({"scheduled": F.lit(True), "line": line}).drop("__now")
    return today.unionByName(coming)


def fact_chunks(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """fact_id and n, the first chunk of the fact's document that has its quote, amounts as whole numbers."""
    bodies = spread(chunks, "doc_id").select("doc_id", "n", F.coalesce(text.squeezed(F.lower(text.plain(F.col("text")))), F.lit("")).alias("__body"))  # never null: a null test would work it out before it is spread
    quoted = facts.filter("quote is not null").select("fact_id", "doc_id", text.squeezed(F.lower(F.col("quote"))).alias("__quote")).filter("__quote <> ''")
    met = quoted.join(bodies, "doc_id").filter(F.col("__body").contains(F.col("__quote")))
    return met.groupBy("fact_id").agg(F.min("n").alias("n"))


def relevant_facts(questions: DataFrame, known: DataFrame) -> DataFrame:
    """question_id with the known facts of its owner that share a token with it, in field name or quote: both sides
    meet on (owner, token), so a question sees only facts that it has a word in common with."""
    q = questions.select("question_id", "owner", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token"))
    about = F.concat_ws(" ", "field", "quote")
    f = known.select("fact_id", F.col("entity_id").alias("owner"), F.explode(F.array_distinct(text.tokens(about))).alias("token"))
    pairs = q.join(f, ["owner", "token"]).select("question_id", "fact_id").distinct()
    return pairs.join(known, "fact_id")


def known_fact_rows(questions: DataFrame, facts: DataFrame, documents: DataFrame, chunks: DataFrame, as_of: str) -> DataFrame:
    """question_id, fact_id, doc_id, n, line: facts a question is about as rows to be cited, at their real chunk; not
    what the owner stated, and nothing whose chunk is gone."""
    known = known_facts(facts, documents, as_of).filter("source_type <> 'owner_stated' and doc_id is not null and quote is not null")
    return relevant_facts(questions, known).join(fact_chunks(known, chunks), "fact_id").select("question_id", "fact_id", "doc_id", "n", "line")


def owner_stated_lines(questions: DataFrame, facts: DataFrame, documents: DataFrame, as_of: str) -> DataFrame:
    """question_id, context: what the owner has stated about it, without a citation."""
    known = known_facts(facts, documents, as_of).filter("source_type = 'owner_stated'")
    found = relevant_facts(questions, known)
    cells = F.sort_array(F.collect_list(F.struct("scheduled", F.when(~F.col("scheduled"), F.col("field")).alias("f"), "valid_from", "seq", "line")))
    lines = F.array_join(F.transform(cells, lambda x: x["line"]), "; ")
    return found.groupBy("question_id").agg(F.concat(F.lit("The owner has also told you: "), lines, F.lit(".")).alias("context"))


def conditional(decisions: DataFrame) -> DataFrame:
    """Decisions (decision_id, owner, seq, quote, ...) that state a condition: field, op, amount."""
    read = kept(spread(decisions, "decision_id").withColumn("__c", parse.condition(F.col("quote"))))  # read once, then filtered
    return read.filter("__c is not null").select(*decisions.columns, "__c.*")


def subject_stems(field: Column) -> Column:
    stems: dict[str, list[str]] = {}
    for word, name in parse.SUBJECTS.items():
        stems.setdefault(name, []).append(word[:5])
    out = F.array().cast("array<string>")
    for name, some in stems.items():
        out = F.when(field == name, F.array(*[F.lit(s) for s in some])).otherwise(out)
    return out


KINDS = ["field", "op", "amount"]


def oldest(rows: DataFrame, by: list[str]) -> DataFrame:
    """For each key the MOST_CHECKS oldest decisions with different conditions."""
    once = rows.groupBy(*by, *KINDS).agg(F.min(F.struct("seq", "decision_id")).alias("d")).select(*by, *KINDS, "d.*")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("seq", "decision_id"))
    return once.withColumn("__r", place).filter(F.col("__r") <= MOST_CHECKS).drop("__r")


def asked_conditions(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """question_id, owner, decision_id, seq, field, op, amount: the oldest MOST_CHECKS different conditions of the
    decisions that a question (with used, ids of decisions it is linked to) is about.

    About it are linked decisions, those that share a word stem with it beyond the condition's own subject, and
    all for a question that speaks of decisions.  Of each stem, as of each owner, only its MOST_CHECKS oldest
    different conditions can be among a question's, so no more are kept and a common stem costs no more than a
    rare one."""
    made = conditional(decisions.select("owner", "decision_id", "seq", "quote"))
    stems = F.array_except(text.stems(F.col("quote")), subject_stems(F.col("field")))
    index = oldest(made.select("owner", "decision_id", "seq", *KINDS, F.explode(stems).alias("stem")), ["owner", "stem"])
    q = questions.select("question_id", "owner", "used", text.stems(F.col("text")).alias("stems"), F.col("text").rlike("(?i)\\b(?:" + "|".join(ASKS_FOR_DECISIONS) + ")\\b").alias("general"))
    out = ["question_id", "owner", "decision_id", "seq", *KINDS]
    by_stem = q.select("question_id", "owner", F.explode("stems").alias("stem")).join(index, ["owner", "stem"]).select(*out)
    linked = q.select("question_id", "owner", F.explode("used").alias("decision_id")).join(made.drop("quote"), ["owner", "decision_id"]).select(*out)
    every = q.filter("general").select("question_id", "owner").join(oldest(made, ["owner"]), "owner").select(*out)
    return oldest(by_stem.unionByName(linked).unionByName(every), ["question_id", "owner"])


def amount_of(value: Column) -> Column:
    return F.coalesce(F.when(value.rlike("^\\d+$"), value.try_cast("long")), parse.parse_amount(value))


def verdict(met: Column) -> Column:
    return F.when(met, "met").when(~met, "NOT met").otherwise("can't compare")


def condition_rows(questions: DataFrame, decisions: DataFrame, facts: DataFrame, documents: DataFrame, chunks: DataFrame, as_of: str) -> DataFrame:
    """question_id, decision_id, met, stops, doc_id, n, line: the conditions a question is about, tested against
    today's fact and each scheduled one; stops is the first day that breaks a condition not broken today.

    Decisions may carry doc_id and n of the chunk that they were grounded in; without one (or if it is gone)
    the line is cited at a fact's chunk, and left out if there is none either."""
    asked = asked_conditions(questions, decisions)
    by = ["entity_id", "field"]
    brief = F.concat("value", F.lit(" ("), told(F.col("label"), F.col("file")), F.lit(")"))
    at = fact_chunks(facts, chunks)
    known = with_source(temporal.current(facts, as_of, by).withColumn("later", F.lit(False)).unionByName(temporal.scheduled(facts, as_of).withColumn("later", F.lit(True))), documents)
    known = known.join(at, "fact_id", "left").select(F.col("entity_id").alias("owner"), "field", "later", "valid_from", "seq", "value", brief.alias("brief"), F.when(F.col("n").isNotNull(), F.struct("doc_id", "n")).alias("place"))
    fields = asked.select("owner", "field").distinct()
    cells = F.sort_array(F.collect_list(F.struct("later", "valid_from", "seq", "value", "brief", "place")))
    versions = known.join(fields, ["owner", "field"], "left_semi").groupBy("owner", "field").agg(cells.alias("versions"))
    live = chunks.select("doc_id", "n").distinct().withColumn("__live", F.lit(True))
    quoted = decisions.select("owner", "decision_id", "quote", "doc_id", "n").join(live, ["doc_id", "n"], "left")
    quoted = quoted.select("owner", "decision_id", "quote", F.when(F.col("__live"), F.struct("doc_id", "n")).alias("own_place"))
    rows = asked.join(quoted, ["owner", "decision_id"]).join(versions, ["owner", "field"], "left")
    none = F.array().cast(versions.schema["versions"].dataType) if versions.columns else None
    tested = F.transform(F.coalesce("versions", none), lambda v: F.struct(v["later"].alias("later"), v["valid_from"].alias("day"), v["brief"].alias("brief"), v["place"].alias("place"), parse.holds(F.col("op"), amount_of(v["value"]), F.col("amount")).alias("met")))
    rows = rows.withColumn("tested", tested)
    rows = rows.withColumns(
        {
            "now": F.get(F.filter("tested", lambda v: ~v["later"]), 0),
            "coming": F.filter("tested", lambda v: v["later"]),
            "place": F.coalesce("own_place", F.get(F.filter(F.transform("tested", lambda v: v["place"]), lambda p: p.isNotNull()), 0)),
        }
    )
    met = F.col("now.met")
    breaks = F.get(F.filter("coming", lambda v: F.coalesce(~v["met"], F.lit(False))), 0)["day"]
    stops = F.when(F.coalesce(met, F.lit(True)), breaks)
    outcome = (
        F.when(stops.isNotNull(), F.concat(F.lit("the condition stops being met on "), F.date_format(stops, "yyyy-MM-dd")))
        .when(met, "the condition is met").when(~met, "the condition is NOT met today").otherwise("can't tell")
    )
    first = F.when(F.col("now").isNull(), F.concat(F.lit("no current "), "field")).otherwise(F.concat("field", F.lit(" today = "), "now.brief", F.lit(" -> "), verdict(met)))
    rest = F.transform("coming", lambda v: F.concat(F.lit("from "), F.date_format(v["day"], "yyyy-MM-dd"), F.lit(" = "), v["brief"], F.lit(" -> "), verdict(v["met"])))
    shown = F.array_join(F.concat(F.array(first), rest), "; ")
    line = F.concat(F.lit('condition check (computed) for "'), "quote", F.lit('" ('), "field", F.lit(" "), "op", F.lit(" "), F.col("amount").cast("string"), F.lit("): outcome: "), outcome, F.lit(". "), shown)
    return rows.filter("place is not null").select("question_id", "decision_id", met.alias("met"), stops.alias("stops"), "place.doc_id", "place.n", line.alias("line"))

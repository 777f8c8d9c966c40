"""From files to facts: routing, reading, typing, grounding, and which state things are in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import parse, text

SUFFIXES = {"pdf": "pdf", "md": "note", "txt": "chat"}
#: Fields that a document of a type can state (fixed values).
DOCUMENT_FIELDS = {
    "bank_statement": ["monthly_income", "loan_default_12m", "employer"],
    "marksheet": ["percentage", "result", "board", "date_of_birth"],
    "id_card": ["date_of_birth", "id_expiry"],
    "rent_agreement": ["rent_amount", "agreement_end_date", "landlord"],
}


def source_of(path: Column) -> Column:
    """Kind of a file by its suffix, null for others."""
    return parse.lookup(SUFFIXES, F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1)))


def relative(path: Column, root: str) -> Column:
    """Path below the root; an error for a path outside."""
    inside = path.startswith(root.rstrip("/") + "/") & ~path.contains("/../")
    return F.when(inside, F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(F.raise_error(F.concat(F.lit("outside the root: "), path)))


def watched(path: Column, folder: str) -> Column:
    """A direct child of the folder with a known suffix, neither hidden nor temporary."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return (path == F.concat(F.lit(folder.rstrip("/") + "/"), name)) & source_of(path).isNotNull() & ~name.rlike("^[.~]|\\.(tmp|part|crdownload)$")


def missing_vectors(chunks: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    return chunks.filter(F.col(vector).isNull() | (F.size(vector) != dim))


def backfilled(chunks: DataFrame, vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Chunks with new vectors where there is one; unknown keys are ignored."""
    new = vectors.select(F.col(key).alias("__k"), F.col(vector).alias("__v"))
    return chunks.join(new, chunks[key] == new["__k"], "left").withColumn(vector, F.coalesce("__v", vector)).drop("__k", "__v")


def live_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the newest version of each path that isn't removed."""
    newest = Window.partitionBy("path").orderBy(F.desc("version"))
    live = documents.withColumn("__r", F.row_number().over(newest)).filter("__r = 1 and removed_at is null")
    return chunks.join(live.select("path", "version"), ["path", "version"], "left_semi")


def removed(documents: DataFrame, gone: DataFrame, when: str) -> DataFrame:
    marks = gone.select(F.col("path").alias("__p")).distinct()
    joined = documents.join(marks, documents["path"] == marks["__p"], "left")
    return joined.withColumn("removed_at", F.when(F.col("__p").isNotNull() & F.col("removed_at").isNull(), F.lit(when)).otherwise(F.col("removed_at"))).drop("__p")


def swapped_identity(rows: DataFrame) -> DataFrame:
    """Of identity anchors only the newest is live; names of the others are scrubbed."""
    newest = rows.agg(F.max("seq").alias("__newest"))
    return rows.crossJoin(F.broadcast(newest)).withColumn("live", F.col("seq") == F.col("__newest")).drop("__newest").withColumn("name", F.when(F.col("live"), F.col("name")))


def reference_date(source: Column, first_text: Column, locator: Column, ingested: Column) -> Column:
    """A chat window's own date, a note's first ISO date, else the day of ingestion."""
    chat = F.try_to_date(F.nullif(F.regexp_extract(locator, "^chat: (\\d{4}-\\d{2}-\\d{2})\\b", 1), F.lit("")), "yyyy-MM-dd")
    note = F.try_to_date(F.nullif(F.regexp_extract(first_text, "\\b(\\d{4}-\\d{2}-\\d{2})\\b", 1), F.lit("")), "yyyy-MM-dd")
    return F.coalesce(F.when(source == "chat", chat), F.when(source == "note", note), ingested)


def allowed_field(doc_type: Column, field: Column) -> Column:
    out = F.lit(True)
    for kind, fields in DOCUMENT_FIELDS.items():
        out = F.when(doc_type == kind, field.isin(fields)).otherwise(out)
    return out


def grounded_facts(candidates: DataFrame) -> DataFrame:
    """Candidates (doc_id, seq, doc_type, field, value, quote, text) that may be stored: an allowed field, a
    value of its shape, a quote of the text that states it; the first of a field in a document."""
    f, q = F.col("field"), F.col("quote")
    value = parse.clean_value(f, F.col("value"))
    kept = candidates.withColumn("clean", value).filter(
        allowed_field(F.col("doc_type"), f) & F.col("clean").isNotNull() & text.quote_in_text(F.col("text"), q) & parse.states_value(f, F.col("clean"), q)
    )
    first = F.row_number().over(Window.partitionBy("doc_id", "field").orderBy("seq"))
    return kept.withColumn("__r", first).filter("__r = 1").drop("__r")


def quote_chunks(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first chunk of a fact's document that holds its quote."""
    inside = text.quote_in_text(F.col("text"), F.col("quote"))
    joined = facts.select("fact_id", "doc_id", "quote").join(chunks.select("doc_id", "n", "text"), "doc_id").filter(inside)
    return joined.groupBy("fact_id").agg(F.min("n").alias("n"))


def named_in(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities a question names as whole words.  The words of the question are joined on the first word of
    the key, so no question meets every entity."""
    q = questions.select("question_id", text.flat(F.col("text")).alias("flat"))
    words = q.select("question_id", "flat", F.explode(F.array_distinct(F.split("flat", " "))).alias("first"))
    keyed = entities.select("id", "key", F.substring_index("key", " ", 1).alias("first"))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return words.join(keyed, "first").filter(padded(F.col("flat")).contains(padded(F.col("key")))).select("question_id", "id", F.length("key").alias("size"))


def support_roots(versions: DataFrame, depth: int) -> DataFrame:
    """fact_id and the fact that its chain of equal values ends at, within depth steps."""
    up = versions.select(F.col("fact_id").alias("__f"), F.col("superseded_by").alias("__next"), F.col("value").alias("__value"))
    here = versions.select("fact_id", F.col("fact_id").alias("root"), "value")
    for _ in range(depth):
        step = here.join(up, here["root"] == up["__f"], "left")
        target = versions.select(F.col("fact_id").alias("__t"), F.col("value").alias("__tv"))
        step = step.join(target, step["__next"] == target["__t"], "left")
        here = step.select("fact_id", F.when(F.col("__tv") == F.col("value"), F.col("__t")).otherwise(F.col("root")).alias("root"), "value")
    return here.select("fact_id", "root")


def states(events: DataFrame, by: str, order: str, finals: list[str]) -> DataFrame:
    """State machine as latest wins, except that a final state stays: the first final event, else the last."""
    final = F.min(F.when(F.col("state").isin(finals), F.struct(order, "state")))
    return events.groupBy(by).agg(final.alias("f"), F.max(F.struct(order, "state")).alias("l")).select(by, F.coalesce("f.state", "l.state").alias("state"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; nulls are kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})


def threshold_claims(profiles: DataFrame, key: str, value: str, name: str, levels: list[int]) -> DataFrame:
    """One row for each claim name_ge_level of a profile."""
    cells = F.array(*[F.struct(F.lit(f"{name}_ge_{t}").alias("claim"), (F.col(value) >= t).alias("holds")) for t in levels])
    return profiles.select(key, F.inline(cells))


def merged_attributes(rows: DataFrame, by: str, order: str, attributes: str) -> DataFrame:
    """Maps of a key merged, the value that came first wins."""
    pairs = rows.select(by, order, F.explode(attributes).alias("k", "v"))
    first = pairs.groupBy(by, "k").agg(F.min_by("v", order).alias("v"))
    return first.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(attributes))


def condition_outcomes(conditions: DataFrame, versions: DataFrame, as_of: str) -> DataFrame:
    """For conditions (id, field, op, amount): whether it is met on as_of, and the first day it stops."""
    day = F.lit(as_of).cast("date")
    joined = conditions.join(versions, "field").withColumn("ok", parse.holds(F.col("op"), F.col("value").try_cast("long"), F.col("amount")))
    now = F.max_by("ok", F.when(F.col("valid_from") <= day, F.col("valid_from")))
    stops = F.min(F.when((F.col("valid_from") > day) & ~F.col("ok"), F.col("valid_from")))
    return joined.groupBy("id").agg(now.alias("met"), stops.alias("stops"))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def time_ago(seconds: Column) -> Column:
    """just now, minutes, hours, days."""
    return (
        F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))
    )

"""What the owner teaches and accepts, which versions and facts count, who is a contact, and lines read back.

Facts are as in temporal; candidates: candidate_id, owner, seq, kind (fact or decision), field, value,
statement, valid_from, project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import parse, text
from tessera.operators import temporal
from tessera.operators.identity import backs
from tessera.sources.shared import kept, spread

# fixed values
STANDARD_FIELDS = [
    "monthly_income", "rent_amount", "percentage", "result", "loan_default_12m", "date_of_birth", "agreement_end_date", "id_expiry", "emi_date",
    "board", "employer", "landlord",
]
PROOFS = ["ISSUER_PROOF", "OWNER_ATTESTED"]
CONTACT_ENDS = {"LANDLORD_OF": "src", "EMPLOYED_BY": "dst", "BANKS_WITH": "dst"}
CUE_WORDS = (
    "rent deposit salary income pay paid fee emi loan landlord owner lease agreement employer job work* office joined board mark marks "
    "percentage result exam birthday born decid* renew* agree* confirm* promise* plan* will going_to from_now starting increase* change* move* shift* "
    "jan* feb* mar* apr* may* jun* jul* aug* sep* oct* nov* dec*"
).split()
REFUSED_WORDS = (
    "exact exactly precise precisely how_much address name account ifsc phone mobile email e-mail aadhar aadhaar pan passport date_of_birth dob birthday born "
    "statement document pdf file copy send forward attach upload download ignore disregard instruction instructions rule rules prompt pretend jailbreak"
).split()
STAMP = "\\[\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}\\]"


def words(listed: list[str]) -> str:
    return parse.any_word([w.replace("_", " ") for w in listed])


def has_cue(message: Column) -> Column:
    """A number, a currency sign or a word of money, people, time or choice, outside the stamps of a chat."""
    bare = F.regexp_replace(message, STAMP, " ")
    return bare.rlike("\\d|₹") | bare.rlike(words(CUE_WORDS))


def is_refused(question: Column) -> Column:
    """A question for what is never disclosed, or with instructions in it, or an empty one."""
    return (F.trim(F.coalesce(question, F.lit(""))) == "") | question.rlike(words(REFUSED_WORDS))


def standard(rows: DataFrame) -> DataFrame:
    """rows (field, value, ...) as they are stored: the field that a name means, its value in that field's shape; both
    null where nothing usable is left."""
    field = text.canonical_field(text.field_name(F.col("field")))
    value = F.when(field.isin(STANDARD_FIELDS), parse.clean_value(field, F.col("value"))).otherwise(F.nullif(F.trim("value"), F.lit("")))
    return rows.withColumns({"__f": field, "__v": value}).withColumns({"field": F.when(F.col("__v").isNotNull(), F.col("__f")), "value": F.when(F.col("__f").isNotNull(), F.col("__v"))}).drop("__f", "__v")


def taught(statements: DataFrame) -> DataFrame:
    """Statements (seq, owner, statement, field, value and valid_from as proposed, today) as facts of the owner: only
    what the statement itself says, in its own words or digits."""
    rows = standard(spread(statements, "seq")).withColumn("__plain", text.plain(F.col("statement")))
    said = parse.grounding(F.col("__plain"), F.col("__plain"), F.col("value")) == "high"
    start = parse.resolve_valid_from(F.col("valid_from"), F.col("today"))
    # kept before it is filtered: a filter would work all of it out again, before the rows are spread
    read = kept(rows.select("seq", "owner", "statement", "field", "value", "today", start.alias("start"), said.alias("said")))
    return read.filter("field is not null and value is not null and said").select(
        F.concat(F.lit("t_"), F.col("seq").cast("string")).alias("fact_id"), "seq", F.col("owner").alias("entity_id"), "field", "value",
        F.lit("owner_stated").alias("source_type"), F.col("statement").alias("quote"), F.lit("high").alias("confidence"), F.coalesce("start", "today").alias("valid_from"),
    )


def accepted(candidates: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates with status, facts and edges that the owner's decisions (candidate_id, seq, remember) make: the first
    decision counts, later ones change nothing.  Accepted facts are the owner's; an accepted decision is an edge
    from the owner, and to its project, without a source chunk."""
    first = decisions.groupBy("candidate_id").agg(F.min_by("remember", "seq").alias("remember"))
    rows = candidates.join(first, "candidate_id", "left")
    status = F.when(F.col("remember").isNull(), "pending").when(F.col("remember"), "accepted").otherwise("discarded")
    rows = rows.withColumn("status", status).drop("remember")
    kept = rows.filter("status = 'accepted'")
    facts = kept.filter("kind = 'fact'").select("candidate_id", F.col("owner").alias("entity_id"), "field", "value", F.lit("owner_stated").alias("source_type"), F.col("statement").alias("quote"), F.lit("high").alias("confidence"), "valid_from")
    made = kept.filter("kind = 'decision'").withColumn("name", text.decision_label(F.col("statement")))
    key = text.name_key(F.col("name"))
    by_owner = made.select("candidate_id", F.col("owner").alias("src"), F.lit("DECIDED").alias("rel"), key.alias("dst"), "valid_from")
    of_project = made.filter("project is not null").select("candidate_id", key.alias("src"), F.lit("PART_OF").alias("rel"), F.col("project").alias("dst"), "valid_from")
    return rows, facts, by_owner.unionByName(of_project)


def owners_versions(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Versions without those of signed documents of another or unknown holder; hidden: how many of the same field
    were left out."""
    other = documents.filter((F.col("signature_status") == "issuer_signed") & F.col("holder_status").isin("mismatch", "unknown")).select(F.col("doc_id").alias("__doc"))
    marked = versions.join(other, versions["doc_id"] == other["__doc"], "left").withColumn("__hide", F.col("__doc").isNotNull())
    hidden = marked.filter("__hide").groupBy("entity_id", "field").agg(F.count(F.lit(1)).alias("hidden"))
    return marked.filter("not __hide").drop("__doc", "__hide").join(hidden, ["entity_id", "field"], "left").withColumn("hidden", F.coalesce("hidden", F.lit(0)))


def proving_facts(facts: DataFrame, documents: DataFrame, as_of: str) -> DataFrame:
    """Of each owner and field the fact that a claim is decided by: open, in force (or without a start), certain, of an
    issuer's document that is signed and the owner's own; the latest start, the newest on a tie."""
    own = documents.filter((F.col("signature_status") == "issuer_signed") & (F.col("holder_status") == "verified")).select("doc_id")
    live = temporal.listed(facts.filter("source_type = 'issuer_doc' and confidence = 'high' and doc_id is not null"), as_of).join(own, "doc_id", "left_semi")
    best = Window.partitionBy("entity_id", "field").orderBy(F.desc_nulls_last("valid_from"), F.desc("seq"))
    return live.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")


def proposal_actions(result: Column, favourable_word: Column) -> Column:
    """struct(favourable, actions): an answer in the owner's favour may be approved or denied, another one answered or
    declined; without a word for what is favourable only a plain no is unfavourable."""
    favourable = F.when(favourable_word.isNotNull(), result.eqNullSafe(favourable_word == "YES"))
    agreeable = F.coalesce(favourable, ~result.eqNullSafe(F.lit(False)))
    return F.struct(favourable.alias("favourable"), F.when(agreeable, F.array(F.lit("approve"), F.lit("deny"))).otherwise(F.array(F.lit("answer"), F.lit("decline"))).alias("actions"))


def entities_used(named: DataFrame, linked: DataFrame) -> DataFrame:
    """question_id, id, place: the named entities (question_id, id, rank) in order, then those linked to the chunks that
    were sent (question_id, rank, pos, id), each once where it comes first."""
    rows = named.select("question_id", "id", F.lit(0).alias("part"), "rank", F.lit(0).alias("pos")).unionByName(linked.select("question_id", "id", F.lit(1).alias("part"), "rank", "pos"))
    first = rows.groupBy("question_id", "id").agg(F.min(F.struct("part", "rank", "pos")).alias("at"))
    return first.select("question_id", "id", F.row_number().over(Window.partitionBy("question_id").orderBy("at", "id")).alias("place"))


def contacts(entities: DataFrame, edges: DataFrame, owner: str) -> DataFrame:
    """id, email, rels: persons and companies with an address, or at the other end of an open role edge of the owner."""
    rows = None
    for rel, end in CONTACT_ENDS.items():
        near = "dst" if end == "src" else "src"
        some = edges.filter((F.col("rel") == rel) & F.col("valid_to").isNull() & (F.col(near) == owner) & (F.col(end) != owner)).select(F.col(end).alias("id"), "rel")
        rows = some if rows is None else rows.unionByName(some)
    roles = rows.groupBy("id").agg(F.sort_array(F.collect_set("rel")).alias("rels"))
    mails = F.filter(F.transform(F.map_values("attrs"), lambda v: F.trim(v)), lambda v: v.rlike("^[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+$"))
    known = entities.filter(F.col("type").isin("PERSON", "ORG") & (F.col("id") != owner)).select("id", F.get(mails, 0).alias("email"))
    return known.join(roles, "id", "left").filter("email is not null or rels is not null").withColumn("rels", F.coalesce("rels", F.array().cast("array<string>")))


def known_emails(entities: DataFrame) -> DataFrame:
    """Distinct addresses of all entities, in lower case."""
    values = entities.select(F.explode(F.map_values("attrs")).alias("v")).select(F.lower(F.trim("v")).alias("email"))
    return values.filter(F.col("email").rlike("^[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+$")).distinct()


def undisclosed(copies: DataFrame) -> DataFrame:
    """cred_id, claim: disclosures of a copy (digests, disclosed: array<struct<claim, digest>>) that match none of its
    digests."""
    return copies.select("cred_id", "digests", F.explode("disclosed").alias("d")).filter(~F.array_contains("digests", F.col("d.digest"))).select("cred_id", "d.claim")


def proof_payloads(requests: DataFrame, strict: bool = False) -> DataFrame:
    """request_id and payload of answered requests with a proof; strict: an error for any other."""
    good = (F.col("status") == "done") & F.col("answer_type").isin(PROOFS) & F.coalesce(F.col("payload") != "", F.lit(False))
    if not strict:
        return requests.filter(good).select("request_id", "payload")
    error = F.raise_error(F.concat("request_id", F.lit(" is not an answered request with a proof")))
    return requests.select("request_id", F.when(good, F.col("payload")).otherwise(error).alias("payload"))


def computed_line(line: Column) -> Column:
    """What a computed line says: struct(kind, field, value, on, now, next, next_on, label, file, since, op, amount,
    breaks_on); kind is fact, scheduled or condition, null for other texts."""
    fact, scheduled = "^([a-z][a-z0-9_]*) today = (.+?) \\((.*)\\)$", "^([a-z][a-z0-9_]*) from (\\d{4}-\\d{2}-\\d{2}) = (.+?) \\((.*)\\)$"
    condition = '^condition check \\(computed\\) for "(.+)" \\(([a-z][a-z0-9_]*) (<=|>=|<|>) (\\d+)\\): outcome: (.+?)\\. (.*)$'
    kind = F.when(line.rlike(condition), "condition").when(line.rlike(scheduled), "scheduled").when(line.rlike(fact), "fact")

    def part(shape: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(line, shape, k), F.lit(""))

    def by_kind(**values: Column) -> Column:
        out = None
        for name, value in values.items():
            out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
        return out

    inner = F.split(part(fact, 4 - 1), ", ")
    plain = F.filter(inner, lambda p: ~p.startswith("since ") & ~p.startswith("changes to "))
    change = F.get(F.filter(inner, lambda p: p.startswith("changes to ")), 0)
    coming = F.split(F.split_part(part(scheduled, 4), F.lit("; "), F.lit(2)), ", ")
    source = by_kind(fact=plain, scheduled=coming)
    named = F.get(source, 1)
    none = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        kind.alias("kind"), by_kind(fact=part(fact, 1), scheduled=part(scheduled, 1), condition=part(condition, 2)).alias("field"), by_kind(fact=part(fact, 2), scheduled=part(scheduled, 3)).alias("value"),
        by_kind(scheduled=part(scheduled, 2)).alias("on"), by_kind(scheduled=none(F.regexp_extract(F.split_part(part(scheduled, 4), F.lit("; "), F.lit(1)), "from today's (.+)$", 1))).alias("now"),
        none(F.regexp_extract(change, "^changes to (.+) on \\d{4}-\\d{2}-\\d{2}$", 1)).alias("next"), none(F.regexp_extract(change, " on (\\d{4}-\\d{2}-\\d{2})$", 1)).alias("next_on"),
        F.get(source, 0).alias("label"), F.when(named.rlike("(?i)^\\S+\\.[a-z0-9]+$"), named).alias("file"),
        F.substr(F.get(F.filter(inner, lambda p: p.startswith("since ")), 0), F.lit(7)).alias("since"), by_kind(condition=part(condition, 3)).alias("op"), by_kind(condition=part(condition, 4)).alias("amount"),
        by_kind(condition=none(F.regexp_extract(part(condition, 5), "stops being met on (\\d{4}-\\d{2}-\\d{2})", 1))).alias("breaks_on"),
    )


def issuer_facts() -> Column:
    """Do a document's facts count as its issuer's?  A missing holder status is from before holders were checked."""
    return (F.col("signature_status") == "issuer_signed") & backs(F.col("holder_status"))


def filtered_timeline(rows: DataFrame, needle: str) -> DataFrame:
    """Fields of which the name or any value holds the text, whatever its case; all of their rows."""
    hit = F.lower(F.replace("field", F.lit("_"), F.lit(" "))).contains(needle.strip().lower()) | F.lower("field").contains(needle.strip().lower()) | F.lower("value").contains(needle.strip().lower())
    fields = rows.filter(F.coalesce(hit, F.lit(False))).select("entity_id", "field").distinct()
    return rows if not needle.strip() else rows.join(fields, ["entity_id", "field"], "left_semi")

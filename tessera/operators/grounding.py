"""Which of the proposed entities, decisions, contacts and relations a chunk supports, and why not the others.

Proposals belong to a chunk (doc_id, n) and carry pos, their order in it.  Every row keeps its state:
kept, or the reason it goes.  All tests are on the chunk's own row: proposals meet their chunk by one
equi-join, names are looked for in its segments inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import forms, text
from tessera.operators.graph import relation_allowed

# fixed values
KEPT, OWNER = "kept", "@owner"
OWNER_WORDS = ["i", "me", "my", "myself", "mine", "owner", "the owner", "writer", "the writer"]
CHOICE_WORDS = ["decid\\w*", "decision", "chose", "choos\\w*", "going to", "planned to", "planning to", "plan to", "if", "unless", "instead"]
#: A role word before a name: the relation, the end of the name, the type that it needs.
ROLE_RELATIONS = {
    "landlord": ("LANDLORD_OF", "src", "PERSON"),
    "landlady": ("LANDLORD_OF", "src", "PERSON"),
    "employer": ("EMPLOYED_BY", "dst", "ORG"),
    "bank": ("BANKS_WITH", "dst", "ORG"),
}
#: Relations that only the code makes.
OWN_RELATIONS = ["MENTIONED_IN", "DECIDED"]
CHUNK = ["doc_id", "n"]


def owner_keys(name: str) -> list[str]:
    """Keys that mean the owner: the words for it, the name and the first name (name already a key)."""
    return [*OWNER_WORDS, *([name, name.split(" ")[0]] if name else [])]


def read_chunks(chunks: DataFrame) -> DataFrame:
    """doc_id, n and what the tests look at: the text in several plain forms, its segments and numbers."""
    whole = text.compatible(F.col("text"))
    return chunks.select(
        *CHUNK,
        F.concat(F.lit(" "), text.flat(whole), F.lit(" ")).alias("__flat"),
        text.squeezed(F.lower(whole)).alias("__spaced"),
        F.lower("text").alias("__lower"),
        F.regexp_replace("text", "\\D", "").alias("__digits"),
        F.col("text").alias("__text"),
        forms.segments(F.col("text")).alias("__segments"),
    )


def names(candidates: DataFrame, chunks: DataFrame, owner: str) -> DataFrame:
    """Candidates (doc_id, n, pos, type, name) with key and state: kept; owner; listed (its key was kept before);
    or the reason: empty name, role word, not in the text."""
    looked = read_chunks(chunks).select(*CHUNK, "__flat")
    rows = candidates.withColumn("key", text.name_key(text.compatible(F.col("name")))).join(looked, CHUNK)
    role = F.col("type").isin("PERSON", "ORG") & text.is_role_word(F.col("name"))
    inside = F.col("__flat").contains(F.concat(F.lit(" "), "key", F.lit(" ")))
    early = (
        F.when(F.coalesce("key", F.lit("")) == "", "empty name")
        .when(F.col("key").isin(owner_keys(owner)), "owner")
        .when(role, "role word, not a name")
    )
    rows = rows.withColumn("__early", early)
    first = F.min(F.when(F.col("__early").isNull() & inside, F.col("pos"))).over(Window.partitionBy(*CHUNK, "key"))
    state = F.coalesce(F.col("__early"), F.when(~inside, "name not in text").when(first < F.col("pos"), "listed").otherwise(KEPT))
    return rows.withColumn("state", state).drop("__flat", "__early")


def decisions(proposed: DataFrame, chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """Decisions (doc_id, n, pos, quote, date) with quote squeezed, name, key, day and state; kept are the
    chunk's names (doc_id, n, key)."""
    looked = read_chunks(chunks).select(*CHUNK, "__spaced", "__text")
    rows = proposed.withColumn("quote", text.squeezed(text.compatible(F.coalesce("quote", F.lit(""))))).join(looked, CHUNK)
    choice = "(?i)\\b(?:" + "|".join(CHOICE_WORDS) + ")\\b"
    rows = rows.withColumn("day", forms.grounded_date(F.col("date"), F.col("__text")))
    reason = (
        F.when((F.col("quote") == "") | ~F.col("__spaced").contains(F.lower("quote")), "decision quote not in text")
        .when(text.is_contact_line(F.col("quote")), "decision quote is a contact line")
        .when(F.col("quote").endswith("?") | ~F.col("quote").rlike(choice), "decision states no choice")
        .when(F.col("day").isNull(), "decision without a date in the text")
    )
    rows = rows.withColumns({"__reason": reason, "name": text.decision_label(F.col("quote"))}).withColumn("key", text.name_key(F.col("name")))
    taken = kept.select(*CHUNK, "key").distinct().withColumn("__taken", F.lit(True))
    rows = rows.join(taken, [*CHUNK, "key"], "left")
    first = F.min(F.when(F.col("__reason").isNull(), F.col("pos"))).over(Window.partitionBy(*CHUNK, "key"))
    listed = F.coalesce(F.col("__taken"), F.lit(False)) | (first < F.col("pos")) | (F.col("key") == "")
    state = F.coalesce(F.col("__reason"), F.when(listed, "listed").otherwise(KEPT))
    return rows.select(*CHUNK, "pos", "quote", "name", "key", "day", state.alias("state"))


def entities(named: DataFrame, decided: DataFrame) -> DataFrame:
    """What is kept of a chunk: doc_id, n, pos, type, name (as it is shown), key, attrs; decisions after names."""
    a = named.filter(F.col("state") == KEPT).select(*CHUNK, "pos", "type", forms.shown_name(F.col("type"), F.col("name")).alias("name"), "key", F.lit(0).alias("late"), F.create_map().cast("map<string,string>").alias("attrs"))
    facts = F.create_map(F.lit("quote"), F.col("quote"), F.lit("date"), F.date_format("day", "yyyy-MM-dd"))
    b = decided.filter(F.col("state") == KEPT).select(*CHUNK, "pos", F.lit("DECISION").alias("type"), "name", "key", F.lit(1).alias("late"), facts.alias("attrs"))
    return a.unionByName(b)


def contacts(proposed: DataFrame, chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, n, key, phone, email: of contacts (doc_id, n, pos, name, phone, email) what the chunk has, for kept
    names; the first of each wins.  A number of over ten digits may lack its prefix in the text."""
    looked = read_chunks(chunks).select(*CHUNK, "__digits", "__lower")
    rows = proposed.withColumn("key", text.name_key(text.compatible(F.col("name")))).join(kept.select(*CHUNK, "key").distinct(), [*CHUNK, "key"]).join(looked, CHUNK)
    digits = F.regexp_replace(F.coalesce("phone", F.lit("")), "\\D", "")
    called = (F.length(digits) >= 6) & (F.col("__digits").contains(digits) | ((F.length(digits) > 10) & F.col("__digits").contains(F.substring(digits, -10, 10))))
    mail = F.trim(F.coalesce("email", F.lit("")))
    written = mail.contains("@") & F.col("__lower").contains(F.lower(mail))
    rows = rows.select(*CHUNK, "key", "pos", F.when(called, F.trim("phone")).alias("phone"), F.when(written, mail).alias("email"))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in ("phone", "email")]
    return rows.groupBy(*CHUNK, "key").agg(*first).filter("phone is not null or email is not null")


def end_key(name: str, owner: str) -> Column:
    key = text.name_key(text.compatible(F.col(name)))
    return F.when(key.isin(owner_keys(owner)), F.lit(OWNER)).otherwise(key)


def typed_ends(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """rows (doc_id, n, src, dst) with src_type and dst_type; null for what isn't kept."""
    for end in ("src", "dst"):
        known = kept.select(*[F.col(c).alias(f"__{c}") for c in CHUNK], F.col("key").alias("__key"), F.col("type").alias("__type"))
        on = (F.col("doc_id") == F.col("__doc_id")) & (F.col("n") == F.col("__n")) & (F.col(end) == F.col("__key"))
        kind = F.when(F.col(end) == OWNER, "PERSON").otherwise(F.col("__type"))
        rows = rows.join(known, on, "left").withColumn(f"{end}_type", kind).drop("__doc_id", "__n", "__key", "__type")
    return rows


def together(src: Column, src_type: Column, dst: Column, dst_type: Column) -> Column:
    """Does one segment name both ends?  The owner is named in all."""
    has = lambda s, key, kind: (key == OWNER) | text.mentions(s, key, kind == "PERSON")
    return F.exists("__segments", lambda s: has(s, src, src_type) & has(s, dst, dst_type))


def listed_relations(proposed: DataFrame, chunks: DataFrame, kept: DataFrame, owner: str) -> DataFrame:
    """Relations (doc_id, n, pos, src, rel, dst; ends by name) with keys and state: kept, dropped, or listed (it was kept before)."""
    rows = proposed.select(*CHUNK, "pos", "rel", end_key("src", owner).alias("src"), end_key("dst", owner).alias("dst"))
    rows = typed_ends(rows, kept).join(read_chunks(chunks).select(*CHUNK, "__segments"), CHUNK)
    fits = F.col("src_type").isNotNull() & F.col("dst_type").isNotNull() & ~F.col("rel").isin(OWN_RELATIONS)
    fits = fits & relation_allowed(F.col("rel"), F.col("src_type"), F.col("dst_type")) & (F.col("src") != F.col("dst"))
    near = together(F.col("src"), F.col("src_type"), F.col("dst"), F.col("dst_type"))
    rows = rows.withColumn("__ok", F.coalesce(fits, F.lit(False)) & near)
    first = F.min(F.when(F.col("__ok"), F.col("pos"))).over(Window.partitionBy(*CHUNK, "src", "rel", "dst"))
    state = F.when(~F.col("__ok"), "dropped").when(first < F.col("pos"), "listed").otherwise(KEPT)
    return rows.select(*CHUNK, "pos", "src", "rel", "dst", state.alias("state"))


def role_relations(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges between the owner and a name that a role word stands before ("my landlord is ..."), by the first
    segment that has one for the name's type."""
    some = kept.filter(F.col("type").isin("PERSON", "ORG")).select(*CHUNK, "pos", "key", "type")
    rows = some.join(read_chunks(chunks).select(*CHUNK, "__segments"), CHUNK)
    first = F.when((F.col("type") == "PERSON") & F.col("key").contains(" "), F.concat(F.lit("|"), F.substring_index("key", " ", 1))).otherwise("")
    found = None
    for kind in ("PERSON", "ORG"):
        words = "|".join(w for w, (_, _, need) in ROLE_RELATIONS.items() if need == kind)
        shape = F.concat(F.lit(f" ({'|'.join(ROLE_RELATIONS)}) (?:is |was )?(?:"), "key", first, F.lit(") "))
        # a segment's first role word before the name counts, and only if it asks for this type
        said = F.transform("__segments", lambda s: F.get(F.regexp_extract_all(F.concat(F.lit(" "), s, F.lit(" ")), shape, F.lit(1)), 0))  # noqa: B023
        role = F.get(F.filter(said, lambda r: F.coalesce(r.rlike(f"^(?:{words})$"), F.lit(False))), 0)  # noqa: B023
        role = F.when(F.col("type") == kind, role)
        found = role if found is None else F.coalesce(found, role)
    rows = rows.withColumn("role", found).filter("role is not null")
    by = {w: rel for w, (rel, _, _) in ROLE_RELATIONS.items()}
    rel = F.element_at(F.create_map(*[F.lit(x) for item in by.items() for x in item]), F.col("role"))
    as_src = F.col("role").isin([w for w, (_, end, _) in ROLE_RELATIONS.items() if end == "src"])
    return rows.select(*CHUNK, "pos", F.when(as_src, F.col("key")).otherwise(F.lit(OWNER)).alias("src"), rel.alias("rel"), F.when(as_src, F.lit(OWNER)).otherwise(F.col("key")).alias("dst"))


def relations(listed: DataFrame, chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, n, src, rel, dst, valid_from of a chunk, each once: what decisions imply (decided by the owner, part
    of its projects, about its concepts; from the decision's day), the listed ones that are kept, those of roles."""
    decided = kept.filter("type = 'DECISION'").select(*CHUNK, F.col("key").alias("src"), F.to_date(F.col("attrs")["date"]).alias("valid_from"))
    by_owner = decided.select(*CHUNK, F.lit(OWNER).alias("src"), F.lit("DECIDED").alias("rel"), F.col("src").alias("dst"), "valid_from")
    topics = kept.filter("type in ('PROJECT', 'CONCEPT')").select(*CHUNK, F.col("key").alias("dst"), F.when(F.col("type") == "PROJECT", "PART_OF").otherwise("ABOUT").alias("rel"))
    about = decided.join(topics, CHUNK).select(*CHUNK, "src", "rel", "dst", "valid_from")
    rest = listed.filter(F.col("state") == KEPT).select(*CHUNK, "src", "rel", "dst").unionByName(role_relations(chunks, kept).select(*CHUNK, "src", "rel", "dst"))
    rows = by_owner.unionByName(about).unionByName(rest.withColumn("valid_from", F.lit(None).cast("date")))
    return rows.filter(F.col("src") != F.col("dst")).groupBy(*CHUNK, "src", "rel", "dst").agg(F.max("valid_from").alias("valid_from"))


def paid_edges(rows: DataFrame, graph: DataFrame) -> DataFrame:
    """Statement rows (doc_id, direction, party) as PAID edges between the owner and parties that the graph (id, seq,
    type, key) already has, each pair of a document once, at its first row (n); the oldest person or company
    of a key is meant."""
    known = graph.filter(F.col("type").isin("PERSON", "ORG")).groupBy("key").agg(F.min_by("id", "seq").alias("id"))
    met = rows.withColumn("key", text.name_key(F.col("party"))).join(known, "key").withColumn("id", F.col("id").cast("string"))
    out = F.col("direction") == "debit"
    ends = met.select(*CHUNK, F.when(out, F.lit(OWNER)).otherwise(F.col("id")).alias("src"), F.when(out, F.col("id")).otherwise(F.lit(OWNER)).alias("dst"))
    return ends.filter("src <> dst").groupBy("doc_id", "src", "dst").agg(F.min("n").alias("n")).withColumn("rel", F.lit("PAID"))

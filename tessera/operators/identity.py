"""Whose document is it: holders read from signed texts, the identity that counts, and what follows when it changes.

Identities: owner, seq, source, name, dob, doc_id (null if none), removed_at.  Documents: doc_id, owner,
seq, doc_type, iss, signature_status, holder_status, removed_at, text.  A date of birth is an ISO date or
a bare year, as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import forms, text
from tessera.operators import temporal
from tessera.operators.citations import pieces
from tessera.sources.shared import kept

# fixed values
HOLDER_LABELS = {
    "bank_statement": ["account holder name", "account holder", "account name", "customer name"],
    "marksheet": ["name of the candidate", "candidate name", "candidate", "student name"],
    "id_card": ["name"],
}
#: Words before a label that make it somebody else's.
NOT_HOLDER = (
    "father mother spouse husband wife guardian nominee parent bank branch company employer landlord school college institution"
).split()
BIRTH_LABELS = ["date of birth", "birth date", "d ?o ?b"]
IDENTITY_ISSUERS = ["mock_govt"]
NEAR, MOST_WORDS = 40, 6


def label_pattern(labels: list[str]) -> str:
    """Any of the labels as whole words with a colon; the longest first."""
    words = "|".join(x.replace(" ", "\\s+") for x in sorted(labels, key=len, reverse=True))
    return f"(?i)(?<![\\p{{L}}\\p{{N}}])(?:{words})\\s*:"


def birth_pattern() -> str:
    """Labels of a date of birth; letters of a short one may have stops or spaces between them."""
    words = "|".join(x.replace(" ?", "\\.?\\s?") + "\\.?" if "?" in x else x.replace(" ", "\\s+") for x in BIRTH_LABELS)
    return f"(?i)(?<![\\p{{L}}\\p{{N}}])(?:{words})(?![\\p{{L}}\\p{{N}}])\\s*[:\\-]?"


def after_labels(body: Column, pattern: str) -> Column:
    """array<struct<before, rest>>: for each label of a text what stands before it (since the last one) and all of
    the text after it."""
    none = F.array().cast("array<struct<before:string,rest:string>>")
    start = F.struct(F.lit("").alias("rest"), none.alias("out"))

    def step(s: Column, p: Column) -> Column:
        found = F.array(F.struct(p["text"].alias("before"), s["rest"].alias("rest")))
        return F.struct(F.concat(p["text"], p["sep"], s["rest"]).alias("rest"), F.when(p["sep"] == "", s["out"]).otherwise(F.concat(found, s["out"])).alias("out"))

    return F.aggregate(F.reverse(pieces(body, pattern)), start, step, lambda s: s["out"])


def first_line(rest: Column) -> Column:
    """The rest of a line, or the next line that isn't blank."""
    return F.regexp_extract(rest, "^(?:[^\\S\\n]*\\n)*([^\\n]*)", 1)


def holder_value(body: Column, doc_type: Column) -> Column:
    """What follows the first label of a holder; labels of all kinds if the kind has none; null without one."""
    every = list(dict.fromkeys(x for labels in HOLDER_LABELS.values() for x in labels))
    cells = None
    for kind, labels in HOLDER_LABELS.items():
        test = after_labels(body, label_pattern(labels))
        cells = F.when(doc_type == kind, test) if cells is None else cells.when(doc_type == kind, test)
    cells = cells.otherwise(after_labels(body, label_pattern(every)))

    def own(c: Column) -> Column:
        words = F.filter(F.regexp_extract_all(F.lower(F.substr(c["before"], F.lit(-NEAR))), F.lit("\\p{L}+"), F.lit(0)), lambda w: w != "s")
        return ~F.coalesce(F.try_element_at(words, F.lit(-1)).isin(NOT_HOLDER), F.lit(False))

    return F.get(F.transform(F.filter(cells, own), lambda c: first_line(c["rest"])), 0)


def stated_births(body: Column) -> Column:
    """Dates of birth that a text states, as ISO text; null where one can't be read."""
    return F.transform(after_labels(body, birth_pattern()), lambda c: forms.leading_date(F.substring(first_line(c["rest"]), 1, NEAR)).cast("string"))


def birth_status(body: Column, dob: Column) -> Column:
    """Every stated date must be dob (its year, if dob is one); one that can't be read leaves it unknown."""
    told = F.transform(stated_births(body), lambda d: F.substring(d, 1, 10))
    wrong = F.exists(told, lambda d: F.coalesce(F.substr(d, F.lit(1), F.length(dob)) != dob, F.lit(False)))
    return F.when(dob.isNull(), "verified").when(wrong, "mismatch").when(F.exists(told, lambda d: d.isNull()), "unknown").otherwise("verified")


def checked(rows: DataFrame) -> DataFrame:
    """rows (text, doc_type, name, dob of the identity, ...) with holder_status: verified, mismatch or unknown.

    The name's words must all be among the first words of the holder's value (two more than the name has), or, in
    a text without such a label, within as many words anywhere.  An empty name is nobody's."""
    wanted = forms.letters(F.col("name"))
    prepared = rows.withColumns({"__wanted": wanted, "__value": holder_value(F.col("text"), F.col("doc_type")), "__birth": birth_status(F.col("text"), F.col("dob"))})
    prepared = prepared.withColumn("__words", forms.letters(F.coalesce("__value", "text")))
    window = F.size("__wanted") + 2
    labelled = forms.holds_words(F.slice("__words", 1, F.greatest(window, F.lit(1))), F.col("__wanted"))
    found = F.when(F.col("__value").isNotNull(), labelled).otherwise(forms.names_holder(F.col("__words"), F.col("__wanted")))
    named = (F.size("__wanted") > 0) & F.coalesce(found, F.lit(False))
    return prepared.withColumn("holder_status", F.when(named, F.col("__birth")).otherwise("mismatch")).drop("__wanted", "__value", "__words", "__birth")


def id_cards(cards: DataFrame) -> DataFrame:
    """cards (text, ...) with name and dob as a card states them; both null where no name can be read."""
    value = holder_value(F.col("text"), F.lit("id_card"))
    cut = F.regexp_replace(value, "(?s)\\s(?:\\p{L}+\\s+){0,2}\\p{L}+\\s*:.*$", "")
    name = F.regexp_replace(text.squeezed(cut), "^[ ,.;]+|[ ,.;]+$", "")
    read = F.when(name.rlike("\\p{L}") & (F.size(F.split(name, " ")) <= MOST_WORDS), name)
    return cards.withColumn("name", read).withColumn("dob", F.when(F.col("name").isNotNull(), F.get(stated_births(F.col("text")), 0)))


def is_identity_card(issuers: list[str] = IDENTITY_ISSUERS) -> Column:
    return (F.col("signature_status") == "issuer_signed") & (F.col("doc_type") == "id_card") & F.col("iss").isin(issuers)


def anchors(identities: DataFrame, documents: DataFrame, owners: DataFrame) -> DataFrame:
    """owner, name, dob, source, doc_id, shown (initials) and birth_year: the newest identity in force; without one the
    oldest live verified card of an identity issuer that can be read; else the configured name (owners: owner, name),
    which proves nothing."""
    live = identities.filter("removed_at is null")
    gone = documents.filter("removed_at is not null").select(F.col("doc_id").alias("__gone"))
    live = live.join(gone, live["doc_id"] == gone["__gone"], "left_anti")
    newest = live.groupBy("owner").agg(F.max_by(F.struct("name", "dob", "source", "doc_id"), "seq").alias("__live"))
    cards = id_cards(documents.filter(is_identity_card() & F.col("removed_at").isNull() & (F.col("holder_status") == "verified"))).filter("name is not null")
    oldest = cards.groupBy("owner").agg(F.min_by(F.struct("name", "dob", F.lit("signed_id").alias("source"), "doc_id"), "seq").alias("__card"))
    configured = F.struct("name", F.lit(None).cast("string").alias("dob"), F.lit("config").alias("source"), F.lit(None).cast(documents.schema["doc_id"].dataType).alias("doc_id"))
    rows = owners.join(newest, "owner", "left").join(oldest, "owner", "left").select("owner", F.coalesce("__live", "__card", configured).alias("__a")).select("owner", "__a.*")
    return rows.withColumns({"shown": text.initials(F.col("name")), "birth_year": F.substring("dob", 1, 4)})


def all_checked(documents: DataFrame, now: DataFrame) -> DataFrame:
    """Documents with the holder status that the anchors give; unsigned ones have none."""
    known = now.select(F.col("owner").alias("__owner"), "name", "dob")
    joined = documents.drop("holder_status").join(known, documents["owner"] == known["__owner"], "left").drop("__owner")
    status = F.when(F.col("signature_status") == "issuer_signed", F.col("holder_status"))
    return checked(joined).withColumn("holder_status", status).drop("name", "dob")


def changed_holders(documents: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """doc_id, was, holder_status of the live signed documents whose status a change of anchors changes.

    Only owners whose name or date of birth differs are looked at, and of them only signed documents: the texts of
    all others aren't read."""
    old = before.select("owner", F.struct("name", "dob").alias("a"))
    new = now.select("owner", F.struct("name", "dob").alias("b"))
    moved = old.join(new, "owner", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("owner")
    reached = documents.filter("signature_status = 'issuer_signed' and removed_at is null").join(moved, "owner", "left_semi")
    again = all_checked(reached.withColumn("__was", F.col("holder_status")), now)
    return again.filter(~F.col("__was").eqNullSafe(F.col("holder_status"))).select("doc_id", F.col("__was").alias("was"), "holder_status")


def backs(status: Column) -> Column:
    """Do facts of a signed document with this holder count as the issuer's?"""
    return status.isNull() | (status == "verified")


def cascade(documents: DataFrame, facts: DataFrame, before: DataFrame, now: DataFrame, closed_on: str) -> tuple[DataFrame, DataFrame]:
    """Changed documents, and facts after a change of anchors: the open facts of documents that no longer back them
    close, and for each its best supporter of equal value reopens; those of documents that back them again reopen.

    Facts that no changed document reaches pass as they are, in one join on the few changed documents."""
    moved = kept(changed_holders(documents, before, now))
    lost = backs(F.col("was")) & ~F.coalesce(backs(F.col("holder_status")), F.lit(False))
    won = ~backs(F.col("was")) & backs(F.col("holder_status"))
    marks = moved.select("doc_id", F.when(lost, "lost").when(won, "won").alias("__turn")).filter("__turn is not null")
    gone = marks.filter("__turn = 'lost'").select("doc_id")
    is_open = F.col("valid_to").isNull() & F.col("superseded_by").isNull()
    # facts without a document are dealt by their own ids, not all of them to one task
    own = F.coalesce(F.col("doc_id").cast("string"), F.col("fact_id").cast("string"))
    turns = marks.select(F.col("doc_id").cast("string").alias("__doc"), "__turn")
    rows = facts.join(turns, (own == F.col("__doc")) & F.col("doc_id").isNotNull(), "left").select(*facts.columns, "__turn")
    closing = facts.filter(is_open).join(gone, "doc_id", "left_semi").select(*facts.columns)
    held = documents.join(gone, "doc_id", "left_anti").select("doc_id", "removed_at", "signature_status")
    heirs = temporal.promoted(closing, facts, held).select(F.col("fact_id").alias("__heir"))
    rows = rows.join(heirs, rows["fact_id"] == heirs["__heir"], "left")
    shut = is_open & (F.col("__turn") == "lost")
    withdrawn = F.col("superseded_by").isNull() & (F.col("__turn") == "won") & (F.col("withdrawn") == F.lit(True))
    end = F.when(shut, F.lit(closed_on).cast("date")).when(withdrawn | F.col("__heir").isNotNull(), F.lit(None).cast("date")).otherwise(F.col("valid_to"))
    by = F.when(F.col("__heir").isNotNull(), F.lit(None).cast("string")).otherwise(F.col("superseded_by"))
    flag = F.when(shut, F.lit(True)).when(withdrawn, F.lit(False)).otherwise(F.col("withdrawn"))
    out = rows.withColumns({"__end": end, "__by": by, "__flag": flag}).withColumns({"valid_to": F.col("__end"), "superseded_by": F.col("__by"), "withdrawn": F.col("__flag")})
    return moved, out.select(*facts.columns)

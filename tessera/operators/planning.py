"""What an instruction asks for: the day of a reminder, and which known values a text gives away."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import parse, text
from tessera.functions.parse import any_word, normalize_amounts
from tessera.functions.scan import reminder_day
from tessera.operators.matching import runs_of_words

# fixed values: a date fact counts only if the instruction has one of its words (all lists must be met)
DATE_WORDS = {
    "agreement_end_date": [["agreement", "lease", "contract", "license", "licence"]],
    "id_expiry": [["id", "identity", "card"], ["expir*"]],
    "emi_date": [["emi", "loan", "installment", "instalment"]],
    "date_of_birth": [["birthday"]],
}
DAYS_BEFORE, MOST_DAYS, LEAST_DIGITS = 7, 365, 3
MOST_STEPS, NOTE_SHOWN, NOTES_KEPT = 4, 400, 300
# fixed values: a tool counts as asked for if the instruction has one of its words (or an @ for an email)
TOOL_WORDS = {
    "draft_email": ["email", "e-mail", "mail", "write", "send", "tell", "ask", "message", "reply", "contact", "inform", "let \\w+ know"],
    "create_reminder": ["remind", "reminder", "alert", "calendar", "alarm"],
    "fill_rental_form": ["form", "application"],
    "save_note": ["note", "jot", "write down", "save", "log"],
}
PROOF_WORDS = ["proof", "proofs", "attestation", "verified", "verification", "certificate"]
# fixed values: fields of the rental form and the facts they are filled from (none: the owner's name)
FORM_FIELDS = {"full_name": None, "date_of_birth": "date_of_birth", "employer": "employer", "monthly_income": "monthly_income", "current_rent": "rent_amount", "current_landlord": "landlord"}
MONEY_FIELDS = ["monthly_income", "rent_amount"]
DISCLOSABLE = ["monthly_income", "loan_default_12m", "date_of_birth", "percentage", "result", "board"]
# fixed values: words for a contact's role and the relation that shows it
ROLES = {"LANDLORD_OF": ["landlord", "landlady", "house owner"], "EMPLOYED_BY": ["employer", "company", "office", "hr"], "BANKS_WITH": ["bank"]}
ADDRESS = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


def speaks_of(fact: Column, instruction: Column) -> Column:
    """Does the instruction talk about a date fact?"""
    out = F.lit(False)
    for name, lists in DATE_WORDS.items():
        shape = "(?i)" + ".*".join(any_word(words).removeprefix("(?i)") for words in lists)
        out = F.when(fact == name, instruction.rlike(shape)).otherwise(out)
    return out


@F.pandas_udf(T.DateType())
def day_of(words: pd.Series, today: pd.Series) -> pd.Series:
    return pd.Series([None if w is None or pd.isna(t) else reminder_day(w, t) for w, t in zip(words, today)], dtype=object)


def reminder_days(steps: DataFrame, facts: DataFrame) -> DataFrame:
    """steps (step_id, owner, instruction, date_text, relative_to, days_before, today) with day: counted back from the
    date fact that is named (facts: owner, field, value), if the instruction talks about it; else by the
    owner's words, which must be in the instruction to count.  base_day is the date fact's own day."""
    base = facts.select(F.col("owner").alias("__owner"), F.col("field").alias("__field"), parse.iso_date(F.col("value")).alias("__base"))
    wanted = F.trim(F.coalesce("relative_to", F.lit("")))
    rows = steps.join(base, (F.col("owner") == F.col("__owner")) & (wanted == F.col("__field")) & speaks_of(wanted, F.col("instruction")), "left")
    said = F.concat_ws(" ", "date_text", "instruction")
    asked = F.coalesce("days_before", F.lit(0))
    back = F.when((asked <= 0) & said.rlike(any_word(["before"])), DAYS_BEFORE).otherwise(F.least(F.greatest(asked, F.lit(0)), F.lit(MOST_DAYS)))
    own = (F.trim(F.coalesce("date_text", F.lit(""))) != "") & text.quote_in_text(F.col("instruction"), F.col("date_text"))
    words = F.when(F.coalesce(own, F.lit(False)), F.col("date_text")).otherwise(F.col("instruction"))
    rows = rows.withColumn("__day", day_of(F.when(F.col("__base").isNull(), words), F.col("today")))
    return rows.withColumn("day", F.coalesce(F.date_sub("__base", back), F.col("__day"))).withColumn("base_day", F.col("__base")).drop("__owner", "__field", "__base", "__day")


def longest_run(value: Column) -> Column:
    """The longest run of digits, the first on a tie."""
    runs = F.transform(F.regexp_extract_all(value, F.lit("\\d+"), F.lit(0)), lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("at"), r.alias("run")))
    return F.array_max(runs)["run"]


def stated_values(texts: DataFrame, values: DataFrame) -> DataFrame:
    """text_id, owner, field: values (owner, field, value; at least three digits) that a text of the owner states as
    whole numbers, amounts normalised.

    A value's longest run of digits is a key that every text with the value has as a run of its own, so both sides
    are joined on it; only such pairs are searched for the whole value."""
    bodies = texts.select("text_id", "owner", F.coalesce(normalize_amounts(F.when(F.col("text").rlike("\\d"), F.col("text"))), F.col("text")).alias("body"))
    runs = bodies.select("text_id", "owner", "body", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("\\d+"), F.lit(0)))).alias("run"))
    long = values.filter(F.length(F.regexp_replace("value", "\\D", "")) >= LEAST_DIGITS).select("owner", "field", "value", longest_run(F.col("value")).alias("run"))
    met = runs.join(long, ["owner", "run"])
    around = F.split("body", F.concat(F.lit("\\Q"), "value", F.lit("\\E")))
    whole = F.exists(F.sequence(F.lit(1), F.size(around) - 1), lambda i: ~F.element_at(around, i).rlike("\\d$") & ~F.element_at(around, i + 1).rlike("^\\d"))
    return met.filter((F.size(around) > 1) & whole).select("text_id", "owner", "field").distinct()


def spellings(value: Column) -> Column:
    """How a value may be written in a passage: a whole number with Indian or Western grouping, plain, or in
    thousands; else as it is."""
    number = value.try_cast("long")
    west = F.regexp_replace(number.cast("string"), "(?<=\\d)(?=(?:\\d{3})+$)", ",")
    short = F.when((number >= 1000) & (number % 1000 == 0), F.concat((number / 1000).cast("long").cast("string"), F.lit("k")))
    forms = F.array_distinct(F.array_compact(F.array(text.indian_grouping(number), west, value, short)))
    return F.when(value.rlike("^\\d+$") & number.isNotNull(), forms).otherwise(F.array(value))


def highlight(passage: Column, value: Column) -> Column:
    """struct(start, end) of the first spelling that the passage has, whatever its case; null if it has none."""
    places = F.transform(spellings(value), lambda s: F.struct((F.instr(F.lower(passage), F.lower(s)) - 1).alias("start"), F.length(s).alias("n")))
    first = F.get(F.filter(places, lambda p: (p["start"] >= 0) & (p["n"] > 0)), 0)
    return F.when(first.isNotNull(), F.struct(first["start"].alias("start"), (first["start"] + first["n"]).alias("end")))


def plannable_facts(facts: DataFrame, as_of: str) -> DataFrame:
    """owner, field, value: of each field the version in force, else the next to come; sure ones from documents only."""
    day = F.lit(as_of).cast("date")
    sure = facts.filter((F.col("confidence") == "high") & (F.col("source_type") != "owner_stated"))
    now = (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day))
    rows = sure.withColumn("__now", now).filter(F.col("__now") | (F.col("valid_from") > day))
    # in force: the latest start; to come: the earliest
    start = F.datediff("valid_from", F.lit("1970-01-01").cast("date"))
    order = F.struct("__now", F.when(F.col("__now"), start).otherwise(-start).alias("start"), F.when(F.col("__now"), F.col("seq")).otherwise(-F.col("seq")).alias("seq"))
    return rows.groupBy("owner", "field").agg(F.max_by("value", order).alias("value"))


def resolved_recipients(steps: DataFrame, contacts: DataFrame) -> DataFrame:
    """steps (task_id, seq, owner, recipient, instruction) with name and address of whom the owner means: an address typed in
    the instruction, a contact in the role that is named, a contact by name or a person by first name, else the only
    address that was typed; null if none.

    contacts: owner, pos (their order), type, name, key, email, rels; only those with an email count.  Roles and names
    are reduced to their first contact for each owner before steps meet them by equality, so no step is paired
    with all contacts of its owner."""
    typed = F.regexp_extract_all("instruction", F.lit(ADDRESS), F.lit(0))
    lower = F.transform(typed, lambda a: F.lower(a))
    meant = F.lower(F.nullif(F.regexp_extract("recipient", ADDRESS, 0), F.lit("")))
    own = F.filter(typed, lambda a: F.lower(a) == meant)
    distinct = F.size(F.array_distinct(lower))
    words = F.trim(F.regexp_replace(F.lower("recipient"), "[^a-z]+", " "))
    rows = steps.withColumns({"__typed": F.try_element_at(own, F.lit(-1)), "__only": F.when(distinct == 1, F.try_element_at(typed, F.lit(-1))), "__words": words})

    who = F.struct("pos", "name", F.col("email").alias("address"))
    reached = contacts.filter("email is not null")
    by_role = reached.select("owner", F.explode("rels").alias("__key"), who.alias("w")).groupBy("owner", "__key").agg(F.min("w").alias("w"))
    first = F.when((F.col("type") == "PERSON") & F.col("key").contains(" "), F.substring_index("key", " ", 1))
    by_name = reached.select("owner", F.explode(F.array_compact(F.array("key", first))).alias("__key"), who.alias("w")).groupBy("owner", "__key").agg(F.min("w").alias("w"))

    asked = F.array_compact(F.array(*[F.when(F.col("__words").rlike(any_word(listed)), F.lit(rel)) for rel, listed in ROLES.items()]))
    sizes = sorted(r[0] for r in by_name.select(F.size(F.split("__key", " "))).distinct().collect())
    for column, keys, firsts in (("__role", asked, by_role), ("__named", runs_of_words(F.col("__words"), sizes) if sizes else F.array().cast("array<string>"), by_name)):
        met = rows.select("task_id", "seq", "owner", F.explode(keys).alias("__key")).join(firsts, ["owner", "__key"])
        rows = rows.join(met.groupBy("task_id", "seq").agg(F.min("w").alias(column)), ["task_id", "seq"], "left")

    def best(part: str) -> Column:
        return F.coalesce("__typed", F.col(f"__role.{part}"), F.col(f"__named.{part}"), "__only")

    return rows.select(*steps.columns, best("name").alias("name"), best("address").alias("address"))


def tool_asked(tool: Column, instruction: Column) -> Column:
    out = F.lit(False)
    for name, words in TOOL_WORDS.items():
        met = instruction.rlike(any_word(words))
        out = F.when(tool == name, met | instruction.contains("@") if name == "draft_email" else met).otherwise(out)
    return F.coalesce(out, F.lit(False))


def said(column: str, otherwise: str | Column) -> Column:
    """The words of a column without blanks at its ends, or what stands for none."""
    words = F.trim(F.coalesce(column, F.lit("")))
    return F.when(words != "", words).otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def signed_off(body: Column, owner: Column) -> Column:
    """The body with the owner's first name below, unless its last line has it."""
    first = F.regexp_extract(owner, "^\\S+", 0)
    bare = F.regexp_replace(body, "\\s+$", "")
    return F.when(F.contains(F.lower(F.element_at(F.split(bare, "\n"), -1)), F.lower(first)), bare).otherwise(F.concat(bare, F.lit("\n\nThanks,\n"), first))


def spaced(name: Column) -> Column:
    return F.translate(name, "_", " ")


def form_of(fields: Column, facts: Column, name: Column) -> Column:
    """array<struct<field, value>> of the form's wanted fields in their order; a value is null where no fact has it."""
    wanted = F.array_distinct(F.filter(F.coalesce(fields, F.array().cast("array<string>")), lambda f: f.isin(list(FORM_FIELDS))))
    wanted = F.when(F.size(wanted) > 0, wanted).otherwise(F.array(F.lit("full_name"), F.lit("employer")))

    def filled(field: Column) -> Column:
        value = F.when(field == "full_name", name)
        for f, source in FORM_FIELDS.items():
            if source:
                raw = F.try_element_at(facts, F.lit(source))
                shown = F.when(raw.rlike("^\\d{1,18}$"), F.concat(F.lit("₹"), F.format_number(raw.try_cast("long"), 0))).otherwise(raw) if source in MONEY_FIELDS else raw
                value = value.when(field == f, shown)
        return F.struct(field.alias("field"), value.alias("value"))

    return F.transform(wanted, filled)


def planned(steps: DataFrame, facts: DataFrame, emails: DataFrame, proofs: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposed steps as checked tool calls, and the tasks (task_id) of which nothing was asked for.

    steps: task_id, seq, owner, tool, instruction, today, recipient (the owner's words), name and address (whom they mean, or
    null), subject, body, attach_proof, title, day, relative_to, base_day (see reminder_days), form_fields, markdown.  facts: owner,
    field, value (see plannable_facts).  emails: owner, email (lower case).  proofs: owner, request_id, at.  owners: owner,
    owner_name.  Each step comes back with state (call, unasked, beyond the first four, unbuilt, invalid, repeat),
    args (JSON), preview and warnings.

    All joins are on the owner or the step; per owner there is one row of form facts and one latest proof, so a
    task or owner with most steps only makes those joins uneven, which adaptive execution splits."""
    line = Window.partitionBy("task_id").orderBy("seq")
    rows = steps.withColumn("asked", tool_asked(F.col("tool"), F.col("instruction")))
    place = rows.filter("asked").withColumn("__place", F.row_number().over(line)).filter(F.col("__place") <= MOST_STEPS).select("task_id", "seq", F.lit(True).alias("__taken"))
    rows = rows.join(place, ["task_id", "seq"], "left")

    form_facts = facts.filter(F.col("field").isin([f for f in FORM_FIELDS.values() if f])).groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__facts"))
    latest = proofs.groupBy("owner").agg(F.max_by("request_id", F.struct("at", "request_id")).alias("__proof"))
    known = emails.select("owner", F.col("email").alias("__to")).distinct().withColumn("__known", F.lit(True))
    rows = rows.join(owners, "owner", "left").join(form_facts, "owner", "left").join(latest, "owner", "left")
    rows = rows.withColumn("__to", F.lower(F.trim("address"))).join(known, ["owner", "__to"], "left")

    body, subject = signed_off(said("body", "Hi,"), F.col("owner_name")), said("subject", "(no subject)")
    note = said("markdown", F.col("instruction"))
    rows = rows.withColumns({"__body": body, "__subject": subject, "__note": note, "__form": form_of(F.col("form_fields"), F.col("__facts"), F.col("owner_name"))})
    email, remind, form = (F.col("tool") == t for t in ("draft_email", "create_reminder", "fill_rental_form"))

    texts = rows.filter("__taken").filter(email & F.col("address").isNotNull() | (F.col("tool") == "save_note"))
    texts = texts.select(F.struct("task_id", "seq").alias("text_id"), "owner", F.when(email, F.concat("__subject", F.lit("\n"), "__body")).otherwise(F.col("__note")).alias("text"))
    told = stated_values(texts, facts.filter(F.col("field").isin(DISCLOSABLE)))
    told = told.groupBy("text_id").agg(F.array_join(F.array_sort(F.collect_set(spaced(F.col("field")))), ", ").alias("__told"))
    rows = rows.join(told.select("text_id.*", "__told"), ["task_id", "seq"], "left")

    wants_proof = F.coalesce("attach_proof", F.lit(False)) | F.col("instruction").rlike(any_word(PROOF_WORDS))
    attached = F.when(wants_proof & F.col("__proof").isNotNull(), F.array("__proof")).otherwise(F.array().cast("array<string>"))
    filled = F.filter("__form", lambda f: f["value"].isNotNull())
    built = F.when(email, F.col("address").isNotNull()).when(remind, F.col("day").isNotNull()).when(form, F.size(filled) > 0).otherwise(F.lit(True))
    typed = F.exists(F.regexp_extract_all("instruction", F.lit(ADDRESS), F.lit(0)), lambda a: F.lower(a) == F.col("__to"))
    invalid = F.when(email & F.col("__known").isNull() & ~F.coalesce(typed, F.lit(False)), F.concat("address", F.lit(" is not a known contact and was not typed by you")))
    invalid = invalid.when(remind & (F.col("day") <= F.col("today")), F.concat(F.col("day").cast("string"), F.lit(" is not in the future")))

    title = F.when(remind, said("title", "Reminder")).otherwise(said("title", "Note"))
    args = F.when(email, F.to_json(F.struct(F.col("address").alias("to"), F.col("__subject").alias("subject"), F.col("__body").alias("body"), attached.alias("attachments"))))
    args = args.when(remind, F.to_json(F.struct(title.alias("title"), F.col("day").alias("date"), F.substring(F.concat(F.lit("From your instruction: "), "instruction"), 1, NOTES_KEPT).alias("notes"))))
    args = args.when(form, F.to_json(F.map_from_entries(filled))).otherwise(F.to_json(F.struct(title.alias("title"), F.col("__note").alias("markdown"))))

    who = F.when(F.coalesce(F.col("name") != F.col("address"), F.lit(False)), F.concat("name", F.lit(" <"), "address", F.lit(">"))).otherwise(F.col("address"))
    long_day = lambda c: F.date_format(c, "d MMM yyyy")
    why = F.when(F.col("base_day") != F.col("day"), F.concat(F.lit(" ("), F.datediff("base_day", "day"), F.lit(" days before "), spaced(F.trim("relative_to")), F.lit(" "), long_day("base_day"), F.lit(")")))
    label = lambda f: F.concat(F.upper(F.substring(f["field"], 1, 1)), spaced(F.substring(f["field"], 2, 99)), F.lit(": "), f["value"])
    preview = F.when(email, F.concat(F.lit("Email to "), who, F.lit(": “"), "__subject", F.lit("”"), F.when(F.size(attached) > 0, " + 1 proof attachment").otherwise(""), F.lit("\n\n"), "__body"))
    preview = preview.when(remind, F.concat(F.lit("Reminder on "), long_day("day"), F.coalesce(why, F.lit("")), F.lit(": "), title))
    preview = preview.when(form, F.concat(F.lit("Rental form with "), F.array_join(F.transform(filled, label), ", ")))
    preview = preview.otherwise(F.concat(F.lit("Save note “"), title, F.lit("” to your vault\n\n"), F.substring("__note", 1, NOTE_SHOWN)))

    nobody = F.concat(F.lit("No email address for “"), said("recipient", "the recipient"), F.lit("” in your vault; type the address in the instruction to use it."))
    no_proof = F.when(wants_proof & F.col("__proof").isNull(), "No answered proof to attach yet; the email is drafted without one.")
    states = F.concat(F.when(email, "The email states your ").otherwise("The note states your "), "__told", F.when(email, "; a proof shares less.").otherwise("."))
    no_day = F.concat(F.lit("Couldn't tell when to remind you about “"), title, F.lit("”; add a date to the instruction."))
    left_off = F.transform(F.filter("__form", lambda f: f["value"].isNull()), lambda f: F.concat(F.lit("No "), spaced(f["field"]), F.lit(" in your documents; left off the form.")))
    left_out = F.concat(F.lit("Left out "), spaced(F.col("tool")), F.lit(": "), invalid, F.lit("."))
    warnings = F.when(email & ~built, F.array(nobody)).when(email, F.array(no_proof, states, left_out)).when(remind & ~built, F.array(no_day)).when(remind, F.array(left_out)).when(form, left_off).otherwise(F.array(states))

    rows = rows.withColumns({"args": args, "__bad": F.when(~built, "unbuilt").when(invalid.isNotNull(), "invalid")})
    again = F.row_number().over(Window.partitionBy("task_id", "tool", "args", F.col("__taken"), "__bad").orderBy("seq")) > 1
    state = F.when(~F.col("asked"), "unasked").when(F.col("__taken").isNull(), "beyond").when(F.col("__bad").isNotNull(), F.col("__bad")).when(again, "repeat").otherwise("call")
    rows = rows.withColumn("state", state)
    call, taken = F.col("state") == "call", F.col("__taken").isNotNull()
    out = rows.select("task_id", "seq", "tool", "state", F.when(call, F.col("args")).alias("args"), F.when(call, preview).alias("preview"), F.when(taken, F.array_compact(warnings)).otherwise(F.array().cast("array<string>")).alias("warnings"))
    none = rows.groupBy("task_id").agg(F.max("asked").alias("any")).filter("not any").select("task_id")
    return out, none


def runnable(calls: DataFrame, tasks: DataFrame, emails: DataFrame, proofs: DataFrame) -> DataFrame:
    """Calls (task_id, seq, owner, tool, args) checked again before they run: task_id, seq, and the reason why one doesn't, else null.

    tasks: task_id, status, instruction, today.  Only an approved task's calls run; emails and proofs are those known now."""
    known = emails.select("owner", F.col("email").alias("__to")).distinct().withColumn("__known", F.lit(True))
    good = proofs.select(F.col("request_id").alias("__proof")).distinct().withColumn("__good", F.lit(True))
    address, proof = F.get_json_object("args", "$.to"), F.get_json_object("args", "$.attachments[0]")
    rows = calls.join(tasks, "task_id", "left").withColumns({"__to": F.lower(F.trim(address)), "__proof": proof})
    rows = rows.join(known, ["owner", "__to"], "left").join(good, "__proof", "left")
    email, remind = F.col("tool") == "draft_email", F.col("tool") == "create_reminder"
    typed = F.coalesce(F.exists(F.regexp_extract_all("instruction", F.lit(ADDRESS), F.lit(0)), lambda a: F.lower(a) == F.col("__to")), F.lit(False))
    day = parse.iso_date(F.get_json_object("args", "$.date"))
    reason = F.when(F.col("status").isNull(), "unknown task").when(F.col("status") != "approved", F.concat(F.lit("task is "), "status", F.lit(", not approved")))
    reason = reason.when(email & F.col("__known").isNull() & ~typed, F.concat(F.coalesce(address, F.lit("nobody")), F.lit(" is not a known contact and was not typed by the owner")))
    reason = reason.when(email & F.col("__proof").isNotNull() & F.col("__good").isNull(), F.concat("__proof", F.lit(" is not an answered request with a proof")))
    reason = reason.when(remind & day.isNull(), F.concat(F.coalesce(F.get_json_object("args", "$.date"), F.lit("nothing")), F.lit(" is not a date")))
    reason = reason.when(remind & (day <= F.col("today")), F.concat(day.cast("string"), F.lit(" is not in the future")))
    return rows.select("task_id", "seq", reason.alias("reason"))

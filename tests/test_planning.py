"""Proposed steps as checked tool calls, on known cases."""

import datetime as dt
import json

import pytest

from tessera.operators import planning

TODAY = dt.date(2026, 9, 20)
STEP = (
    "task_id string, seq long, owner string, tool string, instruction string, today date, recipient string, name string, address string, subject string, body string, attach_proof boolean, "
    "title string, day date, relative_to string, base_day date, form_fields array<string>, markdown string"
)
FACTS = [("o", "monthly_income", "162000"), ("o", "rent_amount", "14500"), ("o", "landlord", "R. Rao"), ("p", "employer", "Acme")]


def plan(spark, *steps, facts=FACTS, emails=(("o", "rao@mail.example"),), proofs=(("o", "q1", 1), ("o", "q2", 2))):
    rows = [{"task_id": "t", "seq": i, "owner": "o", "today": TODAY} | s for i, s in enumerate(steps)]
    rows = [tuple(r.get(f.split()[0]) for f in STEP.split(", ")) for r in rows]
    tables = [
        spark.createDataFrame(rows, STEP), spark.createDataFrame(list(facts), "owner string, field string, value string"), spark.createDataFrame(list(emails), "owner string, email string"),
        spark.createDataFrame(list(proofs), "owner string, request_id string, at int"), spark.createDataFrame([("o", "Asha Verma")], "owner string, owner_name string"),
    ]
    out, none = planning.planned(*tables)
    return sorted(out.collect(), key=lambda r: (r["task_id"], r["seq"])), [r["task_id"] for r in none.collect()]


MAIL = {"tool": "draft_email", "instruction": "Email my landlord the proof of income", "recipient": "my landlord", "name": "R. Rao", "address": "Rao@mail.example", "subject": " Income ", "body": "Dear R. Rao,\nplease find it.\n"}


def test_email(spark):
    (row,), none = plan(spark, MAIL)
    assert row["state"] == "call" and row["warnings"] == [] and none == []
    assert json.loads(row["args"]) == {"to": "Rao@mail.example", "subject": "Income", "body": "Dear R. Rao,\nplease find it.\n\nThanks,\nAsha", "attachments": ["q2"]}
    assert row["preview"] == "Email to R. Rao <Rao@mail.example>: “Income” + 1 proof attachment\n\nDear R. Rao,\nplease find it.\n\nThanks,\nAsha"


@pytest.mark.parametrize(
    "change, state, warnings",
    [
        ({"address": None}, "unbuilt", ["No email address for “my landlord” in your vault; type the address in the instruction to use it."]),
        ({"address": "x@y.example"}, "invalid", ["Left out draft email: x@y.example is not a known contact and was not typed by you."]),
        ({"address": "x@y.example", "instruction": "write to X@y.example."}, "call", []),
        ({"instruction": "think about it"}, "unasked", []), ({"instruction": None}, "unasked", []), ({"instruction": "let Ravi know"}, "call", []),
        ({"body": "I earn 1.62 lakh"}, "call", ["The email states your monthly income; a proof shares less."]), ({"body": "I earn ₹1,62,000 and pay 14500"}, "call", ["The email states your monthly income; a proof shares less."]),
        ({"body": "a 1620001 b"}, "call", []), ({"body": None, "subject": None, "attach_proof": None, "recipient": None}, "call", []),
    ],
)
def test_email_checks(spark, change, state, warnings):
    (row,), _ = plan(spark, MAIL | change)
    assert (row["state"], row["warnings"]) == (state, warnings) and (row["args"] is not None) == (state == "call")


def test_email_without_proof(spark):
    (row,), _ = plan(spark, MAIL | {"instruction": "write", "attach_proof": True}, proofs=())
    assert row["warnings"] == ["No answered proof to attach yet; the email is drafted without one."] and json.loads(row["args"])["attachments"] == []


def test_reminder_form_note(spark):
    remind = {"tool": "create_reminder", "instruction": "Remind me, fill the form, save a note", "title": "Renew", "day": dt.date(2027, 3, 24), "relative_to": "agreement_end_date", "base_day": dt.date(2027, 3, 31)}
    form = {"tool": "fill_rental_form", "instruction": remind["instruction"], "form_fields": ["monthly_income", "employer", "iban", "current_rent", "full_name", "monthly_income", "current_landlord"]}
    note = {"tool": "save_note", "instruction": remind["instruction"], "markdown": "income 162k", "title": " "}
    rows, _ = plan(spark, remind, form, note, remind | {"title": "late", "day": TODAY})
    assert [r["state"] for r in rows] == ["call", "call", "call", "invalid"]
    assert rows[0]["preview"] == "Reminder on 24 Mar 2027 (7 days before agreement end date 31 Mar 2027): Renew" and json.loads(rows[0]["args"])["date"] == "2027-03-24"
    assert rows[1]["preview"] == "Rental form with Monthly income: ₹162,000, Current rent: ₹14,500, Full name: Asha Verma, Current landlord: R. Rao"
    assert rows[1]["warnings"] == ["No employer in your documents; left off the form."] and json.loads(rows[1]["args"])["monthly_income"] == "₹162,000"
    assert rows[2]["preview"] == "Save note “Note” to your vault\n\nincome 162k" and rows[2]["warnings"] == ["The note states your monthly income."]
    assert rows[3]["warnings"] == ["Left out create reminder: 2026-09-20 is not in the future."]


def test_order_of_steps(spark):
    say = "remind me twice, set an alarm"
    one = {"tool": "create_reminder", "instruction": say, "title": "a", "day": dt.date(2027, 1, 1)}
    mail = {"tool": "draft_email", "instruction": say, "address": "rao@mail.example"}
    rows, none = plan(spark, one, mail, one, one | {"title": "b"}, one | {"day": None}, one | {"title": "c"}, {"tool": "save_note", "instruction": "hm", "task_id": "u"}, {"tool": None, "instruction": say, "task_id": "v"})
    assert [r["state"] for r in rows] == ["call", "unasked", "repeat", "call", "unbuilt", "beyond", "unasked", "unasked"] and sorted(none) == ["u", "v"]
    assert rows[4]["warnings"] == ["Couldn't tell when to remind you about “a”; add a date to the instruction."]


def test_no_steps(spark):
    empty = spark.createDataFrame([], STEP)
    tables = [spark.createDataFrame([], s) for s in ("owner string, field string, value string", "owner string, email string", "owner string, request_id string, at int", "owner string, owner_name string")]
    out, none = planning.planned(empty, *tables)
    assert out.collect() == [] and none.collect() == []


def test_runnable(spark):
    calls = [("a", 1, "o", "draft_email", {"to": "rao@mail.example", "attachments": ["q1"]}), ("a", 2, "o", "draft_email", {"to": "rao@mail.example", "attachments": ["q9"]}), ("a", 3, "p", "draft_email", {"to": "rao@mail.example", "attachments": []}),
             ("a", 4, "o", "create_reminder", {"date": "2026-09-20"}), ("a", 5, "o", "create_reminder", {"date": "2026-09-21"}), ("a", 6, "o", "create_reminder", {"date": "soon"}), ("b", 1, "o", "save_note", {}), ("c", 1, "o", "save_note", {}), ("a", 7, "p", "draft_email", {"to": "Typed@x.example"})]
    rows = spark.createDataFrame([(*c[:4], json.dumps(c[4])) for c in calls], "task_id string, seq long, owner string, tool string, args string")
    tasks = spark.createDataFrame([("a", "approved", "mail typed@x.example", TODAY), ("b", "pending", "x", TODAY)], "task_id string, status string, instruction string, today date")
    out = planning.runnable(rows, tasks, spark.createDataFrame([("o", "rao@mail.example")] * 2, "owner string, email string"), spark.createDataFrame([("q1",), ("q1",)], "request_id string"))
    got = {(r["task_id"], r["seq"]): r["reason"] for r in out.collect()}
    assert len(got) == out.count() == 9 and [k for k, v in got.items() if v is None] and {k for k, v in got.items() if v is None} == {("a", 1), ("a", 5), ("a", 7)}
    assert got["a", 2] == "q9 is not an answered request with a proof" and got["a", 4] == "2026-09-20 is not in the future" and got["a", 6] == "soon is not a date" and got["b", 1] == "task is pending, not approved" and got["c", 1] == "unknown task"
    assert got["a", 3] == "rao@mail.example is not a known contact and was not typed by the owner"


def test_plannable_facts(spark):
    rows = [("o", "rent", 1, "10", "2025-01-01", "2026-01-01", "high", "extracted"), ("o", "rent", 2, "12", "2026-01-01", None, "high", "extracted"), ("o", "rent", 3, "14", "2027-01-01", None, "high", "extracted"), ("o", "job", 4, "x", "2026-01-01", None, "low", "extracted"),
            ("o", "job", 5, "y", "2026-01-01", None, "high", "owner_stated"), ("o", "gym", 6, "b", "2027-06-01", None, "high", "issuer_doc"), ("o", "gym", 7, "a", "2027-01-01", None, "high", "issuer_doc"), ("o", "old", 8, "z", "2020-01-01", "2021-01-01", "high", "issuer_doc")]
    facts = spark.createDataFrame(rows, "owner string, field string, seq long, value string, f string, t string, confidence string, source_type string").selectExpr("*", "date(f) valid_from", "date(t) valid_to")
    assert {(r["field"], r["value"]) for r in planning.plannable_facts(facts, "2026-09-20").collect()} == {("rent", "12"), ("gym", "a")}


@pytest.mark.parametrize(
    "recipient, instruction, want",
    [
        ("RAO@Mail.example", "write to Rao@mail.example or x@y.example", ("Rao@mail.example", "Rao@mail.example")), ("rao@mail.example", "write", (None, None)), ("my landlord", "write to x@y.example", ("R. Rao", "rao@mail.example")),
        ("the house  owner", "write", ("R. Rao", "rao@mail.example")), ("our HR", "write", ("Acme", "hr@acme.example")), ("Asha", "write", ("Asha Shah", "asha@mail.example")), ("asha shah's", "write", ("Asha Shah", "asha@mail.example")),
        ("Acme", "write", ("Acme", "hr@acme.example")), ("Big", "write", (None, None)), ("big co", "write", ("Big Co", "big@co.example")), ("Ghost", "mail x@y.example, X@y.example", ("X@y.example", "X@y.example")), (None, "mail x@y.example", ("x@y.example", "x@y.example")),
        ("", "a@b.example c@d.example", (None, None)), ("Asha", None, ("Asha Shah", "asha@mail.example")), ("bank", "write", (None, None)),
    ],
)
def test_recipients(spark, recipient, instruction, want):
    people = [("o", 1, "PERSON", "Ghost", "ghost", None, ["BANKS_WITH"]), ("o", 2, "PERSON", "R. Rao", "r rao", "rao@mail.example", ["LANDLORD_OF"]), ("o", 3, "ORG", "Acme", "acme", "hr@acme.example", ["EMPLOYED_BY"]), ("o", 4, "PERSON", "Asha Shah", "asha shah", "asha@mail.example", []),
              ("o", 5, "PERSON", "Asha Rao", "asha rao", "late@mail.example", ["LANDLORD_OF"]), ("o", 6, "ORG", "Big Co", "big co", "big@co.example", []), ("p", 0, "PERSON", "Asha", "asha", "other@p.example", ["LANDLORD_OF", "BANKS_WITH"])]
    contacts = spark.createDataFrame(people, "owner string, pos int, type string, name string, key string, email string, rels array<string>")
    steps = spark.createDataFrame([("t", 1, "o", recipient, instruction), ("t", 2, "nobody", recipient, "x")], "task_id string, seq long, owner string, recipient string, instruction string")
    out = {r["seq"]: (r["name"], r["address"]) for r in planning.resolved_recipients(steps, contacts).collect()}
    assert out == {1: want, 2: (None, None)}

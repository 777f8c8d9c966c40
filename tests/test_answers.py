"""Names in questions, citations, known facts and conditions: golden cases and brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import parse
from tessera.operators import citations, known, matching


def test_meant_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 17)
    monkeypatch.setattr(matching, "SLICE", 5)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    names = [(100 + i, 1000 - i, (base[i % 12] + rng.normal(size=8) * 0.4).tolist()) for i in range(80)]
    names += [(300 + i, 2000 - i, base[0].tolist()) for i in range(9)] + [(400, 1, [0.0] * 8), (401, 2, None)]
    asked = [(i, (base[i % 12] + rng.normal(size=8) * 0.2).tolist(), [100 + i, 300]) for i in range(40)] + [(90, base[0].tolist(), []), (91, None, []), (92, [0.0] * 8, [])]
    q = spark.createDataFrame(asked, "question_id long, vector array<double>, found array<long>")
    n = spark.createDataFrame(names, "id long, seq long, vector array<double>")
    got = sorted((r["question_id"], r["id"]) for r in matching.meant(q, n).collect())
    want = []
    for i, v, found in asked:
        scored = []
        for k, seq, w in names:
            if v is not None and w is not None and any(v) and any(w) and k not in found:
                cos = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), matching.DIGITS)
                scored.append((-cos, seq, k))
        want += [(i, k) for c, _, k in sorted(scored)[:3] if -c >= 0.72]
    assert got == sorted(want) and len(got) > 60
    assert [r["id"] for r in matching.meant(q.filter("question_id = 90"), n).orderBy("seq").collect()] == [308, 307, 306]
    assert matching.meant(q.limit(0), n).count() == matching.meant(q, n.limit(0)).count() == 0


def test_entities_in_order(spark):
    entities = spark.createDataFrame([(1, 1, "PERSON", "ravi kumar"), (2, 2, "PROJECT", "flat move"), (3, 3, "CONCEPT", "flat"), (4, 4, "ORG", "ab"), (5, 5, "CONCEPT", "rent"), (6, 6, "CONCEPT", "flat")], "id long, seq long, type string, key string")
    vectors = spark.createDataFrame([("rent", [1.0, 0.0]), ("ab", [0.9, 0.1]), ("flat", [1.0, 0.0])], "key string, vector array<double>")
    questions = spark.createDataFrame([(1, "Does Ravi pay for the flat move?", [1.0, 0.1]), (2, " ", [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, "ab?", None), (5, "ab rents", [0.0, 1.0])], "question_id long, text string, vector array<double>")
    out = matching.entities_in(questions, entities, vectors).orderBy("question_id", "rank").collect()
    # the longest alias first, then the older; then by meaning, without what is named
    assert [(r["question_id"], r["id"]) for r in out] == [(1, 2), (1, 1), (1, 3), (1, 6), (1, 4), (1, 5)]
    assert sorted(r["key"] for r in matching.missing_names(entities, vectors).collect()) == ["flat move", "ravi kumar"]
    assert matching.entities_in(questions, entities.limit(0), vectors).count() == 0


@pytest.mark.parametrize(
    "said, left",
    [
        ("I don't have that in your vault. [1][2]", "I don't have that in your vault."),
        ("I don't have that in your vault.\n[1][2]", "I don't have that in your vault."),
        ("I don't have that [1, 2].", "I don't have that."),
        ("Your landlord is Ramesh [2], but I don't have that phone number [1]. Rent is 15000 [1].", "Your landlord is Ramesh [2], but I don't have that phone number. Rent is 15000 [1]."),
        ("Your rent is 15000 [1], but I don't have the lease [2].\nThe next line [3].", "Your rent is 15000 [1], but I don't have the lease [2].\nThe next line [3]."),
        ("I DON’T HAVE THAT [3]\n\n[1]\nRent: 5 [1, 2],  yes.", "I DON’T HAVE THAT\nRent: 5 [1, 2],  yes."),
        ("You have that in note 2 [1].", "You have that in note 2 [1]."),
        ("I don't have thatched roofs [1].", "I don't have thatched roofs [1]."),
        ("", ""),
    ],
)
def test_denials(spark, said, left):
    assert spark.createDataFrame([(said,)], "t string").select(citations.without_citations_of_denials(F.col("t"))).first()[0] == left


CHUNKS = {1: "Monthly rent is 15,000 for the flat. The deposit was 45,000.", 2: "The landlord is Ramesh Kumar. His phone number is 98450 12345.", 3: "Tenant's s."}


@pytest.mark.parametrize(
    "said, left, dropped",
    [
        ("Your rent is 15000 [1][2]. The landlord is Ramesh [1, 2].", "Your rent is 15000 [1]. The landlord is Ramesh [2].", 2),
        ("Monthly rent is 15000 [1][3].", "Monthly rent is 15000 [1].", 1),
        ("Your rent is 15000. [2]\nIt is paid on the 5th [2].", "Your rent is 15000.\nIt is paid on the 5th.", 2),
        ("Your rent is 15000 [1]. The lease ends in March [7].", "Your rent is 15000 [1]. The lease ends in March [7].", 0),
        ("Your rent is 15000. [1]", "Your rent is 15000. [1]", 0),
        ("Two  spaces,\tand a tab [2] stay [1,2] here :\n\nrent 15k [1]", "Two  spaces,\tand a tab  stay  here:\n\nrent 15k [1]", 3),
        ("", "", 0),
    ],
)
def test_unrelated(spark, said, left, dropped):
    answers = spark.createDataFrame([(7, said)], "k int, text string")
    chunks = spark.createDataFrame([(7, n, t) for n, t in CHUNKS.items()], "k int, n int, text string")
    assert tuple(citations.without_unrelated(answers, chunks, "k").first()) == (7, left, dropped)


def test_quotes(spark):
    line = 'condition check (computed) for "I decided to renew only if rent stays under ₹15,000." (rent_amount < 15000): outcome: the condition is met. rent_amount today = 14500 (bank-signed statement, bank_statement_signed.pdf) -> met; from 2027-01-01 = 16000 -> NOT met'
    long = "Clause " + " ".join(f"word{i}" for i in range(80)) + "."
    answers = spark.createDataFrame([(1, "The deposit was ₹45,000 [1]. Ramesh Kumar's phone is 98450 12345 [2]."), (2, "See the clause [1, 2].")], "k int, text string")
    chunks = spark.createDataFrame([(1, 1, CHUNKS[1]), (1, 2, CHUNKS[2]), (1, 3, CHUNKS[3]), (2, 1, long), (2, 2, line)], "k int, n int, text string")
    out = {(r["k"], r["n"]): r["quote"] for r in citations.cited_quotes(answers, chunks, "k").collect()}
    assert out[1, 1] == "The deposit was 45,000." and out[1, 2] == "His phone number is 98450 12345." and out[2, 2] == line and len(out) == 4
    assert len(out[2, 1]) <= 200 and long.startswith(out[2, 1]) and long[len(out[2, 1])] == " "


DAY = dt.date.fromisoformat
FACTS = "fact_id string, seq long, entity_id string, field string, value string, source_type string, doc_id string, quote string, valid_from date, valid_to date, superseded_by string"
DOCUMENTS = "doc_id string, path string, source string, doc_type string, signature_status string, holder_status string"


@pytest.fixture
def demo(spark):
    docs = [("d_dec", "notes/rent_decision.md", "note", "note", "unsigned", None), ("d_bank", "pdfs/bank_statement_signed.pdf", "pdf", "bank_statement", "issuer_signed", None), ("d_inbox", "notes/inbox_note.md", "note", "note", "unsigned", None)]
    chunks = [("d_dec", 0, "I decided to renew only if rent stays under ₹15,000."), ("d_bank", 0, "2026-08-05 UPI/RENT/RAVI KUMAR 14,500.00 65,750.00"), ("d_inbox", 0, "Landlord said rent goes to ₹16k from January.")]
    facts = [
        ("f_now", 1, "o", "rent_amount", "14500", "issuer_doc", "d_bank", "2026-08-05 UPI/RENT/RAVI KUMAR 14500", DAY("2026-08-05"), None, None),
        ("f_jan", 2, "o", "rent_amount", "16000", "extracted", "d_inbox", "Landlord said rent goes to 16000 from January.", DAY("2027-01-01"), None, None),
        ("f_gym", 3, "o", "gym_membership_fee", "2500", "owner_stated", None, "My gym fee is 2500", DAY("2026-09-01"), None, None),
    ]
    decisions = [("e_dec", "o", 1, "I decided to renew only if rent stays under ₹15,000.", "d_dec", 0), ("e_dec2", "o", 2, "I will probably renew if the rent stays below 15000", None, None)]
    return {
        "facts": spark.createDataFrame(facts, FACTS), "documents": spark.createDataFrame(docs, DOCUMENTS), "chunks": spark.createDataFrame(chunks, "doc_id string, n int, text string"),
        "decisions": spark.createDataFrame(decisions, "decision_id string, owner string, seq long, quote string, doc_id string, n int"),
    }


def ask(spark, *texts, used=()):
    return spark.createDataFrame([(i, "o", t, list(used)) for i, t in enumerate(texts)], "question_id int, owner string, text string, used array<string>")


def test_condition_lines(spark, demo):
    about = ["Should I still renew the flat?", "Does my renewal condition still hold?", "What was my decision about renewing the flat?"]
    other = ["What's my rent?", "What is my salary?", "Who is my landlord?", "What about the flat?"]
    out = {r["question_id"]: r for r in known.condition_rows(ask(spark, *about, *other), **demo, as_of="2026-09-30").collect()}
    assert set(out) == {0, 1, 2}
    for r in out.values():
        assert (r["decision_id"], r["doc_id"], r["n"], r["met"], r["stops"]) == ("e_dec", "d_dec", 0, True, DAY("2027-01-01"))
        assert r["line"] == (
            'condition check (computed) for "I decided to renew only if rent stays under ₹15,000." (rent_amount < 15000): outcome: the condition stops being met on 2027-01-01. '
            "rent_amount today = 14500 (bank-signed statement, bank_statement_signed.pdf) -> met; from 2027-01-01 = 16000 (from your notes, inbox_note.md) -> NOT met"
        )
    assert known.condition_rows(ask(spark, "What about the flat?", used=["e_dec"]), **demo, as_of="2026-09-30").count() == 1
    # once January has come, the condition is simply not met
    late = demo | {"facts": demo["facts"].withColumn("valid_to", F.when(F.col("fact_id") == "f_now", F.lit("2027-01-01").cast("date")))}
    assert "outcome: the condition is NOT met today" in known.condition_rows(ask(spark, about[1]), **late, as_of="2027-01-02").first()["line"]
    now = demo | {"facts": demo["facts"].filter("fact_id <> 'f_jan'")}
    assert "outcome: the condition is met." in known.condition_rows(ask(spark, about[1]), **now, as_of="2026-09-30").first()["line"]
    none = demo | {"facts": demo["facts"].limit(0)}
    line = known.condition_rows(ask(spark, about[1]), **none, as_of="2026-09-30").first()["line"]
    assert line.endswith("outcome: can't tell. no current rent_amount")
    gone = demo | {"chunks": demo["chunks"].filter("doc_id <> 'd_dec'")}
    assert known.condition_rows(ask(spark, about[1]), **gone, as_of="2026-09-30").first()["doc_id"] == "d_bank"
    assert known.condition_rows(ask(spark, about[1]), **(demo | {"chunks": demo["chunks"].limit(0)}), as_of="2026-09-30").count() == 0


def test_asked_conditions_equal_a_loop(spark):
    """Two oldest different conditions a question, though an index keeps two a stem only."""
    rng = random.Random(1)
    words = ["renewal", "garden", "balcony", "parking", "kitchen"]
    made = [(f"e{i:03}", "o" if i % 4 else "p", i, f"{' '.join(rng.sample(words, 2))} only if rent stays under {rng.choice([100, 200, 300, 400])}") for i in range(120)]
    asked = [(i, rng.choice("op"), rng.choice(["the ", "my plan "]) + " ".join(rng.sample(words, rng.randrange(3))), rng.sample([m[0] for m in made], rng.randrange(3))) for i in range(60)]
    out = known.asked_conditions(spark.createDataFrame(asked, "question_id int, owner string, text string, used array<string>"), spark.createDataFrame(made, "decision_id string, owner string, seq long, quote string"))
    want = set()
    for i, owner, text, used in asked:
        seen = set()
        for d, o, _, quote in made:
            amount = int(quote.split()[-1])
            stems = {w[:5] for w in quote.split() if w.isalpha()} - {"rent", "under", "stays", "if"}
            about = d in used or "plan" in text or {w[:5] for w in text.split()} & stems & {w[:5] for w in words}
            if o == owner and about and amount not in seen and len(seen) < 2:
                seen.add(amount)
                want.add((i, d))
    assert {(r["question_id"], r["decision_id"]) for r in out.collect()} == want


def test_known_fact_rows(spark, demo):
    del demo["decisions"]
    q = ask(spark, "What is my rent?", "Who is my landlord?", "What is my gym fee?", "How do I get home?")
    rows = {(r["question_id"], r["fact_id"]): r for r in known.known_fact_rows(q, **demo, as_of="2026-09-30").collect()}
    assert set(rows) == {(0, "f_now"), (0, "f_jan"), (1, "f_jan")}
    assert rows[0, "f_now"]["line"] == "rent_amount today = 14500 (bank-signed statement, bank_statement_signed.pdf, since 2026-08-05, changes to 16000 on 2027-01-01)"
    assert rows[0, "f_jan"]["line"] == "rent_amount from 2027-01-01 = 16000 (future change from today's 14500; from your notes, inbox_note.md)"
    assert rows[0, "f_jan"]["doc_id"] == "d_inbox" and rows[0, "f_now"]["n"] == 0
    del demo["chunks"]
    said = known.owner_stated_lines(q, **demo, as_of="2026-09-30").collect()
    assert [tuple(r) for r in said] == [(2, "The owner has also told you: gym_membership_fee today = 2500 (you told me, since 2026-09-01).")]


@pytest.mark.parametrize(
    "source, doc_type, source_type, signature, holder, label",
    [
        ("chat", "whatsapp", "extracted", "unsigned", None, "from your WhatsApp chat"),
        ("note", "note", "extracted", "unsigned", None, "from your notes"),
        ("pdf", "rent_agreement", "extracted", "unsigned", None, "from an unsigned document"),
        ("pdf", "marksheet", "issuer_doc", "issuer_signed", "mismatch", "board-signed marksheet"),
        ("pdf", "other", "issuer_doc", "issuer_signed", None, "issuer-signed document"),
        ("pdf", "marksheet", "extracted", "issuer_signed", "mismatch", "signed document in someone else's name"),
        (None, None, "extracted", None, None, "from your files"),
    ],
)
def test_source_labels(spark, source, doc_type, source_type, signature, holder, label):
    row = spark.createDataFrame([(source, doc_type, source_type, signature, holder)], "source string, doc_type string, kind string, signature string, holder string")
    assert row.select(known.source_label(F.col("kind"), F.lit(True), F.col("source"), F.col("doc_type"), F.col("signature"), F.col("holder"))).first()[0] == label
    assert row.select(known.source_label(F.lit("owner_stated"), F.lit(False), *[F.lit(None).cast("string")] * 4)).first()[0] == "you told me"


@pytest.mark.parametrize(
    "quote, read",
    [
        ("Renew if the rent is less than 500 or over 900.", ("rent_amount", "<", 500)),
        ("We stay as long as my salary is at least Rs 1,20,000", ("monthly_income", ">=", 120000)),
        ("Unless income goes up to 5k, if rent is under 7", ("monthly_income", ">", 5000)),
        ("if the flat is under 5; if rent rises above 6", ("rent_amount", ">", 6)),
        ("if rent is over the moon, within 40", ("rent_amount", "<=", 40)),
        ("if rent is under 99999999999999999999 or above 7", ("rent_amount", ">", 7)),
        ("if rent is under 9223372036854775807", ("rent_amount", "<", 9223372036854775807)),
        ("provided rent stays low. Below 5", None),
        ("if-rent under 5", None),
        ("", None),
        (None, None),
    ],
)
def test_conditions(spark, quote, read):
    c = spark.createDataFrame([(quote,)], "t string").select(parse.condition(F.col("t")).alias("c")).first()["c"]
    assert (c and tuple(c)) == read


def test_conditions_of_a_narrow_file_are_many_tasks(spark):
    one = spark.createDataFrame([(f"e{i}", "u", i, f"if rent is under {i}.") for i in range(300)], "decision_id string, owner string, seq long, quote string").coalesce(1)
    made = known.conditional(one)
    assert made.count() == 300 and sum(n > 0 for n in made.rdd.glom().map(len).collect()) > 4

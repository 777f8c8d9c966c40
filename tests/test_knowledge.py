"""Operators on small cases whose results are known."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import parse, text
from tessera.operators import explode, graph, rules, search, tables, temporal


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "given, want",
    [
        ("₹15,000", 15000), ("Rs. 15,000/-", 15000), ("62,000.00", 62000), ("1.5k", 1500), ("12,34,567", 1234567), ("2 cr", 20000000), ("1.2 lakh", 120000),
        ("3 L", 300000), ("50000", 50000), ("50-60k", None), ("₹99.50", None), ("5 l", None), ("15kg", None), ("about 5", None), ("", None),
    ],
)
def test_amounts(spark, given, want):
    assert one(spark, given, parse.parse_amount) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("salary 62,000.00 and bonus 1.2 lakh", "salary 62000 and bonus 120000"),
        ("50-60k or ₹99.50 or 1,2,3 on 05/06/2026, call 9876543210", "50-60k or ₹99.50 or 1,2,3 on 05/06/2026, call 9876543210"),
        (None, None),
    ],
)
def test_amounts_in_text(spark, given, want):
    assert one(spark, given, parse.normalize_amounts) == want


@pytest.mark.parametrize(
    "quote, want",
    [
        ("only if rent stays under 15000", ("rent_amount", "<", 15000)),
        ("only if rent stays under ₹15,000", ("rent_amount", "<", 15000)),
        ("unless my salary is above 1.2 lakh", ("monthly_income", "<=", 120000)),
        ("unless rent goes above 16000", ("rent_amount", "<=", 16000)),
        ("as long as my salary is at least ₹ 50000", ("monthly_income", ">=", 50000)),
        ("Rent is 15000 below market.", None),
    ],
)
def test_conditions(spark, quote, want):
    got = one(spark, quote, parse.condition)
    assert (tuple(got) if got else None) == want


def test_dates(spark):
    got = one(spark, "On 2026-09-18, 12 March 2026, March 13, 2026 and 05/06/26; 31/02/2026 isn't one", parse.explicit_dates)
    assert [d["day"].isoformat() for d in got] == ["2026-09-18", "2026-03-12", "2026-03-13", "2026-06-05"]
    ref = F.lit("2026-09-18").cast("date")
    for raw, want in (("from January", "2027-01-01"), ("December", "2026-12-01"), ("March 2025", "2025-03-01"), (" ", "2026-09-18"), ("2026-02-30", None), ("2026-02-28", "2026-02-28"), ("soon", None)):
        got = one(spark, raw, lambda c: parse.resolve_valid_from(c, ref))
        assert (got.isoformat() if got else None) == want
    for day, years in (("2024-05-13", 20), ("2024-05-14", 21)):
        assert one(spark, "2003-05-14", lambda c, d=day: parse.age(c.cast("date"), F.lit(d).cast("date"))) == years


def test_text(spark):
    assert one(spark, "Is my rent_15 Flat_4B, Indiranagar", text.tokens) == ["rent", "15", "flat", "4b", "indiranagar"]
    assert one(spark, "Mr. Ravi  KUMAR", text.name_key) == "ravi kumar" and one(spark, "Nimbus Analytics Pvt L", text.name_key) == "nimbus analytics"
    assert one(spark, "the Bank", text.is_role_word) and not one(spark, "State Bank", text.is_role_word)
    assert one(spark, "a [[Flat  move 2026|x]] [[B#h]] [[B]]", text.links) == ["Flat move 2026", "B"]
    assert one(spark, "It is 5. Really? [1]\nYes [2].", text.sentences) == ["It is 5.", "Really? [1]", "Yes [2]."]
    assert one(spark, "See [1, 2] and [3]", text.cited_numbers) == [1, 2, 3]
    assert one(spark, "Well, is it so", text.is_question) and not one(spark, "It is so.", text.is_question)
    assert one(spark, "current_salary", text.canonical_field) == "monthly_income" and one(spark, "Gym fee!", text.field_name) == "gym_fee"
    assert one(spark, "162000", text.indian_grouping) == "1,62,000" and one(spark, "notes/flat_move-2026.md", text.note_title) == "Flat move 2026"
    assert one(spark, "a -----\n\n\n|  b ||", text.compacted) == "a -\n| b |"
    assert one(spark, "ab 12!", text.estimated_tokens) == 4


def test_chunks():
    rng = random.Random(1)
    body = " ".join("w" * rng.randrange(1, 9) for _ in range(400))
    spans = explode.cuts(body, 600, 100)
    assert all(b - a <= 600 for a, b in spans) and spans[-1][1] == len(body)
    assert all(50 <= b - a <= 150 for (_, b), (a, _) in zip(spans, spans[1:])) and all(a == 0 or body[a - 1] == " " for a, _ in spans)
    assert all(b - a <= 600 for a, b in explode.cuts("x" * 1500, 600, 100)) and explode.cuts("", 600, 100) == []


def test_chat(spark):
    chat = "18/09/26, 19:42 - Messages are encrypted\n18/09/26, 19:43 - Ravi: hello\nmore\n[18/09/26, 7:45:10 pm] Asha: <Media omitted>\n19/09/26, 03:00 - Asha: later\n"
    files = spark.createDataFrame([("a", chat), ("b", "12/25/26, 10:00 - X: y"), ("c", "")], "path string, text string")
    out = sorted(map(tuple, explode.messages(files).select("path", "sender", "text", F.date_format("ts", "yyyy-MM-dd HH:mm")).collect()))
    assert out == [("a", "Asha", "later", "2026-09-19 03:00"), ("a", "Ravi", "hello\nmore", "2026-09-18 19:43"), ("b", "X", "y", "2026-12-25 10:00")]
    windows = explode.conversation_windows(explode.messages(files)).filter("path = 'a'").orderBy("locator").collect()
    assert [w["locator"] for w in windows] == ["chat: 2026-09-18 19:43", "chat: 2026-09-19 03:00"]
    long = "\n".join(f"18/09/26, 19:{m:02d} - A: {'x' * 150}" for m in range(8))
    cut = explode.conversation_windows(explode.messages(spark.createDataFrame([("l", long)], "path string, text string"))).orderBy("n").collect()
    assert all(len(w["text"]) <= 600 for w in cut) and cut[1]["text"].split("\n")[0] == cut[0]["text"].split("\n")[-1]


def folded(spark, rows, today="2026-09-20"):
    """rows: (id, value, source, confidence, valid_from) in order of arrival."""
    table = [(f, "e", "k", v, s, c, d, i) for i, (f, v, s, c, d) in enumerate(rows)]
    facts = spark.createDataFrame(table, "fact_id string, entity_id string, field string, value string, source_type string, confidence string, valid_from string, seq long")
    return {r["fact_id"]: (r["valid_to"], r["superseded_by"]) for r in temporal.fold(facts, today).collect()}


def test_fold(spark):
    x = ("extracted", "high")
    assert folded(spark, [("a", "16000", *x, "2026-06-01"), ("b", "15000", *x, "2026-01-01")]) == {"a": (None, None), "b": ("2026-06-01", "a")}
    assert folded(spark, [("a", "15000", *x, "2026-06-01"), ("b", "16000", *x, "2027-01-01")]) == {"a": (None, None), "b": (None, None)}
    assert folded(spark, [("a", "15000", *x, "2026-06-01"), ("b", "16000", *x, "2026-07-01")]) == {"a": ("2026-07-01", "b"), "b": (None, None)}
    low = [("a", "Ravi Kumar", *x, "2026-01-01"), ("b", "somebody", "extracted", "low", "2026-02-01")]
    assert folded(spark, low) == {"a": (None, None), "b": ("2026-02-01", "a")}
    assert folded(spark, [("b", "somebody", "extracted", "low", "2026-02-01"), ("a", "Ravi", *x, "2026-01-01")])["b"] == ("2026-02-01", "a")
    sources = [("i", "14500", "issuer_doc", "high", "2026-06-05"), ("n", "14500", "extracted", "high", "2026-09-18"), ("c", "14500", "extracted", "high", "2026-09-30")]
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        got = folded(spark, [sources[i] for i in order])
        assert got["i"] == (None, None) and got["n"][1] == got["c"][1] == "i"


def test_islands_equal_the_fold_in_order(spark):
    rng = random.Random(3)
    rows = [(i, f"f{i}", f"e{i % 5}", "k", str(rng.randrange(3)), "extracted", "high", dt.date(2024, 1, 1) + dt.timedelta(days=i // 2)) for i in range(120)]
    facts = spark.createDataFrame(rows, "seq long, fact_id string, entity_id string, field string, value string, source_type string, confidence string, valid_from date")
    live = temporal.fold(facts, "2030-01-01").filter("valid_to is null and superseded_by is null")
    last = temporal.islands(facts, ["entity_id", "field"]).filter("valid_to is null")
    assert sorted(map(tuple, live.select("entity_id", "value", "valid_from").collect())) == sorted(map(tuple, last.select("entity_id", "value", F.col("valid_from").cast("string")).collect()))


def test_ledger(spark):
    def allowed(asked, width=25000.0):
        rows = [("k", i, dt.datetime(2026, 9, 1) + dt.timedelta(hours=i), float(t), a) for i, (t, a) in enumerate(asked)]
        q = spark.createDataFrame(rows, "who string, seq long, ts timestamp_ntz, threshold double, answer boolean")
        return [r["allowed"] for r in rules.ledger(q, "who", width).orderBy("seq").collect()]

    assert allowed([(50000, True), (75000, False), (60000, True)]) == [True, True, False]
    assert allowed([(60000, True), (70000, False), (65000, False)]) == [True, False, False]
    assert allowed([(10000, True), (20000, True), (30000, True), (20000, True), (40000, True)]) == [True, True, True, True, False]


def test_audit(spark):
    log = spark.createDataFrame([("a", i, f"b{i}") for i in range(4)], "log string, seq long, body string")
    chain = rules.chained(log, "log")
    assert chain.orderBy("seq").first()["prev_hash"] == "0" * 64
    assert tuple(rules.verified(chain, "log").first()) == ("a", True, None, 4)
    broken = chain.withColumn("body", F.when(F.col("seq") == 2, "x").otherwise(F.col("body")))
    assert tuple(rules.verified(broken, "log").first()) == ("a", False, 2, 4)


def test_hybrid(spark):
    keys = spark.createDataFrame([(i,) for i in range(4)], "id long")
    cosine = spark.createDataFrame([(0, 0.60), (1, 0.45), (2, 0.46), (3, 0.47)], "id long, cos double")
    words = spark.createDataFrame([(1, 2.0)], "id long, bm25 double")
    got = {r["id"]: round(r["score"], 6) for r in search.hybrid(keys, "id", cosine, words).collect()}
    assert got[0] == 0.7 and got[1] == 0.3
    hits = spark.createDataFrame([(i, "d" if i < 4 else "e", 0.9 - i / 10) for i in range(8)], "id long, doc string, score double")
    assert [r["id"] for r in search.capped(hits, "id", "doc").orderBy("rank").collect()] == [0, 1, 4, 5]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "R", "b", "1", False), ("a", "R", "b", "2", True), ("b", "R", "c", "3", False), ("c", "S", "c", "4", False), ("x", "R", "y", "5", True)], "src string, rel string, dst string, source_id string, closed boolean")
    groups = graph.grouped_edges(edges)
    assert {tuple(r) for r in graph.degrees(groups).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert {tuple(r) for r in graph.neighbourhood(edges, ["a"], 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    nodes = spark.createDataFrame([("a",), ("x",)], "id string")
    assert [r["id"] for r in graph.unlinked(nodes, groups).collect()] == ["x"]
    merged = graph.repointed(edges, spark.createDataFrame([("b", "a")], "one_id string, full_id string"))
    assert {r["source_id"]: r["closed"] for r in merged.collect()} == {"1": True, "2": True, "3": False, "4": True, "5": True}
    people = spark.createDataFrame([("1", "ravi"), ("2", "ravi kumar"), ("3", "asha"), ("4", "asha rao"), ("5", "asha iyer")], "id string, key string")
    assert [tuple(r) for r in graph.first_name_merges(people).collect()] == [("1", "2")]
    kinds = spark.createDataFrame([("DECIDED", "PERSON", "DECISION"), ("DECIDED", "ORG", "DECISION"), ("RELATES_TO", "ORG", "PLACE"), ("PART_OF", "ORG", "PROJECT")], "r string, s string, d string")
    assert [r[0] for r in kinds.select(graph.relation_allowed(F.col("r"), F.col("s"), F.col("d"))).collect()] == [True, False, True, False]


def test_tables(spark):
    there = spark.createDataFrame([("a", 1)], "k string, v int")
    more = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "k string, v int")
    assert {tuple(r) for r in tables.inserted_if_absent(there, more, ["k"], [F.col("v")]).collect()} == {("a", 1), ("b", 3)}
    assert {tuple(r) for r in tables.updated(there, more.filter("v = 2"), "k", ["v"]).collect()} == {("a", 2)}


def test_citations(spark):
    answers = spark.createDataFrame([("a", "It is so [1]. Also this."), ("b", "Nothing here."), ("c", "Wrong [7].")], "id string, text string")
    supplied = spark.createDataFrame([("a", 1), ("c", 1)], "id string, n int")
    got = {r["id"]: (r["no_citation"], r["uncited_sentence"], r["citation_ok"]) for r in explode.citation_checks(answers, supplied, "id").collect()}
    assert got == {"a": (False, True, True), "b": (True, False, False), "c": (False, False, False)}


def test_audit_of_a_long_log(spark):
    """A log of several Arrow batches beside a short one, never one value."""
    import hashlib

    log = spark.range(25_000).select(F.when(F.col("id") % 5000 == 7, "b").otherwise("a").alias("log"), F.col("id").alias("seq"), F.concat(F.lit("b"), "id").alias("body"))
    chain = rules.chained(log, "log")
    assert "collect_list" not in chain._jdf.queryExecution().toString()
    last = {"a": "0" * 64, "b": "0" * 64}
    got = {r["seq"]: (r["log"], r["prev_hash"], r["entry_hash"]) for r in chain.collect()}
    for i in range(25_000):
        key = "b" if i % 5000 == 7 else "a"
        entry = hashlib.sha256(f"{last[key]}b{i}".encode()).hexdigest()
        assert got[i] == (key, last[key], entry)
        last[key] = entry


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Is my rent ₹15,000?", ["rent", "15000"]), ("15k", ["15000"]), ("Rs. 15,000/-", ["15000"]), ("1.2 lakh deposit", ["120000", "deposit"]),
        ("Flat_4B, Indiranagar", ["flat", "4b", "indiranagar"]), ("ﬁne Ｈouse", ["fine", "house"]), (None, None), ("", []),
    ],
)
def test_tokens(spark, given, want):
    row = spark.createDataFrame([(given,)], "t string").select(text.tokens(F.col("t")).alias("w")).first()
    assert row["w"] == want


def test_compatible_forms(spark):
    rows = spark.createDataFrame([("ﬁne  day",), ("fine day",), ("é",), ("e\u0301",), ("Miss Rao",), ("rao",)], "t string")
    out = rows.select(text.text_hash(F.col("t")).alias("h"), text.name_key(F.col("t")).alias("k")).collect()
    assert out[0]["h"] == out[1]["h"] and out[2]["h"] == out[3]["h"] and out[4]["k"] == out[5]["k"] == "rao"
    assert [d.isoformat() for _, _, d in parse.dates_in("from 05-06-2026 to 2026-07-01, then 3 May 2027")] == ["2026-06-05", "2026-07-01", "2027-05-03"]


def test_best_sentence_equals_plain_python(spark):
    from tessera.operators import answers

    texts = {1: "The rent is due. The landlord owns the house. Rent of the house is high.", 2: "Nothing here.", 3: ""}
    out = {r["doc_id"]: (r["quote"], r["n_shared"]) for r in answers.best_sentence(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), "doc_id", F.lit("house rent landlord")).collect()}
    asked = {"house", "rent", "landlord"}
    for key, t in texts.items():
        parts = [s for s in t.replace(". ", ".\n").split("\n") if s]
        if parts:
            best = max(parts, key=lambda s: len(asked & set(s.lower().strip(".").split())))
            assert out[key] == (best, len(asked & set(best.lower().strip(".").split())))


def test_display_and_mentions(spark):
    rows = spark.createDataFrame([("RAVI KUMAR",), ("Ravi  Kumar",), ("RK",)], "t string")
    assert [r[0] for r in rows.select(text.display_name(F.col("t"))).collect()] == ["Ravi Kumar", "Ravi Kumar", "RK"]
    one = spark.range(1).select(text.mentions(F.lit("paid ravi today"), F.lit("ravi kumar"), F.lit(True)), text.mentions(F.lit("paid ravi today"), F.lit("ravi kumar"), F.lit(False)), text.escaped(F.lit("</Chunk>"))).first()
    assert tuple(one) == (True, False, "‹/Chunk>")


AMOUNTS = [
    ("₹15,000", 15000), ("Rs. 15,000/-", 15000), ("Rs15,000", 15000), ("INR 5k", 5000), ("₹50K", 50000), ("1,20,000", 120000), ("120,000", 120000), ("2 lakhs", 200000), ("3 lac", 300000), ("5 L", 500000), ("1.5 crore", 15000000),
]
UNCHANGED = [
    "between 50-60k a month", "from ₹50,000 to ₹60,000", "on 2026-08-14 at 21:03", "call 98450 12345", "scored 91.3% in 2026", "items 1,2,3", "5 l of milk, 15kg rice", "12 hours 5 min", "no amounts here", "50k – 60k", "v1.2.3,4", "a15,000 1,000x_", "",
]


def test_scanned_amounts(spark):
    from tessera.functions.scan import plain_amounts

    for given, want in AMOUNTS:
        assert plain_amounts(given) == str(want) and one(spark, given, parse.parse_amount) == want
    for given in UNCHANGED:
        assert plain_amounts(given) == given.replace("1,000x_", "1000x_") and one(spark, given, parse.parse_amount) is None
    assert plain_amounts("Rent: Rs. 15,000 payable on the 5th; ₹1.2 lakh, then 2 cr.") == "Rent: 15000 payable on the 5th; 120000, then 20000000."


@pytest.mark.parametrize("line, want", [("Email: a", True), ("Phone no: 1", True), ("My contact number = 5", True), ("+91 (98450) 123-45.67", True), ("98450 1234", False), ("a@b", True), ("hotel: x", False), ("email me", False)])
def test_contact_lines(spark, line, want):
    assert one(spark, line, text.is_contact_line) is want


@pytest.mark.parametrize("name, want", [("my_salary", "monthly_income"), ("rent_now", "rent_amount"), ("current_house_rent_now", "rent_amount"), ("dob", "date_of_birth"), ("my", "my"), ("new_thing", "new_thing")])
def test_field_synonyms(spark, name, want):
    assert one(spark, name, text.canonical_field) == want


@pytest.mark.parametrize("quote, want", [("if my friends ask, unless the rent, as long as I live, is at most 900", ("rent_amount", ">", 900)), ("Renew as long as the rent is at most 15k", ("rent_amount", "<=", 15000)), ("Decided to move out in January.", None), ("if rent is fine. It is under 500", None), ("if rent stays over 5 or under 3", ("rent_amount", ">", 5))])
def test_more_conditions(spark, quote, want):
    got = one(spark, quote, parse.condition)
    assert (tuple(got) if got else None) == want

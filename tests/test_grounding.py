"""Grounding and the stored graph: golden cases, and the same graph from any cut into batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import grounding as g
from tessera.operators import graph_store as gs

TEXT = "Date: 18 September 2026\n\nDecision: I decided to renew only if rent stays under ₹15,000.\nProject: [[Flat move 2026]]. Topic: rent renewal. Landlord is Mr. Ravi, 98450 12345, ravi@example.com."
OWNER = "ananya iyer"


class Ground:
    def __init__(self, spark, rows):
        """rows: of (text, names, decisions, contacts, relations)."""
        table = lambda data, schema: spark.createDataFrame(data, schema)
        self.chunks = table([("d", i, r[0]) for i, r in enumerate(rows)], "doc_id string, n int, text string")

        def part(k, schema):
            return table([("d", i, pos, *(x if isinstance(x, tuple) else (x,))) for i, r in enumerate(rows) if len(r) > k for pos, x in enumerate(r[k])], "doc_id string, n int, pos int, " + schema)

        self.names = g.names(part(1, "type string, name string"), self.chunks, OWNER)
        kept = self.names.filter("state = 'kept'")
        self.decisions = g.decisions(part(2, "quote string, date string"), self.chunks, kept)
        self.kept = g.entities(self.names, self.decisions)
        self.contacts = g.contacts(part(3, "name string, phone string, email string"), self.chunks, self.kept)
        self.listed = g.listed_relations(part(4, "src string, rel string, dst string"), self.chunks, self.kept, OWNER)
        self.relations = g.relations(self.listed, self.chunks, self.kept)


def test_names(spark):
    rows = [
        (TEXT, [("PERSON", "Ravi"), ("PERSON", "Arjun Rao"), ("PERSON", "I"), ("PERSON", "Ananya"), ("ORG", ""), ("PROJECT", "Flat move 2026")]),
        (TEXT, [("PERSON", "Mr. Ravi"), ("OBLIGATION", "Rent renewal"), ("CONCEPT", "rent renewal"), ("CONCEPT", "Ravi")]),
        ("Tenant: Ananya Iyer. Landlord: Ravi Kumar. My bank is Mock Bank. Landlord notes.", [("PERSON", "Landlord"), ("PERSON", "Tenant"), ("PERSON", "Ravi Kumar"), ("ORG", "Bank"), ("ORG", "Mock Bank"), ("DOCUMENT", "Landlord")]),
    ]
    out = {(r["n"], r["pos"]): r["state"] for r in Ground(spark, rows).names.collect()}
    assert [out[0, i] for i in range(6)] == ["kept", "name not in text", "owner", "owner", "empty name", "kept"]
    assert [out[1, i] for i in range(4)] == ["kept", "kept", "listed", "listed"]
    assert [out[2, i] for i in range(6)] == ["role word, not a name", "role word, not a name", "kept", "role word, not a name", "kept", "kept"]


def test_decisions(spark):
    quote = "decision: i decided to renew only if rent  stays under ₹15,000."
    chat = "18/09/26, 19:46 - Duk: Is the rent still the same?\n18/09/26, 19:48 - Ravi: Yes, the current rent is 14500.\n21/09/26, 11:18 - Ravi: I'll send them tonight.\n20/09/26, 18:21 - Duk: I will probably renew if the rent stays below 15000.\n18/09/26, 19:50 - Duk: I decided to wait."
    said = [("Is the rent still the same?", "2026-09-18"), ("Yes, the current rent is 14500.", "2026-09-18"), ("I'll send them tonight.", "2026-09-21"), ("I will probably renew if the rent stays below 15000.", "2026-09-20"), ("I decided to wait.", "2026-09-18")]
    bad = [("I decided to move out.", "2026-09-18"), ("  ", "2026-09-18"), (quote, None), (quote, "18 September 2026"), (quote, "2026-09-19"), (quote, "2025-09-18"), (None, None)]
    all_ = Ground(spark, [(TEXT, [("PROJECT", "Flat move 2026"), ("CONCEPT", "rent renewal"), ("PERSON", "Ravi")], [(quote, "2026-09-18"), (quote, "2026-09-18")]), (TEXT, [], bad), (chat, [], said)])
    out = {(r["n"], r["pos"]): r for r in all_.decisions.collect()}
    d = out[0, 0]
    assert d["state"] == "kept" and d["name"].lower() == "i decided to renew only if rent stays under ₹15,000" and d["quote"] == "decision: i decided to renew only if rent stays under ₹15,000."
    assert out[0, 1]["state"] == "listed" and all(out[1, i]["state"].startswith("decision ") for i in range(len(bad)))
    assert [out[2, i]["state"] for i in range(5)] == ["decision states no choice"] * 3 + ["kept"] * 2
    got = {(r["src"], r["rel"], r["dst"], r["valid_from"]) for r in all_.relations.filter("n = 0").collect()}
    day = dt.date(2026, 9, 18)
    assert {x for x in got if x[1] != "LANDLORD_OF"} == {("@owner", "DECIDED", d["key"], day), (d["key"], "PART_OF", "flat move 2026", day), (d["key"], "ABOUT", "rent renewal", day)}


def test_contacts_and_relations(spark):
    names = [("PERSON", "Mr. Ravi"), ("PROJECT", "Flat move 2026"), ("ORG", "Rent")]
    contacts = [("Ravi", "+91 98450-12345", "ravi@example.com"), ("Rent", "99999 00000", "x@y.com"), ("Arjun", None, "ravi@example.com"), ("Ravi", "98450", "RAVI@example.com")]
    relations = [("Ravi", "LANDLORD_OF", "I"), ("Ananya", "WORKS_ON", "flat move 2026"), ("Ravi", "LANDLORD_OF", "me"), ("Ravi", "RELATES_TO", "Arjun"), ("Ravi", "RELATES_TO", "Ravi"), ("Ravi", "MENTIONED_IN", "Flat move 2026"), ("I", "DECIDED", "Flat move 2026"), ("Ravi", "WORKS_ON", "Flat move 2026"), ("Ravi", "PART_OF", "Flat move 2026")]
    all_ = Ground(spark, [(TEXT, names, [], contacts, relations)])
    assert [tuple(r)[2:] for r in all_.contacts.collect()] == [("ravi", "+91 98450-12345", "ravi@example.com")]
    states = [r["state"] for r in all_.listed.orderBy("pos").collect()]
    assert states == ["kept", "kept", "listed"] + ["dropped"] * 6
    assert {(r["src"], r["rel"], r["dst"]) for r in all_.relations.collect()} == {("ravi", "LANDLORD_OF", "@owner"), ("@owner", "WORKS_ON", "flat move 2026")}


@pytest.mark.parametrize(
    "said, name, want",
    [
        ("The landlord is Ravi Kumar.", ("PERSON", "Ravi Kumar"), ("ravi kumar", "LANDLORD_OF", "@owner")),
        ("Landlord: Ravi Kumar Property: Flat 402", ("PERSON", "Ravi Kumar"), ("ravi kumar", "LANDLORD_OF", "@owner")),
        ("My landlord Ravi lives upstairs.", ("PERSON", "Ravi"), ("ravi", "LANDLORD_OF", "@owner")),
        ("My employer is Nimbus Analytics Pvt Ltd.", ("ORG", "Nimbus Analytics Pvt Ltd"), ("@owner", "EMPLOYED_BY", "nimbus analytics")),
        ("Bank: Mock Bank of India", ("ORG", "Mock Bank of India"), ("@owner", "BANKS_WITH", "mock bank of india")),
        ("Tenant: Priya Landlord: Ravi Kumar", ("PERSON", "Priya"), None),
        ("My bank is Ravi Kumar.", ("PERSON", "Ravi Kumar"), None),
    ],
)
def test_role_relations(spark, said, name, want):
    got = [(r["src"], r["rel"], r["dst"]) for r in Ground(spark, [(said, [name])]).relations.collect()]
    assert got == ([want] if want else [])


def test_bank_parties(spark):
    rows = spark.createDataFrame([("d", 3, "debit", "RAVI KUMAR"), ("d", 1, "debit", "Mr. Ravi  Kumar"), ("d", 2, "credit", "Nimbus Pvt Ltd"), ("d", 4, "debit", "Nobody")], "doc_id string, n int, direction string, party string")
    graph = spark.createDataFrame([("e9", 9, "PERSON", "ravi kumar"), ("e1", 1, "CONCEPT", "ravi kumar"), ("e4", 4, "PERSON", "ravi kumar"), ("e5", 5, "ORG", "nimbus")], "id string, seq long, type string, key string")
    assert sorted((r["src"], r["rel"], r["dst"], r["n"]) for r in g.paid_edges(rows, graph).collect()) == [("@owner", "PAID", "e4", 1), ("e5", "PAID", "@owner", 2)]


def snapshot(store):
    entities, edges = store.graph()
    a = sorted((r["id"], r["key"], r["type"], r["name"], tuple(sorted(r["attrs"].items())), r["n_mentions"]) for r in entities.collect())
    b = sorted((r["edge_id"], r["src"], r["rel"], r["dst"], str(r["valid_from"]), r["closed"]) for r in edges.collect())
    return a, b


def test_note_links(spark, tmp_path):
    note = "# Budget\nKeep rent low.\n\nRelated:\n- [[Rent renewal]]\n- [[Flat move 2026|flat]]\n- [[Rent renewal#Notes]]\n- [[Budget]]"
    store = gs.GraphStore(spark, str(tmp_path / "g"))
    store.write(0, *gs.note_rows(spark.createDataFrame([("d1", "notes/budget.md", 0, note)], "doc_id string, path string, n int, text string")))
    entities, edges = store.graph()
    found = {r["name"]: r for r in entities.collect()}
    assert {n: (r["type"], dict(r["attrs"])) for n, r in found.items()} == {"Budget": ("DOCUMENT", {"path": "notes/budget.md"}), "Rent renewal": ("CONCEPT", {"origin": "link"}), "Flat move 2026": ("CONCEPT", {"origin": "link"})}
    i = {n: r["id"] for n, r in found.items()}
    assert {(r["src"], r["rel"], r["dst"]) for r in edges.collect()} == {(i[n], "MENTIONED_IN", i["Budget"]) for n in ("Rent renewal", "Flat move 2026")} | {(i["Budget"], "RELATES_TO", i[n]) for n in ("Rent renewal", "Flat move 2026")}
    with_project = spark.createDataFrame([("d2", "notes/plan.md", 0, "Project: [[Flat move 2026]]\nRelated:\n- [[Rent renewal]]\n- [[Ravi]]")], "doc_id string, path string, n int, text string")
    named = spark.createDataFrame([("ravi", "named", "PERSON", "Ravi", {}, "d2", 1), ("flat move 2026", "named", "PROJECT", "Flat Move 2026", {"due": "May"}, "d2", 2)], gs.MENTIONS)
    mentions, more = gs.note_rows(with_project)
    store.write(1, mentions.unionByName(named), more)
    entities, edges = store.graph()
    i = {r["key"]: r["id"] for r in entities.collect()}
    assert {r["key"]: r["type"] for r in entities.collect()}["flat move 2026"] == "PROJECT"  # the placeholder is taken over
    got = {(r["src"], r["rel"], r["dst"]) for r in edges.filter("doc_id = 'd2'").collect()}
    assert got == {(i[k], "MENTIONED_IN", i["plan"]) for k in ("rent renewal", "ravi", "flat move 2026")} | {(i["rent renewal"], "PART_OF", i["flat move 2026"]), (i["flat move 2026"], "RELATES_TO", i["ravi"])}


def test_graph_from_any_batches(spark, tmp_path):
    mentions = [
        ("ravi", "named", "PERSON", "Ravi", {"phone": "98450 12345"}, "d1", 1), ("ravi kumar", "named", "PERSON", "RAVI KUMAR", {}, "d2", 1), ("ravi kumar", "named", "ORG", "Ravi Kumar", {"email": "r@x"}, "d3", 1),
        ("flat", "link", None, "Flat", None, "d1", 2), ("flat", "note", "DOCUMENT", "Flat", {"path": "flat.md"}, "d4", 1), ("rent", "link", None, "Rent", None, "d2", 2), ("rent", "named", "CONCEPT", "rent", {}, "d4", 2),
    ]
    edges = [
        ("d1", 1, "ravi", "named", "LANDLORD_OF", "@owner", "named", None, None), ("d1", 2, "ravi", "named", "RELATES_TO", "ravi kumar", "named", None, None), ("d1", 1, "flat", "link", "RELATES_TO", "rent", "link", None, None),
        ("d3", 1, "ravi kumar", "named", "LANDLORD_OF", "@owner", "named", None, None), ("d3", 1, "ravi kumar", "named", "STUDIED_AT", "rent", "named", None, None), ("d2", 1, "nobody", "named", "RELATES_TO", "rent", "named", None, None),
    ]
    m, e = spark.createDataFrame(mentions, gs.MENTIONS), spark.createDataFrame(edges, gs.EDGES)
    whole = gs.GraphStore(spark, str(tmp_path / "a"))
    whole.write(0, m, e)
    want = snapshot(whole)
    whole.write(0, m, e)
    assert snapshot(whole) == want  # the same batch again
    m.write.parquet(str(tmp_path / "a" / "mentions" / "batch=7"))
    assert snapshot(whole) == want  # a batch without its mark
    parts = gs.GraphStore(spark, str(tmp_path / "b"))
    for k, docs in enumerate((["d1"], ["d2", "d3"], ["d4"])):
        parts.write(k, m.filter(F.col("doc_id").isin(docs)), e.filter(F.col("doc_id").isin(docs)))
    assert snapshot(parts) == want
    entities = {r[1]: r for r in want[0]}
    assert set(entities) == {"ravi kumar", "flat", "rent"} and entities["ravi kumar"][2:5] == ("PERSON", "Ravi Kumar", (("email", "r@x"), ("phone", "98450 12345")))
    assert entities["flat"][2] == "DOCUMENT" and entities["rent"][3] == "Rent"
    assert sorted((x[2], x[5]) for x in want[1]) == [("LANDLORD_OF", False), ("LANDLORD_OF", False), ("RELATES_TO", False), ("RELATES_TO", True)]

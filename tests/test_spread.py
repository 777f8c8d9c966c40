"""Work that is large for its bytes is dealt over all cores, however few row groups its file has."""

import datetime as dt

import pytest

from tessera.operators import explode, memory, views
from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["condition_checks", "unrelated_dropped", "dates_in_texts", "starts_in_quotes"])
def test_narrow_files_are_dealt(spark, name):
    assert "RepartitionByExpression" in catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_taught_statements_are_many_tasks(spark):
    day = dt.date(2024, 2, 1)
    rows = spark.createDataFrame([(i, "u", f"My rent is {i + 1}", "rent", str(i + 1), "", day) for i in range(200)], "seq long, owner string, statement string, field string, value string, valid_from string, today date")
    out = memory.taught(rows.coalesce(1))
    assert out.count() == 200 and out.rdd.getNumPartitions() > 4


def test_chunks_take_few_texts_at_once(spark):
    texts = [(i, None if i % 7 == 0 else f"Word {i} is here. " * (i % 90)) for i in range(3 * explode.TEXTS + 5)]
    out = explode.chunks(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()  # no array of a whole batch's chunks
    want = [(i, n, (t or "").strip()[a:b].strip()) for i, t in texts for n, (a, b) in enumerate(explode.cuts((t or "").strip(), explode.SIZE, explode.OVERLAP))]
    assert sorted(map(tuple, out.collect())) == want


def test_evidence_is_distinct_before_it_meets_chunks(spark):
    edges = spark.createDataFrame([("a", "R", "b", "s1", False)] * 3 + [("b", "R", "a", "s2", False)], "src string, rel string, dst string, source_id string, closed boolean")
    chunks = spark.createDataFrame([("s1",), ("s1",), ("s3",)], "source_id string")
    out = views.existing_evidence(edges, chunks, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert out.count() == 1
    assert not out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")

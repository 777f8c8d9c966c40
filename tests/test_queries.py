"""Every registered query against its SQL, on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    out = catalog.QUERIES[name](spark, DATA)
    columns = sorted(out.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in out.select(*columns).collect()), key=str)
    if name not in catalog.ORACLE:
        assert rows
        return
    found = duck.sql(catalog.ORACLE[name])
    assert sorted(found.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted((tuple(plain(v) for v in r) for r in duck.sql(f"SELECT {names} FROM ({catalog.ORACLE[name]})").fetchall()), key=str)


def test_stream_decides_as_the_batch(spark):
    a = catalog.QUERIES["stream_ledger"](spark, DATA).select("user_id", "seq", "allowed").collect()
    b = catalog.QUERIES["ledger_fold"](spark, DATA).select("user_id", "seq", "allowed").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_streams_write_to_the_shared_folder(spark, tmp_path, monkeypatch):
    from tessera.plans import stream_queries

    monkeypatch.setattr(stream_queries, "shared_folder", lambda spark: f"file://{tmp_path}")
    out = catalog.QUERIES["stream_versions"](spark, DATA)
    assert out.count() > 0 and all("/stream-" in f for f in out.inputFiles())
    assert list(tmp_path.glob("stream-*/state/offsets/*"))

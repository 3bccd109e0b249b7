"""Every query with SQL against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 7)
    return value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in frame.collect()), key=str)
    cursor = duck.execute(entry.oracle_sql()[name])
    places = [c[0] for c in cursor.description]
    assert sorted(places) == names
    order = [places.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {n for n in entry.queries() if n.startswith("op") or n == "pipeline"}))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

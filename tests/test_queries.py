"""Registered queries against the oracles, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return str(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query with SQL gives the same rows in DuckDB; the others run. Small tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


def norm(v):
    return str(v) if isinstance(v, decimal.Decimal) else round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = sorted(repr([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        told = duck.sql(sql)
        at = [told.columns.index(c) for c in sorted(df.columns)]
        assert sorted(told.columns) == sorted(df.columns)
        assert rows == sorted(repr([norm(r[i]) for i in at]) for r in told.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Every query with SQL against DuckDB on the smallest tables, and row checks for the others."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    verdict = compare(got, want)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_gives_rows(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["series", "ts", "value"]

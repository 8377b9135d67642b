"""The registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# The heaviest ones run in checks.compare only.
QUICK = [n for n in SQL if n.split("_")[0].rstrip("0123456789") in ("flt", "rte", "cst", "shp", "win", "top")]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["genre", "routed_strategy", "n", "accuracy", "tokens_spent", "tokens_saved"]
    assert out.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    from pairflow.catalog import QUERIES as OWN
    assert set(OWN) <= set(SQL)


def test_sql_parses():
    for name, sql in SQL.items():
        assert duckdb.extract_statements(sql), name


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, SQL[name]) == []

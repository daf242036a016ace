"""Every query with SQL gives the same rows as DuckDB, value for value."""

import os

import pytest

import catalog
from tests.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
catalog.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_equal_sql(spark, con, name):
    assert compare(catalog.QUERIES[name](spark, SF_DIR), con, catalog.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

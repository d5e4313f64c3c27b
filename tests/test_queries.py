"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest
from compare import compare, duckdb_tables

import __spark_entry__ as entry
from stratamart.checks import CHECKS


@pytest.fixture(scope="module")
def con(small):
    return duckdb_tables(small)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query(spark, con, small, name):
    assert compare(spark, con, name, small) is None


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1

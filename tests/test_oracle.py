"""Every query against its SQL on the small sample tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from mercadia.registry import all_queries
from tests.conftest import SMALL
from tests.oracle_check import connect, differences, run_duckdb, run_spark

# The text operators have tests of their own beside them.
QUERIES = {name: query for name, query in driver.queries().items() if name in all_queries()}
SQL = {name: sql for name, sql in driver.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_entry_runs(spark):
    assert driver.entry(spark).count() == 1


def test_sql_belongs_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert not differences(run_spark(QUERIES[name](spark, SMALL)), run_duckdb(duck, SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0

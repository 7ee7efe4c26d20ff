"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry

from marginmill.plans import catalogue, oracle

from .compare import differences, duck

DIRECTORY = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(DIRECTORY)


def test_every_query_has_sql():
    assert set(catalogue.registered()) == set(SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", catalogue.registered())
def test_query(spark, con, name):
    assert differences(entry.queries()[name](spark, DIRECTORY), con, SQL[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 5

"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as driver
from tests.compare import connect, differences

SQL = driver.oracle_sql()
QUERIES = driver.queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, duck, sf_dir):
    assert differences(QUERIES[name](spark, sf_dir), duck, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0

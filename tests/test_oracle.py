"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    problem, _ = compare(spark, con, name, QUERIES[name], SQL[name], sf)
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 18

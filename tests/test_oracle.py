"""Every registered query with SQL gives the rows that DuckDB gives; the others run and keep their promises."""

import pytest

import compare
from siltstone.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, con, name):
    assert compare.differences(spark, QUERIES[name], SQL[name], sf_dir, con) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10

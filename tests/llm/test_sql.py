"""The operators' queries that SQL can express, against DuckDB."""

import pytest

import compare
from siltstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, sf_dir, name):
    assert compare.differences(spark, queries.queries()[name], queries.oracle_sql()[name], sf_dir) == []


def test_one_query_an_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14))

"""Queries on made tables whose keys go further than those of the test data."""

import compare
from pyspark.sql import functions as F

from siltstone.operators import relational
from siltstone.plans import catalog


def same(spark, folder, name, tables):
    """The query's differences from its SQL over tables (name: rows, schema); others aren't there."""
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    con = compare.duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return compare.differences(spark, catalog.queries()[name], catalog.oracle_sql()[name], str(folder), con)


def test_one_hop_edges_of_many_customers(spark, tmp_path):
    """A customer numbered like a supplier's node isn't that supplier."""
    orders = ([(1, 5), (2, 100003), (3, 7)], "o_orderkey long, o_custkey long")
    lines = ([(1, 1), (1, 3), (2, 4), (3, 3)], "l_orderkey long, l_suppkey long")
    assert same(spark, tmp_path, "g06_one_hop_edges", {"orders": orders, "lineitem": lines}) == []


def test_customers_without_any_order(spark, tmp_path):
    customers = ([(1,), (2,), (3,)], "c_custkey long")
    orders = ([(1, 10.0), (3, 400000.0)], "o_custkey long, o_totalprice double")
    assert same(spark, tmp_path, "j21_anti", {"customer": customers, "orders": orders}) == []
    assert [r.c_custkey for r in catalog.queries()["j21_anti"](spark, str(tmp_path)).collect()] == [2]


def test_blocks_by_rank(spark, tmp_path):
    """Four at a time in order, whatever the numbers; and ranks don't need one task."""
    docs = ([(i * 7,) for i in range(40)], "doc_id long")
    assert same(spark, tmp_path, "r15_block_relevance", {"documents": docs}) == []
    got = {r.doc_id: r.batch for r in catalog.queries()["r15_block_relevance"](spark, str(tmp_path)).collect()}
    assert got == {i * 7: i // 4 for i in range(40)}


def test_running_sums(spark):
    rows = [(g, i, i % 5) for g in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i int, x int").repartition(7)
    got = {(r.g, r.i): r.s for r in relational.running(df, ["g"], ["i"], F.col("x"), "s").collect()}
    assert got == {(g, i): sum(j % 5 for j in range(i)) for g, i, _ in rows}

"""The stored vector index against the exact search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import ann, graph
from siltstone.operators import search as S


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


@pytest.fixture(scope="module")
def index(spark, vectors):
    return ann.VectorIndex.create(vectors, graph.shared_path(spark, "ann"), ann.IndexParams(64, sample=1500))


def top(df):
    return [r.vec_id for r in df.collect()]


def test_recall(index, vectors):
    queries = vectors.filter("vec_id % 20 = 3").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in S.batched_search(queries, vectors, 10).collect()}
    found = index.search_many(queries, 10).collect()
    assert len(found) == len(exact) == 1000
    assert len(exact & {(r.query_id, r.vec_id) for r in found}) >= 0.95 * len(exact)
    scores = {(r.query_id, r.vec_id): r.score for r in S.batched_search(queries, vectors, 10).collect()}
    assert all(abs(scores[r.query_id, r.vec_id] - r.score) < 1e-9 for r in found if (r.query_id, r.vec_id) in scores)
    assert sorted(r["rank"] for r in found if r.query_id == 3) == list(range(1, 11))


def test_few_cells_give_few_rows_and_still_most_neighbours_of_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    rows = spark.createDataFrame([(i, (centres[i % 60] + 0.15 * rng.normal(size=16)).tolist()) for i in range(3000)], "vec_id long, embedding array<double>")
    index = ann.VectorIndex.create(rows, graph.shared_path(spark, "ann"), ann.IndexParams(16, blocks=8))
    assert index.params.nprobe <= 8 and len(index.model.cells) == 54
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in S.batched_search(queries, rows, 10).collect()}
    assert len(exact & {(r.query_id, r.vec_id) for r in index.search_many(queries, 10).collect()}) >= 0.95 * len(exact)


@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_all_cells_and_exact_scores_give_the_exact_answer(spark, vectors, metric):
    few = vectors.filter("vec_id < 700")
    index = ann.VectorIndex.create(few, graph.shared_path(spark, "ann"), ann.IndexParams(64, metric=metric, cells=20, nprobe=3))
    for q in few.filter("vec_id % 200 = 5").collect():
        want = top(S.search(few, q.embedding, 15, metric=metric, where=F.col("label") < 7))
        assert top(index.search(q.embedding, 15, "label < 7", nprobe=20, refine=None)) == want
    if metric == "cosine":
        queries = few.filter("vec_id % 90 = 1").select(F.col("vec_id").alias("query_id"), "embedding")
        want = sorted((r.query_id, r["rank"], r.vec_id) for r in S.batched_search(queries, few, 5).collect())
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in index.search_many(queries, 5, nprobe=20, refine=None).collect()) == want


def test_only_probed_cells_and_codes_are_read(index, vectors):
    plan = index.search([0.1] * 64, 5, nprobe=2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_cell#\d+ IN \(", plan)
    schemas = [x.split("struct<")[1].split(">")[0] for x in plan.split("ReadSchema: ")[1:]]
    assert any("embedding" not in s and "_code" in s for s in schemas)
    cells = index.model.probe(index.model.ready(np.full((1, 64), 0.1)), 2)[0]
    read = index.lists(cells).select("_cell").distinct().collect()
    assert {r._cell for r in read} <= set(cells.tolist())


def test_inserts_deletes_upserts_and_compaction(spark, vectors):
    path = graph.shared_path(spark, "ann")
    first = vectors.filter("vec_id < 300").select("vec_id", "embedding", "label")
    index = ann.VectorIndex.create(first, path, ann.IndexParams(64, cells=8, nprobe=8))
    index.insert(vectors.filter("vec_id BETWEEN 300 AND 399").select("vec_id", "embedding", "label"))
    index.delete(vectors.filter("vec_id % 10 = 0").select("vec_id"))
    q = vectors.filter("vec_id = 7").first().embedding
    alive = vectors.filter("vec_id < 400 AND vec_id % 10 <> 0")
    assert top(index.search(q, 20, refine=None)) == top(S.search(alive, q, 20))
    index.upsert(vectors.filter("vec_id = 8").select("vec_id", "embedding", F.lit(77).alias("label")))
    again = ann.VectorIndex(spark, path)  # opened anew
    assert {r.label for r in again.rows().filter("vec_id = 8").collect()} == {77} and again.rows().count() == 360
    again.insert(vectors.filter("vec_id = 10").select("vec_id", "embedding", "label"))  # a key that was deleted before
    again.compact()
    assert not again._has("deleted") and again.rows().count() == 361
    assert {r.query_id for r in again.search_many(vectors.filter("vec_id IN (1, 2)").select(F.col("vec_id").alias("query_id"), "embedding"), 3).collect()} == {1, 2}


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    index = ann.VectorIndex.create(rows, graph.shared_path(spark, "ann"), ann.IndexParams(2, nprobe=9))
    assert top(index.search([0.0, 1.0], 2)) == [3, 1]
    for bad in ("null", "array(1.0D)"):
        with pytest.raises(ValueError, match="2 values"):
            index.insert(rows.select("vec_id", F.expr(f"cast({bad} as array<double>)").alias("embedding")))
    none = index.search_many(rows.select(F.col("vec_id").alias("query_id"), F.expr("cast(null as array<double>)").alias("embedding")), 2)
    assert none.count() == 0
    empty = ann.VectorIndex.create(rows.filter("false"), graph.shared_path(spark, "ann"), ann.IndexParams(2))
    assert empty.search([1.0, 0.0], 3).count() == 0
    empty.insert(rows)
    assert top(empty.search([1.0, 0.0], 1)) == [1]


def test_a_cell_with_most_rows_has_several_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 50)
    rows = spark.range(400).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 300, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.col("id").cast("double"))).alias("embedding"))
    index = ann.VectorIndex.create(rows, graph.shared_path(spark, "ann"), ann.IndexParams(2, cells=2, nprobe=2))
    assert index.lists().groupBy("_cell").agg(F.max("_part").alias("p")).agg(F.max("p")).first()[0] == 5
    queries = rows.filter("vec_id IN (0, 399)").select(F.col("vec_id").alias("query_id"), "embedding")
    got = index.search_many(queries, 4, refine=None).collect()
    assert sorted(r.vec_id for r in got if r.query_id == 0) == [0, 1, 2, 3] and sorted(r.vec_id for r in got if r.query_id == 399) == [300, 301, 302, 303]

"""Walks with a memory, and the vectors made from them."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import node2vec as N


def frames(spark, pairs, more=()):
    edges = spark.createDataFrame(pairs, "src long, tgt long")
    return edges.select(F.explode(F.array("src", "tgt")).alias("node")).distinct().unionByName(spark.createDataFrame([(x,) for x in more], "node long")), edges


def test_walks_go_along_edges(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (1, 2)]
    nodes, edges = frames(spark, pairs, [9])
    p = N.WalkParams(length=4, per_node=5, back=0.5, away=2.0, tries=2)
    got = [r.walk for r in N.walks(nodes, edges, p).collect()]
    known = {frozenset(x) for x in pairs}
    assert Counter(w[0] for w in got) == dict.fromkeys((1, 2, 3, 4, 9), 5)
    assert all(w == [9] if w[0] == 9 else len(w) == 4 and all(frozenset(x) in known and x[0] != x[1] for x in zip(w, w[1:])) for w in got)
    assert sorted(got) == sorted(r.walk for r in N.walks(nodes.repartition(3), edges.repartition(2), p).collect())


def test_steps_have_the_law_of_both_parameters(spark):
    """From 1 over 2: back to 1 with 1/p, to the common neighbour 3 with 1, on to 4 and 5 with 1/q each."""
    pairs = [(1, 2), (1, 3), (2, 3), (2, 4), (2, 5)]
    nodes, edges = frames(spark, pairs)
    got = [tuple(r.walk) for r in N.walks(nodes.filter("node = 1"), edges, N.WalkParams(length=3, per_node=6000, back=4.0, away=0.5, tries=2)).collect()]
    after = Counter(w[2] for w in got if w[1] == 2)
    n, total = sum(after.values()), 0.25 + 1 + 2 + 2
    assert n == pytest.approx(3000, abs=200)
    for node, weight in ((1, 0.25), (3, 1), (4, 2), (5, 2)):
        assert after[node] / n == pytest.approx(weight / total, abs=0.03)


def test_neighbours_have_like_vectors(spark):
    pairs = [(10 * g + a, 10 * g + b) for g in range(3) for a in range(8) for b in range(a)] + [(0, 10), (10, 20)]
    nodes, edges = frames(spark, pairs)
    p = N.WalkParams(length=8, per_node=8, dims=16, away=2.0, rounds=3)
    one, two = ({r.node: r.vector for r in N.node_vectors(nodes, edges, p).collect()} for _ in range(2))
    assert one == two and len(one) == 24
    x = {k: np.array(v) / np.linalg.norm(v) for k, v in one.items()}
    like = lambda same: np.mean([x[a] @ x[b] for a in x for b in x if a < b and (a // 10 == b // 10) == same])
    assert like(True) > like(False) + 0.2


def test_walks_move_lists_of_bounded_length(spark, monkeypatch):
    """A step joins rows of neighbours, not edges; how many lie in a row, and whether only what is near is joined, changes no walk."""
    pairs = [(0, k) for k in range(1, 40)] + [(k, k % 7) for k in range(8, 40)] + [(0, 1), (1, 0)]
    nodes, edges = frames(spark, pairs, [99])
    p = N.WalkParams(length=4, per_node=3, back=2.0, away=4.0, tries=1)
    got = sorted(r.walk for r in N.walks(nodes, edges, p).collect())
    lists, degree = N._lists(edges)
    assert lists.count() == degree.count() == 40
    monkeypatch.setattr(N, "LIST", 3)
    monkeypatch.setattr(N, "FEW", 5)
    lists = N._lists(edges)[0]
    kept = {(r.src, t) for r in lists.filter("part >= 0").collect() for t in r.tgts}
    assert kept == {x for a, b in pairs for x in ((a, b), (b, a)) if a != b} and lists.filter("part >= 0 AND size(tgts) > 3").isEmpty()
    assert got == sorted(r.walk for r in N.walks(nodes, edges, p).collect())


def test_pairs_are_all_near_places(spark):
    """Every place of every walk meets the next on either side, and none beyond the window."""
    told = spark.createDataFrame([([1, 2, 3, 4, 5, 6],), ([7],), ([8, 9],)], "walk array<long>")
    got = {(r.src, r.tgt) for r in N._pairs(told, N.WalkParams(window=3)).collect()}
    assert got >= {x for a in (1, 2, 3, 4, 5, 8) if a != 6 for x in ((a, a + 1), (a + 1, a))} and all(0 < abs(a - b) <= 3 and 7 not in (a, b) for a, b in got)
    assert {(r.src, r.tgt) for r in N._pairs(told, N.WalkParams(window=1)).collect()} == {x for a in (1, 2, 3, 4, 5, 8) for x in ((a, a + 1), (a + 1, a))}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_vectors_are_learned_in_blocks(spark, monkeypatch, kind):
    """No task holds more than two blocks of vectors, the driver none; like ones are those of neighbours all the same."""
    pairs = [(10 * g + a, 10 * g + b) for g in range(3) for a in range(8) for b in range(a)] + [(0, 10), (10, 20)]
    nodes, edges = frames(spark, pairs, [99])
    p = N.WalkParams(length=6, per_node=8, dims=16, away=2.0, rounds=4)
    monkeypatch.setattr(N, "BLOCK_VALUES", 16 * 9)
    turns, settled = [], N.settled
    monkeypatch.setattr(N, "settled", lambda df, name: turns.append(name) or settled(df, name))
    found = N.node_vectors(nodes.select(F.col("node").cast(kind)), edges.select(F.col("src").cast(kind), F.col("tgt").cast(kind)), p)
    assert dict(found.dtypes) == {"node": {"long": "bigint"}.get(kind, kind), "vector": "array<float>"}
    x = {int(r.node): np.array(r.vector) / np.linalg.norm(r.vector) for r in found.collect()}
    assert len(x) == 25 and turns.count("vectors") == 4 * 3
    like = lambda same: np.mean([x[a] @ x[b] for a in x for b in x if a < b < 99 and (a // 10 == b // 10) == same])
    assert like(True) > like(False) + 0.2


def test_how_rows_come_changes_no_vector():
    rng = np.random.default_rng(1)
    held = [{"task": t, "kind": k, "node": i, "tgt": None, "n": 3, "vector": rng.normal(size=4).astype("f4").tolist()} for t in (0, 2) for k in (0, 1) for i in range(100)]
    pairs = [{"task": t, "kind": 2, "node": int(a), "tgt": int(b), "n": None, "vector": None} for t in (0, 2) for a, b in rng.integers(0, 100, (3000, 2))]
    schema = N.pa.schema([("task", N.pa.int32()), ("kind", N.pa.int32()), ("node", N.pa.int64()), ("tgt", N.pa.int64()), ("n", N.pa.int64()), ("vector", N.pa.list_(N.pa.float32()))])
    table = N.pa.Table.from_pylist(sorted(held + pairs, key=lambda r: (r["task"], r["kind"])), schema)
    one, two = (N.pa.Table.from_batches(N._learned(iter(table.to_batches(max_chunksize=size)), N.WalkParams(dims=4), 0, 1.0)) for size in (10**6, 37))
    assert one.equals(two) and len(one) == 400
    assert not np.allclose([x for r in one["vector"].to_pylist() for x in r], [x for r in table.to_pylist() if r["kind"] < 2 for x in r["vector"]])

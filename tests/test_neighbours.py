"""The neighbour graph, its layout, and mixtures of one component."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from siltstone.operators import cluster, knowledge
from siltstone.operators import neighbours as N


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("vec_id < 1000").select(F.col("vec_id").alias("node"), "embedding")


@pytest.fixture(scope="module")
def exact(vectors):
    rows = sorted((r.node, r.embedding) for r in vectors.collect())
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    return np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1) + 1  # rank of each in each one's order; nodes are 0, 1, ...


@pytest.fixture(scope="module")
def graph(vectors):
    from siltstone.operators.graph import settled

    return settled(N.neighbour_graph(vectors, "embedding", N.LayoutParams(descents=3)), "graph")


def test_most_neighbours_are_found(graph, exact):
    rows = graph.collect()
    assert len(rows) == 15 * len(exact) and len({(r.src, r.tgt) for r in rows}) == len(rows) and all(r.src != r.tgt for r in rows)
    assert np.mean([exact[r.src, r.tgt] <= 15 for r in rows]) >= 0.9


def test_weights_sum_to_the_logarithm(spark):
    pairs = [(0, j, 0.1 * j) for j in range(1, 6)] + [(1, 0, 0.1), (7, 7 + 1, 0.0), (7, 9, 0.0)]
    got = {(r.src, r.tgt): r.weight for r in N.fuzzy_weights(spark.createDataFrame(pairs, "src long, tgt long, d double"), 5).collect()}
    assert got[0, 1] == pytest.approx(1.0) and got[7, 8] == pytest.approx(1.0) == got[7, 9]
    assert sum(got[0, j] for j in range(1, 6)) == pytest.approx(np.log2(5), abs=1e-4)  # the other end adds nothing but to (0, 1), which is 1 anyway
    assert got[0, 2] > got[0, 3] > got[0, 4] > got[0, 5] > 0


def trust(places, exact, k=15):
    x = np.array([places[i] for i in range(len(exact))])
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    over = np.maximum(exact[np.arange(len(exact))[:, None], near] - k, 0).sum()
    n = len(exact)
    return 1 - 2 * over / (n * k * (2 * n - 3 * k - 1)), near


def test_neighbours_stay_neighbours_more_than_on_main_directions(spark, vectors, exact, graph):
    placed = {r.node: r.features for r in N.layout(vectors, "embedding", N.LayoutParams(epochs=15), graph).collect()}
    plain = {r.node: r.f for r in cluster.reduced(vectors, "embedding", 2).select("node", vector_to_array("features").alias("f")).collect()}
    ours, near = trust(placed, exact)
    assert ours > trust(plain, exact)[0] + 0.02
    pairs = spark.createDataFrame([(i, int(j)) for i in range(len(near)) for j in near[i]], "src long, tgt long")
    ranks = spark.createDataFrame([(i, int(j), int(exact[i, j])) for i in range(len(near)) for j in near[i]], "src long, tgt long, rank long")
    assert N.trustworthiness(pairs, ranks, len(exact), 15) == pytest.approx(ours)


def test_groups_come_apart_and_the_same_twice(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(3, 10))
    rows = [(i, (centres[i % 3] + 0.1 * rng.normal(size=10)).tolist()) for i in range(150)] + [(500, centres[0].tolist()), (501, centres[0].tolist()), (502, None)]
    nodes = spark.createDataFrame(rows, "node long, embedding array<double>")
    p = N.LayoutParams(neighbours=8, epochs=5, block=32, descents=1)
    one, two = ({r.node: r.features for r in N.layout(df, "embedding", p).collect()} for df in (nodes, nodes.repartition(3)))
    assert set(one) == set(range(150)) | {500, 501} and all(np.allclose(one[i], two[i], atol=1e-3) for i in one)
    x = np.array([one[i] for i in range(150)])
    middle = np.stack([x[i::3].mean(0) for i in range(3)])
    assert (((x[:, None] - middle) ** 2).sum(2).argmin(1) == np.arange(150) % 3).all()
    found = knowledge.clustered(nodes.filter("node < 150"), "embedding", 2, 6, neighbours=8)
    label = {r.node: r.community for r in found.collect()}
    assert all(label[i] != label[j] for i in range(30) for j in range(30) if i % 3 != j % 3)


def test_few_or_no_nodes(spark):
    nodes = spark.createDataFrame([(1, [1.0, 0.0])], "node long, embedding array<double>")
    assert N.neighbour_graph(nodes, "embedding").count() == 0 == N.neighbour_graph(nodes.filter("false"), "embedding").count()


def gauss(spark, n, centres, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, (np.array(centres[i % len(centres)]) + rng.normal(size=2)).tolist()) for i in range(n)], "node long, f array<double>").select("node", array_to_vector("f").alias("features"))


def test_one_group_is_one_component(spark):
    df = gauss(spark, 300, [(0, 0)], 1)
    model = cluster.mixture(df, "features", 10)
    assert isinstance(model, cluster.One)
    assert {r.community for r in cluster.hard_labels(model, df).collect()} == {0}
    assert {tuple(r.labels) for r in cluster.soft_labels(model, df, 0.5).collect()} == {(0,)}
    x = np.array([r.features.toArray() for r in df.collect()])
    cov = np.cov(x.T, bias=True)
    away = x - x.mean(0)
    like = -0.5 * (np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) + np.log(np.linalg.det(2 * np.pi * cov))).sum()
    assert cluster._bic_of_one(df, "features", 300, 2) == pytest.approx(-2 * like + 5 * np.log(300))


def test_several_groups_and_clusters_of_bounded_size(spark):
    df = gauss(spark, 300, [(0, 0), (12, 0), (0, 12)], 2)
    assert cluster.mixture(df, "features", 10, starts=2).weights.__len__() == 3
    assert len(cluster.mixture(df, "features", 10, size=20).weights) == 15
    assert cluster.mixture(df.filter("false"), "features", 3) is None


def test_a_round_of_descent_moves_vectors_by_node_and_finds_what_all_pairs_would(spark, monkeypatch):
    """One round from the same start, against all pairs of the neighbours that are tried; no join carries two vectors."""
    p, rng = N.LayoutParams(neighbours=4, spare=1, descents=1, directions=1, block=16), np.random.default_rng(8)
    x = {i: rng.normal(size=6).astype(np.float32).tolist() for i in range(60)}
    nodes = spark.createDataFrame(list(x.items()), "node long, vector array<float>")
    plans, settled = [], N.settled
    monkeypatch.setattr(N, "settled", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settled(df, name))
    before = {i: [] for i in x}
    for r in N.neighbour_graph(nodes, "vector", N.LayoutParams(neighbours=4, spare=1, descents=0, directions=1, block=16)).collect():
        before[r.src].append((r.d, r.tgt))
    got = {i: [] for i in x}
    for r in N.neighbour_graph(nodes, "vector", p).collect():
        got[r.src].append((r.d, r.tgt))
    unit = {i: np.float64(v) / np.linalg.norm(np.float64(v)) for i, v in x.items()}
    links = {i: {t for _, t in before[i]} | {s for s in x if i in [t for _, t in before[s]]} for i in x}
    assert max(map(len, links.values())) <= p.tried
    want = {i: {t for _, t in before[i]} | {t for m in x if i in links[m] for t in links[m]} - {i} for i in x}
    for i in x:
        assert sorted(got[i]) == sorted((round(float(1 - unit[i] @ unit[t]), 10), t) for t in want[i])[:4]
    assert not any("va#" in x and "vb#" in x for x in plans)


def test_very_many_components_are_those_of_sparks_estimator(spark):
    """The fit in blocks, narrow components and labels of several included, gives what the dense fit gives."""
    df = gauss(spark, 280, [(5 * i, 3 * j) for i in range(4) for j in range(4)], 3).cache()
    got = cluster.mixture(df, "features", 3, size=4)
    want = cluster.GaussianMixture(k=70, featuresCol="features", seed=7, maxIter=30).fit(df)
    assert isinstance(got, cluster.Many) and got.likely == pytest.approx(want.summary.logLikelihood)
    assert np.allclose(got.weights, want.weights) and np.allclose(got.means, [g.mean for g in want.gaussians])
    told = {r.node: (r.community, r.labels) for r in cluster.hard_labels(got, cluster.soft_labels(got, df, 0.2).drop("prediction")).collect()}
    assert told == {r.node: (r.community, r.labels) for r in cluster.hard_labels(want, cluster.soft_labels(want, df, 0.2).drop("prediction", "probability")).collect()}

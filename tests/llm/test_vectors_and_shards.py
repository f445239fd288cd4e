"""Hard negatives, centroid clustering and sharding against plain versions, on odd rows, ties and heavy groups."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import balltree, centroids, negatives, queries, sharding

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, id string, cell int, anchor boolean"


def table(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, True) for r in rows], SCHEMA)


def clumps(n, dims, seed, groups=6, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    which = rng.integers(0, groups, n)
    return which, centres[which] + spread * rng.normal(size=(n, dims))


def odd_vectors(n=900, dims=8):
    which, x = clumps(n, dims, 5)
    rows = [(i, v.tolist(), int(c) % 4) for i, (c, v) in enumerate(zip(which, x))]
    same = x[0].tolist()
    rows += [(1000 + i, same, i % 2) for i in range(400)]  # one vector has many copies
    rows += rows[:50] + [(300, rows[7][1], 3), (300, rows[8][1], 3)]  # repeated rows, and others of one id
    rows += [(2000, None, 1), (2100, [0.5] * (dims - 1) + [None], 1), (2200, [0.5] * (dims - 1) + [NAN], 1), (2300, [INF] * dims, 1), (None, same, 1), (2400, same, None), (2500, [], 1), (2600, [0.5, 0.25], 2), (2700, [0.0] * dims, 3)]
    return rows


# ---- hard negatives


def plain_negatives(rows, p, anchor):
    seen = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen.add((i, label, tuple(math.floor(p.scale * x) for x in v)))
    width = max(len(v) for _, _, v in seen)
    seen = {(i, label, v + (0,) * (width - len(v))) for i, label, v in seen}
    out = []
    for a in seen:
        if not anchor(a[0]):
            continue
        score = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in seen if b != a))
        for s, i, _ in [x for x in score if x[2] == a[1]][: p.positives]:
            fit = [x for x in score if x[2] != a[1] and p.percent * -s <= 100 * -x[0] <= 100 * -s][: p.negatives]
            out += [(a[0], i, r, j, -s, -t) for r, (t, j, _) in enumerate(fit, 1)]
    return Counter(out)


@pytest.mark.parametrize("sizes", [{}, {"block": 64, "anchor_block": 4, "load": 2, "leaf": 4, "group": 200}])
def test_hard_negatives_equal_plain_ones(spark, sizes):
    rows, p = odd_vectors(), negatives.NegativeParams(**sizes)
    found = negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0, p)
    got = Counter(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == plain_negatives(rows, p, lambda i: i % 50 == 0)
    assert len(got) > 50


def test_no_anchors_no_rows(spark):
    docs = table(spark, odd_vectors()[:30])
    for df, anchor in ((docs, F.lit(False)), (docs.filter("false"), F.lit(True)), (docs.withColumn("embedding", F.lit(None).cast("array<double>")), F.lit(True)), (docs, F.lit(None).cast("boolean"))):
        found = negatives.hard_negatives(df, anchor)
        assert found.columns == negatives.RESULT.replace(",", "").split()[::2] and found.count() == 0


def test_intervals_hold_and_prune():
    _, x = clumps(2000, 16, 1)
    x = np.floor(256 * x).astype(np.int32)
    a, b = (balltree.Tree(x[i][balltree.order(x[i], 32)], 32) for i in (slice(0, 400), slice(400, 2000)))
    for la in a.levels:
        for lb in b.levels[:4]:
            lo, hi = negatives.interval(la.centre, la.radius, lb.centre, lb.radius)
            s = balltree.product(a.x, b.x)
            least = np.minimum.reduceat(np.minimum.reduceat(s, la.bounds[:-1], 0), lb.bounds[:-1], 1)
            most = np.maximum.reduceat(np.maximum.reduceat(s, la.bounds[:-1], 0), lb.bounds[:-1], 1)
            assert (lo <= least).all() and (hi >= most).all()

    def block(rows, label):
        o = balltree.order(x[rows], 32)
        y = balltree.narrow(x[rows][o])
        return negatives.Block({"ids": np.arange(len(y))[o].astype("<i8").tobytes(), "labels": np.full(len(y), label).astype("<i8").tobytes(), "x": y.tobytes(), "w": y.itemsize, "n": len(y), "d": 16}, 32)

    search, others = negatives.Search(block(slice(0, 400), 1), True, 5), block(slice(400, 2000), 1)
    search.show(others)
    before = search.scored
    search.show(others)  # with the bounds known, most pairs of nodes go
    assert search.scored - before < 0.5 * 400 * 1600


def test_scores_that_fit_no_long_are_refused(spark):
    with pytest.raises(Exception, match="fit a long"):
        negatives.hard_negatives(table(spark, [(0, [1e30], 1), (1, [1.0], 1)]), F.lit(True)).collect()


# ---- centroids


def plain_clusters(rows, p):
    kept = [(i, [math.floor(p.scale * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == p.dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{p.seed}{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    centre = [v for _, v in sorted(kept, key=key)[: p.k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centre))
    for _ in range(p.rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centre = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(centre)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    total = Counter()
    for _, c, d in placed:
        total[c] += d
    return Counter((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, centre[c])).encode()).hexdigest()) for i, c, d in placed)


@pytest.mark.parametrize("sizes", [{}, {"block": 50, "leaf": 4}, {"k": 1}, {"k": 3, "rounds": 0}, {"k": 5000}])
def test_clusters_equal_plain_ones(spark, sizes):
    rows, p = odd_vectors(300 if sizes.get("k") == 5000 else 900), centroids.CentroidParams(**{"dims": 8} | sizes)
    rows = rows[:200] + rows[-60:] if sizes.get("k") == 5000 else rows
    found = centroids.clusters(table(spark, rows), p)
    assert Counter(tuple(r) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == plain_clusters(rows, p)


def test_no_vectors_no_clusters(spark):
    docs = table(spark, odd_vectors()[:30])
    for df in (docs.filter("false"), docs):  # 8 components, not 64
        found = centroids.clusters(df)
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and found.count() == 0


def test_whole_balls_go_without_a_look_at_their_vectors():
    _, x = clumps(5000, 8, 3, groups=4, spread=0.01)
    x = np.floor(64 * x).astype(np.int32)
    x = x[balltree.order(x, 32)]
    tree, centre = balltree.Tree(x, 32), np.floor(64 * clumps(4, 8, 3, groups=4, spread=0)[1]).astype(np.int64)
    centre = np.unique(centre, axis=0)
    label, count, sums, looked = centroids.assign(tree, centre)
    exact = ((x[:, None].astype(np.int64) - centre) ** 2).sum(2).argmin(1)
    assert (label == exact).all() and count.sum() == 5000 and looked < 1000
    assert all((sums[j] == x[exact == j].sum(0)).all() for j in range(len(centre)))


# ---- sharding


def check_shards(docs, found, shards):
    sizes = Counter(r.shard for r in found)
    n = len(docs)
    assert [sizes.get(s, 0) for s in range(shards)] == [n // shards + (s < n % shards) for s in range(shards)]
    for s in range(shards):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sizes.get(s, 0)))
    plain = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == plain
    assert {(r.law, r.grown_shard) for r in found} <= {("rows", None)}


def test_shards_of_documents(spark, sf_dir, docs):
    found = queries.op13_sharding(spark, sf_dir)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = found.collect()
    check_shards([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], rows, 16)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, queries.op13_sharding(spark, sf_dir).collect()), key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_odd_rows_in_shards(odd, parts):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = sharding.shard(odd.repartition(parts), sharding.ShardParams(shards=4, bucket_rows=2, group=2)).collect()
    check_shards(rows, found, 4)
    assert Counter((r.doc_id, r._row.text, r._row.n_words) for r in found) == Counter((i, t, 7) for i, t in rows)
    few = sharding.shard(odd.limit(3), sharding.ShardParams(shards=8), carry=[]).collect()
    assert sorted(r.shard for r in few) == [0, 1, 2]


def test_no_rows_no_shards(none):
    assert sharding.shard(none).count() == 0


def test_written_shards(odd, tmp_path):
    found = sharding.shard(odd, sharding.ShardParams(shards=3))
    sharding.write_shards(found, f"file://{tmp_path}/out")
    back = odd.sparkSession.read.parquet(f"file://{tmp_path}/out")
    assert Counter((r.shard, r.slot, r._row.doc_id) for r in back.collect()) == Counter((r.shard, r.slot, r.doc_id) for r in found.collect())


def test_matrix_has_its_sums_and_its_law():
    rows, sizes, rng = [5, 0, 9, 4], [6, 6, 6], np.random.default_rng(1)
    drawn = np.array([sharding.matrix(rng, rows, sizes) for _ in range(20_000)])
    assert (drawn.sum(1) == sizes).all() and (drawn.sum(2) == rows).all()
    # One cell is hypergeometric: 9 draws of 18, 6 of them good.
    exact = np.array([math.comb(6, k) * math.comb(12, 9 - k) / math.comb(18, 9) for k in range(7)])
    seen = np.bincount(drawn[:, 2, 1], minlength=7) / len(drawn)
    assert np.abs(seen - exact).max() < 0.015


def test_large_populations_have_the_same_law(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(sharding, "NUMPY_BOUND", 0)
    own = np.bincount([sharding.hypergeometric(rng, 6, 12, 9) for _ in range(20_000)], minlength=7) / 20_000
    exact = np.array([math.comb(6, k) * math.comb(12, 9 - k) / math.comb(18, 9) for k in range(7)])
    assert np.abs(own - exact).max() < 0.015
    monkeypatch.undo()
    good, bad, draws = 3 * 10**9, 45 * 10**9, 10**8
    large = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(300)])
    mean, var = draws * good / (good + bad), draws * (good / (good + bad)) * (bad / (good + bad))
    assert abs(large.mean() - mean) < 5 * math.sqrt(var / 300) and 0.7 < large.var() / var < 1.35


def test_places_are_uniform(spark):
    docs = spark.range(400, numPartitions=3).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    seen = Counter()
    for seed in range(6):
        seen += Counter((r.doc_id < 200, r.shard) for r in sharding.shard(docs, sharding.ShardParams(shards=2, seed=seed * 100), carry=[]).collect())
    assert abs(seen[True, 0] - 600) < 5 * math.sqrt(6 * 200 * 200 / 400 / 4)

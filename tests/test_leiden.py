"""Communities: modularity, connected parts, bounded sizes."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import leiden as L


def frames(spark, pairs):
    edges = spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "src long, tgt long, weight double")
    return edges.select(F.explode(F.array("src", "tgt")).alias("node")).distinct(), edges


def planted(groups=8, size=20, inside=0.4, between=0.01, seed=3):
    rng, n = np.random.default_rng(seed), groups * size
    return [(a, b, 1.0) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else between)]


def plain_modularity(pairs, label):
    m, degree, within = sum(w for *_, w in pairs), Counter(), 0.0
    for a, b, w in pairs:
        degree[label[a]] += w
        degree[label[b]] += w
        within += w if label[a] == label[b] else 0
    return within / m - sum(k * k for k in degree.values()) / (2 * m) ** 2


def is_connected(members, pairs):
    near = defaultdict(set)
    for a, b, _ in pairs:
        if a in members and b in members:
            near[a].add(b), near[b].add(a)
    seen, todo = set(), [min(members)]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += near[x]
    return seen == members


def groups_of(label):
    out = defaultdict(set)
    for node, c in label.items():
        out[c].add(node)
    return out


@pytest.mark.parametrize("local", [50_000, 0])
def test_planted_groups_are_found(spark, monkeypatch, local):
    monkeypatch.setattr(L, "LOCAL_EDGES", local)
    pairs = planted()
    nodes, edges = frames(spark, pairs)
    found = L.leiden(nodes, edges)
    label = {r.node: r.community for r in found.collect()}
    assert set(label) == {x for a, b, _ in pairs for x in (a, b)}
    q = plain_modularity(pairs, label)
    assert q >= plain_modularity(pairs, {n: n // 20 for n in label}) - (0.001 if local else 0.02)
    assert abs(L.modularity(found, edges) - q) < 1e-9
    assert all(is_connected(m, pairs) for m in groups_of(label).values())
    if local:
        assert {r.node: r.community for r in L.leiden(nodes, edges).collect()} == label


def test_what_rounds_leave_is_clustered_in_tasks(spark, monkeypatch):
    """A graph over the local bound is made smaller by one level of rounds, and finished in tasks."""
    pairs, calls = planted(), []
    monkeypatch.setattr(L, "LOCAL_EDGES", len(pairs) - 1)
    tasks, moved = L._in_tasks, L._moved
    monkeypatch.setattr(L, "_in_tasks", lambda *x: calls.append("tasks") or tasks(*x))
    monkeypatch.setattr(L, "_moved", lambda *x: calls.append("moved") or moved(*x))
    nodes, edges = frames(spark, pairs)
    label = {r.node: r.community for r in L.leiden(nodes, edges).collect()}
    assert calls == ["tasks", "moved", "tasks"]  # the first call has no scope that is small enough
    assert set(label) == {x for a, b, _ in pairs for x in (a, b)} and all(c in m for c, m in groups_of(label).items())
    assert plain_modularity(pairs, label) >= plain_modularity(pairs, {n: n // 20 for n in label}) - 0.02
    assert all(is_connected(m, pairs) for m in groups_of(label).values())


def test_weights_loops_strings_and_lone_nodes(spark):
    pairs = [("a", "b", 5.0), ("b", "c", 5.0), ("a", "c", 5.0), ("c", "d", 0.1), ("d", "e", 5.0), ("e", "f", 5.0), ("d", "f", 5.0), ("f", "f", 1.0)]
    edges = spark.createDataFrame(pairs, "src string, tgt string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcdefz"], "node string")
    got = groups_of({r.node: r.community for r in L.leiden(nodes, edges).collect()})
    assert sorted(map(sorted, got.values())) == [["a", "b", "c"], ["d", "e", "f"], ["z"]]
    assert L.leiden(nodes.filter("false"), edges.filter("false")).count() == 0
    assert {r.community for r in L.leiden(nodes, edges.filter("false")).collect()} == set("abcdefz")


@pytest.mark.parametrize("most", [8])
def test_levels_have_bounded_connected_communities(spark, most):
    clique = [(1000 + a, 1000 + b, 1.0) for a in range(24) for b in range(a)]
    star = [(2000, 2000 + i, 1.0) for i in range(1, 40)]
    pairs = planted(4, 15, 0.5, 0.02) + clique + star + [(0, 1000, 1.0)]
    nodes, edges = frames(spark, pairs)
    rows = L.community_levels(nodes, edges, most).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r.level][r.node] = r.community
    assert set(by[0]) == {r.node for r in nodes.collect()}
    last = {n: c for level in sorted(by) for n, c in by[level].items()}
    assert max(map(len, groups_of(last).values())) <= most
    for level, label in by.items():
        assert all(is_connected(m, pairs) for m in groups_of(label).values())
        if level:  # each lies in one community of the level before, by its name too
            assert all(c.startswith(by[level - 1][n] + "/") for n, c in label.items())
    assert len({last[1000 + i] for i in range(24)}) <= 24 // (most // 2)  # the clique isn't cut to pieces


def test_blocks_choose_by_the_rule_of_all_nodes(spark, monkeypatch):
    """A round's moves, made in blocks that know only their nodes and neighbours, are those of the rule over the whole graph."""
    pairs = [(a, b, w * (1 + (a + 3 * b) % 4)) for a, b, w in planted(6, 12)]
    edges = frames(spark, pairs)[1]
    label = {x: x % 24 for a, b, _ in pairs for x in (a, b)}
    k, near = Counter(), defaultdict(Counter)
    for a, b, w in pairs:
        for x, y in ((a, b), (b, a)):
            k[x] += w
            near[x][label[y]] += w
    total, m2 = Counter(), sum(k.values())
    for x, c in label.items():
        total[c] += k[x]
    takes = {c: c % 2 == 1 for c in total}
    gain = lambda x, c: round(near[x][c] - k[x] * (total[c] - (k[x] if c == label[x] else 0)) / m2, L.DECIMALS)
    want = {}
    for x, c in label.items():
        best = min(((-gain(x, d), d) for d in near[x] if takes[d]), default=(0, None))
        want[x] = best[1] if not takes[c] and -best[0] > gain(x, c) else None
    monkeypatch.setattr(L, "BLOCK_EDGES", 100)
    labels = spark.createDataFrame([(x, 0, float(k[x]), float(m2), c) for x, c in label.items()], "node long, scope int, k double, m2 double, community long")
    lists, blocks = L._near(labels, L.both_ways(edges))
    known = spark.createDataFrame([(x, c, float(total[c]), takes[c]) for x, c in label.items()], "node long, community long, total double, takes boolean").join(blocks, "node")
    got = {}
    for (b,) in lists.select("block").distinct().collect():
        found = L._choices(known.filter(F.array_contains("blocks", b)).toArrow(), lists.filter(F.col("block") == b).toArrow(), 1.0)
        got |= dict(zip(found["node"].to_pylist(), found["new"].to_pylist()))
    assert lists.select("block").distinct().count() > 3 and got == want and any(x is not None for x in want.values())


def test_blocks_change_no_answer(spark, monkeypatch):
    monkeypatch.setattr(L, "LOCAL_EDGES", 0)
    monkeypatch.setattr(L, "FLAT", 0.02)
    edges = frames(spark, planted(5, 12))[1].select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "tgt").alias("tgt"), "weight")
    nodes = edges.select(F.explode(F.array("src", "tgt")).alias("node")).distinct()
    found = []
    for size in (10**6, 60):
        monkeypatch.setattr(L, "BLOCK_EDGES", size)
        found.append({r.node: r.community for r in L.leiden(nodes, edges, rounds=5, levels=2).collect()})
    assert found[0] == found[1] and len(set(found[0].values())) < 30


def test_small_scopes_are_cut_without_rounds(spark):
    """Cutting many small scopes takes a fixed number of jobs."""
    pairs = [(100 * g + a, 100 * g + b, 1.0) for g in range(30) for a in range(12 + g % 3) for b in range(a)]
    nodes, edges = frames(spark, pairs)
    members = nodes.withColumn("scope", F.floor(F.col("node") / 100))
    spark.sparkContext.setJobGroup("cuts", "cuts")
    label = {r.node: r.community for r in L.bounded_parts(members, edges, 5).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("cuts"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    sizes = Counter(label.values())
    assert set(sizes) <= set(label) and all(c // 100 == n // 100 for n, c in label.items())
    assert max(sizes.values()) <= 5 and len(sizes) == 90 and all(is_connected(m, pairs) for m in groups_of(label).values())
    assert jobs < 40

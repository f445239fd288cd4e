"""Communities by modularity: moves, a refinement that keeps communities connected, and aggregation.

A scope with few edges is clustered in one task; all others are clustered together in rounds, in blocks of nodes.

Nodes may be of any type that orders and hashes; a community is named by one of them. Edges (src, tgt, weight) are undirected,
each once; a loop's weight counts twice in its node's degree. A scope splits the graph into parts that are clustered on their
own: the column is carried by nodes, and edges must lie inside one.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import importable

from .graph import both_ways, settled

#: Edges up to which a scope, or what the rounds leave of larger ones, is clustered in one task; a fixed size, a few 100 MB of Python.
LOCAL_EDGES = 1_000_000
#: About so many edges' ends a block of nodes that choose in one task, and edges of small scopes a task.
BLOCK_EDGES = 2_000_000
BUCKET_EDGES = 50_000
#: Rounds of moves end when three in a row raise the modularity of a scope by less, on average; what they leave, later levels move.
FLAT = 0.001

#: Gains are compared at so many decimals, so that the order of a sum can't decide.
DECIMALS = 9


def modularity(labels: DataFrame, edges: DataFrame, resolution: float = 1.0) -> float:
    """Of labels (node, community) over edges (src, tgt, weight)."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("community").alias(f"_{c}"))
    full = edges.join(at("src"), "src").join(at("tgt"), "tgt")
    ends = full.select(F.explode(F.array("_src", "_tgt")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("k"))
    inside = full.agg(F.sum(F.when(F.col("_src") == F.col("_tgt"), F.col("weight"))).alias("w"), F.sum("weight").alias("m")).first()
    squares = ends.agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return (inside.w or 0.0) / inside.m - resolution * squares / (2.0 * inside.m) ** 2 if inside.m else 0.0


def _degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with k, the sum of a node's weights, and m2, that of its scope."""
    k = edges.select(F.explode(F.array("src", "tgt")).alias("node"), F.col("weight").cast("double").alias("w")).groupBy("node").agg(F.sum("w").alias("k"))
    full = settled(nodes.join(k, "node", "left").withColumn("k", F.coalesce("k", F.lit(0.0))), "degrees")
    return full.join(full.groupBy("scope").agg(F.sum("k").alias("m2")), "scope")


def _near(labels: DataFrame, step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """block, src, k, m2, near (tgt, weight): each node's neighbours, about BLOCK_EDGES of them a block. And node, blocks: where a node is or has neighbours.

    Nodes close in order share a block, so that few blocks have to know of a node where edges are local. Blocks don't change what is found.
    """
    n = max(1, math.ceil(step.count() / BLOCK_EDGES))
    rows = step.repartitionByRange(n, "src").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("tgt", "weight"))).alias("near")).withColumn("block", F.spark_partition_id())
    lists = settled(rows.join(labels.select(F.col("node").alias("src"), "k", "m2"), "src").select("block", "src", "k", "m2", "near"), "lists")
    ends = lists.select("block", F.explode(F.concat(F.array("src"), F.col("near.tgt"))).alias("node")).distinct()
    return lists, settled(ends.groupBy("node").agg(F.collect_list("block").alias("blocks")), "blocks")


def _choices(known: pa.Table, lists: pa.Table, gamma: float) -> pa.Table:
    """node, new, part of a block's nodes. known: node, community, total and takes, of the community, of these and their neighbours."""
    names = pc.unique(known["community"])
    rank = np.empty(len(names), np.int64)
    rank[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
    code = rank[pc.index_in(known["community"], value_set=names).to_numpy()]
    total, takes = np.zeros(len(names)), np.zeros(len(names), bool)
    total[code], takes[code] = known["total"].to_numpy(), known["takes"].to_numpy()
    near = lists["near"].combine_chunks()
    near = near.combine_chunks() if isinstance(near, pa.ChunkedArray) else near
    k, m2, n = lists["k"].to_numpy(), lists["m2"].to_numpy(), len(lists)
    place = lambda x: code[pc.index_in(x, value_set=known["node"]).to_numpy(zero_copy_only=False)]
    own, far = place(lists["src"]), place(near.flatten().field("tgt"))
    key = np.repeat(np.arange(n), pc.list_value_length(near).to_numpy()) * len(names) + far
    order = np.argsort(key, kind="stable")
    key, w = key[order], near.flatten().field("weight").to_numpy()[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    w, row, c = np.add.reduceat(w, first), key[first] // len(names), key[first] % len(names)
    inside, stays = np.zeros(n), c == own[row]
    inside[row[stays]] = w[stays]
    with np.errstate(divide="ignore", invalid="ignore"):
        stay = np.round(inside - gamma * k * (total[own] - k) / m2, DECIMALS)
        part = (inside - gamma * k * total[own] / m2) / m2
        gain = np.round(w - gamma * k[row] * total[c] / m2[row], DECIMALS)
    open_ = takes[c] & ~takes[own[row]] & (gain > stay[row])
    row, c, gain = row[open_], c[open_], gain[open_]
    order = np.lexsort((c, -gain, row))
    row, c = row[order], c[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
    new = np.full(n, -1)
    new[row[first]] = c[first]
    by_rank = names.take(pa.array(np.argsort(rank)))
    return pa.table({"node": lists["src"], "new": by_rank.take(pa.array(new, mask=new < 0)), "part": pa.array(part, from_pandas=True)})


def _moved(labels: DataFrame, step: DataFrame, gamma: float, rounds: int) -> DataFrame:
    """labels after rounds of moves to the neighbouring community of largest gain; the best round counts.

    In a round a hash makes each community a giver or a taker; only nodes of givers move, to takers, which lose none meanwhile.
    Nodes choose in blocks, each a task, which are told the communities of their nodes and neighbours.
    """
    best, quality, idle, calm, flat = labels, None, 0, 0, 0
    kind = dict(labels.dtypes)["node"]
    lists, blocks = _near(labels, step)
    least = FLAT * labels.select("scope").distinct().count()
    for turn in range(rounds):
        size = labels.groupBy("community").agg(F.sum("k").alias("total"), (F.pmod(F.xxhash64("community", F.lit(turn)), F.lit(2)) == 1).alias("takes"))
        told = labels.select("node", "community").join(size, "community").join(blocks, "node").select(F.explode("blocks").alias("block"), "node", "community", "total", "takes")
        chosen = told.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(lambda x, y: _choices(x, y, gamma), f"node {kind}, new {kind}, part double")
        now = labels.join(chosen, "node", "left").select("node", "scope", "k", "m2", F.coalesce("new", "community").alias("community"), F.col("new").isNotNull().alias("went"), "part")
        now = settled(now, "moves")
        went, found = now.agg(F.count_if("went"), F.sum("part")).first()  # how many go now, and how good the labels before were
        flat = flat + 1 if quality is not None and (found or 0.0) < quality + least else 0
        if quality is None or (found or 0.0) > quality + 1e-12:
            best, quality, idle = labels, found or 0.0, 0
        else:
            idle += 1
        labels, calm = now.drop("went", "part"), 0 if went else calm + 1
        if idle == 5 or calm == 3 or flat == 3:
            break
    return best


def _refined(labels: DataFrame, edges: DataFrame, gamma: float, rounds: int) -> DataFrame:
    """labels with part: communities cut into connected parts, in tasks, and those with many edges in rounds.

    All nodes start alone. A part of one node joins the part of its community that it has an edge to and gains most from. Only
    well-connected nodes and parts take part, as seen from their community.
    """
    total = labels.groupBy("community").agg(F.sum("k").alias("kc"))
    at = lambda c: labels.select(F.col("node").alias(c), F.col("community").alias(f"_{c}"), F.col("k").alias(f"k_{c}"), "m2")
    inside = edges.join(at("src"), "src").join(at("tgt").drop("m2"), "tgt").filter("_src = _tgt").withColumnRenamed("_src", "community")
    inside = settled(inside.select("community", "src", "tgt", "weight", "k_src", "k_tgt", "m2"), "inside")
    sizes = settled(inside.groupBy("community").agg(F.count("*").alias("n")), "sizes")
    large, n = sizes.filter(F.col("n") > LOCAL_EDGES).select("community"), sizes.agg(F.sum("n")).first()[0] or 0
    kind = dict(labels.dtypes)["node"]
    small = inside.join(large, "community", "left_anti").join(total, "community").withColumn("bucket", _bucket("community", n))
    parts = small.groupBy("bucket").applyInPandas(lambda x: _parts(x, gamma), f"node {kind}, part {kind}")
    if not large.isEmpty():
        some = settled(labels.join(large, "community", "left_semi"), "some")
        parts = parts.unionByName(_refined_in_rounds(some, settled(both_ways(inside.join(large, "community", "left_semi").select("src", "tgt", "weight")), "inside"), gamma, rounds))
    return labels.join(parts, "node", "left").select("node", "scope", "community", F.coalesce("part", "node").alias("part"))


def _bucket(c: str, edges: int) -> Column:
    """Tasks have several groups each, about BUCKET_EDGES in all."""
    return F.pmod(F.xxhash64(c), F.lit(max(1, math.ceil(edges / BUCKET_EDGES))))


def _parts(inside: pd.DataFrame, gamma: float) -> pd.DataFrame:
    """node, part of the ends of edges inside communities, of which none has others elsewhere."""
    names = sorted({*inside.src, *inside.tgt})
    at = {x: i for i, x in enumerate(names)}
    near: list[dict[int, float]] = [defaultdict(float) for _ in names]
    k, community, total, m2 = [0.0] * len(names), [None] * len(names), {}, [0.0] * len(names)
    rows = inside.sort_values(["src", "tgt"])
    for c, a, b, w, ka, kb, m, kc in zip(*(rows[x] for x in ("community", "src", "tgt", "weight", "k_src", "k_tgt", "m2", "kc"))):
        a, b = at[a], at[b]
        near[a][b] += w
        near[b][a] += w
        k[a], k[b], total[c] = ka, kb, kc
        community[a] = community[b] = c
        m2[a] = m2[b] = m
    part = _joined(near, k, community, total, gamma, m2)
    return pd.DataFrame({"node": names, "part": [names[p] for p in part]})


def _joined(near: list[dict[int, float]], k: list[float], community: list, total: dict, gamma: float, m2: list[float]) -> list[int]:
    """The part of each node, named by a node of it: nodes that are alone join the part of their community that gains most, one at a time."""
    nodes = range(len(near))
    part, kp, single = list(nodes), k[:], [True] * len(near)
    cut = [sum(w for j, w in near[i].items() if community[j] == community[i]) for i in nodes]
    firm = lambda p: round(cut[p] - gamma * kp[p] * (total[community[p]] - kp[p]) / m2[p], DECIMALS) >= 0
    for i in nodes:
        if not single[i] or not firm(i):
            continue
        votes = defaultdict(float)
        for j, w in near[i].items():
            if community[j] == community[i]:
                votes[part[j]] += w
        gains = [(round(w - gamma * k[i] * kp[p] / m2[i], DECIMALS), -p) for p, w in votes.items() if p != i and firm(p)]
        if gains and max(gains)[0] > 0:
            to = -max(gains)[1]
            cut[to] += cut[i] - 2 * votes[to]
            kp[to] += k[i]
            part[i], single[to] = to, False
    return part


def _refined_in_rounds(labels: DataFrame, inside: DataFrame, gamma: float, rounds: int) -> DataFrame:
    """node, part of nodes of communities with many edges (inside, both ways).

    In a round a hash makes each part a mover or a target, and parts of one node that move join targets. Targets stay as they
    are, so parts are connected.
    """
    total = labels.groupBy("community").agg(F.sum("k").alias("kc"))
    now = settled(labels.join(total, "community").withColumn("part", F.col("node")), "parts")
    idle = 0
    for turn in range(rounds):
        parts = now.groupBy("part").agg(F.count("*").alias("n"), F.sum("k").alias("kp"), F.first("kc").alias("kc"), F.first("m2").alias("m2"))
        near = lambda c: now.select(F.col("node").alias(c), F.col("part").alias(f"p_{c}"))  # noqa: B023, E731
        links = inside.join(near("src"), "src").join(near("tgt"), "tgt").filter("p_src <> p_tgt").groupBy("p_src", "p_tgt").agg(F.sum("weight").alias("w"))
        cut = links.groupBy(F.col("p_src").alias("part")).agg(F.sum("w").alias("cut"))
        about = parts.join(cut, "part").filter(F.round(F.col("cut") - gamma * F.col("kp") * (F.col("kc") - F.col("kp")) / F.col("m2"), DECIMALS) >= 0)
        mover = F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(2)) == 0
        from_ = about.filter(mover & (F.col("n") == 1)).select(F.col("part").alias("p_src"), F.col("kp").alias("k"), "m2")
        to = about.filter(~mover).select(F.col("part").alias("p_tgt"), "kp")
        gain = F.round(F.col("w") - gamma * F.col("k") * F.col("kp") / F.col("m2"), DECIMALS)
        best = links.join(from_, "p_src").join(to, "p_tgt").withColumn("gain", gain).filter("gain > 0")
        best = best.groupBy(F.col("p_src").alias("part")).agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("p_tgt").alias("c")))["c"].alias("new"))
        after = settled(now.join(best, "part", "left").select("node", "scope", "k", "m2", "community", "kc", F.coalesce("new", "part").alias("part"), F.col("new").isNotNull().alias("went")), "parts")
        idle = idle + 1 if after.filter("went").isEmpty() else 0
        now = after.drop("went")
        if idle == 2:
            break
    return now.select("node", "part")


def local_leiden(edges: list[tuple[int, int, float]], n: int, gamma: float) -> list[int]:
    """The community, named by one of its nodes, of nodes 0 to n - 1: the same steps as in the rounds, one node at a time."""
    near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
    loops = [0.0] * n
    for a, b, w in edges:
        if a == b:
            loops[a] += w
        else:
            near[a][b] += w
            near[b][a] += w
    members, community = [[i] for i in range(n)], list(range(n))
    m2 = sum(sum(x.values()) for x in near) + 2 * sum(loops)
    while m2:
        k = [sum(x.values()) + 2 * o for x, o in zip(near, loops)]
        nodes = range(len(near))
        total = Counter()
        for i in nodes:
            total[community[i]] += k[i]
        todo, queued = deque(nodes), set(nodes)
        while todo:
            i = todo.popleft()
            queued.discard(i)
            votes, own = defaultdict(float), community[i]
            for j, w in near[i].items():
                votes[community[j]] += w
            total[own] -= k[i]
            best = max({own, *votes}, key=lambda c: (round(votes.get(c, 0.0) - gamma * k[i] * total[c] / m2, DECIMALS), c == own, -c))  # noqa: B023
            total[best] += k[i]
            if best != own:
                community[i] = best
                more = [j for j in near[i] if community[j] != best and j not in queued]
                todo.extend(more)
                queued.update(more)
        part = _joined(near, k, community, total, gamma, [m2] * len(near))
        names = sorted(set(part))
        joined: dict[int, list[int]] = {p: [] for p in names}
        for i in nodes:
            joined[part[i]] += members[i]
        done = len(names) == len(near) or len(names) == len({community[i] for i in nodes})
        members = [joined[p] for p in names]
        if done:
            break
        at = {p: x for x, p in enumerate(names)}
        more, rest = [defaultdict(float) for _ in names], [0.0] * len(names)
        for i in nodes:
            a = at[part[i]]
            rest[a] += loops[i]
            for j, w in near[i].items():
                b = at[part[j]]
                if a == b:
                    rest[a] += w / 2  # each edge is seen from both ends
                else:
                    more[a][b] += w
        first: dict[int, int] = {}
        community = [first.setdefault(community[p], x) for x, p in enumerate(names)]
        near, loops = more, rest
    out = [0] * n
    for group in members:
        for i in group:
            out[i] = min(group)
    return out


def _in_tasks(edges: DataFrame, gamma: float, kinds: tuple[str, str], n: int) -> DataFrame:
    """node, scope, community of all ends of the n edges (scope, src, tgt, weight), a scope in one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        for scope, src, tgt, weight in _by_scope(part):
            names = sorted({*src, *tgt})
            at = {x: i for i, x in enumerate(names)}
            rows = sorted((at[a], at[b], float(w)) for a, b, w in zip(src, tgt, weight))
            found = local_leiden(rows, len(names), gamma)
            for col, values in zip(out, (names, [scope] * len(names), [names[c] for c in found])):
                col += values
        return pd.DataFrame(dict(zip(("node", "scope", "community"), out)))

    return edges.groupBy(_bucket("scope", n)).applyInPandas(run, f"node {kinds[0]}, scope {kinds[1]}, community {kinds[0]}")


def _by_scope(part: pd.DataFrame) -> Iterator[tuple]:
    """scope, src, tgt, weight (lists) of each scope."""
    rows = part.sort_values("scope", kind="stable")
    scope, *rest = (rows[c].tolist() for c in ("scope", "src", "tgt", "weight"))
    start = 0
    for i in range(1, len(scope) + 1):
        if i == len(scope) or scope[i] != scope[start]:
            yield scope[start], *(x[start:i] for x in rest)
            start = i


def leiden(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, rounds: int = 16, levels: int = 10) -> DataFrame:
    """node, scope, community: connected communities of large modularity in each scope (nodes: node, and scope where there are several).

    A node without edges is a community of its own. Weights must not be negative. The answer is the same in every run.
    """
    importable(nodes.sparkSession)
    nodes = settled(nodes if "scope" in nodes.columns else nodes.withColumn("scope", F.lit(0)), "nodes")
    kinds = dict(nodes.dtypes)
    own = edges.select("src", "tgt", F.col("weight").cast("double").alias("weight")).join(nodes.select(F.col("node").alias("src"), "scope"), "src")
    own = settled(own, "scoped")
    sizes = settled(own.groupBy("scope").agg(F.count("*").alias("n")), "sizes")
    large, n = sizes.filter(F.col("n") > LOCAL_EDGES).select("scope"), sizes.agg(F.sum("n")).first()[0] or 0
    found = _in_tasks(own.join(large, "scope", "left_anti"), resolution, (kinds["node"], kinds["scope"]), n)
    some = settled(nodes.join(large, "scope", "left_semi"), "large")
    if not some.isEmpty():
        found = found.unionByName(_in_rounds(some, own.join(large, "scope", "left_semi").drop("scope"), resolution, rounds, levels))
    full = nodes.join(found.select("node", "community"), "node", "left")
    return settled(full.select("node", "scope", F.coalesce("community", "node").alias("community")), "communities")


def _in_rounds(nodes: DataFrame, edges: DataFrame, resolution: float, rounds: int, levels: int) -> DataFrame:
    members = settled(nodes.select("node", "scope", F.col("node").alias("community")), "members")
    graph, at, start = edges, members.select("node", "scope"), None
    for _ in range(levels):
        links = graph.filter("src <> tgt")
        labels = settled(_degrees(at, graph).join(start, "node") if start is not None else _degrees(at, graph).withColumn("community", F.col("node")), "labels")
        parts = settled(_refined(_moved(labels, both_ways(links), resolution, rounds), links, resolution, rounds), "refined")
        n, cut, whole = parts.agg(F.count("*"), F.count_distinct("part"), F.count_distinct("scope", "community")).first()
        # A node of this level stands for a part of the last one, so members follow.
        members = settled(members.join(parts.select(F.col("node").alias("community"), "part"), "community").select("node", "scope", F.col("part").alias("community")), "members")
        if cut == n or cut == whole:  # nothing left to join, or every community is one connected part
            break
        name = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"p_{c}"))  # noqa: B023, E731
        ends = graph.join(name("src"), "src").join(name("tgt"), "tgt")
        graph = settled(ends.groupBy(F.least("p_src", "p_tgt").alias("src"), F.greatest("p_src", "p_tgt").alias("tgt")).agg(F.sum("weight").alias("weight")), "graph")
        at, n = parts.select(F.col("part").alias("node"), "scope").distinct(), graph.count()
        if n <= LOCAL_EDGES:  # what is left fits in tasks, and rounds cost the same on few edges
            kinds = dict(members.dtypes)
            rest = _in_tasks(graph.join(at.withColumnRenamed("node", "src"), "src"), resolution, (kinds["node"], kinds["scope"]), n)
            last = rest.select(F.col("node").alias("community"), F.col("community").alias("_last"))
            return settled(members.join(last, "community", "left").select("node", "scope", F.coalesce("_last", "community").alias("community")), "members")
        first = parts.groupBy("community").agg(F.min("part").alias("name"))  # named by one of the new nodes
        start = settled(parts.select(F.col("part").alias("node"), "community").distinct().join(first, "community").select("node", F.col("name").alias("community")), "start")
    return members


def bounded_parts(members: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """node, scope, community: every scope cut into connected parts of at most most nodes, grown by merging along the heaviest edges.

    A scope with few edges is cut in one task, larger ones are in rounds.
    """
    members = settled(members.select("node", "scope"), "members")
    kinds = dict(members.dtypes)
    own = edges.select("src", "tgt", "weight").filter("src <> tgt").join(members.withColumnRenamed("node", "src"), "src")
    own = settled(own.join(members.select(F.col("node").alias("tgt"), F.col("scope").alias("_scope")), "tgt").filter("scope = _scope").drop("_scope"), "scoped")
    sizes = settled(own.groupBy("scope").agg(F.count("*").alias("n")), "sizes")
    large, n = settled(sizes.filter(F.col("n") > LOCAL_EDGES).select("scope"), "large"), sizes.agg(F.sum("n")).first()[0] or 0

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found: dict = {}
        for _, *rows in _by_scope(part):
            found |= _heaviest_first(list(zip(*rows)), most)
        return pd.DataFrame({"node": list(found), "community": list(found.values())})

    found = own.join(large, "scope", "left_anti").groupBy(_bucket("scope", n)).applyInPandas(run, f"node {kinds['node']}, community {kinds['node']}")
    if not large.isEmpty():
        found = found.unionByName(_bounded_in_rounds(members.join(large, "scope", "left_semi"), own.join(large, "scope", "left_semi"), most))
    return members.join(found, "node", "left").select("node", "scope", F.coalesce("community", "node").alias("community"))


def _heaviest_first(edges: list[tuple], most: int) -> dict:
    """The part, named by its smallest node, of each end of edges (src, tgt, weight), met by weight and joined while parts are small."""
    part = {x: [x] for a, b, _ in edges for x in (a, b)}
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], min(e[:2]), max(e[:2]))):
        one, two = part[a], part[b]
        if one is not two and len(one) + len(two) <= most:
            one += two
            for x in two:
                part[x] = one
    return {x: min(group) for x, group in part.items()}


def _bounded_in_rounds(members: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """node, community of scopes with many edges, which lie inside them.

    In a round a hash makes each part a mover or a target; a mover asks the target with the heaviest link that it fits in, and
    a target takes the heaviest mover that asks, one a round, so no part outgrows the bound.
    """
    now, idle, turn = settled(members.select("node", F.col("node").alias("community")), "parts"), 0, 0
    step = settled(both_ways(edges.select("src", "tgt", "weight")), "step")
    while idle < 4:
        near = lambda c: now.select(F.col("node").alias(c), F.col("community").alias(f"p_{c}"))  # noqa: B023, E731
        sizes = now.groupBy("community").agg(F.count("*").alias("n"))
        role = F.pmod(F.xxhash64("community", F.lit(turn)), F.lit(2)) == 0
        links = step.join(near("src"), "src").join(near("tgt"), "tgt").filter("p_src <> p_tgt").groupBy("p_src", "p_tgt").agg(F.sum("weight").alias("w"))
        asks = links.join(sizes.filter(role).select(F.col("community").alias("p_src"), "n"), "p_src").join(sizes.filter(~role).select(F.col("community").alias("p_tgt"), F.col("n").alias("m")), "p_tgt").filter(F.col("n") + F.col("m") <= most)
        asks = asks.groupBy("p_src").agg(F.min(F.struct((-F.col("w")).alias("w"), "p_tgt")).alias("b")).select("p_src", "b.*")
        taken = asks.groupBy("p_tgt").agg(F.min(F.struct("w", "p_src"))["p_src"].alias("community")).withColumnRenamed("p_tgt", "new")
        after = settled(now.join(taken, "community", "left").select("node", F.coalesce("new", "community").alias("community"), F.col("new").isNotNull().alias("went")), "parts")
        idle, turn, now = (idle + 1 if after.filter("went").isEmpty() else 0), turn + 1, after.drop("went")
    return now


def community_levels(nodes: DataFrame, edges: DataFrame, most: int = 10, levels: int = 8, resolution: float = 1.0) -> DataFrame:
    """level, node, community (names joined by /, from the top): communities of communities until none has more than most nodes.

    Each level clusters the inside of every community that is too large on its own. One that has no better division, such as a
    clique, is cut into connected parts of at most most nodes, as are all that are too large on the last level.
    """
    now, out, inside = settled(nodes.select("node", F.lit("").alias("community")).distinct(), "whole"), None, edges
    for level in range(levels):
        ends = lambda c: now.select(F.col("node").alias(c), F.col("community").alias(f"_{c}"))  # noqa: B023, E731
        inside = settled(inside.join(ends("src"), "src").join(ends("tgt"), "tgt").filter("_src = _tgt").select("src", "tgt", "weight"), "inside")
        own = now.withColumnRenamed("community", "scope")
        found = leiden(own, inside, resolution)
        parts = found.groupBy("scope").agg(F.count_distinct("community").alias("parts"), F.count("*").alias("n"))
        stuck = settled(parts.filter((F.col("n") > most) & ((F.col("parts") == 1) | F.lit(level == levels - 1))).select("scope"), "stuck")
        if (level or levels == 1) and not stuck.isEmpty():
            cut = bounded_parts(own.join(stuck, "scope", "left_semi"), inside, most)
            found = found.join(stuck, "scope", "left_anti").unionByName(cut)
        path = F.concat_ws("/", F.nullif("scope", F.lit("")), F.col("community").cast("string"))
        made = settled(found.select("node", path.alias("community")), "communities")
        rows = made.select(F.lit(level).alias("level"), "node", "community")
        out = rows if out is None else out.unionByName(rows)
        large = made.groupBy("community").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        now = settled(made.join(large.select("community"), "community", "left_semi"), "large")
        if now.isEmpty():
            break
    return out

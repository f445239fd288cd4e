"""Nearest-neighbour graphs by NN-descent, and a layout of vectors in few dimensions that keeps neighbours together.

The graph starts from neighbours along random directions; then neighbours of neighbours are tried, round by round. The layout
follows the fuzzy neighbour weights: linked points pull each other, and each point is pushed away from a pool of others that
is drawn anew in every round. Each round is one pass over the edges, summed by node before the shuffle, so a point that very
many have as their neighbour isn't gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import importable

from .graph import both_ways, settled


@dataclass(frozen=True)
class LayoutParams:
    dim: int = 2
    neighbours: int = 15
    #: Random directions for the first neighbours, rows along one that are compared with each other, and rounds of descent.
    directions: int = 4
    block: int = 256
    descents: int = 4
    #: So many times neighbours are kept while the graph is made: more ways lead to the nearest.
    spare: int = 2
    #: Neighbours of a node, either way, that are tried with each other in a round; others have their turn in the next.
    tried: int = 24
    #: Rounds of the layout, points that others are pushed from in a round (drawn by a hash), and pushes an edge.
    epochs: int = 40
    pool: int = 1024
    pushes: int = 5
    seed: int = 224
    #: The curve of likeness by distance, 1 / (1 + a * d^(2b)); these values fit a least distance of 0.1.
    a: float = 1.577
    b: float = 0.895


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _first(pairs: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("src").orderBy("d", "tgt")
    return pairs.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k).drop("_r")


def _along(vectors: DataFrame, p: LayoutParams, turn: int, kind: str) -> DataFrame:
    """Each row's nearest among the rows beside it along one random direction."""
    size = vectors.select(F.size("v")).first()[0]
    way = np.random.default_rng([p.seed, turn]).normal(size=size)
    at = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in way]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0), _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, size))
            for i in range(0, len(ids), p.block):
                j = min(i + p.block, len(ids))
                away = np.round(1 - x[i:j] @ x[i:j].T, 10)
                np.fill_diagonal(away, np.inf)
                n = min(p.spare * p.neighbours, j - i - 1)
                if n < 1:
                    continue
                near = np.argpartition(away, n - 1, axis=1)[:, :n]
                a, b = np.repeat(np.arange(j - i), n), near.ravel()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + i)), ids.take(pa.array(b + i)), pa.array(away[a, b])], ["src", "tgt", "d"])

    dealt = vectors.withColumn("_at", at)
    parts = max(1, -(-vectors.count() // (16 * p.block)))
    return dealt.repartitionByRange(parts, "_at", "node").sortWithinPartitions("_at", "node").select("node", "v").mapInArrow(run, f"src {kind}, tgt {kind}, d double")


def neighbour_graph(nodes: DataFrame, vector: str, p: LayoutParams = LayoutParams()) -> DataFrame:
    """src, tgt, d: about the p.neighbours nearest others of each of nodes (node, vector) by cosine distance.

    Nodes must be distinct and vectors of one size. Null vectors have no neighbours and are none; a zero vector is at distance 1
    from all.
    """
    spark = importable(nodes.sparkSession)
    kind = dict(nodes.dtypes)["node"]

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["node", "v", "raw"])

    own = nodes.select("node", F.col(vector).alias("raw")).filter("node IS NOT NULL AND raw IS NOT NULL")
    vectors = settled(own.mapInArrow(unit, f"node {kind}, v array<double>, raw {dict(own.dtypes)['raw']}"), "units")
    if vectors.isEmpty():
        return spark.createDataFrame([], f"src {kind}, tgt {kind}, d double")
    found = None
    for turn in range(p.directions):
        one = _along(vectors, p, turn, kind)
        found = one if found is None else found.unionByName(one)
    most = p.spare * p.neighbours
    best = settled(_first(found.repartition("src").distinct(), most), "neighbours")

    def score(tried: pa.Table) -> pa.Table:
        """The neighbours of one node with each other, as far as they can be among an end's best."""
        tried = tried.combine_chunks()
        ids, reach = tried.column("tgt").combine_chunks(), tried.column("reach").to_numpy()
        x = _unit(_matrix(tried.column("raw").combine_chunks()))
        a, b = np.triu_indices(len(ids), 1)
        d = np.round(1 - np.einsum("ij,ij->i", x[a], x[b]), 10)
        a, b, d = np.r_[a, b], np.r_[b, a], np.r_[d, d]
        kept = d <= reach[a]
        return pa.table([ids.take(pa.array(a[kept])), ids.take(pa.array(b[kept])), pa.array(d[kept])], ["src", "tgt", "d"])

    for turn in range(p.descents):
        links = both_ways(best.select("src", "tgt")).repartition("src").distinct()
        # Nearest first would try the same ones in every round; a hash of the round gives all their turn, and bounds hubs.
        some = Window.partitionBy("src").orderBy(F.xxhash64("src", "tgt", F.lit(turn)))
        few = links.withColumn("_r", F.row_number().over(some)).filter(F.col("_r") <= p.tried).select("src", "tgt")
        # Vectors move once for each node that tries them, not for each pair; what is further away than a full list reaches doesn't move.
        reach = best.groupBy(F.col("src").alias("tgt")).agg(F.when(F.count("*") >= most, F.max("d")).alias("reach"))
        asked = vectors.select(F.col("node").alias("tgt"), "raw").join(reach, "tgt", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        more = few.join(asked, "tgt").groupBy("src").applyInArrow(score, f"src {kind}, tgt {kind}, d double")
        best = settled(_first(best.unionByName(more).repartition("src").distinct(), most), "neighbours")
    return _first(best, p.neighbours)


def fuzzy_weights(graph: DataFrame, neighbours: int) -> DataFrame:
    """src, tgt, weight of undirected edges (src < tgt): the union of both ends' fuzzy neighbourhoods.

    From a node, the nearest counts 1 and others exp(-(d - nearest) / scale), with the scale at which they sum to the base-2
    logarithm of the number of neighbours.
    """
    kind = dict(graph.dtypes)["src"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            d, at = np.full((len(size), size.max()), np.inf), np.arange(size.max()) < size[:, None]
            d[at] = flat.field("d").to_numpy()
            near = np.where(d > 0, d, np.inf).min(1)
            rest = np.maximum(d - np.where(np.isfinite(near), near, 0.0)[:, None], 0)
            low, high, want = np.zeros(len(d)), np.full(len(d), 1e3), np.log2(max(neighbours, 2))
            for _ in range(50):
                mid = (low + high) / 2
                much = np.exp(-rest / mid[:, None]).sum(1) > want
                high, low = np.where(much, mid, high), np.where(much, low, mid)
            w = np.exp(-rest / np.maximum((low + high) / 2, 1e-6)[:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), size))), flat.field("tgt"), pa.array(np.round(w[at], 9))], ["src", "tgt", "w"])

    own = graph.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("d", "tgt"))).alias("l"))  # as many as neighbours
    one = own.mapInArrow(run, f"src {kind}, tgt {kind}, w double")
    ends = [F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")]
    both = one.groupBy(*ends).agg(F.sum("w").alias("s"), F.when(F.count("*") == 2, F.min("w") * F.max("w")).otherwise(0.0).alias("m"))
    return both.select("src", "tgt", (F.col("s") - F.col("m")).alias("weight"))


def layout(nodes: DataFrame, vector: str, p: LayoutParams = LayoutParams(), graph: DataFrame | None = None) -> DataFrame:
    """node, features (array of p.dim): places of nodes (node, vector) in which neighbours stay neighbours.

    The start is the projection on the main directions, scaled. Every run over the same rows gives the same places, but for the
    last digits. A node without vector has no place.
    """
    from .cluster import reduced

    kind, dim = dict(nodes.dtypes)["node"], p.dim
    graph = settled(graph if graph is not None else neighbour_graph(nodes, vector, p), "neighbours")
    edges = settled(both_ways(fuzzy_weights(graph, p.neighbours)), "weights")
    own = nodes.select("node", F.transform(vector, lambda x: x.cast("double")).alias("v")).filter("node IS NOT NULL AND v IS NOT NULL")
    start = reduced(own, "v", dim).select("node", vector_to_array("features").alias("x"))
    size = start.select(F.max(F.array_max(F.transform("x", lambda c: F.abs(c))))).first()[0] or 1.0
    jitter = F.transform("x", lambda c, i: c * (10 / size) + (F.pmod(F.xxhash64("node", i, F.lit(p.seed)), F.lit(2001)) - 1000) * 1e-5)  # equal vectors part
    now = settled(start.select("node", F.transform(jitter, lambda c: F.round(c, 6)).alias("x")), "places")
    weight = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    edges = settled(edges.join(weight, "src").select("src", "tgt", (F.col("weight") / F.greatest("total", F.lit(1.0))).alias("w")), "weights")
    columns = [f"g{i}" for i in range(dim)]
    for epoch in range(p.epochs):
        rate = 1.0 - epoch / p.epochs
        rows = now.orderBy(F.xxhash64("node", F.lit(p.seed + epoch))).limit(p.pool).toArrow().column("x")
        pool = _matrix(rows.combine_chunks()) if len(rows) else np.zeros((1, dim))

        def force(batches: Iterator[pa.RecordBatch], pool=pool, epoch=epoch) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = (np.column_stack([batch.column(f"{c}{i}").to_numpy() for i in range(dim)]) for c in "xy")
                w, h = batch.column("w").to_numpy(), batch.column("h").to_numpy()
                away = x - y
                d = (away**2).sum(1)
                pull = np.where(d > 0, -2 * p.a * p.b * np.power(d, p.b - 1, where=d > 0, out=np.zeros_like(d)) / (1 + p.a * d**p.b), 0.0)
                g = np.clip(pull[:, None] * away, -4, 4)
                for j in range(p.pushes):
                    pick = np.abs(h + j * 7919 + (h >> 17) * (j + 1)) % len(pool)
                    off = x - pool[pick]
                    d = (off**2).sum(1)
                    push = np.where(d > 0, 2 * p.b / ((0.001 + d) * (1 + p.a * d**p.b)), 0.0)
                    g += np.clip(push[:, None] * off, -4, 4)
                g = np.round(g * w[:, None] * 2**20)  # whole numbers: sums don't depend on the order
                yield pa.RecordBatch.from_arrays([batch.column("src"), *(pa.array(g[:, i].astype(np.int64)) for i in range(dim))], ["src", *columns])

        at = lambda c, name: now.select(F.col("node").alias(c), *[F.get("x", F.lit(i)).alias(f"{name}{i}") for i in range(dim)])  # noqa: B023, E731
        # By src last, so that a node's moves are together and are summed before they are sent on.
        full = edges.join(at("tgt", "y"), "tgt").join(at("src", "x"), "src").withColumn("h", F.xxhash64("src", "tgt", F.lit(p.seed + epoch)))
        moved = full.select("src", *[f"{c}{i}" for c in "xy" for i in range(dim)], "w", "h").mapInArrow(force, f"src {kind}, " + ", ".join(f"{c} long" for c in columns))
        sums = moved.groupBy(F.col("src").alias("node")).agg(*[F.sum(c).alias(c) for c in columns])
        step = F.array(*[F.coalesce(F.col(c), F.lit(0)) * (rate / 2**20) for c in columns])
        now = settled(now.join(sums, "node", "left").select("node", F.zip_with("x", step, lambda a, b: a + b).alias("x")), "places")
    return now.select("node", F.col("x").alias("features"))


def trustworthiness(near: DataFrame, ranks: DataFrame, n: int, k: int) -> float:
    """How far the k nearest in a layout, near (src, tgt), are near in the original too: 1 if all are; ranks has (src, tgt, rank) there."""
    bad = near.join(ranks, ["src", "tgt"]).filter(F.col("rank") > k).agg(F.sum(F.col("rank") - k)).first()[0]
    return 1 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * float(bad or 0)

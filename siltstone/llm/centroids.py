"""Centroid clustering by filtering balls.

Each task builds metric trees over blocks of its own vectors once, and writes them: vectors in tree order and, for each node,
radius, count and integer sum. In a round, a ball goes to one centroid as a whole if even its farthest point is nearer to that
centroid than its nearest point can be to any other (triangle inequality); its count and sum are then added without a look at
its vectors. Other balls are opened; vectors of opened leaves get exact integer distances. A task sends one row for each
centroid and dimension, whatever the number of its vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .balltree import Level, Tree, gathered, integer_rows, narrow, order, product, ranges
from .shared import prepare, written


@dataclass(frozen=True)
class CentroidParams:
    k: int = 16
    rounds: int = 3
    #: Number of components; vectors with another number take no part.
    dims: int = 64
    #: Components become floor(scale * x).
    scale: int = 64
    #: The k vectors whose id has the smallest SHA-256 after this prefix start as centroids.
    seed: str = "1:"
    leaf: int = 32
    block: int = 8192


def _kept(df: DataFrame, p: CentroidParams) -> DataFrame:
    """vec_id and the integer components, as bytes, of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = integer_rows(batch.column(1), p.scale, p.dims)
            body = [r.tobytes() for r in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(body, pa.binary())], ["vec_id", "v"])

    return df.mapInArrow(run, "vec_id long, v binary")


BLOCKS = "ids array<long>, width int, x binary, count binary, sums binary, radius binary"


def _blocks(kept: DataFrame, p: CentroidParams) -> DataFrame:
    """One row a tree; its levels' nodes stand one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for b in batches:
                if b.num_rows:
                    ids = b.column(0)
                    yield ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(-1, p.dims)

        for ids, none, x in gathered(parts(), p.block):
            rows = order(x, p.leaf)
            small = narrow(x[rows])
            levels = Tree(small, p.leaf).levels
            body = [b"".join(np.ascontiguousarray(getattr(v, f)).tobytes() for v in levels) for f in ("count", "sums", "radius")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([pa.array(ids[rows], mask=none[rows])], pa.list_(pa.int64())), pa.array([small.itemsize], pa.int32()), pa.array([small.tobytes()], pa.binary()), *(pa.array([b], pa.binary()) for b in body)],
                ["ids", "width", "x", "count", "sums", "radius"],
            )

    return kept.mapInArrow(run, BLOCKS)


def read_tree(row: dict, p: CentroidParams) -> Tree:
    tree = Tree.__new__(Tree)
    tree.x = np.frombuffer(row["x"], f"<i{row['width']}").reshape(-1, p.dims)
    count, radius = np.frombuffer(row["count"], "<i8"), np.frombuffer(row["radius"], "<f8")
    sums, n, tree.levels = np.frombuffer(row["sums"], "<i8").reshape(-1, p.dims), len(tree.x), []
    for h in range(len(count).bit_length()):
        a, b = (1 << h) - 1, (1 << h + 1) - 1
        tree.levels.append(Level((np.arange((1 << h) + 1) * n) >> h, count[a:b], sums[a:b], radius[a:b]))
    return tree


def assign(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The centroid of each row, counts and sums of each centroid, and the number of rows whose distance was computed."""
    k, n = len(centroids), len(tree.x)
    label, count, sums = np.zeros(n, np.int32), np.zeros(k, np.int64), np.zeros_like(centroids)
    live = np.zeros(1, np.int64)
    for h, level in enumerate(tree.levels):
        if not len(live):
            break
        away = np.sqrt(((level.centre[live][:, None] - centroids) ** 2).sum(2))
        best, r = away.argmin(1), level.radius[live]
        least = away[np.arange(len(live)), best]
        away[np.arange(len(live)), best] = np.inf
        second = away.min(1)
        whole = least + 2 * r < second * (1 - 1e-9) - 1e-9  # strictly: ties go to the leaves
        nodes, to = live[whole], best[whole]
        np.add.at(count, to, level.count[nodes])
        np.add.at(sums, to, level.sums[nodes])
        a, b = level.bounds[nodes], level.bounds[nodes + 1]
        label[ranges(a, b)] = np.repeat(to, b - a)
        live = live[~whole]
        if h + 1 < len(tree.levels):
            live = np.stack([2 * live, 2 * live + 1], 1).ravel()
    rows = ranges(tree.levels[-1].bounds[live], tree.levels[-1].bounds[live + 1])
    if len(rows):
        x = tree.x[rows]
        near = ((centroids**2).sum(1) - 2 * product(x, centroids)).argmin(1)  # the smallest number among equals
        label[rows] = near
        for c in range(k):
            own = x[near == c]
            count[c] += len(own)
            sums[c] += own.sum(0, dtype=np.int64)
    return label, count, sums, len(rows)


def _totals(blocks: DataFrame, centroids: np.ndarray, p: CentroidParams) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the centroids: k * (dims + 1) numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), p.dims + 1), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                _, count, sums, _ = assign(read_tree(row, p), centroids)
                total[:, 0] += count
                total[:, 1:] += sums
        c, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(total[c, d], pa.int64())], ["c", "d", "total"])

    found = np.zeros((len(centroids), p.dims + 1), np.int64)
    parts = blocks.select("width", "x", "count", "sums", "radius").mapInArrow(run, "c int, d int, total long")
    for r in parts.groupBy("c", "d").agg(F.sum("total").alias("total")).collect():
        found[r.c, r.d] = r.total
    return found[:, 0], found[:, 1:]


def clusters(vectors: DataFrame, p: CentroidParams = CentroidParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that takes part.

    A null vector, one with another number of components than dims, or one with a null, infinite or NaN component takes no
    part and gets no row. Rows of one id, repeated ones too, each take part; a row without id can start as a centroid only if
    fewer than k have one. With fewer than k vectors, all of them start. Equal starts are allowed: ties go to the smaller
    number, and an empty centroid stays where it is. An empty table gives an empty result. Other columns are not looked at.
    """
    spark = prepare(vectors.sparkSession)
    kept = _kept(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")), p)
    key = F.sha2(F.concat(F.lit(p.seed), F.col("vec_id").cast("string")), 256)
    starts = kept.orderBy(key.asc_nulls_last(), "v").limit(p.k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return spark.createDataFrame([], schema)
    centroids = np.stack([np.frombuffer(bytes(r.v), "<i4").astype(np.int64) for r in starts])
    blocks = written(_blocks(kept, p), "balls")
    for _ in range(p.rounds):
        count, sums = _totals(blocks, centroids, p)
        centroids = np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, row in zip(batch.column("ids"), batch.drop_columns(["ids"]).to_pylist()):
                tree = read_tree(row, p)
                label, *_ = assign(tree, centroids)
                away = tree.x.astype(np.int64) - centroids[label]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(label), pa.array(np.einsum("ij,ij->i", away, away))], ["vec_id", "cluster", "distance"])

    placed = written(blocks.select("ids", "width", "x", "count", "sums", "radius").mapInArrow(run, "vec_id long, cluster int, distance long"), "placed")
    per = {r.cluster: r.total for r in placed.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows at most
    total = sum(per.values())
    lines = [(c, per[c], total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(per)]
    about = spark.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select(*schema.replace(",", "").split()[::2])

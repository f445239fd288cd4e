"""A stored approximate vector index: lists of vectors by cell, with quantised residuals, searched by probing few cells.

``fit`` learns cells (k-means) and, for each block of dimensions, a codebook of residuals from a bounded sample. ``insert``
assigns every row to its nearest cell and writes it to that cell's folder with a code of a byte a block, so that a search
reads the folders of the probed cells only, and of these first ids and codes alone. The best rows by code are then scored
exactly. Deleted keys are kept in a table of their own until ``compact``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.session import importable

from .graph import settled

#: Rows of one list that a task scores together; a cell with more rows has several parts.
PART_ROWS = 1 << 16
#: Queries that meet a part of a list in one task.
QUERY_BLOCK = 1024


@dataclass(frozen=True)
class IndexParams:
    dim: int
    key: str = "vec_id"
    vector: str = "embedding"
    #: cosine or ip (inner product).
    metric: str = "cosine"
    #: 0: the square root of the number of rows, at most 4,096.
    cells: int = 0
    #: Bytes of a code.
    blocks: int = 16
    #: Rows, chosen by a hash of their key, on which cells and codebooks are fitted. All rows are indexed.
    sample: int = 65_536
    #: Cells that are probed (0: as many as reach the recall on the sample), and rows scored exactly for each one asked for.
    nprobe: int = 0
    recall: float = 0.95
    refine: int = 10
    seed: int = 7


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centres of the rows of x by Lloyd's rounds from a seeded choice of distinct rows; an empty one takes the farthest row."""
    own = np.unique(x, axis=0)
    if len(own) <= k:
        return own
    centre = own[np.sort(np.random.default_rng(seed).choice(len(own), k, replace=False))]
    for _ in range(rounds):
        near, away = nearest(x, centre)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
        empty = np.flatnonzero(n == 0)
        centre[empty] = x[np.argsort(-away, kind="stable")[: len(empty)]]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance."""
    near, away = np.zeros(len(x), np.int64), np.zeros(len(x))
    size = (centre**2).sum(1)
    for i in range(0, len(x), 8192):
        d = size - 2 * x[i : i + 8192] @ centre.T
        near[i : i + 8192] = d.argmin(1)
        away[i : i + 8192] = d[np.arange(len(d)), near[i : i + 8192]] + (x[i : i + 8192] ** 2).sum(1)
    return near, away


class Model:
    """Cells and codebooks; small, and the same for all rows."""

    def __init__(self, cells: np.ndarray, books: list[np.ndarray], metric: str):
        self.cells, self.books, self.metric = cells, books, metric
        self.edges = np.cumsum([0, *(b.shape[1] for b in books)])

    def ready(self, x: np.ndarray) -> np.ndarray:
        """Rows as they are compared: of length one for the cosine (a zero vector stays)."""
        if self.metric == "ip":
            return x
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, _ = nearest(x, self.cells)
        rest = x - self.cells[cell]
        return cell, np.stack([nearest(rest[:, a:b], book)[0] for a, b, book in zip(self.edges, self.edges[1:], self.books)], 1).astype(np.uint8)

    def probe(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n most promising cells of each query, the best first."""
        score = q @ self.cells.T - (0.5 * (self.cells**2).sum(1) if self.metric == "cosine" else 0)
        return np.argsort(-score, axis=1, kind="stable")[:, :n]

    def approximate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with the vectors that codes of one cell stand for."""
        score = np.repeat((q @ self.cells[cell])[:, None], len(codes), 1)
        for j, (a, b, book) in enumerate(zip(self.edges, self.edges[1:], self.books)):
            score += (q[:, a:b] @ book.T)[:, codes[:, j]]
        return score


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class VectorIndex:
    """Opened by its path; made by ``create``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = importable(spark), path.rstrip("/")
        about = spark.read.text(f"{self.path}/about", wholetext=True).first()[0]
        kept = json.loads(about)
        self.params = IndexParams(**kept["params"])
        self.types = kept["types"]
        self.model = Model(np.array(kept["cells"]), [np.array(b) for b in kept["books"]], self.params.metric)

    @classmethod
    def create(cls, rows: DataFrame, path: str, params: IndexParams) -> VectorIndex:
        """Fits cells and codebooks on a sample of rows and inserts all of them; other columns are kept beside the vector."""
        spark, p = importable(rows.sparkSession), params
        own = rows.filter(F.size(p.vector) == p.dim)
        n = own.count()
        some = own.orderBy(F.xxhash64(p.key)).select(p.vector).limit(p.sample).toArrow().column(0)
        model = Model(np.zeros((1, p.dim)), [], p.metric)
        x = model.ready(rows_of(some, p.dim)) if len(some) else np.zeros((1, p.dim))
        cells = kmeans(x, p.cells or max(1, min(4096, int(n**0.5))), 12, p.seed)
        rest = x - cells[nearest(x, cells)[0]]
        edges = np.linspace(0, p.dim, min(p.blocks, p.dim) + 1).astype(int)
        books = [kmeans(rest[:, a:b], 256, 8, p.seed + i) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
        cls._keep(spark, path, p, dict(rows.dtypes), Model(cells, books, p.metric))
        index = cls(spark, path)
        index.insert(rows)
        if not p.nprobe:
            index.tune(own, p.recall)
        return index

    @staticmethod
    def _keep(spark: SparkSession, path: str, p: IndexParams, types: dict, model: Model) -> None:
        about = json.dumps({"params": asdict(p), "types": types, "cells": model.cells.tolist(), "books": [b.tolist() for b in model.books]})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/about")

    def tune(self, rows: DataFrame, recall: float, queries: int = 64, k: int = 10) -> float:
        """Sets nprobe to the least power of two (or all cells) whose measured recall of the k nearest on sample queries reaches recall."""
        from .search import batched_search

        p = self.params
        some = settled(rows.orderBy(F.xxhash64(p.key, F.lit(p.seed))).limit(queries).select(F.col(p.key).alias("query_id"), p.vector), "tuning")
        if some.isEmpty():  # nothing to measure on
            self.params = replace(p, nprobe=len(self.model.cells))
            self._keep(self.spark, self.path, self.params, self.types, self.model)
            return 1.0
        exact = batched_search(some, rows, k, key=p.key, vector=p.vector) if p.metric == "cosine" else self.search_many(some, k, nprobe=len(self.model.cells), refine=None)
        exact = settled(exact.select("query_id", p.key), "exact")
        n, most, got = 1, len(self.model.cells), 0.0
        while True:
            n = min(n, most)
            hits = self.search_many(some, k, nprobe=n).select("query_id", p.key).join(exact, ["query_id", p.key], "left_semi").count()
            got = hits / max(exact.count(), 1)
            if got >= recall or n == most:
                break
            n *= 2
        self.params = replace(p, nprobe=n)
        self._keep(self.spark, self.path, self.params, self.types, self.model)
        return got

    def _has(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _number(self) -> int:
        """Writes so far: inserts and deletes are ordered by it."""
        out = [-1]
        for name in ("lists", "deleted"):
            if self._has(name):
                out.append(self.spark.read.schema("_n int").parquet(f"{self.path}/{name}").agg(F.coalesce(F.max("_n"), F.lit(-1))).first()[0])
        return max(out) + 1

    def insert(self, rows: DataFrame) -> None:
        """Adds rows. A row whose vector hasn't dim values is refused, with all others. A key may come more than once."""
        p, model, names = self.params, self.model, [c for c in rows.columns if c not in ("_cell", "_part", "_code", "_n")]
        if not rows.filter(F.coalesce(F.size(p.vector), F.lit(-1)) != p.dim).isEmpty():
            raise ValueError(f"vectors must have {p.dim} values")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, code = model.encode(model.ready(rows_of(batch.column(p.vector), p.dim)))
                made = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "_code", "_cell"])

        kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*names).dtypes)
        coded = settled(rows.select(*names).mapInArrow(run, f"{kinds}, _code binary, _cell int"), "coded")
        # A cell may hold a large part of all rows: its parts are written by several tasks and searched by several.
        parts = coded.groupBy("_cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts"))
        dealt = coded.join(F.broadcast(parts), "_cell").withColumn("_part", F.pmod(F.xxhash64(p.key), F.col("_parts")).cast("int")).withColumn("_n", F.lit(self._number()))
        dealt.drop("_parts").repartition("_cell", "_part").sortWithinPartitions("_cell", "_part", p.key).write.mode("append").partitionBy("_cell").parquet(f"{self.path}/lists")

    def delete(self, keys: DataFrame) -> None:
        """Deletes the rows with these keys (column key) that are stored now; rows inserted later with such a key stay."""
        keys.select(self.params.key).distinct().withColumn("_n", F.lit(self._number())).write.mode("append").parquet(f"{self.path}/deleted")

    def upsert(self, rows: DataFrame) -> None:
        self.delete(rows)
        self.insert(rows)

    def lists(self, cells: list[int] | None = None) -> DataFrame:
        """Stored rows, of some cells only (their folders are the only ones that are read), without deleted ones."""
        kinds = ", ".join(f"`{c}` {t}" for c, t in self.types.items())
        if not self._has("lists"):
            return self.spark.createDataFrame([], f"{kinds}, _code binary, _part int, _n int, _cell int")
        found = self.spark.read.schema(f"{kinds}, _code binary, _part int, _n int, _cell int").parquet(f"{self.path}/lists")
        if cells is not None:
            found = found.filter(F.col("_cell").isin([int(c) for c in cells]))
        if self._has("deleted"):
            key = self.params.key
            gone = self.spark.read.parquet(f"{self.path}/deleted").groupBy(F.col(key).alias("_gone")).agg(F.max("_n").alias("_until"))
            found = found.join(gone, (F.col(key) == F.col("_gone")) & (F.col("_n") < F.col("_until")), "left_anti")
        return found

    def rows(self) -> DataFrame:
        return self.lists().select(*self.types)

    def compact(self) -> None:
        """Writes the lists anew without deleted rows."""
        kept = settled(self.rows(), "kept")
        for name in ("deleted", "lists"):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.insert(kept)

    def _score(self, q) -> Column:
        from siltstone.functions import vectors as V

        v = F.transform(self.params.vector, lambda x: x.cast("double"))
        return V.dot(v, q) if self.params.metric == "ip" else F.when(V.norm(v) * V.norm(q) == 0, 0.0).otherwise(V.cosine(v, q))

    def search(self, query: list[float], k: int, where: str = "true", nprobe: int | None = None, refine: int | None = -1) -> DataFrame:
        """Stored columns and score of the k nearest rows of the probed cells that meet where; ties by key.

        refine: how many rows for each one asked for are scored exactly (-1: as the index was made); None: all of them, so
        that with all cells the answer is the exact one.
        """
        p, model = self.params, self.model
        q = model.ready(np.array([query], np.float64))
        cells = model.probe(q, nprobe or p.nprobe)[0]
        few = self.lists(cells).filter(where)
        if refine is not None:
            n, table = k * (p.refine if refine < 0 else refine), q.astype(np.float64)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    cell, near = batch.column(1).to_numpy(), np.zeros(batch.num_rows)
                    for c in np.unique(cell):
                        near[cell == c] = model.approximate(table, c, codes[cell == c])[0]
                    keep = np.argsort(-near, kind="stable")[:n]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), batch.column(3).take(pa.array(keep)), pa.array(near[keep])], [p.key, "_cell", "_n", "_near"])

            kind = self.types[p.key]
            best = few.select(p.key, "_cell", "_code", "_n").mapInArrow(run, f"`{p.key}` {kind}, _cell int, _n int, _near double")
            best = best.orderBy(F.desc("_near"), p.key).limit(n).select(p.key, "_cell", "_n").distinct()
            few = few.join(F.broadcast(best), [p.key, "_cell", "_n"], "left_semi")  # k * refine rows
        scored = few.withColumn("score", self._score(F.array(*[F.lit(float(x)) for x in query])))
        return scored.orderBy(F.desc("score"), p.key).limit(k).select(*self.types, "score")

    def search_many(self, queries: DataFrame, k: int, query_key: str = "query_id", nprobe: int | None = None, refine: int | None = -1) -> DataFrame:
        """query_id, key, score, rank: the k nearest stored rows of each row of queries (query_id, vector), of the cells it probes.

        Queries are sent to the parts of the lists that they probe, in blocks of about QUERY_BLOCK, and nothing passes the driver.
        Queries without a vector have no rows; several rows of one query_id count as one query with the best of all.
        """
        p, model, probed = self.params, self.model, nprobe or self.params.nprobe
        kind, named = self.types[p.key], dict(queries.dtypes)[query_key]
        asked = queries.select(F.col(query_key).alias("_q"), F.transform(p.vector, lambda x: x.cast("double")).alias("_v")).filter(F.size("_v") == p.dim)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    q = model.ready(rows_of(batch.column(1), p.dim))
                    cells = model.probe(q, probed)
                    to = np.repeat(np.arange(len(q)), cells.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(to)), pa.array(cells.ravel().astype(np.int32)), pa.array([r.tobytes() for r in q[to]], pa.binary())], ["_q", "_to", "_w"])

        sent = asked.mapInArrow(send, f"_q {named}, _to int, _w binary")
        stored = self.lists()
        parts = stored.groupBy(F.col("_cell").alias("_to")).agg(F.max("_part").alias("_last"))
        blocks = sent.groupBy("_to").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("_blocks"))
        cells = settled(parts.join(blocks, "_to"), "probed")  # a row a cell
        dealt = sent.join(F.broadcast(cells), "_to").withColumn("_block", F.pmod(F.xxhash64("_q", "_w"), F.col("_blocks")).cast("int"))
        dealt = dealt.withColumn("_part_to", F.explode(F.sequence(F.lit(0), "_last"))).select("_to", "_part_to", "_block", "_q", "_w")
        shown = stored.select("_cell", "_part", p.key, "_n", *(["_code"] if refine is not None else [F.transform(p.vector, lambda x: x.cast("double")).alias("_x")]))
        shown = shown.join(F.broadcast(cells.select(F.col("_to").alias("_cell"), "_blocks")), "_cell").withColumn("_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
        n = k if refine is None else k * (p.refine if refine < 0 else refine)

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["_q", p.key, "_cell", "_part", "_n", "_near"]
            if not left.num_rows or not right.num_rows:
                return pa.table({"_q": left.column("_q").slice(0, 0), p.key: right.column(p.key).slice(0, 0)} | {c: pa.array([], pa.int32()) for c in names[2:5]} | {"_near": pa.array([], pa.float64())})
            asked = np.frombuffer(b"".join(left.column("_w").to_pylist()), np.float64).reshape(-1, p.dim)
            cell, order, out = right.column("_cell")[0].as_py(), pc.sort_indices(right, sort_keys=[(p.key, "ascending")]).to_numpy(), []
            if refine is None:
                exact = model.ready(rows_of(right.column("_x"), p.dim)).T
            else:
                codes = np.frombuffer(b"".join(right.column("_code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            for i in range(0, len(asked), 64):  # bounds the matrix of scores
                q = asked[i : i + 64]
                near = q @ exact if refine is None else model.approximate(q, cell, codes)
                best = order[np.argsort(-np.round(near[:, order], 10), axis=1, kind="stable")[:, :n]]
                a, b = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
                rows = right.take(pa.array(b))
                out.append(pa.table([left.column("_q").take(pa.array(a + i)), rows.column(p.key), rows.column("_cell"), rows.column("_part"), rows.column("_n"), pa.array(near[a, b])], names))
            return pa.concat_tables(out)

        found = dealt.groupBy("_to", "_part_to", "_block").cogroup(shown.groupBy("_cell", "_part", "_own")).applyInArrow(meet, f"_q {named}, `{p.key}` {kind}, _cell int, _part int, _n int, _near double")
        first = Window.partitionBy("_q").orderBy(F.desc(F.round("_near", 10)), p.key)
        best = found.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n)
        if refine is None:
            return best.select(F.col("_q").alias(query_key), p.key, F.col("_near").alias("score"), F.col("_r").alias("rank"))
        full = best.join(stored.select(p.key, "_cell", "_part", "_n", p.vector), [p.key, "_cell", "_part", "_n"]).join(asked, "_q")
        exact = full.withColumn("score", self._score(F.col("_v"))).withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc(F.round("score", 10)), p.key)))
        return exact.filter(F.col("rank") <= k).select(F.col("_q").alias(query_key), p.key, "score", "rank")

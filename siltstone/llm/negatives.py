"""Hard-negative mining by dual-tree search.

All vectors are put in order of label and cell (nearest of a few pivots) and cut into blocks; each block is a metric tree, and
so is each block of anchors. The inner product of any point of one ball with any of another lies within
<c, d> - (r|d| + s|c| + rs) and <c, d> + (r|d| + s|c| + rs), where c, d are the centres and r, s the radii. Every anchor has
windows of scores of which it wants the k best: one open window for its positives, then one for each positive for its
negatives. A block of anchors isn't sent to a group of vectors if that interval misses all windows of all its anchors; within a
task, node pairs are dropped in the same way, from the roots down, also where an anchor already has k better ones; the leaf
pairs that remain are scored exactly in whole numbers.

Positives are searched twice: first in the groups of an anchor's own label and cell, which gives a bound that prunes the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .balltree import Tree, gathered, integer_rows, joined, narrow, order, product
from .shared import partitions, prepare, written

LOW, HIGH = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class NegativeParams:
    #: Components become floor(scale * x).
    scale: int = 256
    positives: int = 5
    negatives: int = 5
    #: A negative's score lies between so many percent of the positive's and the positive's.
    percent: int = 80
    #: Vectors whose order of hashes makes them pivots of cells; they only bear on the speed.
    pivots: int = 64
    leaf: int = 64
    #: Vectors and anchors in a tree, and trees of each kind that one task loads together.
    block: int = 8192
    anchor_block: int = 1024
    load: int = 16
    #: Vectors in a group: the driver keeps a line for each, and for max_groups at most (groups are larger then).
    group: int = 1 << 18
    max_groups: int = 16384


def _cells(df: DataFrame, scale: int, pivots: np.ndarray) -> DataFrame:
    """The integer components, as bytes without zeros at the end, and the cell; rows that are equal in one batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = integer_rows(batch.column("v"), scale)
            ids, labels = (batch.column(c).to_numpy()[rows] for c in ("id", "label"))
            both = np.column_stack([ids, labels, x])
            _, first = np.unique(both, axis=0, return_index=True)
            x, ids, labels = x[first], ids[first], labels[first]
            anchors = np.asarray(batch.column("anchor").to_numpy(zero_copy_only=False), bool)[rows][first]
            cell = np.zeros(len(x), np.int32)
            if len(pivots) and len(x):
                a, b = joined((x.astype(np.float64), pivots))[: len(x)], joined((pivots, x[:1].astype(np.float64)))[: len(pivots)]
                cell = ((b**2).sum(1) - 2 * a @ b.T).argmin(1).astype(np.int32)
            body = [r.astype("<i4").tobytes().rstrip(b"\0") for r in x]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(cell), pa.array(anchors), pa.array(body, pa.binary())], ["id", "label", "cell", "anchor", "v"])

    return df.mapInArrow(run, "id long, label long, cell int, anchor boolean, v binary")


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of the bytes that _cells has made, filled with zeros to the longest."""
    parts = column.to_pylist()
    width = max((-(-len(b) // 4) for b in parts), default=0)
    return np.frombuffer(b"".join(b.ljust(4 * width, b"\0") for b in parts), "<i4").reshape(len(parts), width)


KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(f.split()[0], KINDS[f.split()[1]]) for f in text.split(", ")])


BLOCK = "block long, g int, load int, lmin long, lmax long, cmin int, cmax int, n int, d int, w int, centre array<double>, radius double, ids binary, labels binary, x binary"
FOUND = "block long, place int, w int, anchor long, id long, score long"


def _blocks(rows: DataFrame, parts: int, size: int, p: NegativeParams) -> DataFrame:
    """One row a tree. g is the number of the partition, load counts its runs of p.load trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        g, last = TaskContext.get().partitionId(), None

        def fresh():
            nonlocal last
            for b in batches:
                lines = list(zip(*(b.column(c).to_pylist() for c in ("id", "label", "v"))))
                new = [i for i, x in enumerate(lines) if x != (lines[i - 1] if i else last)]
                if new:
                    last, c = lines[-1], b.take(pa.array(new, pa.int64()))
                    yield (*(c.column(k).to_numpy() for k in ("id", "label", "cell")), _vectors(c.column("v")))

        for number, (ids, labels, cell, x) in enumerate(gathered(fresh(), size)):
            o = order(x, p.leaf)
            small = narrow(x[o])
            top = Tree(small, len(small)).levels[0]
            row = {
                "block": (g << 32) + number, "g": g, "load": number // p.load, "lmin": labels.min(), "lmax": labels.max(), "cmin": cell.min(), "cmax": cell.max(), "n": len(x), "d": x.shape[1], "w": small.itemsize,
                "centre": top.centre[0].tolist(), "radius": top.radius[0], "ids": ids[o].astype("<i8").tobytes(), "labels": labels[o].astype("<i8").tobytes(), "x": small.tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_schema(BLOCK))

    # Keys that are equal in full are one row's copies; of each batch only one has come here.
    dealt = rows.select("id", "label", "cell", "v").repartitionByRange(parts, "label", "cell", "id", F.xxhash64("v")).sortWithinPartitions("label", "cell", "id", "v")
    return written(dealt.mapInArrow(run, BLOCK), "trees")


def _groups(trees: DataFrame) -> list[dict]:
    """A ball around all trees of each group, with its labels, cells and number of loads."""
    kind = "g int, lmin long, lmax long, cmin int, cmax int, loads int, centre array<double>, radius double"

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        centres = joined(tuple(np.array([r["centre"]]) for r in rows))
        n = np.array([r["n"] for r in rows])
        centre = (centres * n[:, None]).sum(0) / n.sum()
        radius = (np.sqrt(((centres - centre) ** 2).sum(1)) + [r["radius"] for r in rows]).max() * (1 + 1e-9) + 1e-6
        one = {"g": rows[0]["g"], "loads": max(r["load"] for r in rows) + 1, "centre": centre.tolist(), "radius": radius}
        one |= {c: min(r[c] for r in rows) for c in ("lmin", "cmin")} | {c: max(r[c] for r in rows) for c in ("lmax", "cmax")}
        return pa.Table.from_pylist([one], schema=_schema(kind))

    about = trees.select("g", "load", "lmin", "lmax", "cmin", "cmax", "n", "centre", "radius")
    return [r.asDict() for r in about.groupBy("g").applyInArrow(run, kind).collect()]


class Block:
    """A block row as arrays and a tree; of an anchor block also the windows of each anchor (one that is open, if none are given)."""

    def __init__(self, row: dict, leaf: int):
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.x = np.frombuffer(row["x"], f"<i{row['w']}").reshape(row["n"], row["d"])
        self.tree, n = Tree(self.x, leaf), len(self.ids)
        low, high = row.get("low"), row.get("high")
        self.low = np.full((n, 1), LOW) if low is None else np.frombuffer(low, "<i8").reshape(n, -1)
        self.high = np.full((n, 1), HIGH) if high is None else np.frombuffer(high, "<i8").reshape(n, -1)
        self.about = [tuple((np.minimum.reduceat(self.labels, v.bounds[:-1]), np.maximum.reduceat(self.labels, v.bounds[:-1]))) for v in self.tree.levels]


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def interval(c: np.ndarray, r: np.ndarray, d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of the points of each ball (c, r) with those of each ball (d, s)."""
    width = max(c.shape[1], d.shape[1])
    c, d = _wide(c, width), _wide(d, width)
    m, n = np.sqrt((c**2).sum(1))[:, None], np.sqrt((d**2).sum(1))[None]
    r, s = r[:, None], s[None]
    at, off = c @ d.T, (r * n + s * m + r * s) * (1 + 1e-9) + 1e-9 * m * n + 1e-6
    return at - off, at + off


def best(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k first of each slot by descending score and ascending id, in the order of slots, and their ranks from 0."""
    o = np.lexsort((ids, -score, slot))
    s = slot[o]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return o[rank < k], rank[rank < k]


class Search:
    """The k best of each window of the anchors of one block, over blocks of vectors that are shown one by one."""

    def __init__(self, anchors: Block, same: bool, k: int):
        self.a, self.same, self.k, self.scored = anchors, same, k, 0
        self.windows = anchors.low.shape[1]
        self.slot, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.low = anchors.low.copy()  # rises to the k-th best score

    def leaf_pairs(self, c: Block) -> np.ndarray:
        """Which leaves of the anchors meet which leaves of c: pairs of nodes are dropped from the roots down."""
        a, low, high = self.a, self.low.min(1), self.a.high.max(1)
        ta, tc = a.tree.levels, c.tree.levels
        live = np.ones((1, 1), bool)
        for h in range(max(len(ta), len(tc))):
            i, j = min(h, len(ta) - 1), min(h, len(tc) - 1)
            if h:
                live = np.repeat(live, 2, 0) if h == i else live
                live = np.repeat(live, 2, 1) if h == j else live
            (amin, amax), (cmin, cmax) = a.about[i], c.about[j]
            if self.same:
                live &= (amin[:, None] <= cmax) & (amax[:, None] >= cmin)
            else:
                live &= ~((amin == amax)[:, None] & (cmin == cmax) & (amin[:, None] == cmin))
            rows, cols = np.flatnonzero(live.any(1)), np.flatnonzero(live.any(0))
            if not len(rows):
                break
            lo, hi = interval(ta[i].centre[rows], ta[i].radius[rows], tc[j].centre[cols], tc[j].radius[cols])
            least, most = np.minimum.reduceat(low, ta[i].bounds[:-1])[rows, None], np.maximum.reduceat(high, ta[i].bounds[:-1])[rows, None]
            live[np.ix_(rows, cols)] &= (hi >= least) & (lo <= most)
        return live if live.shape == (len(ta[-1].count), len(tc[-1].count)) else np.zeros((len(ta[-1].count), len(tc[-1].count)), bool)

    def show(self, c: Block) -> None:
        live, bounds = self.leaf_pairs(c), self.a.tree.levels[-1].bounds
        for i in np.flatnonzero(live.any(1)):
            a, b = bounds[i : i + 2]
            rows = np.flatnonzero(np.repeat(live[i], c.tree.levels[-1].count))
            width = max(self.a.x.shape[1], c.x.shape[1])
            xa, xc = _wide(self.a.x[a:b], width), _wide(c.x[rows], width)
            score = product(xa, xc)
            self.scored += score.size
            fit = (self.a.labels[a:b, None] == c.labels[rows]) == self.same
            if self.same:  # an anchor isn't its own positive
                for q, j in zip(*np.nonzero(fit & (self.a.ids[a:b, None] == c.ids[rows]))):
                    fit[q, j] = not np.array_equal(xa[q], xc[j])
            new = []
            for w in range(self.windows):
                q, j = np.nonzero(fit & (score >= self.low[a:b, w, None]) & (score <= self.a.high[a:b, w, None]))
                new.append(((q + a) * self.windows + w, score[q, j], c.ids[rows[j]]))
            self._add(*(np.concatenate(x) for x in zip(*new)))

    def _add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        old = np.isin(self.slot, slot)
        slot, score, ids = (np.concatenate([x[old], y]) for x, y in ((self.slot, slot), (self.score, score), (self.ids, ids)))
        keep, rank = best(slot, score, ids, self.k)
        slot, score, ids = slot[keep], score[keep], ids[keep]
        self.slot, self.score, self.ids = (np.concatenate([x[~old], y]) for x, y in ((self.slot, slot), (self.score, score), (self.ids, ids)))
        full = rank == self.k - 1
        self.low.reshape(-1)[slot[full]] = score[full]

    def found(self, block: int) -> pa.Table:
        n, place = len(self.slot), self.slot // self.windows
        return pa.table([np.full(n, block), place.astype(np.int32), (self.slot % self.windows).astype(np.int32), self.a.ids[place], self.ids, self.score], _schema(FOUND))


def _search(anchors: DataFrame, trees: DataFrame, groups: list[dict], same: bool, k: int, p: NegativeParams, home: bool | None = None) -> DataFrame:
    """FOUND rows and rank, from 1: the k best of each window of each anchor.

    home: only in groups that have labels and cells in common with the anchor's block, only in others, or in all.
    """
    kind = f"to_g int, to_load int, own int, {BLOCK}, low binary, high binary"
    centre = joined(tuple(np.array([g["centre"]]) for g in groups))
    radius = np.array([g["radius"] for g in groups])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block of anchors once for every load of vectors that it can't do without."""
        for batch in batches:
            for row in batch.to_pylist():
                a = Block(row, row["n"])
                lo, hi = interval(np.array([row["centre"]]), np.array([row["radius"]]), centre, radius)
                for g, x, y in zip(groups, lo[0], hi[0]):
                    shares = row["lmin"] <= g["lmax"] and g["lmin"] <= row["lmax"]
                    only = row["lmin"] == row["lmax"] == g["lmin"] == g["lmax"]
                    near = shares and row["cmin"] <= g["cmax"] and g["cmin"] <= row["cmax"]
                    if (shares if same else not only) and x <= a.high.max() and y >= a.low.min() and home in (None, near):
                        for n in range(g["loads"]):
                            yield pa.RecordBatch.from_pylist([row | {"to_g": g["g"], "to_load": n, "own": (row["block"] >> 32) * 65536 + (row["block"] & 0xFFFFFFFF) // p.load}], schema=_schema(kind))

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks, out = [Block(r, p.leaf) for r in right.to_pylist()], []
        for row in left.to_pylist():
            search = Search(Block(row, p.leaf), same, k)
            top = search.a.tree.levels[0]
            ahead = [-interval(top.centre, top.radius, b.tree.levels[0].centre, b.tree.levels[0].radius)[1][0, 0] for b in blocks]
            for j in np.argsort(ahead, kind="stable"):  # the most promising first, for the bounds that they give
                search.show(blocks[j])
            out.append(search.found(row["block"]))
        return pa.concat_tables(out) if out else _schema(FOUND).empty_table()

    sent = written(anchors.mapInArrow(send, kind), "sent")
    ways = sent.select(F.col("to_g").alias("g"), F.col("to_load").alias("load"), F.col("own").alias("by")).distinct()
    shown = trees.join(ways, ["g", "load"])
    return _first(sent.groupBy("to_g", "to_load", "own").cogroup(shown.groupBy("g", "load", "by")).applyInArrow(pairs, FOUND), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("block", "place", "w").orderBy(F.desc("score"), "id")
    return found.select(*_schema(FOUND).names, F.row_number().over(own).alias("rank")).filter(F.col("rank") <= k)


def _windows(anchors: DataFrame, found: DataFrame, windows: int, make) -> DataFrame:
    """anchors with the windows low to high that make sets: called with arrays low, high and the found places, ranks, scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low, high = (np.zeros((row["n"], windows), np.int64) for _ in range(2))
                got = np.array([(x["place"], x["rank"], x["score"]) for x in row["got"] or ()], np.int64).reshape(-1, 3)
                make(low, high, *got.T)
                new = row | {"low": low.astype("<i8").tobytes(), "high": high.astype("<i8").tobytes()}
                new.pop("got")
                yield pa.RecordBatch.from_pylist([new], schema=_schema(f"{BLOCK}, low binary, high binary"))

    per = found.groupBy("block").agg(F.collect_list(F.struct("place", "rank", "score")).alias("got"))  # p.positives a place at most
    return anchors.join(per, "block", "left").select(*_schema(BLOCK).names, "got").mapInArrow(run, f"{BLOCK}, low binary, high binary")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, anchor: Column, p: NegativeParams = NegativeParams(), id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of which anchor is true.

    Rows with a null id, label or vector, or with a null, infinite or NaN component, take no part. A shorter vector counts as
    filled with zeros. Rows that are equal in id, label and components are one row; others of one id each take part. Ties go
    to the smaller id. An anchor without another row of its label gives no rows, nor does a positive without a negative in its
    window; a positive with a score below zero has none, as its window is empty. An empty table, or one without anchors, gives
    an empty result. Other columns are not looked at.
    """
    spark = prepare(vectors.sparkSession)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    some = pa.array([list(r.v) for r in rows.orderBy(F.xxhash64("id"), "id", "label").limit(p.pivots).select("v").collect()], pa.list_(pa.float64()))
    pivots = integer_rows(some, p.scale)[0].astype(np.float64)
    cells = written(_cells(rows, p.scale, pivots), "cells")
    n, m = cells.agg(F.count("*"), F.count_if("anchor")).first()
    if not m:
        return spark.createDataFrame([], RESULT)
    most = partitions(spark)
    trees = _blocks(cells, min(p.max_groups, max(-(-n // p.group), min(most, -(-n // 4096)))), p.block, p)
    anchors = _blocks(cells.filter("anchor"), max(-(-m // (p.anchor_block * p.load)), min(most, -(-m // 256))), p.anchor_block, p)
    groups = _groups(trees)
    none = F.lit(None).cast("binary")
    near = written(_search(anchors.withColumns({"low": none, "high": none}), trees, groups, True, p.positives, p, home=True), "near")

    def rest(low, high, place, rank, score):
        low[:], high[:] = LOW, HIGH
        last = rank == p.positives
        low[place[last], 0] = score[last]

    def windows(low, high, place, rank, score):
        low[:], high[:] = HIGH, LOW
        low[place, rank - 1], high[place, rank - 1] = -((-p.percent * score) // 100), score

    far = _search(_windows(anchors, near, 1, rest), trees, groups, True, p.positives, p, home=False)
    positives = written(_first(near.unionByName(far), p.positives), "positives")
    found = _search(_windows(anchors, positives, p.positives, windows), trees, groups, False, p.negatives, p)
    own = positives.select("block", "place", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(own, ["block", "place", "w"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

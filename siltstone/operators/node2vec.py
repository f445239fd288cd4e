"""Node vectors from walks that remember where they came from.

A step proposes a neighbour by its number among the node's edges, which lie in rows of bounded length so that each moves little,
and takes it with a probability that depends on the node before: 1/p to go back, 1 to a common neighbour, 1/q elsewhere, all
over the largest of these. Walks whose proposals were all refused propose again. Vectors are then learned from nodes that are near
each other on walks (skip-gram with negative samples): blocks of nodes meet blocks of their neighbours in turns, a pair of blocks a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import importable

from .graph import both_ways, settled, shared_path


@dataclass(frozen=True)
class WalkParams:
    length: int = 40
    per_node: int = 10
    #: Larger: less often back, and less often further away.
    back: float = 1.0
    away: float = 1.0
    #: Proposals that a walk makes at once.
    tries: int = 4
    dims: int = 64
    window: int = 5
    rounds: int = 1
    seed: int = 3
    #: Nodes drawn against each pair, and the size of the first steps.
    negatives: int = 5
    rate: float = 0.05


def _chance(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


#: Neighbours in a row.
LIST = 1024
#: Up to so many waiting walks, only the lists of the nodes where they are and were are joined.
FEW = 50_000


def _lists(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """src, part, tgts: each node's neighbours in order, LIST a part from 0 on; of nodes with more, also dealt by hash to parts below 0. And src, degree."""
    w = Window.partitionBy("src").orderBy("tgt")
    step = both_ways(edges.select("src", "tgt")).filter("src <> tgt").select("src", "tgt", F.lag("tgt").over(w).alias("_same"), (F.dense_rank().over(w) - 1).alias("number")).filter("_same IS NULL OR _same <> tgt")
    lists = settled(step.groupBy("src", F.floor(F.col("number") / LIST).cast("int").alias("part")).agg(F.array_sort(F.collect_list("tgt")).alias("tgts")), "lists")
    degree = settled(lists.groupBy("src").agg(F.sum(F.size("tgts")).alias("degree")), "degrees")
    long = lists.join(degree.filter(F.col("degree") > LIST), "src").select("src", "degree", F.explode("tgts").alias("tgt"))
    dealt = settled(long.groupBy("src", _hashed("tgt", "degree").alias("part")).agg(F.collect_list("tgt").alias("tgts")), "dealt")
    return lists.unionByName(dealt), degree


def _hashed(node: str, degree: str) -> Column:
    """The part below 0 that holds a neighbour."""
    return (-1 - F.pmod(F.xxhash64(node), F.ceil(F.col(degree) / LIST))).cast("int")


def walks(nodes: DataFrame, edges: DataFrame, p: WalkParams = WalkParams()) -> DataFrame:
    """walk (array of nodes): per_node walks of length nodes from each of nodes (node) over undirected edges (src, tgt).

    Repeated edges and loops count once and not at all. A node without edges has walks of itself alone. Choices come from
    hashes, so every run gives the same walks.
    """
    lists, degree = _lists(edges)
    most = max(1.0, 1 / p.back, 1 / p.away)
    each = nodes.select("node").distinct().select("node", F.explode(F.sequence(F.lit(1), F.lit(p.per_node))).alias("copy"))
    first = each.select(F.xxhash64("node", "copy").alias("id"), F.array("node").alias("walk"), F.col("node").alias("here"), F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("before"), F.lit(None).cast("long").alias("degree_before"))
    of = lambda df: df.join(degree.withColumnRenamed("src", "here"), "here", "left")
    first = settled(of(first), "walks")
    now, alone = first.filter("degree IS NOT NULL"), first.filter("degree IS NULL")
    turn = 0
    for size in range(2, p.length + 1):
        waiting, took, held = now, None, lists
        while True:
            turn += 1
            key = [F.col("id"), F.col("try"), F.lit(p.seed + turn)]
            asked = waiting.select("id", "here", "before", "degree_before", "degree", F.explode(F.sequence(F.lit(1), F.lit(p.tries))).alias("try"))
            asked = asked.withColumn("number", F.floor(_chance(*key, F.lit("which")) * F.col("degree")).cast("int")).withColumn("part", F.floor(F.col("number") / LIST).cast("int"))
            found = asked.join(held.withColumnRenamed("src", "here"), ["here", "part"]).select("id", "try", "before", "degree_before", F.get("tgts", F.col("number") % LIST).alias("next"))
            if size > 2 and p.away != 1:
                found = found.withColumn("part", F.when(F.col("degree_before") <= LIST, 0).otherwise(_hashed("next", "degree_before")))
                found = found.join(held.withColumnRenamed("src", "before"), ["before", "part"], "left").withColumn("common", F.array_contains("tgts", F.col("next"))).drop("tgts")
            else:
                found = found.withColumn("common", F.lit(p.away == 1))
            weight = F.when(F.col("before").isNull(), 1.0).when(F.col("next") == F.col("before"), 1 / p.back).when(F.col("common"), 1.0).otherwise(1 / p.away)
            top = F.when(F.col("before").isNull(), 1.0).otherwise(most)
            taken = found.filter(_chance(*key, F.lit("whether")) < weight / top).groupBy("id").agg(F.min(F.struct("try", "next"))["next"].alias("next"))
            both = settled(waiting.join(taken, "id", "left"), "step")
            went = both.filter("next IS NOT NULL").select("id", F.concat("walk", F.array("next")).alias("walk"), F.col("next").alias("here"), F.col("here").alias("before"), F.col("degree").alias("degree_before"))
            took = went if took is None else took.unionByName(went)
            waiting = both.filter("next IS NULL").drop("next")
            left = waiting.count()
            if not left:
                break
            if left <= FEW:
                ends = waiting.select(F.explode(F.array("here", "before")).alias("src")).filter("src IS NOT NULL").distinct()
                held = settled(held.join(F.broadcast(ends), "src", "left_semi"), "near")
        now = settled(of(took), "walks")
    return now.select("walk").unionByName(alone.select("walk"))


#: Blocks have at most so many numbers of vectors, and so many pairs meet in a task, but at least FEWEST nodes share a block.
BLOCK_VALUES = 1 << 24
TASK_PAIRS = 1 << 21
FEWEST = 1024
#: Pairs whose steps are taken at once, at most, and steps of a node that add up in these.
AT_ONCE = 8192
STEPS = 32


def _pairs(told: DataFrame, p: WalkParams) -> DataFrame:
    """src, tgt, order: nodes of a walk (walk) and those at most 1 to p.window places away, a hash of walk and place says how many."""
    at = told.select("walk", F.posexplode("walk").alias("i", "src")).withColumn("reach", (1 + F.pmod(F.xxhash64("walk", "i", F.lit(p.seed)), F.lit(p.window))).cast("int"))
    first, last = F.greatest(F.col("i") - F.col("reach"), F.lit(0)), F.least(F.col("i") + F.col("reach"), F.size("walk") - 1)
    near = at.select("walk", "i", "src", F.explode(F.sequence(first, last)).alias("j")).filter("i <> j")
    return near.select("src", F.get("walk", F.col("j")).alias("tgt"), F.xxhash64("walk", "i", "j").alias("order"))


def node_vectors(nodes: DataFrame, edges: DataFrame, p: WalkParams = WalkParams()) -> DataFrame:
    """node, vector (array<float> of p.dims): nodes that meet on walks have like vectors.

    Nobody holds more than two blocks of vectors: those of nodes, and what is learned of them as neighbours of others. In a
    turn each block of nodes meets another block of neighbours, with all pairs between the two. Every run gives the same vectors.
    """
    importable(nodes.sparkSession)
    told = settled(walks(nodes, edges, p), "told")
    seen = settled(told.select(F.explode("walk").alias("node")).groupBy("node").agg(F.count("*").alias("n")), "seen")
    many, places = seen.agg(F.count("*"), F.sum("n")).first()
    pairs = (places or 0) * (p.window + 1)  # an estimate that doesn't need them
    n = max(1, math.ceil(many * p.dims / BLOCK_VALUES), min(math.ceil(math.sqrt(pairs / TASK_PAIRS)), many // FEWEST))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(p.seed)), F.lit(n)).cast("int")
    path = shared_path(nodes.sparkSession, "pairs")
    found = _pairs(told, p).withColumn("block", block("src"))
    found.withColumn("turn", F.pmod(block("tgt") - F.col("block"), F.lit(n))).write.partitionBy("turn").parquet(path)
    found = nodes.sparkSession.read.schema(f"src {dict(seen.dtypes)['node']}, tgt {dict(seen.dtypes)['node']}, order long, block int, turn int").parquet(path)
    start = F.transform(F.sequence(F.lit(0), F.lit(p.dims - 1)), lambda d: ((_chance(F.col("node"), d, F.lit(p.seed)) - 0.5) / p.dims).cast("float"))
    own = seen.withColumn("block", block("node"))
    held = own.select(F.lit(0).alias("kind"), "block", "node", "n", start.alias("vector")).unionByName(own.select(F.lit(1).alias("kind"), "block", "node", "n", F.array_repeat(F.lit(0.0).cast("float"), p.dims).alias("vector")))
    none = F.array().cast("array<float>").alias("vector")  # nulls instead of empty arrays take Arrow ten times as long
    ranked = lambda kind, order: kind * F.lit(1 << 61) + F.shiftrightunsigned(order, 3)
    for step in range(p.rounds * n):
        turn, left = step % n, 1 - step / (p.rounds * n)
        task = F.when(F.col("kind") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - turn, F.lit(n))).alias("task")
        meet = held.select(task, "kind", ranked(F.col("kind"), F.xxhash64("node")).alias("order"), "node", F.lit(None).cast(dict(seen.dtypes)["node"]).alias("tgt"), "n", "vector").unionByName(
            found.filter(F.col("turn") == turn).select(F.col("block").alias("task"), F.lit(2).alias("kind"), ranked(F.lit(2), F.col("order")).alias("order"), F.col("src").alias("node"), "tgt", F.lit(None).cast("long").alias("n"), none)
        )
        rows = meet.repartitionById(n, F.col("task")).sortWithinPartitions("order", "node", "tgt")  # one number sorts nearly all
        made = rows.mapInArrow(lambda batches, step=step, left=left: _learned(batches, p, step, left), f"kind int, task int, node {dict(seen.dtypes)['node']}, n long, vector array<float>")
        held = settled(made.select("kind", F.when(F.col("kind") == 0, F.col("task")).otherwise(F.pmod(F.col("task") + turn, F.lit(n))).alias("block"), "node", "n", "vector"), "vectors")
    return held.filter("kind = 0").select("node", "vector")


def _learned(batches: Iterator[pa.RecordBatch], p: WalkParams, step: int, left: float) -> Iterator[pa.RecordBatch]:
    """The vectors of each task (kind 0: of nodes, 1: of neighbours), in the order of tasks, after its pairs (kind 2), which come last."""
    now, held, waiting = None, None, []

    def learn(last: bool) -> None:
        have = sum(map(len, waiting))
        if held and have and (last or have >= 32 * AT_ONCE):
            table = pa.Table.from_batches(waiting)
            cut = have if last else have - have % held.size
            held.learn(table.slice(0, cut))
            waiting[:] = table.slice(cut).to_batches()

    for batch in batches:
        task, kind = batch["task"].to_numpy(), batch["kind"].to_numpy()
        edges = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (kind[1:] != kind[:-1])])
        for a, b in zip(edges, [*edges[1:], len(task)]):
            rows = batch.slice(a, b - a)
            if task[a] != now:
                learn(True)
                if held:
                    yield from held.rows()
                now, held = task[a], _Held(p, int(task[a]), step, left, rows.select(["node", "n", "vector"]).schema)
            if kind[a] < 2:
                held.parts[kind[a]].append(rows.select(["node", "n", "vector"]))
            else:
                waiting.append(rows.select(["node", "tgt"]))
                learn(False)
    learn(True)
    if held:
        yield from held.rows()


class _Held:
    """Two blocks of vectors, and the steps that pairs between them take."""

    def __init__(self, p: WalkParams, task: int, step: int, left: float, none: pa.Schema):
        self.p, self.task, self.left, self.none, self.rng = p, task, left, none, np.random.default_rng([p.seed, step, task])
        self.parts: tuple[list, list] = ([], [])
        self.tables: list = []
        self.vectors: list = []

    @property
    def size(self) -> int:
        """Pairs at once: few where nodes are few, so that each sees what the others learned."""
        self._settle()
        return min(AT_ONCE, max(16, len(self.tables[0]) // 4))

    def _settle(self) -> None:
        """All vectors of the task have come."""
        if not self.tables:
            for part in self.parts:
                t = pa.Table.from_batches(part, None if part else self.none)
                self.vectors.append(t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(t), self.p.dims))
                self.tables.append(t.drop_columns("vector"))
                part.clear()
            self.weight = np.cumsum(self.tables[1]["n"].to_numpy() ** 0.75)

    def learn(self, pairs: pa.Table) -> None:
        self._settle()
        (u, v), rate = self.vectors, self.p.rate * max(self.left, 1e-4)
        src, tgt = (pc.index_in(pairs[c], value_set=t["node"]).to_numpy() for c, t in zip(("node", "tgt"), self.tables))
        for a in range(0, len(src), self.size):
            s, t = src[a : a + self.size], tgt[a : a + self.size]
            drawn = np.searchsorted(self.weight, self.rng.random((len(s), self.p.negatives)) * self.weight[-1], side="right")
            both = np.concatenate([t[:, None], np.minimum(drawn, len(v) - 1)], axis=1)
            x, y = u[s], v[both]
            chance = 1 / (1 + np.exp(-np.clip(np.einsum("md,mkd->mk", x, y), -30, 30)))
            pull = (rate * ((np.arange(both.shape[1]) == 0) - chance)).astype(np.float32)
            pull[:, 1:][both[:, 1:] == t[:, None]] = 0  # the neighbour itself is no counterexample
            _add(u, s, np.einsum("mk,mkd->md", pull, y))
            _add(v, both.ravel(), (pull[:, :, None] * x[:, None, :]).reshape(-1, x.shape[1]))

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        for kind, table in enumerate(self.tables):
            for a in range(0, len(table), 65_536):
                part, x = table.slice(a, 65_536), self.vectors[kind][a : a + 65_536]
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                same = lambda y: pa.array(np.full(len(x), y, np.int32))  # noqa: B023, E731
                whole = lambda c: part[c].combine_chunks()  # noqa: B023, E731
                cols = [same(kind), same(self.task), whole("node"), whole("n"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))]
                yield from pa.table(cols, names=["kind", "task", "node", "n", "vector"]).to_batches()


def _add(x: np.ndarray, at: np.ndarray, steps: np.ndarray) -> None:
    """Adds steps to rows of x; of a row with more than STEPS, as much as STEPS of their mean."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[first, len(at)])
    x[at[first]] += np.add.reduceat(steps[order], first, axis=0) * np.minimum(1, STEPS / n)[:, None].astype(np.float32)

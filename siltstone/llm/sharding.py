"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Where a uniform permutation puts n rows into shards of fixed sizes, the numbers of rows that go from each input partition to
each shard follow a multivariate hypergeometric law. So these numbers are drawn first: the driver draws a line for every group
of partitions, tasks draw the lines of the partitions in a group. Each partition then orders its rows by a keyed hash (a
permutation of its own), and the drawn counts cut this order into the parts for each shard: every row knows its shard without
any exchange, and all shard sizes are exact. After the exchange a second hash orders the rows within their shard. A shard may
be larger than a task can hold, so it is ordered in buckets of the second hash; offsets of buckets come from counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, written


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    seed: int = 20240229
    #: Partitions whose lines of the matrix one task draws.
    group: int = 1024
    #: Rows of a shard that are ordered together, about.
    bucket_rows: int = 100_000
    #: The matrix is broadcast up to so many numbers, and joined by shuffles beyond.
    broadcast_numbers: int = 1 << 21


#: numpy's own sampler takes populations below this.
NUMPY_BOUND = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """The number of good ones among draws without replacement, for populations of any size.

    Beyond numpy's bound by inversion of the cumulative law within 12 standard deviations of the mode, outside of which less
    than 1e-30 lies; the weights come from ratios of neighbours, in double precision.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    if total < NUMPY_BOUND:
        return int(rng.hypergeometric(good, bad, draws))
    share = good / total
    spread = 12 * math.sqrt(max(draws * share * (1 - share) * (total - draws) / (total - 1), 1)) + 50
    mode = (draws + 1) * (good + 1) // (total + 2)
    a, b = max(low, int(mode - spread)), min(high, int(mode + spread))
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(float(bad - draws + 1) + k)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return min(a + int(np.searchsorted(weight, rng.random() * weight[-1], side="right")), b)


def matrix(rng: np.random.Generator, rows: list[int], sizes: list[int]) -> np.ndarray:
    """Counts by row and column, with these sums of rows and columns, drawn as a uniform permutation would give them."""
    left, out = list(sizes), np.zeros((len(rows), len(sizes)), np.int64)
    for i, draws in enumerate(rows):
        others = sum(left)
        for j, size in enumerate(left):
            others -= size
            out[i, j] = hypergeometric(rng, size, others, draws)
            draws -= int(out[i, j])
        left = [a - int(b) for a, b in zip(left, out[i])]
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    """At most one apart, the larger ones first."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def _matrix_table(counts: DataFrame, p: ShardParams) -> tuple[DataFrame, int]:
    """The line of each partition as the ranks at which its shards end, and the number of all rows.

    The driver holds one number for every p.group partitions and shard.
    """
    spark = counts.sparkSession
    groups = counts.groupBy((F.col("p") / p.group).cast("long").alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("parts")).orderBy("g").collect()
    total = sum(r.n for r in groups)
    lines = matrix(np.random.default_rng([p.seed, 0]), [r.n for r in groups], shard_sizes(total, p.shards))
    drawn = spark.createDataFrame([(r.g, x.tolist()) for r, x in zip(groups, lines)], "g long, sizes array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = sorted((x["p"], x["n"]) for x in row["parts"])
                own = matrix(np.random.default_rng([p.seed, 1, row["g"]]), [n for _, n in parts], row["sizes"])
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in parts], pa.int32()), pa.array(np.cumsum(own, axis=1).tolist(), pa.list_(pa.int64()))], ["p", "ends"])

    # A group has p.group partitions at most, so its list has a fixed bound.
    parts = counts.groupBy((F.col("p") / p.group).cast("long").alias("g")).agg(F.collect_list(F.struct("p", "n")).alias("parts"))
    ends = written(parts.join(drawn, "g").mapInArrow(run, "p int, ends array<long>"), "matrix")
    return F.broadcast(ends) if p.shards * sum(r.parts for r in groups) <= p.broadcast_numbers else ends, total


def shard(docs: DataFrame, p: ShardParams = ShardParams(), carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and _row, a struct of the columns in carry (all, if None).

    Law ``rows``: the sizes of any two shards differ by one row at most; slots count from 0 in every shard without gaps.
    grown_shard is null, as it has a meaning only where ids decide. The order is a uniform one given by hashes of the seed and
    the row, so a run over the same files gives the same answer. Equal texts aren't kept together. A null text has size 1
    and checksum 0. Rows of one doc_id, repeated ones and those without doc_id each have a place of their own. An empty
    table gives an empty result. Columns of any name may be carried. Fewer rows than shards leave the last shards empty.
    """
    spark = prepare(docs.sparkSession)
    names = docs.columns if carry is None else carry
    text = F.coalesce(F.col(text_col), F.lit("")).cast("string")
    rows = docs.select(
        F.spark_partition_id().alias("p"), F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *([F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row")] if names else []),
    )
    key = lambda n: F.xxhash64(F.lit(p.seed + n), "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("first", key(0)).sortWithinPartitions("first").drop("first")
    # Written as it is drawn from: a task that runs again can't change ranks or counts. The place in a task is the id's lower part.
    ranked = ranked.withColumn("r", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    base = written(ranked, "ranked")
    ends, total = _matrix_table(base.groupBy("p").agg(F.count("*").alias("n")), p)
    buckets = max(1, -(-total // (p.shards * p.bucket_rows)))
    at = F.size(F.filter("ends", lambda e: e <= F.col("r"))).alias("shard")
    placed = base.join(ends, "p").withColumn("shard", at).drop("ends")
    placed = placed.withColumn("second", key(1)).withColumn("bucket", F.pmod(F.shiftrightunsigned("second", 32), F.lit(buckets)).cast("int"))
    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = Window.partitionBy("shard", "bucket").orderBy("second", "p", "r")
    out = placed.withColumn("number", F.row_number().over(own)).join(starts, ["shard", "bucket"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("start") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["_row"] if names else [])
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder for each shard, with the carried columns and the slot; files of one shard are in the order of slots."""
    last = sharded.select("shard", "slot", "_row")
    parts = max(1, int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    last.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

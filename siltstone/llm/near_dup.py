"""Near-duplicate documents by one-permutation MinHash.

A document's set is its distinct 5-word shingles (lower-cased A-Z), as 64-bit hashes. One permutation serves all bins: the
top bits of a hash name its bin, and each bin keeps its least hash. An empty bin borrows from a full one chosen by a fixed
pseudo-random order of its own (optimal densification), so that all signatures are full and comparable bin by bin. Bins are
grouped in bands; documents that agree in a band share a bucket.

Documents with equal sets, confirmed by a 128-bit cryptographic digest of the whole set, are first brought together under
their smallest doc_id. In each bucket the smallest of these is a
hub, and only edges from the hub to the others become candidates: as many as the bucket has members, never all pairs. Links
are confirmed on the full sets, and linked documents are joined into components.

A bucket that then still holds several components is taken up once more, so that no link is lost to the choice of hub. Its
members outside its largest component are compared, by their signatures only, with all members of other components: both
sides travel in blocks, a block of one against a block of the other in one numpy comparison. Only pairs whose signatures
agree in nearly enough bins are given out, and they are confirmed on the full sets too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import prepare, texts, written


@dataclass(frozen=True)
class NearDupParams:
    shingle: int = 5
    #: Linked if percent * union <= 100 * intersection.
    percent: int = 85
    bands: int = 32
    #: Bins of a band; bands * rows must be a power of two.
    rows: int = 8
    #: Members of a block, on average, where an unresolved bucket is taken up again.
    block: int = 128
    #: Percent of equal bins from which a pair is confirmed then; a pair at the threshold of 85 has fewer with probability 9e-6.
    sketch_percent: int = 75
    #: Tasks over which the rows of one set are dealt.
    salts: int = 32
    #: Up to so many documents in shared buckets, their ids (16 MB) are broadcast to pick out their texts; beyond, both are shuffled.
    broadcast_ids: int = 2_000_000
    #: Pairs of one hub that are confirmed in one task, about.
    hub_pairs: int = 256


def _probes(bins: int) -> np.ndarray:
    """For each bin, all bins in a pseudo-random order of its own."""
    rng = np.random.Generator(np.random.PCG64(11))
    return np.stack([rng.permutation(bins) for _ in range(bins)])


_probe_tables: dict[int, np.ndarray] = {}


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one after the other, and their bounds."""
    low = at.LOWER[buf]
    starts, ends, first = at.words(low, offs)
    h = at.span_hashes(low, starts, ends)
    n = np.diff(first)
    full = at.starts_within(first, k)
    codes, rows = at.ngrams(h, k)[full], np.searchsorted(first, full, side="right") - 1
    for m in range(1, k):  # fewer words: the whole sequence is one shingle
        own = np.flatnonzero(n == m)
        if len(own):
            short = at.mix(at.ngrams(h, m)[first[own]] + np.uint64(m))
            codes, rows = np.concatenate([codes, short]), np.concatenate([rows, own])
    order = np.lexsort((codes, rows)) if (n < k).any() else None
    if order is not None:
        codes, rows = codes[order], rows[order]
    bounds = np.searchsorted(rows, np.arange(len(offs)))
    out, sizes = [], np.zeros(len(offs) - 1, np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if a < b:
            own = np.unique(codes[a:b])
            out.append(own)
            sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def signatures(codes: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signatures of non-empty sets, made full by optimal densification."""
    if bins not in _probe_tables:
        _probe_tables[bins] = _probes(bins)
    probes = _probe_tables[bins]
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    row, bin_ = at.row_of(bounds), (codes >> shift).astype(np.int64)
    new = np.ones(len(codes), bool)
    new[1:] = (row[1:] != row[:-1]) | (bin_[1:] != bin_[:-1])
    sig = np.zeros((len(bounds) - 1, bins), np.uint64)
    full = np.zeros(sig.shape, bool)
    sig[row[new], bin_[new]], full[row[new], bin_[new]] = codes[new], True
    r, b = np.nonzero(~full & full.any(1)[:, None])
    for attempt in range(bins):
        if not len(r):
            break
        other = probes[b, attempt]
        ok = full[r, other]
        sig[r[ok], b[ok]] = sig[r[ok], other[ok]]
        r, b = r[~ok], b[~ok]
    return sig


def _sketches(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = at.utf8(batch.column("text"))
            for i, j in at.blocks(offs):
                codes, bounds = shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p.shingle)
                sig = signatures(codes, bounds, p.bands * p.rows).reshape(j - i, p.bands, p.rows)
                n = np.diff(bounds)
                bucket = np.zeros(sig.shape[:2], np.uint64) + np.arange(p.bands, dtype=np.uint64)
                for k in range(p.rows):
                    bucket = at.mix(bucket + sig[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                body = memoryview(codes.astype("<u8").tobytes())
                digest = [hashlib.blake2b(body[8 * x : 8 * y], digest_size=16).digest() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                low = np.ascontiguousarray((sig.reshape(j - i, -1) & np.uint64(255)).astype(np.uint8))
                offsets = pa.array(np.arange(j - i + 1, dtype=np.int32) * p.bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bucket.reshape(-1).view(np.int64))), pa.array([x.tobytes() for x in low], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "buckets", "sketch"],
                )

    return run


def _sets(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = at.utf8(batch.column("text"))
            for i, j in at.blocks(offs):
                codes, bounds = shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p.shingle)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(codes.view(np.int64)))], ["doc_id", "codes"])

    return run


def _with_least(edges: DataFrame, least: DataFrame, salts: int) -> DataFrame:
    """edges (a, b, salt) joined with least (a, m, _s): a hub's edges are dealt over several tasks, and its line is sent to each that has any."""
    sent = least.withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda k: F.bit_get("_s", k) == 1))).drop("_s")
    return edges.join(sent, ["a", "salt"]).drop("salt")


def components(edges: DataFrame, salts: int = 16) -> DataFrame:
    """node, component (its smallest reachable node) for all ends of edges (a, b), by alternating large and small stars.

    Least neighbours are combined before they are shuffled, and joined back to salts parts of each node's edges (fewer, if it
    has fewer); so no more lines are sent than there are edges.
    """
    dealt = lambda e: e.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    parts = F.bit_or(F.expr("shiftleft(1, salt)")).alias("_s")
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    mark = None
    while True:
        both = dealt(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), parts)
        large = _with_least(both, least, salts).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        large = dealt(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"), parts)
        small = _with_least(large, least, salts)
        edges = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    # A hub's pairs are dealt over several tasks, and its set is sent to each.
    heavy = pairs.groupBy("b").agg(F.ceil(F.count("*") / p.hub_pairs).cast("int").alias("parts")).filter("parts > 1")
    heavy = written(heavy, "hubs")
    heavy = F.broadcast(heavy) if heavy.count() <= p.broadcast_ids else heavy
    pairs = pairs.join(heavy, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    hubs = sets.select(F.col("doc_id").alias("b"), F.col("codes").alias("y")).join(heavy, "b", "left")
    hubs = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("codes").alias("x")), "a").join(hubs, ["b", "part"])
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.filter(100 * F.col("common") >= p.percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b").distinct()


def _compare(p: NearDupParams):
    """Pairs (a, b) of a block of stragglers and a block of members that lie in different components and have like sketches."""
    bins = p.bands * p.rows

    def side(rows: pa.Scalar) -> tuple[np.ndarray, ...]:
        flat = rows.values
        raw, offs = at.utf8(flat.field("sketch"))
        buckets = flat.field("buckets").flatten().to_numpy().reshape(-1, p.bands)
        return flat.field("doc_id").to_numpy(), flat.field("component").to_numpy(), flat.field("n_shingles").to_numpy(), raw.reshape(-1, bins), buckets, flat.field("few").to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, x, y in zip(batch.column("bucket").to_pylist(), batch.column("few"), batch.column("all")):
                id_x, comp_x, n_x, sk_x, in_x, _ = side(x)
                id_y, comp_y, n_y, sk_y, in_y, few_y = side(y)
                band = int(np.flatnonzero(in_x[0] == bucket)[0])
                for k in range(len(id_x)):
                    near = (comp_y != comp_x[k]) & ~(few_y & (id_y < id_x[k])) & (100 * np.minimum(n_y, n_x[k]) >= p.percent * np.maximum(n_y, n_x[k]))
                    if near.any():
                        hit = np.flatnonzero(near)
                        hit = hit[100 * (sk_y[hit] == sk_x[k]).sum(1) >= p.sketch_percent * bins]
                        hit = hit[~(in_y[hit, :band] == in_x[k, :band]).any(1)]  # given out in the first bucket they share
                        if len(hit):
                            one = np.full(len(hit), id_x[k])
                            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, id_y[hit])), pa.array(np.minimum(one, id_y[hit]))], ["a", "b"])

    return run


def links(reps: DataFrame, docs: DataFrame, p: NearDupParams) -> DataFrame:
    """node, component for all documents of reps (doc_id, n_shingles, buckets, sketch) that are linked to another. docs: doc_id, text."""
    rows = reps.select("doc_id", "n_shingles", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    left = written(rows.join(shared.select("bucket", "hub"), "bucket"), "buckets")
    ids = written(left.select("doc_id").distinct(), "ids")
    n_ids = ids.count()
    ids = F.broadcast(ids) if n_ids <= p.broadcast_ids else ids
    sets = written(docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets(p), "doc_id long, codes array<long>"), "sets")

    sizes = left.select(F.col("doc_id").alias("hub"), F.col("n_shingles").alias("n_hub")).distinct()
    alike = 100 * F.least("n_hub", "n_shingles") >= p.percent * F.greatest("n_hub", "n_shingles")
    pairs = left.select("hub", "doc_id", "n_shingles").filter("hub < doc_id").distinct().join(sizes, "hub").filter(alike)
    edges = written(_confirmed(written(pairs.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")), "pairs"), sets, p), "links")
    found = components(edges)

    # Buckets whose members lie in several components; the members outside the largest one meet all others.
    placed = left.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = written(placed.select("bucket", "doc_id", "n_shingles", "component"), "placed")
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("several"))
    mixed = mixed.filter("several > 1").select("bucket", "main", F.ceil(F.col("total") / p.block).alias("of_all"), F.ceil((F.col("total") - F.col("most")) / p.block).alias("of_few"))
    member = written(placed.join(mixed, "bucket").join(reps.select("doc_id", "sketch", "buckets"), "doc_id"), "unresolved")
    one = F.collect_list(F.struct("doc_id", "component", "n_shingles", "sketch", "buckets", (F.col("component") != F.col("main")).alias("few")))
    number = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    # The blocks of a bucket's few are dealt over up to so many tasks, and all of its blocks are sent to each of these.
    every = member.groupBy("bucket", "of_few", number("of_all").alias("block")).agg(one.alias("all"))
    every = every.withColumn("deal", F.explode(F.sequence(F.lit(0), F.least("of_few", F.lit(p.salts)).cast("int") - 1))).select("bucket", "deal", "all")
    few = member.filter("component <> main").groupBy("bucket", number("of_few").alias("block")).agg(one.alias("few")).withColumn("deal", F.pmod("block", F.lit(p.salts)).cast("int")).drop("block")
    more = few.join(every, ["bucket", "deal"]).select("bucket", "few", "all").mapInArrow(_compare(p), "a long, b long").distinct()
    more = written(_confirmed(written(more, "candidates"), sets, p), "links")
    return components(edges.unionByName(more)) if not more.isEmpty() else found


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    component_id is the smallest doc_id reachable by links, the own one if there are none; kept: doc_id is that. A text with
    fewer words than a shingle has, has its whole sequence as one shingle; null and empty texts have none and are linked with
    nothing. Rows of one doc_id are one document: they share a component, in which any of their texts may be linked. A row
    without doc_id is linked with nothing, has a null component_id and is kept. An empty table gives an empty result. Other
    columns are not looked at.
    """
    prepare(docs.sparkSession)
    own = texts(docs, id_col, text_col)
    rows = written(own.mapInArrow(_sketches(p), "doc_id long, n_shingles long, digest binary, buckets array<long>, sketch binary"), "sketches")
    some = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    keys = ["digest", "n_shingles"]
    classes = some.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    # A class may hold a large part of all rows, so its rows are dealt over several tasks, and its line is sent to each.
    classes = classes.select(*keys, "rep", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))).alias("salt"))
    members = some.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(p.salts)).cast("int")).join(classes, [*keys, "salt"], "left")
    members = members.withColumn("rep", F.coalesce("rep", "doc_id"))
    equal = members.filter("doc_id <> rep").select(F.col("doc_id").alias("node"), "rep").distinct()
    reps = members.filter("doc_id = rep").select("doc_id", "n_shingles", "buckets", "sketch")
    found = links(reps, own.filter("doc_id IS NOT NULL"), p)
    copies = equal.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))
    # Rows of one doc_id with different texts can bring several components together; else this changes nothing.
    several = copies.unionByName(found).groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("other"))
    joint = written(several, "components")
    if not joint.filter("component <> other").isEmpty():
        joint = components(joint.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(joint.select(F.col("node").alias("a"), F.col("other").alias("b"))))
    out = rows.select("doc_id", "n_shingles").join(joint.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

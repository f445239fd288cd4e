"""Document fingerprints: digests of improbable features in chained Bloom filters.

Every window of 12 bytes is a possible feature. Its entropy follows from that of the window before by the counts of the byte
that leaves and of the byte that comes; those counts are found for all places at once. Windows whose entropy lies far from
that of common text are rare and rank first. In every run of 16 windows the rarest, leftmost one gets a point; windows with
enough points are the selected features, in texts of any size. A text with fewer windows than a run is one run, whose rarest
window is its feature; one without a window or feature is its own feature. Features are put, in order, into Bloom filters of 2,048 bits with five bits a feature;
a full filter is followed by the next. Two digests are compared by the bits that their filters share beyond chance, as a
share of what they could.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import partitions, prepare, texts, written

FILTER_BITS = 2048
SUB_HASHES = 5


@dataclass(frozen=True)
class FingerprintParams:
    window: int = 12
    #: Windows of a run; points that a feature needs.
    run: int = 16
    points: int = 6
    #: Entropy (bits) of common text windows, and below which a window is no feature.
    common_entropy: float = 3.5
    least_entropy: float = 1.0
    features_per_filter: int = 224
    #: Share of the room between chance and full overlap that counts as nothing.
    cutoff: float = 0.15


def _entropies(buf: np.ndarray, offs: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Entropy, in 1/65536 bits, of every window of each row, and the rows' bounds among them."""
    g = np.zeros(w + 1, np.int64)
    g[1:] = np.rint(np.arange(1, w + 1) * np.log2(np.arange(1, w + 1)) * 65536)
    step = np.diff(g)  # from c to c + 1
    ahead, behind = np.zeros(len(buf), np.uint8), np.zeros(len(buf), np.uint8)
    same = np.empty(len(buf), bool)
    for d in range(1, min(w, len(buf))):
        s = np.equal(buf[d:], buf[:-d], out=same[: len(buf) - d]).view(np.uint8)
        ahead[:-d] += s
        behind[d:] += s
    sizes = np.maximum(np.diff(offs) - w + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return np.zeros(0, np.int64), bounds
    counts = np.zeros((len(rows), 256), np.int64)
    first = buf[offs[rows][:, None] + np.arange(w)]
    np.add.at(counts, (np.arange(len(rows))[:, None], first), 1)
    change = np.zeros(bounds[-1], np.int64)
    place = at.starts_within(offs, w)
    inner = np.ones(len(place), bool)
    inner[bounds[rows]] = False
    before = place[inner] - 1
    change[inner] = step[behind[before + w]] - step[ahead[before]]
    total = np.cumsum(change)
    start = g[counts].sum(1)
    total += np.repeat(start - total[bounds[rows]], sizes[rows])
    return w * np.int64(np.rint(np.log2(w) * 65536)) - total, bounds  # w times the entropy


def features(buf: np.ndarray, offs: np.ndarray, p: FingerprintParams) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the selected features of all rows, in order, and their bounds."""
    entropy, bounds = _entropies(buf, offs, p.window)
    bits = entropy // p.window
    far = np.abs(bits - round(p.common_entropy * 65536)) >> 10
    rank = np.where(bits < round(p.least_entropy * 65536), np.int64(1 << 20), (1 << 19) - far)  # the rarest first
    key = (rank << 40) | np.arange(len(rank))
    low, have = key, 1
    while have < p.run and len(low):
        step = min(have, p.run - have)
        low, have = np.minimum(low[: max(len(low) - step, 0)], low[step:]), have + step
    full = at.starts_within(bounds, p.run)
    mask = (1 << 40) - 1
    chosen = np.bincount(low[full] & mask, minlength=len(rank)) >= p.points if len(full) else np.zeros(len(rank), bool)
    n = np.diff(bounds)
    short = np.flatnonzero((n > 0) & (n < p.run))
    if len(short):  # fewer windows than a run: their rarest
        edges = np.stack([bounds[short], bounds[short + 1]], 1).reshape(-1)
        padded = np.append(key, np.iinfo(np.int64).max)
        chosen[np.minimum.reduceat(padded, edges)[::2] & mask] = True
    chosen &= rank < 1 << 20
    picked = np.flatnonzero(chosen)
    places = at.starts_within(offs, p.window)[picked]
    codes = at.span_hashes(buf, places, places + p.window)
    rows = np.searchsorted(bounds, picked, side="right") - 1
    size = np.diff(offs)
    bare = np.flatnonzero((np.bincount(rows, minlength=len(size)) == 0) & (size > 0))
    codes = np.concatenate([codes, at.span_hashes(buf, offs[bare], offs[bare + 1])])  # texts without a feature are one themselves
    rows = np.concatenate([rows, bare])
    order = np.argsort(rows, kind="stable")
    codes, counts = codes[order], np.bincount(rows, minlength=len(size))
    return codes, np.concatenate([[0], np.cumsum(counts)])


def filters(codes: np.ndarray, bounds: np.ndarray, p: FingerprintParams) -> tuple[np.ndarray, np.ndarray]:
    """Chained Bloom filters of all rows, 256 bytes each, and their bounds."""
    n = np.diff(bounds)
    chain = np.concatenate([[0], np.cumsum(-(-n // p.features_per_filter))])
    row = np.repeat(np.arange(len(n)), n)
    own = chain[row] + (np.arange(len(codes)) - bounds[row]) // p.features_per_filter
    bits = np.zeros((int(chain[-1]), FILTER_BITS), bool)
    for k in range(SUB_HASHES):
        bits[own, ((codes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1), chain


def likeness(a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray, p: FingerprintParams) -> np.ndarray:
    """Likeness of the digests of row i of a and row i of b, 0 to 1: equal digests 1, an empty one and another 0."""
    out = np.zeros(len(a_bounds) - 1)
    set_a, set_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    swap = np.diff(a_bounds) > np.diff(b_bounds)  # the digest with fewer filters is looked for in the other
    for flip in (False, True):
        x, xb, xs, y, yb, ys = (b, b_bounds, set_b, a, a_bounds, set_a) if flip else (a, a_bounds, set_a, b, b_bounds, set_b)
        rows = np.flatnonzero((swap == flip) & (np.diff(xb) > 0) & (np.diff(yb) > 0))
        work = np.cumsum(np.diff(xb)[rows] * np.diff(yb)[rows])
        for k in np.split(rows, np.searchsorted(work, np.arange(1 << 15, work[-1], 1 << 15))) if len(rows) else ():
            if not len(k):
                continue
            nx, ny = np.diff(xb)[k], np.diff(yb)[k]
            fx = at.gather(np.arange(len(x)), xb[k], nx)  # every filter of x
            per = np.repeat(ny, nx)
            f = np.repeat(fx, per)
            g = at.gather(np.arange(len(y)), np.repeat(yb[k], nx), per)
            common = np.empty(len(f), np.int64)
            for i in range(0, len(f), 1 << 15):
                common[i : i + (1 << 15)] = np.bitwise_count(x[f[i : i + (1 << 15)]] & y[g[i : i + (1 << 15)]]).sum(1, dtype=np.int64)
            most = np.minimum(xs[f], ys[g])
            chance = xs[f] * ys[g] / FILTER_BITS
            floor = chance + p.cutoff * (most - chance)
            score = np.clip((common - floor) / np.maximum(most - floor, 1e-9), 0, 1)
            best = np.maximum.reduceat(score, np.cumsum(per) - per)
            out[k] = np.add.reduceat(best, np.cumsum(nx) - nx) / nx
    for i in np.flatnonzero(np.diff(a_bounds) == np.diff(b_bounds)):
        if np.array_equal(a[a_bounds[i] : a_bounds[i + 1]], b[b_bounds[i] : b_bounds[i + 1]]):
            out[i] = 1.0
    return out


def digests(many: list[str], p: FingerprintParams) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Filters, their bounds, and the digest of each text: the bytes of its filters."""
    raw = [x.encode() for x in many]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])
    made, bounds = filters(*features(buf, offs, p), p)
    return made, bounds, [made[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_COLUMNS = [x.split()[0] for x in RESULT.split(", ")]


def _rows(ids: list, own: list[str], following: list[str], p: FingerprintParams, in_order: bool) -> list[pa.Array]:
    """Result columns of texts and those that follow them; in_order: each text but the last is followed by the next."""
    n = [len(x) for x in own]
    edited = [x[: k - k // 4] + y[: k // 4] for x, y, k in zip(own, following, n)]
    m = len(own)
    made, bounds, printed = digests(own + (following[-1:] if in_order else following) + edited, p)
    last = len(printed) - m
    a, e = bounds[: m + 1], bounds[last:]
    nxt = bounds[1 : m + 2] if in_order else bounds[m : 2 * m + 1]
    return [
        pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array([hashlib.sha256(x.encode()).digest() for x in edited], pa.binary()), pa.array(printed[:m], pa.binary()), pa.array(printed[last:], pa.binary()),
        pa.array(likeness(made, a, made, e, p)), pa.array(likeness(made, a, made, nxt, p)),
    ]


def fingerprints(docs: DataFrame, p: FingerprintParams = FingerprintParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text is the text with its last quarter of characters replaced by the first as many of the next document, in
    ascending doc_id order; after the last comes the first. near_edited and near_next: likeness of the fingerprint to that of
    the edited text and of the next document. A null text counts as empty; fingerprints are hexadecimal, that of an empty text is empty, like only
    itself. Rows of one doc_id follow each other by a hash of their text; null ids come first. A single document is followed
    by itself. An empty table gives an empty result. Other columns are not looked at.
    """
    spark = prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def edge(kind: int, doc_id, text: str) -> pa.RecordBatch:
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *empty, pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([text])], [*_COLUMNS, "kind", "part", "text"])

        held: tuple | None = None  # the document whose next one isn't known yet
        for batch in batches:
            ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, j in at.blocks(at.utf8(column)[1], 1 << 17):
                names, own = ids[i:j], column.slice(i, j - i).to_pylist()
                if held is None:
                    yield edge(1, names[0], own[0])
                else:
                    names, own = [held[0], *names], [held[1], *own]
                held = (names[-1], own[-1])
                if len(own) > 1:
                    found = _rows(names[:-1], own[:-1], own[1:], p, True)
                    m = len(own) - 1
                    yield pa.RecordBatch.from_arrays([*found, pa.array([0] * m, pa.int32()), pa.array([part] * m, pa.int32()), pa.nulls(m, pa.string())], [*_COLUMNS, "kind", "part", "text"])
        if held is not None:
            yield edge(2, *held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(_rows(one.column("doc_id").to_pylist(), one.column("text").to_pylist(), one.column("following").to_pylist(), p, False), _COLUMNS)

    order = ["doc_id", F.xxhash64("text")]
    dealt = texts(docs, id_col, text_col).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    made = written(dealt.mapInArrow(run, RESULT + ", kind int, part int, text string"), "fingerprints")
    # Two rows a range stand at its edges; the last document of one is followed by the first of the next range with rows.
    firsts = made.filter("kind = 1").select("part", F.col("text").alias("following"))
    turn = Window.orderBy("part")
    after = firsts.select("part", F.lead("part").over(turn).alias("then")).withColumn("least", F.min("part").over(Window.partitionBy()))
    after = after.select("part", F.coalesce("then", "least").alias("then"))
    lasts = made.filter("kind = 2").select("doc_id", "text", "part").join(after, "part")
    paired = lasts.join(firsts.withColumnRenamed("part", "then"), "then").select("doc_id", "text", "following")
    found = made.filter("kind = 0").select(*_COLUMNS).unionByName(paired.mapInArrow(join, RESULT))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})

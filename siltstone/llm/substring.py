"""Substring deduplication by super-k-mer partitioning.

A window is a fixed number of consecutive words of one document. Its minimiser is the 3-word sequence in it with the
smallest hash, the leftmost of equals. Consecutive windows that share one minimiser travel together, as one packed string of
words (a super-k-mer), to the bucket of that minimiser; so all copies of a window meet in one bucket. There the windows are
sorted by a 64-bit hash, windows of one hash are compared word for word, and the smallest document of each sequence is
found. The flagged positions go back to their documents, where the covered words are removed.

A map task packs each distinct super-k-mer once for many documents (compressed). Of one that very many of its documents have
it sends the least and largest id only, so that a passage that a third of all documents share doesn't gather in one bucket;
the bucket answers with the least id of each of its windows, and a second pass over the texts, with these answers at hand,
flags the copies where they are. The number of buckets follows the bytes of text; nothing is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at
from .shared import partitions, prepare, texts, written


@dataclass(frozen=True)
class SubstringParams:
    window: int = 13
    #: Words of a minimiser.
    minimiser: int = 3
    #: Bytes of text for which a bucket is made; its super-k-mers have about three times as many. Many buckets a task even out.
    bucket_bytes: int = 3 << 19
    #: Bytes of packed strings that a map task gathers before it writes them to the buckets.
    flush_bytes: int = 48 << 20
    #: Copies of one super-k-mer in what a map task gathers from which they aren't sent.
    hot: int = 64
    #: Answers that go to all tasks; more are joined with the copies, dealt over so many parts each, of which a filter of 2 ^ filter_bits bits passes few others.
    answers: int = 100_000
    salts: int = 16
    filter_bits: int = 26
    #: Up to so many doc_ids of several rows (16 MB) are broadcast to mark their rows; beyond, both are shuffled.
    broadcast_ids: int = 2_000_000


BUCKET_SCHEMA = "bucket long, payload binary"
FLAG_SCHEMA = "doc_id long, version long, at int, n int"
#: What a bucket gives: flags, and, with a digest, the least id of windows at to at + n - 1 of a super-k-mer.
FOUND_SCHEMA = FLAG_SCHEMA + ", code long, digest binary, least long"


def _sliding_leftmost(key: np.ndarray, width: int) -> np.ndarray:
    """For each start, the position of the leftmost minimum among width entries."""
    val, pos, have = key, np.arange(len(key)), 1
    while have < width:
        step = min(have, width - have)
        m = len(val) - step
        right = val[step:] < val[:m]
        val, pos, have = np.where(right, val[step:], val[:m]), np.where(right, pos[step:], pos[:m]), have + step
    return pos


def _canonical(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words, each followed by one space, as bytes, with their starts and ends there."""
    sizes = ends - starts
    new = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.full(int(new[-1] + sizes[-1] + 1) if len(new) else 0, 32, np.uint8)
    if len(new):
        total = int(sizes.sum())
        before = np.cumsum(sizes) - sizes
        inside = np.arange(total)
        out[inside + np.repeat(new - before, sizes)] = buf[inside + np.repeat(starts - before, sizes)]
    return out.tobytes(), new, new + sizes


def _codes(windows: np.ndarray, first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each super-k-mer, by its first and last window's hashes and its bytes."""
    return at.mix(at.mix(windows[first]) + windows[last] * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))


def _super_kmers(buf: np.ndarray, offs: np.ndarray, p: SubstringParams):
    """The rows' words as bytes, and of each super-k-mer its start and end there, minimiser hash, code, row, and word position; None without any."""
    k, m = p.window, p.minimiser
    starts, ends, bounds = at.words(buf, offs)
    wins = at.starts_within(bounds, k)
    if not len(wins):
        return None
    h = at.span_hashes(buf, starts, ends)
    g = at.ngrams(h, m)
    low = _sliding_leftmost(g, k - m + 1)[wins]
    row = np.searchsorted(bounds, wins, side="right") - 1
    cut = np.ones(len(wins), bool)
    cut[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(wins)) - 1
    text, cs, ce = _canonical(buf, starts, ends)
    a, b, at_row = cs[wins[first]], ce[wins[last] + k - 1], row[first]
    return text, a, b, at.mix(g[low[first]]), (at.ngrams(h, k), wins[first], wins[last]), at_row, (wins[first] - bounds[at_row]).astype(np.int32)


class _Packer:
    """Super-k-mers of a task by bucket: each distinct string once, with the rows and word positions it occurs at."""

    def __init__(self, p: SubstringParams, n_buckets: int):
        self.p, self.n, self.bytes = p, n_buckets, 0
        self.found: dict[bytes, list[int]] = {}
        self.bucket: list[int] = []
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, versions: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> None:
        cut = _super_kmers(buf, offs, self.p)
        if cut is None:
            return
        text, a, b, minimisers, _, at_row, places = cut
        a, b = a.tolist(), b.tolist()
        buckets = (minimisers % np.uint64(self.n)).astype(np.int64).tolist()
        numbers = np.empty(len(a), np.int64)
        found, known = self.found, self.bucket
        for i, (x, y) in enumerate(zip(a, b)):
            s = text[x:y]
            number = found.get(s)
            if number is None:
                number = found[s] = len(known)
                known.append(buckets[i])
                self.bytes += y - x + 100
            numbers[i] = number
        self.rows.append((numbers, ids[at_row], versions[at_row], places))
        self.bytes += 28 * len(numbers)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        numbers, ids, versions, pos = (np.concatenate(x) for x in zip(*self.rows))
        strings, bucket = list(self.found), np.array(self.bucket, np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.argsort(place[numbers], kind="stable")
        where, ids, versions, pos = place[numbers][by], ids[by], versions[by], pos[by]
        copies = np.bincount(where, minlength=len(order))
        if (copies > self.p.hot).any():  # of these, two lines without a place
            first = np.cumsum(copies) - copies
            many = np.flatnonzero(copies > self.p.hot)
            least, most = np.minimum.reduceat(ids, first)[many], np.maximum.reduceat(ids, first)[many]
            keep = copies[where] <= self.p.hot
            keep[first[many]] = keep[first[many] + 1] = True
            ids[first[many]], ids[first[many] + 1] = least, most
            versions[first[many]] = versions[first[many] + 1] = 0
            pos[first[many]] = pos[first[many] + 1] = -1
            where, ids, versions, pos = where[keep], ids[keep], versions[keep], pos[keep]
        edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
        pack, out_b, out_p = zstandard.ZstdCompressor(level=6), [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            i, j = np.searchsorted(where, (lo, hi))
            own = [strings[x] for x in order[lo:hi]]
            body = b"".join((
                np.array([hi - lo, j - i], np.int64).tobytes(), np.array([len(x) for x in own], np.int32).tobytes(), np.diff(where[i:j], prepend=lo).astype(np.int32).tobytes(),
                ids[i:j].tobytes(), versions[i:j].tobytes(), pos[i:j].tobytes(), b"".join(own),
            ))
            out_b.append(int(bucket[order[lo]]))
            out_p.append(pack.compress(body))
            if len(out_b) == 64:
                yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array(out_p, pa.binary())], ["bucket", "payload"])
                out_b, out_p = [], []
        if out_b:
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array(out_p, pa.binary())], ["bucket", "payload"])
        self.__init__(self.p, self.n)


def _unpack(payload: bytes):
    body = zstandard.ZstdDecompressor().decompress(payload)
    s, o = np.frombuffer(body, np.int64, 2)
    out, here = [], 16
    for n, kind in ((s, np.int32), (o, np.int32), (o, np.int64), (o, np.int64), (o, np.int32)):
        out.append(np.frombuffer(body, kind, n, here))
        here += n * np.dtype(kind).itemsize
    return (*out, body[here:])


def _smallest(text: bytes, codes: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window text[a:b] with hash code: the smallest of least over all windows of the same words."""
    order = np.argsort(codes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = codes[order][1:] != codes[order][:-1]
    group = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    sizes = np.diff(np.append(group, len(order)))
    out[order] = np.repeat(np.minimum.reduceat(least[order], group), sizes) if len(group) else 0
    for lo, n in zip(group[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        mine = order[lo : lo + n].tolist()
        head = text[a[mine[0]] : b[mine[0]]]
        if any(text[a[i] : b[i]] != head for i in mine[1:]):  # one hash, several word sequences
            same = defaultdict(list)
            for i in mine:
                same[text[a[i] : b[i]]].append(i)
            for own in same.values():
                out[own] = least[own].min()
    return out


def _flags(payloads: list[bytes], p: SubstringParams) -> pa.Table:
    """Runs of windows of a bucket that also start in a document with a smaller id, and the answers for super-k-mers whose copies weren't sent."""
    lens, which, ids, versions, pos, bodies, base = [], [], [], [], [], [], 0
    for x in payloads:
        n, w, i, v, q, body = _unpack(x)
        lens.append(n), which.append(np.cumsum(w) + base), ids.append(i), versions.append(v), pos.append(q), bodies.append(body)
        base += len(n)
    lens, which, ids, versions, pos = (np.concatenate(x) for x in (lens, which, ids, versions, pos))
    text = b"".join(bodies)
    buf = np.frombuffer(text, np.uint8)
    offs = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
    by = np.argsort(which, kind="stable")
    which, ids, versions, pos = which[by], ids[by], versions[by], pos[by]
    edges = np.searchsorted(which, np.arange(len(lens)))
    least, most = np.minimum.reduceat(ids, edges), np.maximum.reduceat(ids, edges)
    codes, a, b, bounds = [], [], [], [0]
    for i, j in at.blocks(offs):
        sub = offs[i : j + 1] - offs[i]
        starts, ends, first = at.words(buf[offs[i] : offs[j]], sub)
        wins = at.starts_within(first, p.window)
        codes.append(at.ngrams(at.span_hashes(buf[offs[i] : offs[j]], starts, ends), p.window)[wins])
        a.append(starts[wins] + offs[i])
        b.append(ends[wins + p.window - 1] + offs[i])
        bounds.extend((bounds[-1] + np.cumsum(np.diff(first) - p.window + 1)).tolist())
    codes, a, b, bounds = np.concatenate(codes), np.concatenate(a), np.concatenate(b), np.array(bounds)
    row = at.row_of(bounds)
    low = _smallest(text, codes, a, b, least[row])
    some = np.zeros(len(lens), bool)
    some[row[low < most[row]]] = True  # strings with a window that an earlier document has
    code = _codes(codes, bounds[:-1], bounds[1:] - 1, lens)
    unsent = np.isin(code, code[which[pos < 0]])
    answers = _answers(text, offs, code, bounds, low, np.flatnonzero(unsent))
    some[unsent] = False
    use = np.flatnonzero(some[which])
    n = np.diff(bounds)[which[use]]
    window = at.gather(np.arange(len(low)), bounds[which[use]], n)
    occurrence = np.repeat(use, n)
    hit = low[window] < ids[occurrence]
    window, occurrence = window[hit], occurrence[hit]
    new = np.ones(len(window), bool)
    new[1:] = (occurrence[1:] != occurrence[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    o = occurrence[first]
    start = pos[o] + window[first] - bounds[which[o]]
    size = np.diff(np.append(first, len(window)))
    none = [pa.nulls(len(o), pa.int64()), pa.nulls(len(o), pa.binary()), pa.nulls(len(o), pa.int64())]
    return pa.concat_tables([pa.table([pa.array(ids[o]), pa.array(versions[o]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), *none], _FOUND), answers])


_FOUND = [x.split()[0] for x in FOUND_SCHEMA.split(", ")]


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _answers(text: bytes, offs: np.ndarray, code: np.ndarray, bounds: np.ndarray, low: np.ndarray, which: np.ndarray) -> pa.Table:
    """For each distinct one of the strings numbered which, runs of its windows with one least id."""
    rows: list[tuple] = []
    seen = set()
    for i in which.tolist():
        digest = _digest(text[offs[i] : offs[i + 1]])
        if digest not in seen:
            seen.add(digest)
            own = low[bounds[i] : bounds[i + 1]]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            for a, n in zip(first.tolist(), np.diff(np.append(first, len(own))).tolist()):
                rows.append((a, n, int(code[i].astype(np.int64)), digest, int(own[a])))
    at_, n, codes, digests, least = zip(*rows) if rows else ((),) * 5
    return pa.table([pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array(at_, pa.int32()), pa.array(n, pa.int32()), pa.array(codes, pa.int64()), pa.array(digests, pa.binary()), pa.array(least, pa.int64())], _FOUND)


def _looked_up(docs: DataFrame, p: SubstringParams, pick, schema: str) -> DataFrame:
    """Rows that pick gives for the super-k-mers of docs: called with text, starts, ends, codes, doc_ids, versions and places of a block's."""
    kinds = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = at.utf8(batch.column("text"))
            ids, versions = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "version"))
            for i, j in at.blocks(offs):
                cut = _super_kmers(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p)
                if cut is None:
                    continue
                text, a, b, _, (windows, first, last), row, places = cut
                found = pick(text, a, b, _codes(windows, first, last, b - a), ids[i + row], versions[i + row], places)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds.types)], schema=kinds)

    return docs.mapInArrow(run, schema)


def _flag_copies(docs: DataFrame, answers: DataFrame, p: SubstringParams) -> DataFrame:
    """Flags of all copies of the super-k-mers in answers (code, digest, at, n, least), which fit the driver."""
    rows = answers.select("code", "digest", "at", "n", "least").toArrow()
    runs = defaultdict(list)
    for code, digest, at_, n, least in zip(*(rows.column(c).to_pylist() for c in ("code", "digest", "at", "n", "least"))):
        runs[(code, digest)].append((at_, n, least))
    shared = docs.sparkSession.sparkContext.broadcast((np.array(sorted({c for c, _ in runs}), np.int64), dict(runs)))

    def pick(text, a, b, code, docs_, versions, places) -> list[tuple]:
        wanted, known = shared.value
        wanted = np.sort(wanted.view(np.uint64))
        place = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
        found = []
        for x in np.flatnonzero(wanted[place] == code).tolist():
            doc = int(docs_[x])
            for at_, n, least in known.get((int(code[x].astype(np.int64)), _digest(text[a[x] : b[x]])), ()):
                if least < doc:
                    found.append((doc, int(versions[x]), int(places[x]) + at_, n))
        return found

    return _looked_up(docs, p, pick, FLAG_SCHEMA)


def _flag_many(docs: DataFrame, answers: DataFrame, p: SubstringParams) -> DataFrame:
    """As _flag_copies, for any number of answers in one pass over the texts.

    A bit for each code's first bits goes to all tasks, whatever the number of answers; super-k-mers whose bit is set are joined
    with the answers. One string's copies are dealt over p.salts parts, to each of which its answers are sent.
    """
    bit = F.shiftrightunsigned("code", 64 - p.filter_bits) + 1  # Spark counts from 1
    words = answers.select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("b")).groupBy("k").agg(F.bitmap_construct_agg("b").alias("bits"))
    table = np.zeros(max((1 << p.filter_bits) // 8, 4096), np.uint8)
    for r in words.collect():  # 4 KB for every 32,768 bits
        own = np.frombuffer(bytes(r.bits), np.uint8)
        table[(r.k - 1) * 4096 : (r.k - 1) * 4096 + len(own)] |= own
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def pick(text, a, b, code, docs_, versions, places) -> list[tuple]:
        at_ = (code >> np.uint64(64 - p.filter_bits)).astype(np.int64)
        set_ = (shared.value[at_ >> 3] >> (at_ & 7).astype(np.uint8)) & 1
        return [(int(code[x].astype(np.int64)), _digest(text[a[x] : b[x]]), int(docs_[x]), int(versions[x]), int(places[x])) for x in np.flatnonzero(set_).tolist()]

    copies = _looked_up(docs, p, pick, "code long, digest binary, doc_id long, version long, place int")
    copies = copies.withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), F.lit(p.salts)).cast("int"))
    sent = answers.select("code", "digest", F.col("at").alias("_at"), "n", "least", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))).alias("salt"))
    found = copies.join(sent, ["code", "digest", "salt"]).filter("least < doc_id")
    return found.select("doc_id", "version", (F.col("place") + F.col("_at")).cast("int").alias("at"), "n")


def flagged_windows(docs: DataFrame, p: SubstringParams = SubstringParams()) -> DataFrame:
    """doc_id, version, at, n: runs of n windows from word at on that also start in a smaller doc_id. docs: doc_id, version, text."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(partitions(docs.sparkSession), math.ceil(size / p.bucket_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(p, n_buckets)
        for batch in batches:
            buf, offs = at.utf8(batch.column("text"))
            ids, versions = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "version"))
            for i, j in at.blocks(offs):
                packer.add(ids[i:j], versions[i:j], buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                if packer.bytes >= p.flush_bytes:
                    yield from packer.flush()
        yield from packer.flush()

    def check(table: pa.Table) -> pa.Table:
        return _flags(table.column("payload").to_pylist(), p)

    found = written(docs.mapInArrow(pack, BUCKET_SCHEMA).groupBy("bucket").applyInArrow(check, FOUND_SCHEMA), "windows")
    flags, answers = found.filter("digest IS NULL").select(*_FOUND[:4]), found.filter("digest IS NOT NULL")
    n = answers.count()
    if n:
        flags = flags.unionByName((_flag_copies if n <= p.answers else _flag_many)(docs, answers, p))
    return flags


def _versioned(own: DataFrame, p: SubstringParams) -> DataFrame:
    """own (doc_id, _id, text) with version, which tells rows of one doc_id apart: a 64-bit hash of text and size, 0 for the only row of an id."""
    hashed = F.xxhash64("text", F.octet_length("text"))
    repeated = written(own.filter("_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1"), "repeated")
    n = repeated.count()
    if not n:
        return own.withColumn("version", F.when(F.col("_id").isNull(), hashed).otherwise(F.lit(0).cast("long")))
    own = own.join(F.broadcast(repeated) if n <= p.broadcast_ids else repeated, "doc_id", "left")
    return own.withColumn("version", F.when(F.col("_id").isNull() | F.col("_n").isNotNull(), hashed).otherwise(F.lit(0).cast("long"))).drop("_n")


def dedup_substrings(docs: DataFrame, p: SubstringParams = SubstringParams(), id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 for every row.

    Every word covered by a window whose words also start in a document with a smaller doc_id is removed; windows are judged
    on the input. kept_text is the kept words joined by one space. A null or empty text has no words; texts shorter than a
    window keep all. A null doc_id counts as larger than all others. Rows of one doc_id, repeated or different, don't remove
    from each other. An empty table gives an empty result. With row, the input row comes along as the struct _row.
    """
    prepare(docs.sparkSession)
    last = F.lit((1 << 63) - 1)
    own = _versioned(texts(docs, id_col, text_col, row).withColumn("_id", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", last)), p)
    flags = flagged_windows(own.select("doc_id", "version", "text"), p)
    runs = flags.groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "n")).alias("_runs"))
    joined = own.join(runs, ["doc_id", "version"], "left").select(
        F.col("_id").alias("doc_id"), "text", F.transform("_runs", lambda x: x["at"]).alias("at"), F.transform("_runs", lambda x: x["n"]).alias("n"), *(["_row"] if row else [])
    )
    extra = joined.schema.fields[4:]
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    k = p.window

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, sha = [], [], [], []
            for text, where, n in zip(batch.column("text"), batch.column("at").to_pylist(), batch.column("n").to_pylist()):
                words = text.as_py().encode().split()
                gone = 0
                if where:
                    keep = bytearray(b"\1") * len(words)
                    for i, m in zip(where, n):
                        keep[i : i + m + k - 1] = bytes(m + k - 1)
                    left = [w for w, x in zip(words, keep) if x]
                    gone = len(words) - len(left)
                else:
                    left = words
                out = b" ".join(left)
                n_words.append(len(words)), n_removed.append(gone), kept.append(out.decode()), sha.append(hashlib.sha256(out).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string()), *([batch.column("_row")] if row else [])],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", *(["_row"] if row else [])],
            )

    return joined.mapInArrow(remove, T.StructType(schema.fields + extra))

"""Token ids as wavelet matrices: one compressed file a shard, with access, counting and occurrence lookup.

A wavelet matrix holds a sequence as one bit-plane for each bit of an id, from the highest down. After each plane the
sequence is dealt anew, stably, those with bit 0 first. A plane is packed into 64-bit words with a directory of ones before
every eighth word; rank counts ones before a place, select finds the k-th. With them a token, the number of times an id
occurs in a range, and the places where it occurs are found in as many steps as an id has bits.

File layout, little-endian, compressed by zstd as a whole: b"WVM1"; uint32 bits; uint64 tokens; uint32 documents; int64 doc
ids and uint32 lengths of the documents; then for each plane uint64 zeros, the words, and the uint32 directory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrowtext as at
from .chunkcode import ChunkEncoder, added_tokens, library_encoder
from .shared import partitions, prepare, texts, written

MAGIC = b"WVM1"
_EVERY = 8  # words


@dataclass(frozen=True)
class TokenFileParams:
    tokenizer_path: str
    end_id: int = 2
    bits: int = 16
    #: A shard is closed once it has so many tokens; a longer document makes a longer shard.
    shard_tokens: int = 1 << 18


class Shard:
    """A sequence of token ids with the documents that it is made of."""

    def __init__(self, n: int, bits: int, doc_ids: np.ndarray, lengths: np.ndarray, planes: list[tuple[int, np.ndarray, np.ndarray]]):
        self.n, self.bits, self.doc_ids, self.lengths, self.planes = n, bits, doc_ids, lengths, planes

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, bits: int) -> Shard:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"ids need more than {bits} bits")
        seq, planes = ids.astype(np.uint16 if bits <= 16 else np.uint32), []
        for k in range(bits - 1, -1, -1):
            one = (seq & seq.dtype.type(1 << k)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            words = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8")
            before = np.cumsum(np.bitwise_count(words), dtype=np.uint32)
            directory = np.concatenate([np.zeros(1, np.uint32), before[_EVERY - 1 :: _EVERY]])
            zeros = len(seq) - int(np.count_nonzero(one))
            planes.append((zeros, words, directory))
            dealt = np.empty_like(seq)
            np.compress(one, seq, out=dealt[zeros:])
            np.compress(np.logical_not(one, out=one), seq, out=dealt[:zeros])
            seq = dealt
        return cls(len(ids), bits, doc_ids.astype("<i8"), lengths.astype("<u4"), planes)

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<IQI", self.bits, self.n, len(self.doc_ids)), self.doc_ids.tobytes(), self.lengths.tobytes()]
        for zeros, words, directory in self.planes:
            out += [struct.pack("<Q", zeros), words.tobytes(), directory.tobytes()]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(out))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        body = zstandard.ZstdDecompressor().decompress(raw)
        if body[:4] != MAGIC:
            raise ValueError("not a token file")
        bits, n, docs = struct.unpack_from("<IQI", body, 4)
        here = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal here
            out = np.frombuffer(body, kind, count, here)
            here += out.nbytes
            return out

        doc_ids, lengths, planes = take("<i8", docs), take("<u4", docs), []
        n_words = -(-n // 64)
        for _ in range(bits):
            zeros = int(take("<u8", 1)[0])
            planes.append((zeros, take("<u8", n_words), take("<u4", n_words // _EVERY + 1)))
        return cls(n, bits, doc_ids, lengths, planes)

    def _rank(self, plane: int, at_: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        _, words, directory = self.planes[plane]
        at_ = np.asarray(at_, np.int64)
        word = at_ >> 6
        out = directory[word // _EVERY].astype(np.int64)
        for k in range(_EVERY - 1):
            w = (word // _EVERY) * _EVERY + k
            inside = w < word
            out[inside] += np.bitwise_count(words[w[inside]])
        rest = (at_ & 63).astype(np.uint64)
        part = rest > 0
        out[part] += np.bitwise_count(words[word[part]] & ((np.uint64(1) << rest[part]) - np.uint64(1)))
        return out

    def _select(self, plane: int, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th (from 0) one or zero: the last place with at most k of them before it."""
        low, high = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            before = self._rank(plane, mid + 1)
            before = before if one else mid + 1 - before
            right = before <= k
            low, high = np.where(right & (low < high), mid + 1, low), np.where(~right & (low < high), mid, high)
        return low

    def access(self, at_) -> np.ndarray:
        """Ids at the given places."""
        at_ = np.asarray(at_, np.int64)
        out = np.zeros(len(at_), np.int64)
        for k, (zeros, words, _) in enumerate(self.planes):
            bit = ((words[at_ >> 6] >> (at_ & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._rank(k, at_)
            out = (out << 1) | bit
            at_ = np.where(bit, zeros + ones, at_ - ones)
        return out

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes' deals are undone from the lowest up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            zeros, words, _ = self.planes[k]
            one = np.unpackbits(words.view(np.uint8), count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, kind)
            back[np.flatnonzero(one)] = seq[zeros:] | kind(1 << (self.bits - 1 - k))
            back[np.flatnonzero(np.logical_not(one))] = seq[:zeros]
            seq = back
        return seq

    def _ranges(self, token: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the occurrences of token in places lo to hi stand after the last plane."""
        lo, hi = np.asarray(lo, np.int64), np.asarray(hi, np.int64)
        for k, (zeros, _, _) in enumerate(self.planes):
            a, b = self._rank(k, lo), self._rank(k, hi)
            lo, hi = (zeros + a, zeros + b) if (token >> (self.bits - 1 - k)) & 1 else (lo - a, hi - b)
        return lo, hi

    def counts(self, token: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How often token occurs in each of many ranges of places."""
        a, b = self._ranges(token, lo, hi)
        return b - a

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often token occurs in places lo to hi."""
        return int(self.counts(token, np.array([lo]), np.array([self.n if hi is None else hi]))[0])

    def occurrences(self, token: int) -> np.ndarray:
        """All places of token, ascending."""
        a, b = self._ranges(token, np.array([0]), np.array([self.n]))
        at_ = np.arange(a[0], b[0], dtype=np.int64)
        for k in range(self.bits - 1, -1, -1):
            one = bool((token >> (self.bits - 1 - k)) & 1)
            at_ = self._select(k, at_ - self.planes[k][0] if one else at_, one)
        return at_


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(library_encoder(path, between="\x0b"), added=added_tokens(path))
    return _encoders[path]


def write_shards(docs: DataFrame, p: TokenFileParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written token files of docs in ascending doc_id order: part, seq, prior (tokens before it in the part), n_tokens, n_docs, file.

    Each shard is a file of its own in the shared folder, a Parquet file of one row whose column file holds its bytes.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, seq, prior = encoder(p.tokenizer_path), TaskContext.get().partitionId(), 0, 0
        ids, lengths, names, have = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, prior, have
            shard = Shard.build(np.concatenate(ids), np.concatenate(names), np.concatenate(lengths), p.bits)
            row = [[part], [seq], [prior], [shard.n], [len(shard.doc_ids)], [shard.to_bytes()]]
            seq, prior, have = seq + 1, prior + shard.n, 0
            ids.clear(), lengths.clear(), names.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["part", "seq", "prior", "n_tokens", "n_docs", "file"])

        for batch in at.gathered(batches, "text", 6 << 20):
            column, doc_ids = batch.column("text"), batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            for i, j in at.blocks(at.utf8(column)[1], 1 << 23):
                flat, n = own.ids(column.slice(i, j - i))
                ends = np.cumsum(n)
                ids.append(np.insert(flat, ends, p.end_id).astype(np.uint32))
                lengths.append(n + 1)
                names.append(doc_ids[i:j])
                have += len(ids[-1])
                if have >= p.shard_tokens:
                    yield close()
        if names:
            yield close()

    own = texts(docs, id_col, text_col)
    order = ["doc_id", F.xxhash64("text")]
    dealt = own.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    made = dealt.mapInArrow(run, "part int, seq int, prior long, n_tokens long, n_docs long, file binary")
    return written(made, "token-files", maxRecordsPerFile=1, compression="none")  # the bytes are compressed


def read_shards(shards: DataFrame, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_end_ids of all documents in the files.

    start: tokens of all documents before; n_end_ids: how often the end id occurs in the document, counted by rank alone.
    """
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each writing task
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    placed = shards.join(F.broadcast(before), "part").select((F.col("base") + F.col("prior")).alias("start"), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in zip(batch.column("start").to_pylist(), batch.column("file")):
                shard = Shard.from_bytes(raw.as_py())
                body, n = memoryview(shard.tokens().astype("<u4").tobytes()), shard.lengths.astype(np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(body[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                names = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == -(1 << 63))
                marks = shard.counts(end_id, ends - n, ends)
                yield pa.RecordBatch.from_arrays([names, pa.array(first + ends - n), pa.array(n), pa.array(crc, pa.int64()), pa.array(marks)], ["doc_id", "start", "n_tokens", "ids_crc32", "n_end_ids"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_end_ids long")


def lookup(shards: DataFrame, token: int) -> DataFrame:
    """part, seq, n, places of each file with the token: how often it occurs, and where in the file, by rank and select."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, raw in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("file")):
                places = Shard.from_bytes(raw.as_py()).occurrences(token)
                if len(places):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(places)], pa.int64()), pa.array([places], pa.list_(pa.int64()))], ["part", "seq", "n", "places"])

    return shards.select("part", "seq", "file").mapInArrow(run, "part int, seq int, n long, places array<long>")


def token_files(docs: DataFrame, p: TokenFileParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes docs, writes the token files, and reads doc_id, start, n_tokens, ids_crc32, n_end_ids of every document back from them.

    Every text gets the end id after its ids; a null text counts as empty and so has the end id alone. Rows of one doc_id
    are ordered by a hash of their text; null ids come first. An empty table makes no file and an empty result. Other
    columns are not looked at.
    """
    return read_shards(write_shards(docs, p, id_col, text_col), p.end_id)

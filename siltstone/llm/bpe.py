"""Byte-level BPE encoding and decoding in numpy.

A text is cut by the pre-splitting pattern; each distinct piece becomes one row of a padded matrix of ranks, with pieces of
like length together. In each round every row merges its leftmost pair of least rank; pairs are looked up in an open-addressed
hash table of two numpy arrays, and a merged row is closed up by shifting its tail. Rows without a mergeable pair leave.
Pieces longer than a bound go through a heap of pairs with the same order of merges, which needs no matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrowtext as at
from .chunkcode import ChunkEncoder
from .shared import prepare, texts

NONE = np.int64(1 << 40)
LONG_PIECE = 256


class Ranks:
    """Ranks of byte strings and the pairs of ranks that merge."""

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.single = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        size = max(self.rank.values()) + 1
        self.token = [b""] * size
        for k, v in self.rank.items():
            self.token[v] = k
        self.length = np.array([len(x) for x in self.token], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        digits = [b"%d," % i for i in range(size)]
        self.digit_length = np.array([len(x) for x in digits], np.int64)
        self.digit_start = np.cumsum(self.digit_length) - self.digit_length
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.pair = {}
        for k, v in self.rank.items():
            for cut in range(1, len(k)):
                a, b = self.rank.get(k[:cut]), self.rank.get(k[cut:])
                if a is not None and b is not None:
                    self.pair[a << 20 | b] = v
        bits = int(len(self.pair) * 2).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        for k, v in self.pair.items():
            i = ((k * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> (64 - bits)
            while self.keys[i] >= 0:
                i = (i + 1) & self.mask
            self.keys[i], self.values[i] = k, v

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, or NONE."""
        key = (a << 20) | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        out = np.full(key.shape, NONE, np.int64)
        todo = np.flatnonzero(np.ones(key.size, bool))
        flat, slots = key.ravel(), slot.ravel()
        res = out.ravel()
        while len(todo):
            there = self.keys[slots[todo]]
            hit = there == flat[todo]
            res[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            slots[todo] = (slots[todo] + 1) & self.mask
        return res.reshape(key.shape)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        todo: dict[int, list[int]] = {}
        for i, x in enumerate(pieces):
            known = self.rank.get(x)
            if known is not None:
                out[i] = np.array([known], np.uint32)  # a piece that is a token stays whole
            elif len(x) > LONG_PIECE:
                out[i] = self._heap(x)
            else:
                todo.setdefault(max(4, 1 << (len(x) - 1).bit_length()), []).append(i)  # padded to 4, 8, 16, ...
        for width, rows in todo.items():
            for k in range(0, len(rows), 1 << 16):
                some = rows[k : k + (1 << 16)]
                for i, ids in zip(some, self._matrix([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n = np.array([len(x) for x in pieces], np.int64)
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.full((len(pieces), width), -1, np.int64)
        row = np.repeat(np.arange(len(pieces)), n)
        col = np.arange(len(joined)) - np.repeat(np.cumsum(n) - n, n)
        ids[row, col] = self.single[joined]
        ranks = np.full((len(pieces), width), NONE, np.int64)
        ok = ids[:, 1:] >= 0
        r, c = np.nonzero(ok)
        ranks[r, c] = self.lookup(ids[r, c], ids[r, c + 1])
        done_ids, done_n = np.full((len(pieces), width), -1, np.int64), n.copy()
        live = np.arange(len(pieces))
        while len(live):
            best = ranks.argmin(1)  # the leftmost of the least
            rows = np.arange(len(live))
            rank = ranks[rows, best]
            more = rank < NONE
            if not more.all():
                gone = ~more
                done_ids[live[gone]], done_n[live[gone]] = ids[gone], n[live[gone]]
                live, ids, ranks, best, rank = live[more], ids[more], ranks[more], best[more], rank[more]
                rows = np.arange(len(live))
            if not len(live):
                break
            ids[rows, best] = rank
            col = np.arange(width - 1)
            source = col[None, :] + (col[None, :] > best[:, None])  # closes the gap after the merged pair
            moved = np.take_along_axis(ids, np.concatenate([source, np.full((len(live), 1), width - 1)], 1), 1)
            moved[:, -1] = -1
            shifted = np.take_along_axis(ranks, np.concatenate([source, np.full((len(live), 1), width - 1)], 1), 1)
            shifted[:, -1] = NONE
            ids, ranks = moved, shifted
            n[live] -= 1
            right = np.where(best + 1 < n[live], best + 1, 0)
            ranks[rows, best] = np.where(best + 1 < n[live], self.lookup(ids[rows, best], ids[rows, right]), NONE)
            left = best > 0
            lr, lb = rows[left], best[left] - 1
            ranks[lr, lb] = self.lookup(ids[lr, lb], ids[lr, lb + 1])
        return [done_ids[i, : done_n[i]].astype(np.uint32) for i in range(len(pieces))]

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = [int(self.single[x]) for x in piece]
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get, alive = self.pair.get, [True] * len(ids)
        heap = [(v, i) for i in range(len(ids) - 1) if (v := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            v, i = heapq.heappop(heap)
            j = nxt[i] if alive[i] else len(ids)
            if j >= len(ids) or get(ids[i] << 20 | ids[j]) != v:
                continue  # what stood here has been merged since
            ids[i], alive[j] = v, False
            nxt[i] = nxt[j]
            if nxt[i] < len(ids):
                prv[nxt[i]] = i
                if (x := get(v << 20 | ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (x, i))
            if prv[i] >= 0 and (x := get(ids[prv[i]] << 20 | v)) is not None:
                heapq.heappush(heap, (x, prv[i]))
        return np.array([x for x, a in zip(ids, alive) if a], np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return at.gather(self.bytes, self.start[ids], self.length[ids]).tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return at.gather(self.digits, self.digit_start[ids], self.digit_length[ids])[:-1].tobytes()


class Codec:
    """encode and decode by the ranks at path, with texts cut by pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as file:
            self.ranks = Ranks(file.read())
        self.pattern = regex.compile(pattern)
        self.chunks = ChunkEncoder(self._encode)

    def _encode(self, many: list[str]) -> list[np.ndarray]:
        pieces: dict[str, int] = {}
        rows = [[pieces.setdefault(x, len(pieces)) for x in self.pattern.findall(text)] for text in many]
        ids = self.ranks.merge([x.encode() for x in pieces])
        return [ids[row[0]] if len(row) == 1 else np.concatenate([ids[i] for i in row]) if row else np.zeros(0, np.uint32) for row in rows]

    def encode(self, many: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.chunks.ids(many)


@dataclass(frozen=True)
class BpeParams:
    ranks_path: str
    pattern: str


_codecs: dict[BpeParams, Codec] = {}


def codec(p: BpeParams) -> Codec:
    """One codec a worker and file."""
    if p not in _codecs:
        _codecs[p] = Codec(p.ranks_path, p.pattern)
    return _codecs[p]


def encode(docs: DataFrame, p: BpeParams, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (only if ids), ids_sha256, decoded, decoded_sha256 for every row, in one pass.

    decoded (only if ids) is the bytes that the ids stand for. A null text counts as empty; an empty text has no ids and the
    hashes of nothing. Special tokens in a text are ordinary text. Repeated rows are encoded alike; an empty table gives an
    empty result; other columns are not looked at.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(p)
        for batch in batches:
            column = batch.column("text")
            offs = at.utf8(column)[1]
            out: list[list] = [[], [], [], [], []]
            for i, j in at.blocks(offs):
                flat, n = own.encode(column.slice(i, j - i))
                here = 0
                for size in n.tolist():
                    mine = flat[here : here + size]
                    here += size
                    raw = own.ranks.decode(mine)
                    out[0].append(size), out[1].append(hashlib.sha256(own.ranks.decimal(mine)).hexdigest()), out[2].append(hashlib.sha256(raw).hexdigest())
                    if ids:
                        out[3].append(mine.astype(np.int32)), out[4].append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), *([pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.binary())] if ids else [])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if ids else "")
    return texts(docs, id_col, text_col).mapInArrow(run, schema)

"""Packing of token ids into sequences by order-preserving dynamic programming.

Documents are taken in ascending doc_id order, dealt out by ranges. Cuts may fall after a document, after a token that ends a
sentence, or, where neither comes in time, anywhere. Over the possible cuts in order, the best cost up to cut j is
min(cost(i) + capacity - (pos(j) - pos(i))) + penalty(j) over all i with pos(j) - pos(i) <= capacity: padding of the sequence
between i and j plus what a sequence and a cut at j cost. As the minimum only needs cost(i) + pos(i) over a sliding range of
i, a monotone queue gives every step in constant time. A sequence whose size is a power of two needs no padding, so the few i
at such a distance are priced besides. The sequence still open at the end of a block of documents goes on in the next block.
In the last sequence's reach before the end of a range, cuts may fall anywhere, at their price.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .chunkcode import ChunkEncoder, added_tokens, library_encoder
from .shared import partitions, prepare, texts


@dataclass(frozen=True)
class PackingParams:
    tokenizer_path: str
    capacity: int = 4096
    end_id: int = 2
    #: Padding tokens that one cut is worth: after a sentence, and anywhere else.
    sentence_penalty: int = 4
    hard_penalty: int = 64
    #: Padding tokens that one more sequence is worth.
    sequence_price: int = 32
    #: Tokens that are planned together.
    block_tokens: int = 1 << 18


_encoders: dict[str, tuple[ChunkEncoder, np.ndarray]] = {}


def encoder(path: str) -> tuple[ChunkEncoder, np.ndarray]:
    """The encoder and, for each id, whether it ends a sentence."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(path).get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[v for k, v in vocabulary.items() if k.removesuffix("</w>")[-1:] in (".", "!", "?")]] = True
        _encoders[path] = ChunkEncoder(library_encoder(path, between=" ★ "), loose=True, keep=400_000, added=added_tokens(path)), ends
    return _encoders[path]


def _exact(pos: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """For each cut, the earlier cuts at a distance of a power of two below capacity, one after the other, and their bounds."""
    cuts, before = [], []
    for k in range((capacity - 1).bit_length()):
        i = np.searchsorted(pos, pos - (1 << k))
        found = np.flatnonzero(pos[i] == pos - (1 << k))
        cuts.append(found), before.append(i[found])
    cuts, before = np.concatenate(cuts), np.concatenate(before)
    order = np.argsort(cuts, kind="stable")
    return before[order].tolist(), np.searchsorted(cuts[order], np.arange(len(pos) + 1)).tolist()


def plan_cuts(pos: np.ndarray, penalty: np.ndarray, capacity: int, price: int = 0, closed: bool = False) -> list[int]:
    """Indices of the chosen cuts, ascending, the last place included.

    pos: possible cuts, ascending, from 0 on, at most capacity apart. A sequence costs price and its padding, none at a power
    of two. What stands after the last cut but one is left open and costs nothing; with closed, it is a sequence like others.
    """
    p, extra = pos.tolist(), (penalty + price).tolist()
    exact, edges = _exact(pos, capacity) if len(p) > 1 else ([], [0, 0])
    cost, back = [0] * len(p), [0] * len(p)
    queue, keys = deque([0]), deque([0])
    for j in range(1, len(p)):
        low = p[j] - capacity
        while p[queue[0]] < low:
            queue.popleft(), keys.popleft()
        i, c = queue[0], keys[0] + capacity - p[j]
        for x in exact[edges[j] : edges[j + 1]]:  # sizes that need no padding
            if cost[x] < c:
                i, c = x, cost[x]
        back[j] = i
        cost[j] = c = c + extra[j]
        key = c + p[j]
        while keys and keys[-1] >= key:
            queue.pop(), keys.pop()
        queue.append(j), keys.append(key)
    chosen, j = [], len(p) - 1
    if j and not closed:
        near = range(int(np.searchsorted(pos, p[j] - capacity)), j)
        back[j] = min(near, key=lambda i: (cost[i], -i))
    while j:
        chosen.append(j)
        j = back[j]
    return chosen[::-1]


def possible_cuts(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, p: PackingParams, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places where ids may be cut, and what each costs; with last, all places within reach of the end."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    if last:
        cost[max(len(ids) - p.capacity, 0) :] = p.hard_penalty
    cost[np.flatnonzero(sentence_end[ids]) + 1] = p.sentence_penalty
    cost[len(ids)] = 0
    cost[doc_ends] = 0
    cost[0] = 0
    pos = np.flatnonzero(cost >= 0)
    wide = np.flatnonzero(np.diff(pos) > p.capacity)
    if len(wide):  # no boundary within reach: cuts at every so many tokens
        more = np.concatenate([np.arange(pos[i] + p.capacity, pos[i + 1], p.capacity) for i in wide])
        cost[more] = p.hard_penalty
        pos = np.flatnonzero(cost >= 0)
    return pos, cost[pos]


class Packer:
    """Takes documents' ids in order and gives pieces of finished sequences."""

    def __init__(self, p: PackingParams, sentence_end: np.ndarray, first_sequence: int):
        self.p, self.sentence_end, self.sequence = p, sentence_end, first_sequence
        self.ids = np.zeros(0, np.uint32)
        self.docs = np.zeros((0, 3), np.int64)  # doc_id, all its tokens, its tokens in sequences given before
        self.left = np.zeros(0, np.int64)  # its tokens still here

    def add(self, ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.docs = np.concatenate([self.docs, np.stack([doc_ids, lengths, np.zeros_like(lengths)], 1)])
        self.left = np.concatenate([self.left, lengths])

    def pieces(self, last: bool) -> list[list]:
        """Columns of the pieces of all sequences but the open one; with last, of all."""
        ends = np.cumsum(self.left)
        pos, penalty = possible_cuts(self.ids, ends, self.sentence_end, self.p, last)
        cuts = pos[plan_cuts(pos, penalty, self.p.capacity, self.p.sequence_price, last)].tolist()
        if not last:
            cuts = cuts[:-1]
        out: list[list] = [[] for _ in range(7)]
        stop = cuts[-1] if cuts else 0
        if stop:
            seq = np.array(cuts)
            edges = np.unique(np.concatenate([[0], seq, ends[ends <= stop]]))
            a, b = edges[:-1], edges[1:]
            doc = np.searchsorted(ends, a, side="right")
            own = np.searchsorted(seq, a, side="right")
            seq_start = np.concatenate([[0], seq])[own]
            start = a - (ends - self.left)[doc] + self.docs[doc, 2]
            body = memoryview(self.ids[:stop].astype("<u4").tobytes())
            out = [
                self.docs[doc, 0], start, b - a, np.array([zlib.crc32(body[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())], np.int64),
                self.docs[doc, 1], self.sequence + own, a - seq_start,
            ]
            self.sequence += len(cuts)
            gone = int(np.searchsorted(ends, stop, side="right"))
            self.docs, self.left, ends = self.docs[gone:], self.left[gone:], ends[gone:]
            if len(self.left):
                here = ends[0] - stop
                self.docs = self.docs.copy()
                self.docs[0, 2] += self.left[0] - here
                self.left = self.left.copy()
                self.left[0] = here
            self.ids = self.ids[stop:]
        return out


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, p: PackingParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every document.

    Each text's ids are followed by the end id; a null or empty text has that one alone. Each id lies in exactly one piece;
    offsets in a sequence have no gaps. sequence_id is the number of the range times 2^32 plus the number in it. Rows of one
    doc_id are ordered by a hash of their text and each packed; null ids come first. An empty table gives no pieces. Other
    columns are not looked at.
    """
    prepare(docs.sparkSession)
    none = -(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, ends = encoder(p.tokenizer_path)
        packer = Packer(p, ends, TaskContext.get().partitionId() << 32)

        def give(last: bool) -> Iterator[pa.RecordBatch]:
            out = packer.pieces(last)
            if len(out[0]):
                names = pa.array(out[0], pa.int64(), mask=out[0] == none)
                yield pa.RecordBatch.from_arrays([names, *(pa.array(x, pa.int64()) for x in out[1:])], COLUMNS)

        for batch in at.gathered(batches, "text", 6 << 20):
            column, doc_ids = batch.column("text"), batch.column("doc_id").fill_null(none).to_numpy(zero_copy_only=False)
            for i, j in at.blocks(at.utf8(column)[1], 1 << 23):
                flat, n = own.ids(column.slice(i, j - i))
                packer.add(np.insert(flat, np.cumsum(n), p.end_id).astype(np.uint32), doc_ids[i:j], n + 1)
                if len(packer.ids) >= p.block_tokens:
                    yield from give(False)
        yield from give(True)

    own = texts(docs, id_col, text_col)
    order = ["doc_id", F.xxhash64("text")]
    dealt = own.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS))

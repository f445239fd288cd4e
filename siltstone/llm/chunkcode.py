"""Token ids of texts, with each distinct chunk encoded once in a while.

Byte-level tokenizers split a text by a pattern before they merge, and no piece of that pattern holds a space or line feed
after another character. So a text without doubled or outer white space is cut before each space and line feed into chunks,
whose ids don't depend on what stands around. The chunks of a block are one Arrow array over the texts' own bytes, whose
distinct values Arrow finds; a bounded table keeps the ids of chunks, and when it is full, of those met more than once.
Texts with other white space, and texts in which one of the tokenizer's added tokens is spelled out, are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute

from .arrowtext import gather, utf8

_PLAIN = np.zeros(256, bool)  # space and line feed
_PLAIN[[32, 10]] = True
_RARE = np.zeros(256, bool)  # other white space of one byte
_RARE[[9, 11, 12, 13, 28, 29, 30, 31]] = True
#: First bytes of the white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _beyond_ascii(buf: np.ndarray) -> np.ndarray:
    """Places where white space beyond ASCII begins."""
    at = np.flatnonzero(_LEADS[buf])
    if not len(at):
        return at
    padded = np.append(buf, np.zeros(2, np.uint8))
    x, y, z = buf[at], padded[at + 1], padded[at + 2]
    two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
    general = (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
    others = ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
    return at[two | general | others]


def odd_rows(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows with white space next to white space, at an end, or of a kind other than space and line feed."""
    plain = _PLAIN[buf]
    bad = _RARE[buf]
    bad[1:] |= plain[1:] & plain[:-1]
    full = offs[:-1] < offs[1:]
    bad[offs[:-1][full]] |= plain[offs[:-1][full]]
    bad[offs[1:][full] - 1] |= plain[offs[1:][full] - 1]
    places = np.concatenate([np.flatnonzero(bad), _beyond_ascii(buf)])
    out = np.zeros(len(offs) - 1, bool)
    out[np.searchsorted(offs, places, side="right") - 1] = True
    return out


class ChunkEncoder:
    """encode: list of strings to list of id sequences. With loose, white space makes no ids and all texts may be cut at it."""

    def __init__(self, encode: Callable[[list[str]], list], loose: bool = False, keep: int = 800_000, added: tuple[str, ...] = ()):
        self.encode, self.loose, self.keep, self.added = encode, loose, keep, added
        self.number: dict = {}
        self.flat, self.start, self.length, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, column: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number in each text."""
        column = pa.array(column, pa.string()) if isinstance(column, list) else column
        buf, offs = utf8(column)
        odd = np.zeros(len(column), bool) if self.loose else odd_rows(buf, offs)
        for token in self.added:
            odd |= pa.compute.match_substring(column, token).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._cut(buf, offs)
        sizes = np.zeros(len(column), np.int64)
        plain, whole = np.flatnonzero(~odd), np.flatnonzero(odd)
        flat, sizes[plain] = self._cut(*utf8(column.take(pa.array(plain))))
        found = [np.asarray(x, np.uint32) for x in self.encode(column.take(pa.array(whole)).to_pylist())]
        sizes[whole] = [len(x) for x in found]
        # Brought back into the order of the texts.
        every = np.concatenate([flat, *found])
        order = np.concatenate([plain, whole])
        start = np.empty(len(column), np.int64)
        start[order] = np.cumsum(sizes[order]) - sizes[order]
        return gather(every, start, sizes), sizes

    def _cut(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        first = _PLAIN[buf]
        first[offs[:-1][offs[:-1] < offs[1:]]] = True
        starts = np.flatnonzero(first)
        edges = np.searchsorted(starts, offs)
        places = np.append(starts, len(buf)).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(buf)))
        coded = chunks.dictionary_encode()
        row = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        self.met += np.bincount(row, minlength=len(self.met))
        lengths = self.length[row]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return gather(self.flat, self.start[row], lengths), total[edges[1:]] - total[edges[:-1]]

    def _numbers(self, chunks: list) -> np.ndarray:
        """Numbers of distinct chunks; new ones are encoded."""
        if len(self.number) > self.keep:
            self._forget()
        known = self.number
        out = np.fromiter(map(known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [chunks[i] for i in missing.tolist()]
            first = len(known)
            known.update(zip(new, range(first, first + len(new))))
            out[missing] = np.arange(first, first + len(new))
            found = self.encode(new)
            n = np.fromiter(map(len, found), np.int64, len(found))
            at = len(self.flat)
            self.flat = np.concatenate([self.flat, *found]).astype(np.uint32)
            self.start = np.concatenate([self.start, at + np.cumsum(n) - n])
            self.length = np.concatenate([self.length, n])
            self.met = np.concatenate([self.met, np.zeros(len(n), np.int64)])
        return out

    def _forget(self) -> None:
        """Keeps chunks met more than once, or none if those are too many too."""
        stay = np.flatnonzero(self.met > 1)
        stay = stay if len(stay) <= self.keep // 2 else stay[:0]
        keys = np.array(list(self.number), dtype=object)[stay] if len(stay) else []
        self.number = {k: i for i, k in enumerate(keys)}
        self.flat = gather(self.flat, self.start[stay], self.length[stay])
        self.length = self.length[stay]
        self.start = np.cumsum(self.length) - self.length
        self.met = np.zeros(len(stay), np.int64)


def added_tokens(path: str) -> tuple[str, ...]:
    """Strings that the tokenizer at path takes for one token wherever they stand."""
    from tokenizers import Tokenizer

    return tuple(x.content for x in Tokenizer.from_file(path).get_added_tokens_decoder().values())


def library_encoder(path: str, between: str) -> Callable[[list[str]], list]:
    """The tokenizers library with the file at path, add_special_tokens=False, and else as it is.

    A special token that is spelled out in a text gets its own id, as the library gives it. Short strings are encoded many at a time, joined by between: that must become exactly one id of its own wherever it
    stands. Strings in which it occurs, and groups for which the ids don't split up as expected, are encoded singly.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    (mark,) = tokenizer.encode(between, add_special_tokens=False).ids
    apart = (between.strip(" "), *added_tokens(path))

    def singly(many: list[str]) -> list:
        return [x.ids for x in tokenizer.encode_batch_fast(many, add_special_tokens=False)]

    def encode(many: list[str]) -> list:
        if len(many) == 1:
            return singly(many)
        out: list = []
        for k in range(0, len(many), 500):
            group = many[k : k + 500]
            if any(len(x) > 200 or any(s in x for s in apart) for x in group):
                out += singly(group)
                continue
            ids = np.array(tokenizer.encode_batch_fast([between.join(group)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == mark)
            if len(cut) != len(group) - 1:
                out += singly(group)
                continue
            edges = [-1, *cut.tolist(), len(ids)]
            out += [ids[a + 1 : b] for a, b in zip(edges[:-1], edges[1:])]
        return out

    return encode

"""Byte-level text primitives over Arrow batches.

Texts stay UTF-8 bytes: a batch's string column is viewed as one uint8 array with row offsets, and words, word hashes
and shingles are computed for all rows at once. Words are runs of bytes other than space and 0x09-0x0D; those bytes never
occur inside a multi-byte character, so byte words equal character words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Rows are taken in blocks of about so many bytes, which bounds the 8-byte arrays made from them.
BLOCK_BYTES = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; nulls must have been replaced before."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges (i, j) of at most limit bytes, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def gathered(batches, column: str, limit: int):
    """Batches put together until their texts have about limit bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    held = [x for x in held if x.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (with a last entry for the end)."""
    ns = NONSPACE[buf]
    first, last = ns.copy(), ns.copy()
    if len(buf):
        first[1:] &= ~ns[:-1]
        last[:-1] &= ~ns[1:]
        at = offs[:-1][offs[:-1] < offs[1:]]
        first[at] = ns[at]
        at = offs[1:][offs[:-1] < offs[1:]] - 1
        last[at] = ns[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        pair = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, np.uint64(base), dtype=np.uint64)
            p[0] = 1
            pair.append(np.cumprod(p, dtype=np.uint64))
        _powers[size] = pair
    return _powers[size]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans ascend and don't overlap. Equal bytes give equal hashes anywhere."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK_BYTES, side="right")))
        part = buf[lo : ends[j - 1]]
        up, down = _power(len(part) + 1)
        total = np.empty(len(part) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_VALUES[part] * up[: len(part)], out=total[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[b] - total[a]) * down[a]
        i = j
    return mix(out)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries, one for each start with n entries left (rows aren't told apart)."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(h) - n + 1
    out = h[:m] * _ODD
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _ODD + h[k : k + m]
    return mix(out)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For bounds [0, 2, 2, 5]: [0, 0, 2, 2, 2]."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def starts_within(bounds: np.ndarray, n: int) -> np.ndarray:
    """Indices i such that i .. i + n - 1 all lie in one row."""
    sizes = np.maximum(np.diff(bounds) - n + 1, 0)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[:-1] - (ends - sizes), sizes)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of flat[s : s + n] over all s, n."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]

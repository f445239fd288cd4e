"""Balanced metric trees over integer vectors, built and walked level by level with numpy.

Node i of level l holds the rows ``bounds[l][i]`` to ``bounds[l][i + 1]`` of the tree's order; its children are nodes 2i and
2i + 1 of the next level. Each node has its count, the exact integer sum of its vectors, and a radius around their mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bound of a component after scaling. Sums of 128 products of two such numbers fit into 64 bits.
LIMIT = 1 << 27


def integer_rows(column: pa.Array, scale: int, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of an array<double> column as rows, and the places of the rows that are taken.

    A row is taken if it and all its components are neither null nor infinite nor NaN, and, with dims, if it has so many of
    them. Without dims, shorter rows are filled with zeros. A component beyond LIMIT is an error, as its products wouldn't
    fit a long.
    """
    ok = ~np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    offs = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(offs)
    values = column.values.slice(0, int(offs[-1])) if len(offs) else column.values
    x = values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ok &= odd[offs[1:]] == odd[offs[:-1]]
    if dims is not None:
        ok &= size == dims
    rows = np.flatnonzero(ok)
    width = dims if dims is not None else int(size[rows].max(initial=0))
    at = offs[rows][:, None] + np.arange(width)
    inside = np.arange(width) < size[rows][:, None]
    full = np.floor(scale * np.where(inside, x[np.where(inside, at, 0)] if len(x) else 0.0, 0.0))
    if full.size and np.abs(full).max() > LIMIT:
        raise ValueError(f"a component times {scale} is beyond {LIMIT}: scores of such vectors don't fit a long")
    return full.astype(np.int64), rows


def narrow(x: np.ndarray) -> np.ndarray:
    """x in the smallest integer type that holds it."""
    most = int(np.abs(x).max()) if x.size else 0
    return x.astype(np.int8 if most < 128 else np.int16 if most < 1 << 15 else np.int32)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b, as int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most >= 2.0**63:
        raise ValueError("inner products don't fit a long")
    if most < 2.0**53:  # all partial sums are whole numbers that doubles hold exactly
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def depth(n: int, leaf: int) -> int:
    return max(0, (-(-n // leaf) - 1).bit_length())


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    n = ends - starts
    if not n.sum():
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


@dataclass
class Level:
    bounds: np.ndarray
    count: np.ndarray
    sums: np.ndarray
    radius: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        return self.sums / self.count[:, None]


class Tree:
    """x must be in tree order (see ``order``); at least one row."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.x, n = x, len(x)
        wide, levels = x.astype(np.int64), []
        for h in range(depth(n, leaf) + 1):
            bounds = (np.arange((1 << h) + 1) * n) >> h
            count = np.diff(bounds)
            sums = np.add.reduceat(wide, bounds[:-1], axis=0)
            away = wide - np.repeat(sums / count[:, None], count, axis=0)
            radius = np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", away, away), bounds[:-1]))
            levels.append(Level(bounds, count, sums, radius * (1 + 1e-9) + 1e-9))
        self.levels: list[Level] = levels


def order(x: np.ndarray, leaf: int) -> np.ndarray:
    """The rows in tree order: every node is halved at the median of its widest dimension."""
    n, rows = len(x), np.arange(len(x))
    if not x.shape[1]:
        return rows
    for h in range(depth(n, leaf)):
        bounds = (np.arange((1 << h) + 1) * n) >> h
        here = x[rows]
        spread = np.maximum.reduceat(here, bounds[:-1], axis=0).astype(np.int64) - np.minimum.reduceat(here, bounds[:-1], axis=0)
        node = np.repeat(np.arange(1 << h), np.diff(bounds))
        rows = rows[np.lexsort((here[np.arange(n), spread.argmax(1)[node]], node))]
    return rows


def gathered(parts: Iterator[tuple], size: int) -> Iterator[tuple]:
    """Tuples of arrays of equally many rows, joined to runs of exactly size rows (the last one may be smaller)."""
    held: list[tuple] = []
    have = 0
    for part in parts:
        held.append(part)
        have += len(part[0])
        if have >= size:
            whole = tuple(joined(x) for x in zip(*held))
            while have >= size:
                yield tuple(x[:size] for x in whole)
                whole = tuple(x[size:] for x in whole)
                have -= size
            held = [whole]
    if have:
        yield tuple(joined(x) for x in zip(*held))


def joined(arrays: tuple[np.ndarray, ...]) -> np.ndarray:
    """The arrays one after the other; matrices of fewer columns are filled with zeros."""
    if arrays[0].ndim == 1:
        return np.concatenate(arrays)
    width = max(a.shape[1] for a in arrays)
    return np.concatenate([a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in arrays])

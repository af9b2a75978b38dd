"""Byte-level helpers over Arrow string columns, used inside tasks.

A block is the concatenated UTF-8 of some documents and the offsets that separate
them. Nulls count as empty. All hashes are fixed functions of the bytes, so every
task and every rerun computes the same values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEED = np.random.default_rng(20240607)
_TABLES = _SEED.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

#: The separators of words in every contract of this package: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets has one entry more than the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or at[0] == at[-1]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def groups(offsets: np.ndarray, limit: int):
    """Consecutive ranges (i, j) of documents with at most `limit` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as blocks need them."""

    def __init__(self, base: np.uint64):
        inverse = pow(int(base), -1, 2**64)
        self.base, self.inverse = base, np.uint64(inverse)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))


_POWERS = [_Powers(b) for b in _BASES]


class Prefix:
    """Prefix sums of a polynomial hash; `of(s, e)` is the hash of bytes (or of 64-bit hashes) s..e-1 for arrays of ranges."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.powers = _POWERS[which]
        self.powers.grow(len(data) + 1)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((_TABLES[which][data] if data.dtype == np.uint8 else data) * self.powers.up[: len(data)], out=self.sums[1:])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.sums[e] - self.sums[s]) * self.powers.down[s]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers, so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words of each document; first[i] is the index of document i's first word."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    opened = bounds[:-1][bounds[:-1] < n]
    begin[opened] |= inside[opened]  # a word never crosses into the next document
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | begin[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[0]..starts[0]+counts[0]-1, starts[1].. and so on, as one array."""
    total = int(counts.sum())
    if total == 0:
        return np.empty(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's LONG."""
    return x.view(np.int64)

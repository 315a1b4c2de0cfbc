"""Whole texts as flat byte arrays: words, word hashes and shingles without a Python loop over words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, in UTF-8. Hashes are polynomial
prefix sums modulo 2**64 with a finishing mix; equal words hash equally in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
SPAN = 1 << 19

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SPAN)
            inverse = pow(BASE, -1, 1 << 64)
            self.up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, BASE, U64)]), dtype=U64)
            self.down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, inverse, U64)]), dtype=U64)
        return self.up, self.down


POWERS = _Powers()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after another, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    first, last = int(at[0]), int(at[-1])
    if last == first:
        return np.zeros(0, np.uint8), at - first
    return np.frombuffer(data, np.uint8)[first:last], at - first


def released() -> None:
    """Give memory that Arrow and the C library hold for later back to the machine, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent outside the GNU C library
    if trim:
        trim(0)


def slices(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of values of about ``most`` bytes together; a longer value is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each value the index of its first word (n + 1 entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _IS_SPACE[data]
    before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
    before[1:] = space
    after[:-1] = space
    before[offsets] = True  # a value begins afresh
    after[offsets] = True
    starts = np.flatnonzero(~space & before[:-1])
    ends = np.flatnonzero(~space & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U64)
    first, n = 0, len(starts)
    while first < n:
        at = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, at + SPAN, "right")))
        to = int(ends[last - 1])
        up, down = POWERS.upto(to - at + 1)
        sums = np.zeros(to - at + 1, U64)
        np.cumsum((data[at:to].astype(U64) + U64(1)) * up[: to - at], out=sums[1:])
        s, e = starts[first:last] - at, ends[first:last] - at
        out[first:last] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        first = last
    return mix64(out)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each value, value after value, and n + 1 bounds.

    A value of fewer than k words, but at least one, has one shingle: all its words.
    """
    counts = np.diff(bounds)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    n = len(hashes)
    rolled = np.zeros(max(n - k + 1, 0), U64)
    factor = 1
    for j in range(k):
        rolled += hashes[j : n - k + 1 + j] * U64(factor) if n >= k else U64(0)
        factor = factor * BASE % (1 << 64)
    rolled = mix64(rolled)
    out = np.empty(int(out_bounds[-1]), U64)
    value = np.repeat(np.arange(len(counts)), sizes)
    at = np.arange(len(out)) - out_bounds[:-1][value] + bounds[:-1][value]
    full = counts[value] >= k
    out[full] = rolled[at[full]]
    for v in np.flatnonzero((counts > 0) & (counts < k)):
        total, factor = int(counts[v]), 1
        for h in hashes[bounds[v] : bounds[v + 1]].tolist():
            total, factor = (total + h * factor) % (1 << 64), factor * BASE % (1 << 64)
        out[out_bounds[v]] = mix64(np.array([total], U64))[0]
    return out, out_bounds


def bags(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each value's distinct shingles in ascending order, how often each occurs, and n + 1 bounds."""
    starts, ends, bounds = words(data, offsets)
    found, at = shingles(word_hashes(data, starts, ends), bounds, k)
    for v in range(len(at) - 1):
        found[at[v] : at[v + 1]].sort()
    fresh = np.ones(len(found), bool)
    fresh[1:] = found[1:] != found[:-1]
    fresh[at[:-1][np.diff(at) > 0]] = True
    where = np.flatnonzero(fresh)
    counts = np.diff(np.append(where, len(found)))
    return found[where], counts, np.searchsorted(where, at)

"""Vectorised word kernels that the Arrow-based operators share.

A batch of texts is handled as one flat UTF-8 buffer. Words are runs of bytes
outside a separator class; as every class used here consists of ASCII bytes
only, cutting the bytes gives the same words as cutting the characters. Each
word gets a 64-bit hash (random byte table, polynomial positions modulo 2**64,
then an avalanche step), computed with prefix sums and so without a Python
loop. Long texts are read piece by piece, cut between two words, so memory
stays bounded by PIECE bytes and not by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes and rows handled at once.
PIECE = 1 << 21
ROWS = 4096

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_TABLE = _TABLE.copy()
_LOWER_TABLE[65:91] = _TABLE[97:123]

#: Separators of white-space words: space and \x09-\x0D.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Separators of alphanumeric words: ASCII bytes other than digits and letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = False
NOT_ALNUM[65:91] = False
NOT_ALNUM[97:123] = False


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_pow = _inv = np.ones(1, np.uint64)


def _grown(n: int) -> None:
    global _pow, _inv
    if len(_pow) < n:
        _pow = _powers(int(_BASE), n)
        _inv = _powers(pow(int(_BASE), -1, 1 << 64), n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche step on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of the rows first..first+n-1: row i has hashes[ptr[i]:ptr[i+1]]."""

    first: int
    n: int
    hashes: np.ndarray
    ptr: np.ndarray

    def row_of(self) -> np.ndarray:
        """For each word, its row's index from 0."""
        return np.repeat(np.arange(self.n), np.diff(self.ptr))


def _piece(buf: np.ndarray, bounds: np.ndarray, sep: np.ndarray, lower: bool, prefix: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in buf, and for each bound how many words start before it."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    _grown(n)
    cut = sep[buf]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = ~cut
    last = start.copy()
    start[1:] &= cut[:-1] | edge[1:n]
    last[:-1] &= cut[1:] | edge[1:n]
    starts, lasts = np.flatnonzero(start), np.flatnonzero(last)
    if prefix:
        lasts = np.minimum(lasts, starts + prefix - 1)
    value = (_LOWER_TABLE if lower else _TABLE)[buf]
    value *= _pow[:n]
    head = value[starts]
    np.cumsum(value, out=value)
    hashes = (value[lasts] - value[starts] + head) * _inv[starts]
    hashes += (lasts - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(hashes), np.searchsorted(starts, bounds)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(column: pa.Array, sep: np.ndarray = WHITE, lower: bool = False, prefix: int | None = None) -> Iterator[Words]:
    """The hashed words of a column of texts, or the hashes of their first `prefix` bytes, some rows at a time."""
    data, at = flat(column)
    n, i = len(column), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        j = min(j, n, i + ROWS)
        if at[j] - at[i] <= PIECE:
            hashes, ptr = _piece(data[at[i] : at[j]], at[i : j + 1] - at[i], sep, lower, prefix)
        else:  # one text that is longer than a piece
            parts, a, end = [], int(at[i]), int(at[j])
            while a < end:
                b = min(a + PIECE, end)
                while b < end and not sep[data[b]]:
                    step = np.flatnonzero(sep[data[b : b + PIECE]])
                    b = min(end, b + (int(step[0]) if len(step) else PIECE))
                parts.append(_piece(data[a:b], np.array([0, b - a]), sep, lower, prefix)[0])
                a = b
            hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            ptr = np.array([0, len(hashes)])
        yield Words(i, j - i, hashes, ptr)
        i = j


_WEIGHT = _powers(int(_BASE) ^ 0x5851F42D4C957F2C, 4096)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words in flat order, and whether each lies within one row.

    The run that begins at flat word i is at index i; there are len(hashes)-k+1
    runs (none if there are fewer words).
    """
    m = len(w.hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = w.hashes[:m].copy()
    for j in range(1, k):
        out *= np.uint64(0xD1342543DE82EF95)
        out += w.hashes[j : m + j]
    within = np.ones(m, bool)
    for end in w.ptr[1:-1]:  # runs that cross the end of a row
        within[max(0, end - k + 1) : end] = False
    return mix(out), within


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values (doubling steps)."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x

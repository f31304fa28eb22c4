"""Words and word hashes straight from Arrow string buffers.

Texts stay UTF-8 bytes: a column's rows lie one after another in one buffer, so
splitting and hashing are a few array operations over many rows at once and no
Python string is made.  Every function works on a *chunk*: consecutive rows of
about ``CHUNK`` bytes (a longer row is a chunk of its own), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
#: Bytes hashed at a time, so that the 8-byte prefix sums stay in the CPU cache.
SPAN = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _table(pick) -> np.ndarray:
    return np.array([pick(b) for b in range(256)], dtype=bool)


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased; every byte of a non-ASCII character is 0x80 or above.
ALNUM = _table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: [^\x20\x09-\x0D]
NONSPACE = _table(lambda b: b != 32 and not 9 <= b <= 13)


@dataclass
class Chunk:
    """Rows ``first`` to ``first + rows`` of a column: their bytes and each row's begin (one more at the end)."""

    first: int
    buf: np.ndarray
    at: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.at) - 1


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """A string column in chunks; a null row is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield Chunk(row, buf[at[row] : at[end]], at[row : end + 1] - at[row])
        row = end


@dataclass
class Words:
    """Words of a chunk: byte ranges, and each row's first word (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row) - 1), self.counts)


def words(chunk: Chunk, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of a kind (a table of 256 booleans), never across rows."""
    inside = kind[chunk.buf]
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(chunk.at), np.int64))
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[chunk.at] = True
    start = inside & edge[:-1]
    start[1:] |= inside[1:] & ~inside[:-1]
    end = inside & edge[1:]
    end[:-1] |= inside[:-1] & ~inside[1:]
    begins = np.flatnonzero(start)
    return Words(begins, np.flatnonzero(end) + 1, np.searchsorted(begins, chunk.at))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        both = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, b, _U)]), dtype=_U) for b in (_BASE, inverse)]
    return both[0], both[1]


def word_hashes(buf: np.ndarray, w: Words, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of each word's folded bytes, the same wherever the word stands."""
    out = np.empty(len(w), _U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(w):
            base = int(w.start[i])
            j = max(i + 1, int(np.searchsorted(w.end, base + SPAN, "right")))
            j = min(j, len(w))
            last = int(w.end[j - 1])
            size = last - base
            power, inverse = _powers(SPAN) if size <= SPAN else _powers(1 << size.bit_length())
            sums = np.empty(size + 1, _U)
            sums[0] = 0
            np.cumsum((fold[buf[base:last]].astype(_U) + _U(1)) * power[:size], out=sums[1:])
            a, b = w.start[i:j] - base, w.end[i:j] - base
            out[i:j] = (sums[b] - sums[a]) * inverse[a]
            i = j
        return mix(out + (w.end - w.start).astype(_U))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on (all but the last ``size - 1``); callers skip those that cross rows."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        total = hashes[:n].copy()
        for t in range(1, size):
            total *= _U(_BASE)
            total += hashes[t : t + n]
        return mix(total + _U(size))


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct values of two ascending arrays, ascending."""
    x = np.sort(np.concatenate([a, b]), kind="stable")
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def within(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each value whether it is in an ascending array."""
    at = np.searchsorted(of, x)
    return (at < len(of)) & (of[np.minimum(at, len(of) - 1)] == x) if len(of) else np.zeros(len(x), bool)


def same_bytes(a: np.ndarray, a0: np.ndarray, a1: np.ndarray, b: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """For each i, whether a[a0:a1] equals b[b0:b1] after folding A-Z."""
    size = a1 - a0
    same = size == b1 - b0
    pick = np.flatnonzero(same & (size > 0))
    if len(pick):
        n = size[pick]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differs = LOWER[a[np.repeat(a0[pick], n) + step]] != LOWER[b[np.repeat(b0[pick], n) + step]]
        same[pick] &= np.add.reduceat(differs, np.cumsum(n) - n) == 0
    return same

"""Token ids of the lower-casing word BPE, and where sentences end.

White space never reaches that tokenizer's model, and its pre-tokenizer splits words, digits
and punctuation before merging, so a text's ids are those of its *units* one after another.  Units are found on the
bytes of many texts at once and named by a 64-bit hash; a worker keeps the ids of units it has met in a table of ``SLOTS``
places (a unit that another has pushed out is encoded again) and encodes what it misses once per chunk.  Units of over ``LONG``
bytes are never looked up by their hash.

Units of ASCII and Latin letters go to the merges as they are.  A white-space chunk with any other character
(or one that normalisation changes, or a special token's ``<|``) is one unit, encoded by the tokenizer itself.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from annolith.llm import _bytes as B

SLOTS = 1 << 20
#: Ids kept for all units of the table; beyond that it starts anew.
KEPT = 1 << 21
LONG = 64
_STOP = re.compile(r"[.!?…。！？]")
_U = np.uint64
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.array(
    [_SPACE if b in (9, 10, 11, 12, 13, 32) else _DIGIT if 48 <= b <= 57 else _LETTER if chr(b).isalpha() or b >= 128 else _SIGN if 33 <= b <= 126 else _OTHER for b in range(256)],
    dtype=np.uint8,
)
_SAME = np.arange(256, dtype=np.uint8)


def _pairs() -> tuple[np.ndarray, np.ndarray]:
    """For U+00C0 to U+017F by number: whether it is a plain letter, and the two bytes of its lower case."""
    plain, lower = np.zeros(192, bool), np.zeros((192, 2), np.uint8)
    for i, c in enumerate(map(chr, range(0xC0, 0x180))):
        plain[i] = c not in "×÷İ"
        lower[i] = list((c.lower() if plain[i] else c).encode())
    return plain, lower


_PLAIN, _LOWER = _pairs()
# byte-level BPE's characters: printable bytes stand for themselves, the others for 256 on
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b if b in _SELF else 256 + sum(c not in _SELF for c in range(b)) for b in range(256)}
_workers: dict[str, Encoder] = {}


def _kinds(chunk: B.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Each byte's kind, and the bytes in lower case (those of other chunks stay)."""
    buf = chunk.buf
    kind, out = _KIND[buf], B.LOWER[buf]
    high = np.flatnonzero(buf >= 128)
    odd = [np.flatnonzero(kind == _OTHER)]
    if len(high):
        lead = high[(buf[high] >= 0xC3) & (buf[high] <= 0xC5)]
        number = (buf[lead].astype(np.int64) - 0xC3) * 64 + (buf[lead + 1] - 0x80)
        good = _PLAIN[number]
        lead, number = lead[good], number[good]
        covered = np.zeros(len(buf), bool)
        covered[lead] = covered[lead + 1] = True
        odd.append(high[~covered[high]])
        out[lead], out[lead + 1] = _LOWER[number].T
    mark = np.flatnonzero(buf[:-1] == 60)  # the special tokens' <|
    odd.append(mark[buf[mark + 1] == 124])
    at = np.concatenate(odd)
    if len(at):
        w = B.words(chunk, B.NONSPACE)
        hit = np.unique(np.searchsorted(w.start, at, "right") - 1)
        hit = hit[hit >= 0]
        step = np.zeros(len(buf) + 1, np.int8)
        step[w.start[hit]] += 1
        step[w.end[hit]] -= 1
        whole = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        kind[whole] = _OTHER
        out[whole] = buf[whole]
    return kind, out


def units(chunk: B.Chunk) -> tuple[B.Words, np.ndarray, np.ndarray]:
    """Units as byte ranges by row, their kinds, and the lower-cased bytes that they are ranges of."""
    kind, low = _kinds(chunk)
    n = len(kind)
    edge = np.zeros(n + 1, bool)
    edge[chunk.at] = edge[0] = edge[n] = True
    edge[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    at = np.flatnonzero(edge)
    start, end = at[:-1].copy(), at[1:].copy()
    own = kind[start]
    # contractions: a quote that begins a run takes one or two letters of the next
    quote = np.flatnonzero((own[:-1] == _SIGN) & (own[1:] == _LETTER) & (low[start[:-1]] == 39) & (end[:-1] - start[:-1] == 1))
    if len(quote):
        quote = quote[~np.isin(start[quote + 1], chunk.at)]
        first = low[end[quote]]
        second = np.where(end[quote] + 1 < end[quote + 1], low[np.minimum(end[quote] + 1, n - 1)], 0)
        one = np.isin(first, list(b"stmd"))
        two = ((first == ord("r")) & (second == ord("e"))) | ((first == ord("v")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        took = one + 2 * (two & ~one)
        end[quote] += took
        start[quote + 1] += took
    pick = (own != _SPACE) & (start < end)
    start, end, own = start[pick], end[pick], own[pick]
    return B.Words(start, end, np.searchsorted(start, chunk.at)), own, low


class Encoder:
    """Ids and sentence ends of many texts at once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._reset()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def _reset(self) -> None:
        """Forget all units.  A place holds a unit's hash, where its ids begin, and twice their number (one more if it ends a sentence)."""
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.key, self.at, self.size = (np.zeros(SLOTS, t) for t in (_U, np.int32, np.int32))

    def _ids(self, unit: bytes, other: bool) -> list[int]:
        if other:
            return self.tokenizer.encode(unit.decode(), add_special_tokens=False).ids
        return [t.id for t in self.tokenizer.model.tokenize(unit.decode("latin-1").translate(_BYTES))]

    def _learn(self, w: B.Words, rows: np.ndarray, kind: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids' beginnings and sizes of the units ``rows``, whose ids are added."""
        data = low.tobytes()
        text = [data[a:b] for a, b in zip(w.start[rows].tolist(), w.end[rows].tolist(), strict=True)]
        found = [self._ids(t, k == _OTHER) for t, k in zip(text, kind[rows].tolist(), strict=True)]
        stop = [k >= _SIGN and not (u := t.decode())[0].isalnum() and _STOP.search(u) is not None for t, k in zip(text, kind[rows].tolist(), strict=True)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(n) - n
        self.used += len(ids)
        return at, 2 * n + np.array(stop, np.int64)

    def encode_chunk(self, chunk: B.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the chunk's rows, each row's end among them, and the places (in all ids) where a sentence ends within a row."""
        if self.used > KEPT:
            self._reset()
        w, kind, low = units(chunk)
        if not len(w):
            return np.zeros(0, np.uint32), np.zeros(chunk.rows, np.int64), np.zeros(0, np.int64)
        h = B.word_hashes(low, w, _SAME) | _U(1)
        slot = h >> _U(64 - SLOTS.bit_length() + 1)
        long = w.end - w.start > LONG
        missed = np.flatnonzero((self.key[slot] != h) & ~long)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        if len(missed):
            _, first, which = np.unique(h[missed], return_index=True, return_inverse=True)
            rows = missed[first]
            new_at, new_size = self._learn(w, rows, kind, low)
            self.key[slot[rows]], self.at[slot[rows]], self.size[slot[rows]] = h[rows], new_at, new_size
            at[missed], size[missed] = new_at[which], new_size[which]
        if long.any():
            rows = np.flatnonzero(long)
            at[rows], size[rows] = self._learn(w, rows, kind, low)
        n = size >> 1
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(at - ends[:-1], n) + np.arange(ends[-1])]
        lines = np.searchsorted(w.start, np.flatnonzero(chunk.buf == 10))
        stops = B.merged(ends[1:][(size & 1) == 1], ends[lines])
        return ids, ends[w.row[1:]], stops[stops > 0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of texts."""
        ids, ends, stops, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for chunk in B.chunks(pa.array(texts, pa.string())):
            i, e, s = self.encode_chunk(chunk)
            ids.append(i)
            ends.append(e + n)
            stops.append(s + n)
            n += len(i)
        return np.concatenate(ids), np.concatenate(ends), np.concatenate(stops)

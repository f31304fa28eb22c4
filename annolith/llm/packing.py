"""Order-preserving packing by dynamic programming with a monotone queue.

Documents are laid one after another in the order in which they are stored, and the stream of
their ids is cut into windows of at most ``length`` ids.  Candidates for a cut are document ends
(free) and sentence ends (``sentence_penalty``); where none lies within ``hard_every`` ids, places
within a sentence (``hard_penalty``).  A window costs its padding (none if its length is a power of two)
plus its cut's penalty plus 1.  With p a candidate's place, the cheapest last window before j costs

    length - p[j] + min over i of (best[i] + p[i]),  p[j] - length <= p[i] < p[j],

a minimum over a sliding range, which a monotone queue gives in constant time; windows of a power of two are
looked up beside it.  Each task packs its own rows in blocks of about ``block`` ids and carries
the last window over to the next block, so memory is bounded and nothing is shuffled.  A task's
windows depend on its rows alone, so a lost task gives the same again.

Cases: null and empty texts are the end id alone.  Null ids and repeated rows are packed like others.
Other columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.llm import _bytes as B
from annolith.llm._store import bounded, tidied
from annolith.llm.tokens import Encoder

LENGTH = 2048
END_ID = 1
FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(places: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Indices of the candidates to cut at; places ascend, none is farther than ``length`` from the one before, and the last is always cut."""
    n = len(places)
    p = np.concatenate([[0], places])
    # pairs of candidates a power of two apart
    later, earlier = [], []
    k = 1
    while k <= length:
        at = np.searchsorted(p, p - k)
        hit = np.flatnonzero((p >= k) & (p[np.minimum(at, n)] == p - k))
        later.append(hit)
        earlier.append(at[hit])
        k *= 2
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(later, kind="stable")
    later, earlier = later[order].tolist(), earlier[order].tolist()
    later.append(n + 1)
    place, fine = p.tolist(), [0, *penalties.tolist()]
    best, came = [0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[float, int]] = deque([(0, 0)])  # (best + place, index), values ascend
    x = 0
    for j in range(1, n + 1):
        here = place[j]
        while place[queue[0][1]] < here - length:
            queue.popleft()
        value, i = queue[0]
        value += length - here
        while later[x] == j:
            if best[earlier[x]] < value:
                i = earlier[x]
                value = best[i]
            x += 1
        value += fine[j] + 1
        best[j], came[j] = value, i
        value += here
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], n
    while j:
        cuts.append(j - 1)
        j = came[j]
    return cuts[::-1]


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, sentence_penalty: int, hard_penalty: int, hard_every: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and penalties; gaps of over ``hard_every`` are filled with places within the sentence."""
    places = B.merged(doc_ends, sentence_ends[sentence_ends < doc_ends[-1]])
    places = places[places > 0]
    gap = np.diff(places, prepend=0)
    wide = np.flatnonzero(gap > hard_every)
    if len(wide):
        places = B.merged(places, np.concatenate([np.arange(places[i] - gap[i] + hard_every, places[i], hard_every) for i in wide]))
    penalty = np.full(len(places), hard_penalty)
    penalty[B.within(places, sentence_ends)] = sentence_penalty
    penalty[B.within(places, doc_ends)] = 0
    return places, penalty


class _Packer:
    def __init__(self, first_sequence: int, length: int, sentence_penalty: int, hard_penalty: int, hard_every: int):
        self.sequence, self.length, self.rule = first_sequence, length, (sentence_penalty, hard_penalty, hard_every)
        self.ids = np.zeros(0, np.uint32)
        self.keys: list = []
        self.begin, self.end, self.stops = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, keys: list, ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> None:
        """Documents by their ids (each ending with the end id)."""
        n = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        self.keys += keys
        self.begin = np.concatenate([self.begin, n + ends - np.diff(ends, prepend=0)])
        self.end = np.concatenate([self.end, n + ends])
        self.stops = np.concatenate([self.stops, n + stops])

    def pack(self, last: bool):
        """Pieces of all windows but, unless this is the last call, the last one, which stays."""
        cuts = best_cuts(*(c := candidates(self.end, self.stops, *self.rule)), self.length)
        cut = c[0][cuts]
        if not last:
            cut = cut[:-1]
        done = int(cut[-1]) if len(cut) else 0
        if done:
            bounds = B.merged(cut, self.end[self.end < done])
            start = np.concatenate([[0], bounds[:-1]])
            doc = np.searchsorted(self.end, start, "right")
            window = np.searchsorted(cut, start, "right")
            base = np.concatenate([[0], cut[:-1]])[window]
            raw = self.ids[:done].astype("<u4").tobytes()
            crc = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(start.tolist(), bounds.tolist(), strict=True)]
            yield [self.keys[i] for i in doc.tolist()], start - self.begin[doc], bounds - start, np.array(crc, np.int64), (self.end - self.begin)[doc], self.sequence + window, start - base
            self.sequence += len(cut)
        keep = int(np.searchsorted(self.end, done, "right"))
        self.ids, self.keys = self.ids[done:], self.keys[keep:]
        self.begin, self.end = self.begin[keep:] - done, self.end[keep:] - done
        self.stops = self.stops[self.stops > done] - done


def packed_pieces(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, sentence_penalty: int = 4, hard_penalty: int = 32, hard_every: int = 256, block: int = 1 << 18
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of the tokenizer's file, the same on all executors.
    """
    hard_every = min(hard_every, length)
    docs = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[0].dataType

    def run(batches):
        from pyspark import TaskContext

        encoder = Encoder.of(tokenizer)
        packer = _Packer(TaskContext.get().partitionId() << 40, length, sentence_penalty, hard_penalty, hard_every)

        def out(last):
            for keys, *columns in packer.pack(last):
                yield pa.RecordBatch.from_arrays([pa.array(keys, types), *[pa.array(c.astype(np.int64)) for c in columns]], names)

        types, names = None, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            types = batch.column(0).type
            keys = batch.column(0).to_pylist()
            for chunk in B.chunks(batch.column(1)):
                ids, ends, stops = encoder.encode_chunk(chunk)
                n = chunk.rows
                full = np.empty(len(ids) + n, np.uint32)
                shift = np.repeat(np.arange(n), np.diff(ends, prepend=0))
                full[np.arange(len(ids)) + shift] = ids
                full[ends + np.arange(n)] = end_id
                stops = stops + np.searchsorted(ends, stops, "left")
                packer.add(keys[chunk.first : chunk.first + n], full, ends + np.arange(1, n + 1), stops)
                if len(packer.ids) >= block:
                    yield from out(False)
        if len(packer.ids):
            yield from out(True)

    return docs.mapInArrow(tidied(run), f"doc_id {kind.simpleString()}, {FIELDS}")

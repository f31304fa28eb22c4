"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A *window* is ``window`` consecutive words of a benchmark item (an item of fewer
words, but not none, is one window).  A window is a set of positioned shingles
of ``shingle`` words.  As every shingle of a window must occur for the window to
occur, its necessary prefix under any order is one shingle; the order is rarity,
counted over **all** documents.  Documents look up only these rarest shingles,
a hit fixes where the window would have to begin, positional and length bounds
discard what would leave the document, and the survivors are compared word by
word and byte by byte.

The benchmark is read in blocks of at most ``block_words`` words (a stated query
set against all rows), each a broadcast of bounded size (about 70 bytes a word).  Rarity is counted for ``count_words`` words of
blocks in one pass over the documents; then documents pass all blocks one after another in one stage, without a shuffle.
A benchmark of w words so takes 1 + w / ``count_words`` passes, and the driver holds no more than the blocks of one counting pass.

Cases: null and empty texts have no words and no hits.  Null item ids count as
the empty string; rows that repeat an item id are one item.  Repeated document
rows each get their own row of the result; other columns are ignored, whatever
their names.  An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolith.llm import _bytes as B
from annolith.llm._store import bounded, tidied

BLOCK_WORDS = 250_000
COUNT_WORDS = 1_000_000
_STATE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW_STATE = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


@dataclass
class Lookup:
    """Sorted keys with a table of about sixteen bits a key, by the keys' upper bits."""

    keys: np.ndarray
    sieve: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, keys: np.ndarray) -> Lookup:
        bits = max(10, (16 * len(keys)).bit_length())
        sieve = np.zeros(1 << bits, bool)
        sieve[keys >> np.uint64(64 - bits)] = True
        return cls(keys, sieve, np.uint64(64 - bits))

    def find(self, sought: np.ndarray) -> np.ndarray:
        """Where keys that are held stand in ``sought``."""
        at = np.flatnonzero(self.sieve[sought >> self.shift])
        place = np.searchsorted(self.keys, sought[at])
        return at[self.keys[np.minimum(place, len(self.keys) - 1)] == sought[at]]


@dataclass
class Block:
    """Words of some items and the distinct windows among them: first word, size, and which items have it (``owner[owner_at[i] : owner_at[i + 1]]``)."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    size: np.ndarray
    items: list[str]
    owner: np.ndarray
    owner_at: np.ndarray
    shingle: int
    #: by shingle size: keys (sorted, may repeat), their windows and places within them
    index: dict[int, tuple[Lookup, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @property
    def words(self) -> int:
        return len(self.start)

    def shingles(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle size: keys, windows and places of all shingles of all windows."""
        found: dict[int, list] = {}
        for length in np.unique(self.size):
            rows = np.flatnonzero(self.size == length)
            k = min(self.shingle, int(length))
            s = B.shingle_hashes(self.hashes, k)
            for place in range(int(length) - k + 1):
                found.setdefault(k, []).append((s[self.first[rows] + place], rows, np.full(len(rows), place)))
        return {k: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for k, parts in found.items()}

    def watch_rarest(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> Block:
        """Look up each window's rarest shingle only; counts: by shingle size, sorted keys and how often they occur."""
        self.index = {}
        for k, (keys, rows, places) in self.shingles().items():
            known, n = counts.get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            seen = np.where(B.within(keys, known), n[np.minimum(np.searchsorted(known, keys), len(known) - 1)], 0) if len(known) else np.zeros(len(keys), np.int64)
            order = np.lexsort((keys, seen, rows))
            first = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
            first = first[np.argsort(keys[first], kind="stable")]
            self.index[k] = Lookup.of(keys[first]), rows[first], places[first]
        return self

    def owners(self, windows: np.ndarray) -> set[str]:
        return {self.items[o] for x in windows for o in self.owner[self.owner_at[x] : self.owner_at[x + 1]]}


def make_block(items: list[tuple[str, str]], window: int, shingle: int) -> Block | None:
    """Windows of (id, text) pairs; None if there are no words."""
    chunk = next(B.chunks(pa.array([t or "" for _, t in items], pa.string()), 1 << 60), None)
    if chunk is None or not len(chunk.buf):
        return None
    w = B.words(chunk, B.ALNUM)
    if not len(w):
        return None
    h = B.word_hashes(chunk.buf, w)
    size = np.minimum(window, w.counts)
    n = np.where(size > 0, w.counts - size + 1, 0)
    item = np.repeat(np.arange(len(items)), n)
    first = np.repeat(w.row[:-1], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    size = size[item]
    # windows of the same words are one
    same = np.arange(len(first))
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        key = B.shingle_hashes(h, int(length))[first[rows]]
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        a, b = rows, rows[one[which]]
        span = np.arange(int(length))
        x, y = (first[a][:, None] + span).ravel(), (first[b][:, None] + span).ravel()
        equal = B.same_bytes(chunk.buf, w.start[x], w.end[x], chunk.buf, w.start[y], w.end[y]).reshape(len(rows), -1).all(axis=1)
        same[rows] = np.where(equal, b, a)
    kept, which = np.unique(same, return_inverse=True)
    names = {name: i for i, name in enumerate(sorted({i or "" for i, _ in items}))}
    own = np.unique(np.stack([which, np.array([names[i or ""] for i, _ in items], dtype=np.int64)[item]]), axis=1)
    return Block(chunk.buf.copy(), w.start, w.end, h, first[kept], size[kept], list(names), own[1], np.searchsorted(own[0], np.arange(len(kept) + 1)), shingle)


def blocks(items: DataFrame, item_id: str, text: str, window: int, shingle: int, block_words: int) -> Iterator[Block]:
    """Items in blocks of bounded size, one partition's rows on the driver at a time.  An item longer than a block is cut, with windows overlapping the cut."""
    held: list[tuple[str, str]] = []
    size = 0
    for item, body in items.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        for part in _cut(body or "", window, block_words):
            n = len(part) // 2
            if held and size + n > block_words:
                if (b := make_block(held, window, shingle)) is not None:
                    yield b
                held, size = [], 0
            held.append((item, part))
            size += n
    if held and (b := make_block(held, window, shingle)) is not None:
        yield b


def _cut(text: str, window: int, block_words: int) -> Iterator[str]:
    if len(text) <= block_words * 2:
        yield text
        return
    chunk = next(B.chunks(pa.array([text], pa.string()), 1 << 60))
    w = B.words(chunk, B.ALNUM)
    for s in range(0, max(1, len(w) - window + 1), block_words):
        e = min(len(w), s + block_words + window - 1)
        if e > s:
            yield chunk.buf[w.start[s] : w.end[e - 1]].tobytes().decode()


def _lookups(held: dict[int, Lookup], w: B.Words, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shingle size, word places, their keys) of document shingles that are looked up."""
    last = np.repeat(w.row[1:], w.counts)
    for k, lookup in held.items():
        s = B.shingle_hashes(h, k)
        place = lookup.find(s)
        place = place[place + k <= last[place]]
        if len(place):
            yield k, place, s[place]


def occurrences(block: Block, buf: np.ndarray, w: B.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and windows of all occurrences of the block's windows."""
    first, which = [], []
    row_of = w.row_of()
    for k, place, key in _lookups({k: x[0] for k, x in block.index.items()}, w, h):
        lookup, windows, offsets = block.index[k]
        lo, hi = np.searchsorted(lookup.keys, key, "left"), np.searchsorted(lookup.keys, key, "right")
        n = hi - lo
        entry = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        begin, win = np.repeat(place, n) - offsets[entry], windows[entry]
        row, size = row_of[np.repeat(place, n)], block.size[win]
        fits = (begin >= w.row[row]) & (begin + size <= w.row[row + 1])
        begin, win, size = begin[fits], win[fits], size[fits]
        for length in np.unique(size):
            b, x = begin[size == length], win[size == length]
            span = np.arange(int(length))
            same = (h[b[:, None] + span] == block.hashes[block.first[x][:, None] + span]).all(axis=1)
            b, x = b[same], x[same]
            if len(b):
                place2, theirs = (b[:, None] + span).ravel(), (block.first[x][:, None] + span).ravel()
                ok = B.same_bytes(buf, w.start[place2], w.end[place2], block.buf, block.start[theirs], block.end[theirs]).reshape(len(b), -1).all(axis=1)
                first.append(b[ok])
                which.append(x[ok])
    if not first:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate(first), np.concatenate(which)


def _runs(covered: np.ndarray) -> np.ndarray:
    """Begins and ends of runs of true, alternating."""
    return np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))


def _mark(block: Block, texts: pa.Array, state: list[dict | None]) -> list[dict]:
    """State of each row after the block: words, covered word ranges, ids of occurring items."""
    out: list[dict] = []
    for chunk in B.chunks(texts):
        w = B.words(chunk, B.ALNUM)
        h = B.word_hashes(chunk.buf, w)
        first, which = occurrences(block, chunk.buf, w, h)
        row = np.searchsorted(w.row, first, "right") - 1
        order = np.argsort(row, kind="stable")
        bounds = np.searchsorted(row[order], np.arange(chunk.rows + 1))
        for i in range(chunk.rows):
            old = state[chunk.first + i] or {"spans": [], "items": []}
            here = order[bounds[i] : bounds[i + 1]]
            if len(here):
                a = int(w.row[i])
                step = np.zeros(int(w.row[i + 1]) - a + 1, np.int64)
                np.add.at(step, first[here] - a, 1)
                np.add.at(step, first[here] - a + block.size[which[here]], -1)
                for s, e in zip(old["spans"][::2], old["spans"][1::2], strict=True):
                    step[s] += 1
                    step[e] -= 1
                ids = block.owners(np.unique(which[here])) | set(old["items"])
                old = {"spans": _runs(np.cumsum(step)[:-1] > 0).tolist(), "items": sorted(ids)}
            out.append({"n_words": int(w.row[i + 1] - w.row[i])} | {k: old[k] for k in ("spans", "items")})
    return out


def _rarity(docs: DataFrame, text: str, found: list[Block]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By shingle size: the blocks' shingles, sorted, and how often each occurs in all documents."""
    held: dict[int, list[np.ndarray]] = {}
    for block in found:
        for k, (keys, _, _) in block.shingles().items():
            held.setdefault(k, []).append(keys)
    watched = docs.sparkSession.sparkContext.broadcast({k: Lookup.of(np.unique(np.concatenate(v))) for k, v in held.items()})

    def count(batches):
        for batch in batches:
            for chunk in B.chunks(batch.column(0)):
                w = B.words(chunk, B.ALNUM)
                for k, _, key in _lookups(watched.value, w, B.word_hashes(chunk.buf, w)):
                    keys, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k), pa.int32()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "key", "n"])

    counted = docs.select(F.col(text)).mapInArrow(tidied(count), "k int, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # no more rows than the blocks have shingles
    size, key, n = (table.column(c).to_numpy() for c in ("k", "key", "n"))
    out = {}
    for k in np.unique(size):
        mine = size == k
        order = np.argsort(key[mine].view(np.uint64))
        out[int(k)] = key[mine].view(np.uint64)[order], n[mine][order]
    return out


def contaminated_spans(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5, block_words: int = BLOCK_WORDS, count_words: int = COUNT_WORDS, into: str = "hits") -> DataFrame:
    """``docs`` with a struct ``into``: n_words, covered word ranges (begin, end alternating) and sorted ids of occurring items.

    A column of ``docs`` that is called ``into`` already is replaced.
    """
    shingle = min(shingle, window)
    out = bounded(docs).drop(into)
    schema = T.StructType([*out.schema.fields, T.StructField(into, _STATE)])
    at = out.columns.index(text)
    out = out.withColumn(into, F.lit(None).cast(_STATE))
    context = docs.sparkSession.sparkContext
    held: list[Block] = []

    def marked(out: DataFrame) -> DataFrame:
        counts = _rarity(docs, text, held)
        for block in held:
            out = out.mapInArrow(_marker(context.broadcast(block.watch_rarest(counts)), at), schema)
        held.clear()
        return out

    none = True
    for block in blocks(items, item_id, item_text, window, shingle, block_words):
        none = False
        held.append(block)
        if sum(b.words for b in held) >= count_words:
            out = marked(out)
    if held:
        out = marked(out)
    if none:
        nothing = np.zeros(0, np.int64)
        out = out.mapInArrow(_marker(context.broadcast(Block(*[nothing] * 6, [], nothing, np.zeros(1, np.int64), shingle)), at), schema)
    return out


def _marker(block, at: int):
    def mark(batches):
        for batch in batches:
            state = _mark(block.value, batch.column(at), batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(state, _ARROW_STATE)], batch.schema.names)

    return tidied(mark)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs."""
    name = "__annolith_hits"
    return contaminated_spans(docs, items, into=name, **options).filter(F.size(f"{name}.items") == 0).drop(name)


def contamination_report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    text = options.get("text", "text")
    hit = contaminated_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, **options | {"text": "text"})
    n = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda s, x: x - s)  # e - (b - s) over begins b and ends e
    return hit.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hits.items")).cast("binary"), 256).alias("items_sha256"),
        (F.size("hits.spans") > 0).alias("contaminated"),
    )


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()

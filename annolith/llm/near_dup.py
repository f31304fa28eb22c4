"""N-gram Jaccard join by count vectors in R-trees.

A document is the set of its distinct shingles.  Two documents link when
``100 * |A & B| >= percent * |A | B|``; the result names the connected component.

The method hashes shingles into groups, takes the counts per group as a point,
keeps points in an R-tree, bounds a pair's (or subtree's) overlap by the sum of
coordinate minima and verifies what survives on the sets themselves.  A tree is
in one task's memory, so the points are dealt to trees first, by a lossless rule
over the same kind of groups (``Dealer``): sets that link differ in few shingles, so they
agree on all that several pairs of groups hold.  Sets
that agree on enough belong to one *block* (transitively) and a block is one tree.  The more sets there are, the more of them passages chain to one
large block, so one of over ``block_sets`` sets is split by its rarest shingles first (``_rare_shingles``, lossless too); what is as large even then is
several trees, of which those sets that aren't joined yet meet all others.

What moves: narrow (document, set key) rows; 17 bytes for each signature of each
distinct set, combined per task before the shuffle so that a signature that very many sets
share is sent once per task; for sets in a block with another set only, the sets; and, for those in large blocks, 20 bytes for each shingle and 22 back
for each that another set of the block has.  Copies are one set, so they are never expanded into pairs.

Cases: null texts, empty texts and texts without words have an empty set, link
with nothing and are their own component.  Texts with fewer words than a shingle
are one shingle.  Repeated rows (also with one id) are copies.  A null id takes
part, but never is a component's name unless no member has an id.  Other columns
are ignored, whatever their names.  Sets and shingles are compared by 64-bit
hashes: among 10^9 distinct sets the chance that any two share a key is 3 %.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolith.llm import _bytes as B
from annolith.llm import _sieve
from annolith.llm._store import bounded, cut, forget, swept, tidied
from annolith.llm.components import labelled, named

_U = np.uint64
#: Below so many shingles sets are dealt by choices of FEW of their smallest hashes.
SMALL = 24
FEW = 4
#: Linked sets agree on so many signatures (but those of few shingles, of which they share one).
AGREE = 3
#: Sets that have a signature of more sets are not compared in pairs for it.
MANY = 64
#: Upper ends of the size classes grow by this factor.
RATIO = 1.6
BLOCK_SETS = 4000
#: Sets of a part's largest component that meet those of other parts first.
SAMPLE = 32
BUCKET_BYTES = 4 << 20
FLUSH_BYTES = 12 << 20
#: The filter of keys has eight bits for each, but no more than these (32 MB).
_BLOOM_BITS = 1 << 28


def _ceil(a, b):
    return -(-a // b)


def needed(n, m, percent):
    """Least overlap with which sets of n and m shingles link."""
    return _ceil(percent * (n + m), 100 + percent)


def shingle_sets(texts: pa.Array, size: int):
    """For each row its sorted distinct shingle hashes."""
    for chunk in B.chunks(texts):
        w = B.words(chunk, B.NONSPACE)
        h = B.word_hashes(chunk.buf, w)
        s = B.shingle_hashes(h, size)
        for a, b in zip(w.row[:-1].tolist(), w.row[1:].tolist(), strict=True):
            if b - a >= size:
                x = np.sort(s[a : b - size + 1])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])]
            else:
                yield B.shingle_hashes(h[a:b], b - a) if b > a else s[:0]


def set_key(shingles: np.ndarray) -> int:
    """64 bits of the set's content, as a signed integer."""
    with np.errstate(over="ignore"):
        return int(B.mix(np.array([B.mix(shingles + _U(0x632BE59BD9B4E019)).sum(dtype=_U) + _U(len(shingles))]))[0].astype(np.int64))


class Dealer:
    """Signatures of sets: two sets that link have ``AGREE`` in common, others hardly ever.

    From ``SMALL`` shingles on, shingles are hashed into groups, three to a block; a signature is the content of two groups of
    a block.  Linked sets differ in at most d groups of more than 1.5 d + 3 ``AGREE``, so in more than ``AGREE`` blocks two groups agree.  Passages
    that two sets share are no signature unless these groups hold nothing else.  Smaller sets take all choices of ``FEW``
    of their smallest hashes, marked by the lowest bit: linked sets share as many of the first n - least overlap + ``FEW``, so one choice at least.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.tops = [SMALL]
        while self.tops[-1] < 1 << 40:
            self.tops.append(int(self.tops[-1] * RATIO) + 1)
        # d: the most shingles by which linked sets below a class's top differ
        most = [2 * (t - 1) - 2 * needed(t - 1, t - 1, percent) for t in self.tops]
        self.groups = [3 * _ceil(3 * d // 2 + d // 12 + 3 + 3 * AGREE, 3) for d in most]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        n, out = len(s), []
        largest = 100 * n // self.percent
        if n + largest == 2 * needed(n, largest, self.percent):
            return s[:0]  # links with equal sets only
        if self.percent * n < 100 * SMALL:
            least = _ceil(self.percent * n, 100)
            few = min(FEW, least)
            x = s[_choices(n - least + few, few)]
            with np.errstate(over="ignore"):
                total = x[:, 0].copy()
                for k in range(1, few):
                    total = B.mix(total) + x[:, k]
                out.append(B.mix(total ^ _U(0x5851F42D4C957F2D)) | _U(1))
        if n * 100 >= self.percent * SMALL:
            own = int(np.searchsorted(self.tops, n, "right"))  # tops[own - 1] <= n < tops[own]
            if own:
                out.append(self._grouped(s, own))
            if 100 * n >= self.percent * self.tops[own]:
                out.append(self._grouped(s, own + 1))
        return np.concatenate(out)

    def _grouped(self, s: np.ndarray, level: int) -> np.ndarray:
        """A hash of each two groups of a block, unless both are empty."""
        count = self.groups[level]
        with np.errstate(over="ignore"):
            x = s * _U(0xD6E8FEB86659FD93 + 2 * level)  # hashes already; other groups at each level
            x ^= x >> _U(29)
            upper = x >> _U(32)
            group = (upper * _U(count) >> _U(32)).astype(np.int64)
            low = np.bincount(group, x.astype(np.uint32), count).astype(_U)
            high = np.bincount(group, upper, count).astype(_U)
            c = B.mix(low * _U(0x9E3779B97F4A7C15) + B.mix(high + (np.arange(count).astype(_U) << _U(40)) + _U(level))).reshape(-1, 3)
            size = np.bincount(group, minlength=count).reshape(-1, 3)
            first, second = [0, 0, 1], [1, 2, 2]
            return B.mix(B.mix(c[:, first]) + c[:, second])[size[:, first] + size[:, second] > 0] & ~_U(1)


@lru_cache(maxsize=256)
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), dtype=np.int64)


class CountVectorTree:
    """An R-tree over group counts, packed bottom-up; answers which points may overlap enough with a given one."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        order = self._tile(np.arange(len(points)), 0)
        self.order = order
        hi, least, most = points[order], sizes[order], sizes[order]
        self.levels = []  # from leaves to root: per node the upper corner, the smallest and the largest size
        while len(hi) > 1:
            at = np.arange(0, len(hi), self.FAN)
            hi, least, most = np.maximum.reduceat(hi, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((hi, least, most))

    def _tile(self, rows: np.ndarray, depth: int) -> np.ndarray:
        """Sort-tile order: by size first, then slabs by the coordinate that varies most."""
        if len(rows) <= self.FAN:
            return rows
        by = self.sizes[rows] if depth == 0 else self.points[rows, np.argmax(self.points[rows].var(axis=0))]
        rows = rows[np.argsort(by, kind="stable")]
        slabs = max(2, round((len(rows) / self.FAN) ** 0.5)) if depth < 3 else 2
        size = _ceil(_ceil(len(rows), slabs), self.FAN) * self.FAN
        if size >= len(rows):
            return rows
        return np.concatenate([self._tile(rows[i : i + size], depth + 1) for i in range(0, len(rows), size)])

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose summed coordinate minima with the point reach the overlap that a link needs."""
        low = _ceil(percent * size, 100)
        nodes = np.arange(len(self.levels[-1][0])) if self.levels else None
        for level in range(len(self.levels) - 1, -1, -1):
            hi, least, most = self.levels[level]
            m = np.maximum(least[nodes], low)
            keep = (most[nodes] >= low) & (100 * size >= percent * least[nodes]) & (np.minimum(hi[nodes], point).sum(axis=1) >= needed(size, m, percent))
            nodes = nodes[keep]
            width = len(self.levels[level - 1][0]) if level else len(self.order)
            nodes = (nodes[:, None] * self.FAN + np.arange(self.FAN)).ravel()
            nodes = nodes[nodes < width]
        rows = self.order[nodes] if nodes is not None else self.order
        m = self.sizes[rows]
        return rows[np.minimum(self.points[rows], point).sum(axis=1) >= needed(size, m, percent)]


def count_vectors(sets: list[np.ndarray]) -> np.ndarray:
    """Shingle counts per hashed group; groups grow with the sets, as differences must not cancel out."""
    most = max(map(len, sets))
    dims = min(256, max(16, 1 << (most // 8).bit_length()))
    return np.array([np.bincount((x >> _U(40)).astype(np.int64) & (dims - 1), minlength=dims) for x in sets], dtype=np.int32)


def linked(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all linked sets into their components.  side: only pairs from different sides are of interest."""
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    points = count_vectors(sets)
    tree = CountVectorTree(points, sizes)
    member = np.arange(n)
    out = []
    for i in range(n):
        if side is not None and side[i]:
            continue
        found = tree.search(points[i], int(sizes[i]), percent)
        found = found[found > i] if side is None else found[side[found] == 1]
        while len(found := found[member[found] != member[i]]):
            j, found = int(found[0]), found[1:]
            both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                out.append((i, j))
                member[member == member[j]] = member[i]
    return out


def _keys(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, key): key is null for the empty set."""

    def run(batches):
        for batch in batches:
            found = [(len(s), set_key(s) if len(s) else None) for s in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int64())], ["doc_id", "n", "key"])

    return docs.mapInArrow(tidied(run), f"doc_id {docs.schema[0].dataType.simpleString()}, n long, key long")


def _fresh(batches, column: int, size: int, limit: int = 1 << 19):
    """(key, set) of sets that the task hasn't met before (it forgets after ``limit`` sets, which costs repeated work only)."""
    seen: set[int] = set()
    for batch in batches:
        for s in shingle_sets(batch.column(column), size):
            if len(s) and (key := set_key(s)) not in seen:
                if len(seen) >= limit:
                    seen.clear()
                seen.add(key)
                yield key, s


class Runs:
    """(signature, key) rows sorted into runs of one signature.  ``wide``: rows that stand for more sets than ``many``, kept in ``local``."""

    def __init__(self, sig: np.ndarray, key: np.ndarray, wide: np.ndarray, many: int):
        order = np.lexsort((key, sig))
        sig, key, wide = sig[order], key[order], wide[order]
        new = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]))
        self.sig, self.key, wide = sig[new], key[new], np.maximum.reduceat(wide, new)
        self.local = wide > 0
        self.at = np.flatnonzero(np.concatenate([[True], self.sig[1:] != self.sig[:-1]]))
        self.n = np.diff(self.at, append=len(self.sig))
        self.few = (self.sig[self.at] & _U(1)) == 1
        self.wide = ((self.n > many) | (np.maximum.reduceat(wide, self.at) > 0)) & ~self.few
        self.root = np.repeat(self.key[self.at], self.n)

    def rows(self, runs: np.ndarray) -> np.ndarray:
        return np.repeat(runs, self.n)

    def pairs(self) -> np.ndarray:
        """(a, b), a < b, of runs that are neither wide nor of few shingles, once for each run."""
        out = [np.zeros((0, 2), np.int64)]
        for n in np.unique(self.n[(self.n > 1) & ~self.wide & ~self.few]):
            begin = self.at[(self.n == n) & ~self.wide & ~self.few]
            out.append(self.key[begin[:, None, None] + _choices(int(n), 2)[None]].reshape(-1, 2))
        return np.concatenate(out)


EDGES = "wide boolean, a long, b long, n long"


def _edges(wide: bool, ends: np.ndarray, weight: int):
    """Batches of distinct (a, b) with their number times the weight."""
    if len(ends):
        ends = ends[np.lexsort((ends[:, 1], ends[:, 0]))]
        new = np.flatnonzero(np.concatenate([[True], (ends[1:] != ends[:-1]).any(axis=1)]))
        n = np.diff(new, append=len(ends)) * weight
        for i in range(0, len(new), 1 << 16):
            part = new[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), wide)), pa.array(ends[part, 0].copy()), pa.array(ends[part, 1].copy()), pa.array(n[i : i + (1 << 16)])], ["wide", "a", "b", "n"])


def _candidate_edges(docs: DataFrame, size: int, percent: int, buckets: int, many: int) -> DataFrame:
    """(a, b) edges between keys of sets, enough to connect all that may link.

    Linked sets agree on ``AGREE`` signatures.  Those that at most ``many`` sets have count for each pair of these; the others count for each set and
    connect it to one of them.  A pair stays if its own signatures and the fewer of both sets' others may make ``AGREE``, unless it lacks some and both
    sets have as many others; an edge of the other kind stays if the set has as many, or if the set stands for others of its flush.
    """
    dealer = Dealer(percent)

    def send(batches):
        held, bytes_held = [], 0

        def flush():
            sig = np.concatenate([x for x, _ in held])
            r = Runs(sig, np.repeat(np.array([k for _, k in held], dtype=np.int64), [len(x) for x, _ in held]), np.zeros(len(sig), np.uint8), many)
            wide, few = r.rows(r.wide), r.rows(r.few)
            stay = (wide | few) & (r.key != r.root)  # a signature of many sets, or of few shingles, is sent once
            yield from message(wide[stay], np.stack([r.key, r.root], axis=1)[stay])
            sig, key, wide = r.sig[~stay], r.key[~stay], wide[~stay]
            to = (sig >> _U(1)) % _U(buckets)
            order = np.argsort(to, kind="stable")
            sig, key, wide, to = sig[order], key[order], wide[order], to[order].astype(np.int64)
            at = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
            for i in range(0, len(at) - 1, 4096):
                part = list(zip(at[i : i + 4096], at[i + 1 : i + 4097], strict=False))
                yield batch(to[[a for a, _ in part]], [[x[a:b].tobytes() for a, b in part] for x in (sig, key, wide.astype(np.uint8))])

        def message(wide, ends):
            """Edges found here already, on their way to any bucket."""
            for i in range(0, len(ends), 65536):
                yield batch([(i + int(ends[i, 0])) % buckets], [[None], [ends[i : i + 65536].tobytes()], [wide[i : i + 65536].astype(np.uint8).tobytes()]])

        def batch(to, columns):
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], ["bucket", "sig", "key", "wide"])

        for k, s in _fresh(batches, 0, size):
            x = dealer.signatures(s)
            if not len(x):
                continue
            held.append((x, k))
            bytes_held += 16 * len(x)
            if bytes_held >= FLUSH_BYTES:
                yield from flush()
                held, bytes_held = [], 0
        if held:
            yield from flush()

    def meet(batches):
        def found(held):
            if held:
                r = Runs(*(np.concatenate(x) for x in zip(*held, strict=True)), many)
                wide, few = r.rows(r.wide), r.rows(r.few)
                ends = np.stack([r.key, r.root], axis=1)
                yield from _edges(False, r.pairs(), 1)
                yield from _edges(False, ends[few & (r.key != r.root)], AGREE)
                yield from _edges(False, ends[r.local & wide & (r.key != r.root)], AGREE)  # others' edges lead to a local root
                yield from _edges(True, ends[wide], 1)

        at, held = None, []
        for batch in batches:
            for bucket, sig, key, wide in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                k, w = np.frombuffer(key.as_buffer(), np.int64).copy(), np.frombuffer(wide.as_buffer(), np.uint8).copy()
                if not sig.is_valid:
                    ends = k.reshape(-1, 2)
                    yield from _edges(True, ends[w == 1], 1)
                    yield from _edges(False, ends[w == 0], AGREE)
                    continue
                if bucket != at:
                    yield from found(held)
                    at, held = bucket, []
                held.append((np.frombuffer(sig.as_buffer(), _U).copy(), k, w))
        yield from found(held)

    sent = docs.select("text").mapInArrow(tidied(send), "bucket long, sig binary, key binary, wide binary")
    met = cut(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidied(meet), EDGES))
    del sent
    swept(docs)  # the signatures are the most that is ever shuffled
    star = met.where("wide").groupBy("a", "b").agg(F.sum("n").alias("n"))
    others = cut(star.groupBy("a").agg(F.sum("n").alias("n")))
    pair = met.where("not wide").groupBy("a", "b").agg(F.sum("n").alias("n"))
    sure = pair.where(F.col("n") >= AGREE).select("a", "b")
    # the others' sets, if signatures of many sets may make up for what is missing; where both ends have AGREE of
    # these, a pair that lacks one agrees on such a signature, and its star connects both
    lack = pair.where(F.col("n") < AGREE)
    few, rest = others.where(F.col("n") < AGREE), others.where(F.col("n") >= AGREE)
    by = lambda rows, end: rows.select(F.col("a").alias(end), F.col("n").alias(f"n{end}"))
    maybe = lack.join(by(few, "a"), "a").join(by(others, "b"), "b").unionByName(lack.join(by(few, "b"), "b").join(by(rest, "a"), "a"))
    maybe = maybe.where(F.col("n") + F.least("na", "nb") >= AGREE).select("a", "b")
    starred = star.select("a", "b").join(others.where(F.col("n") >= AGREE).select("a"), "a", "left_semi").where("a <> b")
    return sure.unionByName(maybe).unionByName(starred.select("a", "b"))


def _bloom(keys: DataFrame) -> np.ndarray:
    """A bit for each key, in a table of bounded size; the driver gets no more words than the table has."""
    bits = min(_BLOOM_BITS, max(1 << 16, 1 << (8 * keys.count()).bit_length()))
    bit = F.pmod(F.col("vertex"), F.lit(bits))
    words = keys.select(F.shiftright(bit, 6).alias("w"), F.pmod(bit, F.lit(64)).cast("int").alias("i"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("m")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def _true_links(docs: DataFrame, blocks: DataFrame, size: int, percent: int, block_sets: int) -> DataFrame:
    """(a, b): verified links that join the sets of each block into components."""
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(blocks))

    def pick(batches):
        rows, total = [], 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([s.tobytes() for _, s in rows], pa.binary())], ["vertex", "shingles"])

        for k, s in _fresh(batches, 0, size):
            bit = k % (64 * len(bits.value))
            if int(bits.value[bit >> 6]) >> (bit & 63) & 1:
                rows.append((k, s))
                total += s.nbytes
                if total >= 4 << 20:
                    yield batch_of(rows)
                    rows, total = [], 0
        if rows:
            yield batch_of(rows)

    placed, large = _placed(blocks, block_sets)
    sets = docs.select("text").mapInArrow(tidied(pick), "vertex long, shingles binary").join(placed, "vertex").select("root", "part", F.lit(0).alias("side"), "vertex", "shingles", "parts")
    if not large:
        return _trees(sets, percent)
    sets = cut(sets)
    wide = cut(sets.where("parts > 1").dropDuplicates(["vertex"]))  # a set comes from each task that met it
    small = cut(_trees(sets.where("parts = 1"), percent))
    forget(sets)
    del sets
    swept(docs)
    found = labelled(_rare_shingles(wide, percent)).join(wide.select("vertex"), "vertex")  # without the shingles themselves
    placed, large = _placed(cut(found), block_sets)
    finer = wide.select("vertex", "shingles").join(placed, "vertex").select("root", "part", F.lit(0).alias("side"), "vertex", "shingles", "parts")
    if not large:
        return small.unionByName(_trees(finer, percent))
    finer = cut(finer)
    forget(wide)
    del wide
    swept(docs)
    return small.unionByName(_trees(finer.where("parts = 1"), percent)).unionByName(_large_links(finer.where("parts > 1"), placed.where("parts > 1"), percent, block_sets))


def _placed(blocks: DataFrame, block_sets: int) -> tuple[DataFrame, bool]:
    """(vertex, root, part, parts) of (vertex, root), and whether any block has several parts."""
    large = cut(blocks.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_sets).select("root", F.ceil(F.col("n") / block_sets).alias("parts")))
    placed = named(blocks, large, "root").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).select("vertex", "root", F.pmod("vertex", "parts").alias("part"), "parts")
    return placed, large.limit(1).count() > 0


def _rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) edges from sets to shingles, which connect all sets of a block that link: of (root, vertex, shingles), a written table with distinct vertices.

    Shingles of a block are in one order, those that fewer of its sets have first.  A set of n shingles shares at least m = ceil(percent * n / 100) with what it links with, so
    it and that share one of the first n - m + 1 of each.  Shingles that no other set has come first and connect nothing, so a set with over n - m of them drops
    out: passages that many sets have don't connect sets whose other shingles are their own.
    """
    total = sets.agg(F.sum(F.length("shingles"))).first()[0] or 0
    buckets = max(1, int(total / 8 * 20 / BUCKET_BYTES) + 1)
    names, types = ["bucket", "shingle", "vertex", "n", "sets"], ["long", *["binary"] * 4]
    of = [np.dtype(t) for t in (np.uint64, np.int64, np.uint32, np.uint16)]

    def schema(columns: int) -> str:
        return ", ".join(f"{c} {t}" for c, t in zip(names[: columns + 1], types, strict=False))

    def message(to: np.ndarray, *arrays):
        """A row for each bucket: the elements that go there."""
        order = np.argsort(to, kind="stable")
        to, arrays = to[order], [x[order] for x in arrays]
        at = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
        for i in range(0, len(at) - 1, 4096):
            part = list(zip(at[i : i + 4096], at[i + 1 : i + 4097], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(to[[a for a, _ in part]], pa.int64()), *[pa.array([x[a:b].tobytes() for a, b in part], pa.binary()) for x in arrays]], names[: len(arrays) + 1])

    def gathered(batches):
        """The arrays of each bucket."""
        at, held = None, []
        for batch in batches:
            for bucket, *columns in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                if bucket != at and held:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                    held = []
                at = bucket
                held.append([np.frombuffer(x.as_buffer(), t).copy() for x, t in zip(columns, of, strict=False)])
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def to_shingles(batches):
        held, bytes_held = [], 0

        def flush():
            x, vertex, n = (np.concatenate(c) for c in zip(*held, strict=True))
            yield from message((x % _U(buckets)).astype(np.int64), x, vertex, n)

        for batch in batches:
            for root, vertex, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = np.frombuffer(shingles.as_buffer(), _U)
                with np.errstate(over="ignore"):
                    x = B.mix(s + B.mix(np.array([root], np.int64).view(_U)))  # each block has shingles of its own
                held.append((x, np.full(len(s), vertex, np.int64), np.full(len(s), len(s), np.uint32)))
                bytes_held += 20 * len(s)
                if bytes_held >= FLUSH_BYTES:
                    yield from flush()
                    held, bytes_held = [], 0
        if held:
            yield from flush()

    def to_sets(batches):
        for x, vertex, n in gathered(batches):
            order = np.argsort(x, kind="stable")
            x, vertex, n = x[order], vertex[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            size = np.diff(at, append=len(x))
            rows = np.repeat(size, size)
            more = rows > 1
            yield from message((B.mix(vertex[more].view(_U)) % _U(buckets)).astype(np.int64), x[more], vertex[more], n[more], np.minimum(rows[more], 65535).astype(np.uint16))

    def first(batches):
        for x, vertex, n, rows in gathered(batches):
            order = np.lexsort((x, rows, vertex))
            x, vertex, n = x[order], vertex[order], n[order].astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], vertex[1:] != vertex[:-1]]))
            shared = np.diff(at, append=len(x))
            place = np.arange(len(x)) + np.repeat(n[at] - shared - at, shared)  # after those that no other set has
            keep = place <= n - _ceil(percent * n, 100)
            for i in range(0, int(keep.sum()), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[keep][i : i + (1 << 16)]) for c in (vertex, x.view(np.int64))], ["a", "b"])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    shingles = sets.select("root", "vertex", "shingles").mapInArrow(tidied(to_shingles), schema(3))
    return dealt(dealt(shingles).mapInArrow(tidied(to_sets), schema(4))).mapInArrow(tidied(first), "a long, b long")


def _trees(members: DataFrame, percent: int, *more: str) -> DataFrame:
    """(a, b) verified links within each (root, part, more ...) of (root, part, side, vertex, shingles); where a tree has sides 0 and 1, between these only."""
    keys = ["root", "part", *more]

    def run(batches):
        def done(held):
            if len(held) < 2:
                return
            side = np.array([s for s, _ in held])
            if side.any() and side.all():
                return
            pairs = linked(list(held.values()), percent, side if side.any() else None)
            name = [v for _, v in held]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([name[i] for i, _ in pairs], pa.int64()), pa.array([name[j] for _, j in pairs], pa.int64())], ["a", "b"])

        at, held = None, {}
        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in range(len(keys))), strict=True))
            side, vertex, shingles = (batch.column(len(keys) + c) for c in range(3))
            for r, key in enumerate(zip(side.to_pylist(), vertex.to_pylist(), strict=True)):
                if where[r] != at:
                    yield from done(held)
                    at, held = where[r], {}
                if key not in held:
                    held[key] = np.frombuffer(shingles[r].as_buffer(), _U).copy()
        yield from done(held)

    return members.select(*keys, "side", "vertex", "shingles").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidied(run), "a long, b long")


def _large_links(sets: DataFrame, placed: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """Links of blocks of several parts.

    Each part is a tree.  Samples of its parts' largest components meet in a few more trees, with those of the first part in each, which joins the greater part of a
    family of near copies.  What is then outside a block's largest component meets all of the block, a tree for each two parts; pairs within that
    component needn't meet, as they are joined already.  A block of n sets, m of them outside, so moves about n * m / ``block_sets`` sets and not n * n / ``block_sets``.
    """
    one = cut(_trees(sets, percent))
    comp = labelled(one).select("vertex", F.col("root").alias("comp"))
    own = cut(named(placed.select("root", "part", "vertex"), comp, "vertex").withColumn("comp", F.coalesce("comp", "vertex")))
    # a part has block_sets sets, so none of these windows is large
    of_comp, of_part = Window.partitionBy("root", "part", "comp"), Window.partitionBy("root", "part")
    sized = own.withColumn("n", F.count(F.lit(1)).over(of_comp)).withColumn("most", F.max_by("comp", F.struct("n", "comp")).over(of_part)).where("comp = most")
    sample = sized.withColumn("k", F.row_number().over(of_part.orderBy(F.xxhash64("vertex"), "vertex"))).where(F.col("k") <= SAMPLE).select("root", "part", "vertex")
    anchors = sample.where("part = 0")
    each = max(1, block_sets // SAMPLE)  # parts whose samples fill a tree
    trees = sample.select("root", F.expr(f"part div {each}").alias("part")).distinct()
    meeting = sample.select("root", F.expr(f"part div {each}").alias("part"), "vertex").unionByName(trees.join(anchors.select("root", "vertex"), "root").select("root", "part", "vertex")).distinct()
    known = sets.select("vertex", "shingles")
    two = cut(_trees(meeting.join(known, "vertex").withColumn("side", F.lit(0)), percent))
    comp = labelled(one.unionByName(two)).select("vertex", F.col("root").alias("comp"))
    own = cut(named(placed.select("root", "part", "vertex"), comp, "vertex").withColumn("comp", F.coalesce("comp", "vertex")))
    counts = cut(own.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("n")))
    main = cut(counts.groupBy("root").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0").withColumn("pieces", F.ceil(F.col("outside") / block_sets)))
    left = named(own, main, "root").where("pieces is not null").select("root", "part", "vertex", "pieces", (F.col("comp") != F.col("main")).alias("outside"))
    with_sets = cut(left.join(known, "vertex"))
    parts = cut(left.groupBy("root").agg((F.max("part") + 1).alias("parts")))
    every = with_sets.withColumn("piece", F.explode(F.expr("sequence(0L, pieces - 1)"))).select("root", "part", "piece", F.lit(1).alias("side"), "vertex", "shingles")
    outside = named(with_sets.where("outside"), parts, "root").withColumn("piece", F.pmod(F.xxhash64("vertex"), "pieces")).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    three = _trees(every.unionByName(outside.select("root", "part", "piece", F.lit(0).alias("side"), "vertex", "shingles")), percent, "piece")
    return one.unionByName(two).unionByName(three)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, block_sets: int = BLOCK_SETS, many: int = MANY) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    if not 75 <= percent <= 100:  # signatures of small sets are choices whose number explodes below
        raise ValueError("percent must be between 75 and 100")
    docs = bounded(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    keyed = cut(_keys(docs, size))
    classes = cut(keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(total * 0.8 * 17 / BUCKET_BYTES) + 1)
    blocks = labelled(_candidate_edges(docs, size, percent, buckets, many))
    labels = labelled(_true_links(docs, blocks, size, percent, block_sets))
    forget(blocks)
    # names of components, then of sets that have any but their only document's
    member = labels.join(classes.select(F.col("key").alias("vertex"), "least"), "vertex")
    names = cut(member.groupBy("root").agg(F.min("least").alias("component_id")))
    found = cut(named(labels, names, "root").select(F.col("vertex").alias("key"), "component_id"))
    every = classes.join(found, "key", "left").where("rows > 1 or component_id is not null").select("key", F.coalesce("component_id", "least").alias("component_id"))
    named_rows = named(keyed, cut(every), "key")
    return named_rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id (rows that share it all stay)."""
    found = near_duplicates(docs, doc_id, **options)
    kept = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = cut(found.groupBy("doc_id").agg(kept.alias("kept")).where("not kept").select("doc_id"))
    return _sieve.drop_rows(docs, {"doc_id": F.col(doc_id)}, gone, ["doc_id"])

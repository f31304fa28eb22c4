"""Connected components of an edge table by contraction.

A round reduces edges to stars where they lie (each task joins the edges it has and sends each vertex's link to the first
vertex of its part), then brings each vertex's links together: a vertex takes the first as its parent, and its other links
become links between parents.  The next round sees the links of vertices that are somebody's parent only, so tables shrink with each
round; what fits one task (``alone`` edges) is solved there.  Names then come back, a round at a time.

A vertex has one row for each task at most when links meet, however many edges it has, so no vertex is a hot key.  "First"
is by another pseudo-random order each round, so that no numbering of vertices makes long chains.  Names come
back by a broadcast of at most ``NAMES`` rows, or else by a join whose sides Spark can split where a parent has
very many children.  The driver gets a count per round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.llm._store import cut, forget, tidied

#: Edges that one task joins at once (16 bytes each).
ALONE = 1 << 18
#: Rows of a table that may be broadcast (16 bytes each).
NAMES = 100_000
_U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
_BACK = tuple(pow(x, -1, 1 << 64) for x in _ODD)


def shuffled(x: np.ndarray, turn: int) -> np.ndarray:
    """A permutation of the 64-bit numbers, another for each turn."""
    with np.errstate(over="ignore"):
        y = (x.astype(np.int64).view(_U) + _U(turn)) * _U(_ODD[0])
        return ((y ^ (y >> _U(32))) * _U(_ODD[1])).view(np.int64)


def restored(y: np.ndarray, turn: int) -> np.ndarray:
    """The inverse of ``shuffled``."""
    with np.errstate(over="ignore"):
        x = y.view(_U) * _U(_BACK[1])
        return ((x ^ (x >> _U(32))) * _U(_BACK[0]) - _U(turn)).view(np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex it is connected with) of all vertices but the smallest ones."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(names))
    while True:
        left, right = label[x], label[y]
        live = left != right
        if not live.any():
            moved = np.flatnonzero(label != np.arange(len(names)))
            return names[moved], names[label[moved]]
        x, y, left, right = x[live], y[live], left[live], right[live]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))  # both are roots
        while not np.array_equal(upper := label[label], label):
            label = upper


def _ends(batch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(), batch.column(1).to_numpy()


def _gathered(batches, limit: int):
    """(a, b) of about ``limit`` edges at a time."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(_ends(batch))
            n += batch.num_rows
        if n >= limit:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _stars(turn: int, limit: int):
    """(v, p) links of each vertex to the first of its part, and (v, null) for all that are first or have loops."""

    def run(batches):
        for a, b in _gathered(batches, limit):
            a, b = shuffled(a, turn), shuffled(b, turn)
            v, p = forest(a, b)
            first = np.unique(np.concatenate([p, a[a == b]]))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(p)], ["v", "p"])
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.nulls(len(first), pa.int64())], ["v", "p"])

    return tidied(run)


def _contract(turn: int):
    """Of rows sorted by v and p: (true, vertex, parent), the parent being itself if it has none, and (false, a, b) for the edges of the next round."""

    def split(v, p, null):
        start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        size = np.diff(start, append=len(v))
        nulls = np.add.reduceat(null.astype(np.int64), start)
        has = nulls < size
        parent = np.where(has, p[np.minimum(start + nulls, len(p) - 1)], v[start])
        inner = has & (nulls > 0)
        each = np.repeat(parent, size)
        more = np.flatnonzero(~null & (p != each))
        a = np.concatenate([v[start], v[start[inner]], p[more]])
        b = np.concatenate([parent, parent[inner], each[more]])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(a)) < len(start)), pa.array(restored(a, turn)), pa.array(restored(b, turn))], ["tree", "v", "p"])

    def run(batches):
        held = None  # the rows of the last vertex so far: as many as tasks that sent it
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).to_numpy(), batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            at = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            if at:
                yield split(*(x[:at] for x in rows))
            held = tuple(x[at:].copy() for x in rows)
        if held is not None:
            yield split(*held)

    return tidied(run)


def _solve(batches):
    for a, b in _gathered(batches, 1 << 62):
        v, p = forest(a, b)
        own = np.setdiff1d(np.concatenate([p, a[a == b]]), v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v, own])), pa.array(np.concatenate([p, own]))], ["v", "p"])


def named(rows: DataFrame, names: DataFrame, on: str, limit: int = NAMES) -> DataFrame:
    """``rows`` left-joined with ``names`` (a written table with distinct keys ``on``): by a broadcast if it has at most
    ``limit`` rows, else by a join of two plain exchanges, whose skewed partitions Spark splits."""
    return rows.join(F.broadcast(names) if names.limit(limit + 1).count() <= limit else names, on, "left")


def labelled(edges: DataFrame, a: str = "a", b: str = "b", alone: int = ALONE, names: int = NAMES) -> DataFrame:
    """(vertex, root) of all vertices of ``edges`` (64-bit numbers), a written table; root is one vertex of the component, the same for all of it.

    Null ends are ignored; loops and repeated edges do no harm; no edges give an empty table.
    """
    links = given = cut(edges.select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("p")).where("v is not null and p is not null"))
    trees: list[DataFrame] = []
    while (n := links.count()) > alone:
        turn, tasks = len(trees) + 1, -(-n // alone)
        # the more edges a task joins, the fewer stars it sends
        met = links.coalesce(tasks).mapInArrow(_stars(turn, alone), "v long, p long").repartition(tasks, "v").sortWithinPartitions("v", "p")
        met = cut(met.mapInArrow(_contract(turn), "tree boolean, v long, p long"))
        if given is not None:
            forget(given)
        given = None
        trees.append(met.where("tree").select("v", "p"))
        links = met.where("not tree").select("v", "p")
    labels = cut(links.coalesce(1).mapInArrow(tidied(_solve), "v long, p long"))
    if given is not None:
        forget(given)
    while trees:
        known = labels.select(F.col("v").alias("p"), F.col("p").alias("root"))
        labels = cut(named(trees.pop(), known, "p", names).select("v", F.coalesce("root", "p").alias("p")))
    return labels.select(F.col("v").alias("vertex"), F.col("p").alias("root"))


def components(edges: DataFrame, a: str = "a", b: str = "b", alone: int = ALONE, names: int = NAMES) -> DataFrame:
    """The same with the smallest vertex of each component as its root."""
    found = labelled(edges, a, b, alone, names)
    least = cut(found.groupBy("root").agg(F.min("vertex").alias("least")))
    return named(found, least, "root", names).select("vertex", F.col("least").alias("root"))

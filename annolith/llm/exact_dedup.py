r"""Exact dedup by a log-structured merge index, in built-in functions only.

*Memtables and runs*: input partitions are dealt to ``MEMTABLES`` memtables, each of which is flushed as a run of (digest, id) rows, sorted by
digest in each of its files, in the shared folder; no shuffle.  *Compaction* merges ``FAN`` runs of a level into one of the next level, which keeps the
smallest id and the number of rows of a digest; merging combines per task first, so a digest that a third of all rows have is no
hot key.  Merged runs are deleted.  *Filters*: each run that stays has a bit table of its digests, by which the other runs are
probed: a digest of one row that is in no other run's filter is alone, and only the others are merged across runs.
*Hits* (digests of over one row) get *byte verification*: of the texts under a digest the smallest and the largest must be
the same bytes; a digest that fails is split by the texts themselves.

Texts are equal when they are the same bytes after each run of ``[\x20\x09-\x0D]``
became one space.  Texts are normalised and digested once; those of possible hits, found by a filter of their ids, once more.

Cases: a null text is the empty text.  A null id is greater than any other, so it is kept only in
a group without ids.  Rows that repeat an id and a text are one document: they are kept or
dropped together, and each counts in group_size.  Other columns are ignored, whatever their
names.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.llm import _sieve
from annolith.llm._store import cut, ensure_checkpoint_dir, forget, remove

#: A digest of more than this share of all rows is heavy: fewer than its inverse can be.
HEAVY = 1000
MEMTABLES = 8


def normalised(text: Column) -> Column:
    """Whitespace runs become one space; only those that aren't one space already are matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass
class Run:
    """Rows (digest, least, rows) in a folder of its own, sorted by digest in each file.  Runs of level 0 may repeat a digest, others don't."""

    level: int
    rows: DataFrame
    path: str | None
    held: _sieve.Sieve | None = None

    def filter(self) -> _sieve.Sieve:
        """The run's digests as bits, made when the run is first probed."""
        if self.held is None:
            made = _sieve.sieve(self.rows, F.xxhash64("digest"), self.rows.count())
            self.held = _sieve.Sieve(made.bits, cut(made.table))
        return self.held


class DigestIndex:
    """Sorted runs by level: ``append`` and ``load`` flush, ``compact`` and ``seal`` merge, ``probed`` and ``hits`` look up."""

    #: Runs of a level that are merged into one of the next.
    FAN = 4

    def __init__(self, spark: SparkSession, path: str | None = None):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.path = path or f"{spark.sparkContext.getCheckpointDir()}/digest-index-{uuid.uuid4().hex}"
        self.runs: list[Run] = []

    def _write(self, rows: DataFrame, level: int) -> Run:
        path = f"{self.path}/run-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("digest").write.parquet(path)
        return Run(level, self.spark.read.schema(rows.schema).parquet(path), path)

    def _add(self, run: Run) -> None:
        """A new run; a level that is full is merged into the next."""
        self.runs.append(run)
        while len(full := [r for r in self.runs if r.level == run.level]) >= self.FAN:
            run = self._merge(full)

    def _merge(self, runs: list[Run]) -> Run:
        every = reduce(DataFrame.unionByName, [r.rows for r in runs])
        made = self._write(every.groupBy("digest").agg(F.min("least").alias("least"), F.sum("rows").alias("rows")), max(r.level for r in runs) + 1)
        self.runs = [r for r in self.runs if r not in runs] + [made]
        for r in runs:
            if r.path is not None:
                remove(self.spark, r.path)
            if r.held is not None:
                forget(r.held.table)
        return made

    def append(self, rows: DataFrame) -> None:
        """Flush a memtable of (digest, id) rows."""
        self._add(self._write(rows.select("digest", F.col("id").alias("least"), F.lit(1).cast("long").alias("rows")), 0))

    def load(self, rows: DataFrame, memtables: int = MEMTABLES) -> DataFrame:
        """Flush (digest, id, ...) rows as ``memtables`` runs in one pass; returns the rows as written."""
        path = f"{self.path}/rows-{uuid.uuid4().hex}"
        dealt = rows.withColumn("memtable", F.pmod(F.spark_partition_id(), F.lit(memtables)))
        dealt.sortWithinPartitions("memtable", "digest").write.partitionBy("memtable").parquet(path)
        written = self.spark.read.schema(dealt.schema).parquet(path)
        for m in range(memtables):
            run = written.where(F.col("memtable") == m).select("digest", F.col("id").alias("least"), F.lit(1).cast("long").alias("rows"))
            self._add(Run(0, run, None))
        return written.drop("memtable")

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1 or any(r.level == 0 for r in self.runs):
            self._merge(self.runs)

    def seal(self) -> None:
        """Merge what is left of level 0, so that no run repeats a digest."""
        if left := [r for r in self.runs if r.level == 0]:
            self._merge(left)

    def read(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [r.rows for r in self.runs])

    def probed(self, rows: DataFrame, but: Run | None = None) -> DataFrame:
        """``rows`` with a boolean ``met``: false if no run but ``but`` has the row's digest."""
        out = rows.withColumn("met", F.lit(False))
        for run in self.runs:
            if run is not but:
                out = _sieve.maybe(out, F.xxhash64("digest"), run.filter(), "__here").withColumn("met", F.col("met") | F.col("__here")).drop("__here")
        return out

    def hits(self) -> DataFrame:
        """(digest, least, rows) of digests of over one row.  Only digests that filters don't clear are merged across runs."""
        self.seal()
        possible = [self.probed(run.rows, run).where("met or rows > 1").drop("met") for run in self.runs]
        merged = reduce(DataFrame.unionByName, possible).groupBy("digest").agg(F.min("least").alias("least"), F.sum("rows").alias("rows"))
        return merged.where("rows > 1")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, memtables: int = MEMTABLES) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    digest: an expression over the normalised text; a weak one costs more byte comparisons, not wrong results.
    """
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    bodies = lambda rows: rows.withColumn("body", normalised(F.col("text"))).withColumn("digest", digest(F.col("body"))).withColumn("sha", sha256(F.col("body")))
    sha = "digest" if digest is sha256 else "sha"
    index = DigestIndex(docs.sparkSession)
    narrow = index.load(bodies(given).select("id", "digest", *([sha] if sha != "digest" else [])), memtables)
    hits = cut(index.hits())
    total, n_hits = narrow.count(), hits.count()

    # rows of possible hits meet them; heavy digests, of which there are fewer than HEAVY, by a broadcast
    marked = _sieve.maybe(narrow, F.xxhash64("digest"), _sieve.sieve(hits, F.xxhash64("digest"), n_hits), "maybe")
    alone = marked.where("not maybe").select("id", "digest", F.col(sha).alias("sha"), F.col("id").alias("least"), F.lit(1).cast("long").alias("rows"))
    heavy = F.broadcast(hits.where(F.col("rows") * HEAVY > total))
    light = hits.where(F.col("rows") * HEAVY <= total)
    columns = ["id", "digest", F.col(sha).alias("sha"), "least", "rows"]
    rest = marked.where("maybe")
    grouped = rest.join(heavy, "digest").select(*columns).unionByName(rest.join(heavy.select("digest"), "digest", "left_anti").join(light, "digest", "left").select(*columns))
    grouped = cut(grouped.select("id", "digest", "sha", F.when(F.col("rows").isNull(), F.col("id")).otherwise(F.col("least")).alias("least"), F.coalesce("rows", F.lit(1)).cast("long").alias("rows")))

    # byte verification of the texts of hits, found by their ids
    ids = grouped.where("rows > 1").select("id")
    held = _sieve.maybe(given, F.xxhash64("id"), _sieve.sieve(ids, F.xxhash64("id"), ids.count()), "maybe").where("maybe")
    spread = bodies(held).groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    collided = cut(spread.where("low <> high").select("digest"))

    if collided.limit(1).count():
        texts = bodies(given).join(collided, "digest", "left_semi").select("id", "digest", "body", "sha")
        groups = texts.groupBy("digest", "body").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
        split = texts.join(groups, ["digest", "body"]).select("id", "digest", "sha", "least", "rows")
        grouped = grouped.join(collided, "digest", "left_anti").select("id", "digest", "sha", "least", "rows").unionByName(split)
    return alone.unionByName(grouped).select(F.col("id").alias("doc_id"), F.col("least").alias("keep_id"), F.col("rows").alias("group_size"), F.col("id").eqNullSafe(F.col("least")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of equal texts: that with the smallest id."""
    found = exact_duplicates(docs, doc_id, text)
    dropped = cut(found.where("not kept").select("doc_id", "text_sha256").distinct())
    return _sieve.drop_rows(docs, {"doc_id": F.col(doc_id), "text_sha256": F.sha2(normalised(F.col(text)).cast("binary"), 256)}, dropped, ["doc_id"])

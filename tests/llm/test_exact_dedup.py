"""Exact dedup against brute force."""

import hashlib
import re

import pytest
from annolith.llm import exact_dedup as X
from pyspark.sql import functions as F

ROWS = [(5, "a b"), (3, "a  b"), (9, "a\t\nb"), (7, "c"), (None, "c"), (None, None), (1, ""), (2, None), (4, " "), (6, "\n\n"), (8, "a b "), (8, "A b"), (8, "A b"), (10, "é x"), (11, "é x"), (None, "only"), (None, "only"), (12, "z" * 200000), (13, "z" * 200000), (14, "y" * 200000)]
SCHEMA = "doc_id long, text string, kept string, digest int"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (d, _), t in zip(rows, norm, strict=True):
        ids = [r[0] for r, x in zip(rows, norm, strict=True) if x == t]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [X.sha256, lambda body: F.length(body).cast("string").cast("binary")])
def test_matches_brute_force(spark, digest):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA).repartition(3)
    assert sorted(map(tuple, X.exact_duplicates(docs, digest=digest).collect()), key=str) == brute(ROWS)


def test_heavy_digests(spark, monkeypatch):
    monkeypatch.setattr(X, "HEAVY", 4)
    rows = ROWS + [(100 + i, "hot text") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, X.exact_duplicates(docs).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert X.exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_appends_and_compactions_give_the_same_index(spark):
    one, many = X.DigestIndex(spark), X.DigestIndex(spark)
    rows = spark.range(500).selectExpr("unhex(sha2(cast(id % 37 as string), 256)) as digest", "id")
    one.append(rows)
    for k in range(11):
        many.append(rows.where(f"id % 11 = {k}"))
    one.compact(), many.compact()
    assert len(many.runs) == 1
    assert sorted(map(str, one.read().collect())) == sorted(map(str, many.read().collect()))


@pytest.mark.parametrize("memtables", [1, 3, 4, 9, 16])
def test_any_number_of_memtables_gives_the_same(spark, memtables):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, X.exact_duplicates(docs, memtables=memtables).collect()), key=str) == brute(ROWS)


def test_levels_filters_and_deleted_runs(spark):
    index = X.DigestIndex(spark)
    rows = spark.range(600).selectExpr("unhex(sha2(cast(id % 451 as string), 256)) as digest", "id")
    for k in range(9):
        index.append(rows.where(f"id % 9 = {k}"))
    assert sorted(r.level for r in index.runs) == [0, 1, 1]
    folder = spark._jvm.org.apache.hadoop.fs.Path(index.path)
    assert len(folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)) == 3  # merged runs are gone
    known = index.probed(spark.range(300, 900).selectExpr("unhex(sha2(cast(id as string), 256)) as digest", "id")).collect()
    assert all(r.met for r in known if r.id < 451)
    assert sum(r.met for r in known if r.id >= 451) < 20  # a filter lets few others through
    hits = index.hits()
    assert sorted(r.level for r in index.runs) == [1, 1, 1]
    assert {(r.least, r.rows) for r in hits.collect()} == {(i, 2) for i in range(149)}


def test_keep_first(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA)
    kept = X.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in brute(ROWS) if r[3]), key=str)

"""Sharding against the permutation in Python."""

import zlib
from collections import Counter

import pytest
from annolith.llm import shard as S

SCHEMA = "doc_id long, text string, slot string, number int"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000, 4097])
def test_permutation(n):
    assert sorted(S.permute(i, n, 7) for i in range(n)) == list(range(n))


def test_shuffles(spark):
    n = 4000
    p = [S.permute(i, n, 1) for i in range(n)]
    assert sum(abs(a - i) for i, a in enumerate(p)) / n == pytest.approx(n / 3, rel=0.1)
    assert sum(b - a in (1, -1) for a, b in zip(p, p[1:], strict=False)) < 10


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_matches_python(spark, shards):
    rows = [(None, None), (None, "x")] + [(i % 230, f"é{i % 50}") for i in range(261)] + [(500, ""), (500, "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    key = sorted(((d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16), d) for d, t in rows)
    want = []
    for i, (k, d) in enumerate(key):
        p = S.permute(i, len(rows), 20240229)
        want.append((d, k[3], k[2], "rows", p % shards, p // shards, None))
    got = sorted(map(tuple, S.shuffled_shards(docs, shards).collect()), key=str)
    assert got == sorted(want, key=str)
    sizes = Counter(r[4] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 or len(rows) < shards


def test_empty_table(spark):
    assert S.shuffled_shards(spark.createDataFrame([], SCHEMA), 40).collect() == []

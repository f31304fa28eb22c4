"""Benchmark decontamination against brute force."""

import re

import pytest
from annolith.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n_words string, hits int"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out, sought = [], {}
    for item, body in items:
        w = words(body)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if n else ():
            sought.setdefault(tuple(w[s : s + n]), set()).add(str(item) if item is not None else "")
    for doc_id, text in docs:
        d = words(text)
        hit, ids = set(), set()
        for n in {len(x) for x in sought}:
            for p in range(len(d) - n + 1):
                if found := sought.get(tuple(d[p : p + n])):
                    hit.update(range(p, p + n))
                    ids |= found
        out.append((doc_id, len(d), len(hit), len(ids), D.items_digest(ids), bool(hit)))
    return sorted(out, key=str)


ITEM = "the quick brown fox jumps over the lazy dog and then runs far away from here"
DOC_ROWS = [
    (1, "Intro. THE quick, brown fox jumps over the lazy dog; and then runs far... end"),
    (2, "nothing to see"),
    (3, None),
    (4, ""),
    (5, "x " * 3000 + ITEM + " y" * 3000),
    (5, "x " * 3000 + ITEM + " y" * 3000),
    (None, "tiny é item here"),
    (7, "the quick brown fox jumps over the lazy cat and then"),
    (8, "a b " * 20),
    (9, "The QUICK " + ITEM + " " + ITEM),
    (10, "tiny é itemhere tiny É item"),
]
ITEM_ROWS = [(1, ITEM), (2, "tiny é item"), (3, None), (4, "..."), (5, "a b a b a b a b a b a b"), (1, "nothing"), (None, "cat and"), (7, ITEM)]


def report(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "x", 3) for r in docs], DOCS)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, D.contamination_report(d, i, **options).collect()), key=str)


@pytest.mark.parametrize(("block_words", "count_words"), [(50_000, 1_000_000), (12, 20), (12, 1_000_000), (3, 1)])
def test_matches_brute_force(spark, block_words, count_words):
    assert report(spark, DOC_ROWS, ITEM_ROWS, block_words=block_words, count_words=count_words) == brute(DOC_ROWS, ITEM_ROWS)


def test_windows_of_the_same_words_are_one():
    block = D.make_block([("b", ITEM), (None, "x y"), ("a", ITEM.upper()), ("a", "X, y")], 10, 5)
    assert len(block.first) == 7 + 1 and block.words == 2 * 16 + 4
    assert [sorted(block.owners([i])) for i in range(8)] == [["a", "b"]] * 7 + [["", "a"]]


def test_other_windows(spark):
    assert report(spark, DOC_ROWS, ITEM_ROWS, window=3) == brute(DOC_ROWS, ITEM_ROWS, 3)


def test_empty_tables(spark):
    assert report(spark, [], ITEM_ROWS) == []
    assert report(spark, DOC_ROWS, []) == brute(DOC_ROWS, [])


def test_filter_keeps_clean_rows_with_all_columns(spark):
    d = spark.createDataFrame([(*r, "x", 3) for r in DOC_ROWS], DOCS)
    kept = D.decontaminate(d, spark.createDataFrame(ITEM_ROWS, "item_id long, text string"))
    assert kept.columns == d.columns
    clean = [r[0] for r in brute(DOC_ROWS, ITEM_ROWS) if not r[5]]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_real_tables(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = sorted(map(tuple, D.contamination_report(docs, items).collect()), key=str)
    rows = [[tuple(r) for r in x.collect()] for x in (docs.select("doc_id", "text"), items.select("item_id", "text"))]
    assert got == brute(*rows)
    assert any(r[5] for r in got)

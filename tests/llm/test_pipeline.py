"""The corpus pipeline, stage by stage against brute force."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as C
import test_decontaminate
import test_language
import test_near_dup
from annolith.llm import language


def test_stages_take_effect_and_keep_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(90001, "123 ... !", None, "x", 9), (90002, None, "en", "x", 0), (90003, "", None, None, None)], docs.schema)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents"))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    before = spark.read.parquet(str(tmp_path / "documents"))
    for name, stage in C.STAGES[:-1]:
        rows = {r.doc_id: r.text for r in before.collect()}
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns
        kept = {r.doc_id for r in after.collect()}
        if name == "language_id":
            model = language.train(before.where(~language.held_out(before.doc_id)))
            found = {d: test_language.brute(model, t) for d, t in rows.items()}
            want = {d for d, (lang, score) in found.items() if lang != "und" and score >= 0.34}
        elif name == "exact_dedup":
            least = {}
            for d in sorted(rows):
                least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[d]), d)
            want = set(least.values())
        elif name == "ngram_jaccard":
            want = {d for d, _, c in test_near_dup.brute(sorted(rows.items()), 5, 80) if d == c}
        else:
            want = {r[0] for r in test_decontaminate.brute(rows.items(), items) if not r[5]}
        assert kept == want
        assert kept < set(rows)
        before = after
    pieces = C.STAGES[-1][1](spark, before, sf_dir).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in before.select("doc_id").collect()}
    assert max(p.offset + p.length for p in pieces) <= 2048


def test_run(spark, sf_dir):
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "decontamination", "packing"]
    assert C.run(spark, sf_dir).count() > 0


def test_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        C.run(spark, str(tmp_path))

"""Language identification: held-out accuracy, mixtures, odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from annolith.llm import _bytes as B
from annolith.llm import language as L

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int"
EN = "the cat and the dog were in the house with their friends and they had some food"
DE = "die katze und der hund waren in dem haus mit ihren freunden und sie hatten etwas essen"
FR = "le chat et le chien étaient dans la maison avec leurs amis et ils avaient un peu de nourriture"


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, t + f" x{i}", n) for i, (t, n) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr")] * 6)]
    return L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_rows(spark):
    got = spark.range(-5, 300).select("id", L.held_out(pytest.importorskip("pyspark.sql.functions").col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_single_and_mixed_texts(small):
    texts = [EN, DE.upper(), FR, f"{EN} {EN} {DE}", f"{DE} {FR} {DE}", None, "", "123 ... !", "…—", "日本語", "É"]
    langs, scores = small.predict(pa.array(texts, pa.string()))
    assert langs[:5] == ["en", "de", "fr", "en", "de"]
    assert scores[0] == scores[1] == 1.0
    assert 0.5 < scores[3] < 0.8 and 0.5 < scores[4] < 0.8
    assert langs[5:9] == ["und"] * 4 and not scores[5:9].any()
    assert all(x in small.langs for x in langs[9:]) and (scores >= 0).all() and (scores <= 1).all()


def test_rows_do_not_affect_each_other(small):
    texts = [EN, DE, "chat", "der", "é", "the", FR * 50, None, "und"]
    together = small.predict(pa.array(texts, pa.string()))
    alone = [small.predict(pa.array([t], pa.string())) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert np.allclose(together[1], [a[1][0] for a in alone])


def test_proportions_match_plain_em(small):
    chunk = next(B.chunks(pa.array([f"{EN} {DE} {DE}"])))
    w, score, _ = small.word_scores(chunk)
    pi, ll = L.em(np.exp(score), np.ones(len(w), np.int64), np.array([len(w)]), np.ones((1, 3), bool))
    x = np.full(3, 1 / 3)
    for _ in range(500):
        r = np.exp(score) * x
        x = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    assert np.allclose(pi[0], x, atol=0.02)
    assert ll[0] == pytest.approx(np.log((np.exp(score) * x).sum(axis=1)).sum(), abs=0.1)


def test_accuracy_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 30
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert L.identify(none).collect() == []
    rows = [(1, EN, None, "s", 1), (None, None, None, "s", 1), (1, EN, None, "s", 1)]
    got = L.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 3


def test_filter_keeps_columns(spark, small):
    rows = [(1, EN, "en", "s", 1), (2, "12", None, "s", 1), (3, None, "en", "s", 1), (None, DE, None, None, None)]
    kept = L.keep_identified(spark.createDataFrame(rows, SCHEMA), small)
    assert kept.columns == ["doc_id", "text", "lang", "score", "lang_pred"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, None]


def plain_em(p, allowed):
    pi = {k: 1 / len(allowed) for k in allowed}
    for _ in range(L.ROUNDS):
        new = dict.fromkeys(allowed, 0.0)
        for row in p:
            z = sum(pi[k] * row[k] for k in allowed)
            for k in allowed:
                new[k] += pi[k] * row[k] / z / len(p)
        moved = max(abs(new[k] - pi[k]) for k in allowed)
        pi = new
        if moved < 1e-3:
            break
    return pi, sum(math.log(sum(pi[k] * row[k] for k in allowed)) for row in p)


def brute(model, text):
    """Label and score word by word, from the model's tables alone."""
    fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in s)
    words = re.findall(r"[A-Za-z\u0080-\U0010ffff]+", text or "")
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    n = len(model.langs)
    scores = []
    for word in map(fold, words):
        b = b" " + word.encode() + b"  "
        codes = [(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761) % 2**32) >> (32 - L.BITS) for i in range(len(b) - 3)]
        whole = int(B.word_hashes(np.frombuffer(word.encode(), np.uint8), B.Words(np.array([0]), np.array([len(word.encode())]), np.array([0, 1])))[0]) >> (64 - L.BITS)
        row = [sum(int(model.tables[0, k, c]) for c in codes) + int(model.tables[1, k, whole]) for k in range(n)]
        scores.append([max(x - max(row), -int(L.CLIP * L.UNIT)) / L.UNIT for x in row])
    p = [[math.exp(x) for x in row] for row in scores]
    single = [sum(row[k] for row in scores) for k in range(n)]
    top = max(range(n), key=lambda k: single[k])
    mixed, _ = plain_em(p, range(n))
    order = [top] + [k for k in sorted(range(n), key=lambda k: -mixed[k]) if k != top]
    best, like = {top: 1.0}, single[top]
    for size in range(1, n):
        pi, ll = plain_em(p, order[: size + 1])
        if ll - like <= L.PENALTY * math.log(len(words) + 1):
            break
        best, like = pi, ll
    lang = max(range(n), key=lambda k: best.get(k, 0.0))
    return model.langs[lang], min(1.0, best[lang])


def mixtures(seed, n):
    rnd = random.Random(seed)
    words = [t.split() for t in (EN, DE, FR)]
    return [" ".join(rnd.choice(words[rnd.choice(langs)]) for _ in range(rnd.choice([1, 2, 5, 30, 200]))) for langs in (rnd.choices(range(3), k=rnd.randint(1, 3)) for _ in range(n))]


def test_matches_brute_force(spark, sf_dir, small):
    texts = [*mixtures(1, 60), None, "", "12", "É", "日本語", "the…the", "X" * 300]
    langs, scores = small.predict(pa.array(texts, pa.string()))
    for text, lang, score in zip(texts, langs, scores, strict=True):
        want = brute(small, text)
        assert (lang, score) == (want[0], pytest.approx(want[1], abs=1e-9)), text
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")  # the query itself, over a table
    model = L.train(docs.where(~L.held_out(docs.doc_id)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = L.identify(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if len(texts[r.doc_id] or "") < 1500:
            want = brute(model, texts[r.doc_id])
            assert (r.lang_pred, r.score) == (want[0], pytest.approx(want[1], abs=1e-9))


def test_scores_are_the_same_for_any_split(small):
    texts = mixtures(2, 300)
    whole = small.predict(pa.array(texts))
    parts = [small.predict(pa.array([t])) for t in texts]
    assert whole[0] == [x[0][0] for x in parts]
    assert whole[1].tolist() == [float(x[1][0]) for x in parts]


def test_very_long_texts_are_read_whole(small, monkeypatch):
    texts = [f"{t} 12 " * 60 for t in mixtures(3, 12)] + ["1" * 5000 + " der"]
    whole = small.predict(pa.array(texts))
    monkeypatch.setattr(B, "CHUNK", 1 << 10)
    monkeypatch.setattr(L, "LEAST", 0)
    cut = small.predict(pa.array(texts))
    assert whole[0] == cut[0]
    assert np.allclose(whole[1], cut[1])
    langs, scores = small.predict(pa.array(["é" * 5000, "x" * 5000]))  # one word, in pieces
    assert set(langs) <= set(small.langs) and (scores > 0).all()


def test_too_many_labels(spark):
    with pytest.raises(ValueError, match="languages"):
        L.train(spark.range(600).selectExpr("id as doc_id", "'a' as text", "cast(id as string) as lang"))

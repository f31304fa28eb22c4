"""Packing against brute force and the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from annolith.llm import packing as P
from annolith.llm.tokens import Encoder
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = Encoder.of(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


ODD = ["", "It's THE end. Don't stop! 3.14", "a b İstanbul ΣΣ é ﬁ Ω", "x <|endoftext|> y<|startoftext|>z", "\x1c\x1d ctrl \x00", "× café ÉTÉ 'é 'S 'Re 'll'", "中文。 \U0001f600!", "Á b\n\n\nc. \t d", "'t", "''s .'s o'the", "ŉ ſſ"]


@pytest.mark.parametrize("text", ODD)
def test_ids_match_the_tokenizer(text):
    ids, ends, _ = ENCODER.encode([text])
    assert ids.tolist() == ids_of(text)
    assert ends.tolist() == [len(ids)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aBcS sté'’.,!?0123 \n\t-–_#"), st.characters(codec="utf-8"))))
def test_ids_match_for_any_text(text):
    assert ENCODER.encode([text, "x"])[0].tolist() == ids_of(text) + ids_of("x")


def brute(places, penalties, length):
    best = [(0, 0)] + [(float("inf"), 0)] * len(places)
    p = [0, *places]
    for j in range(1, len(p)):
        for i in range(j):
            n = p[j] - p[i]
            if n <= length:
                pad = 0 if n & (n - 1) == 0 else length - n
                best[j] = min(best[j], (best[i][0] + pad + penalties[j - 1] + 1, i))
    return best[-1][0]


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_optimal(seed):
    rnd = random.Random(seed)
    places = np.cumsum([rnd.randint(1, 20) for _ in range(rnd.randint(1, 60))])
    penalties = np.array([rnd.choice([0, 3, 9]) for _ in places])
    cuts = P.best_cuts(places, penalties, 32)
    cost, last = 0, 0
    for c in cuts:
        n = places[c] - last
        assert n <= 32
        cost += (0 if n & (n - 1) == 0 else 32 - n) + penalties[c] + 1
        last = places[c]
    assert cuts[-1] == len(places) - 1
    assert cost == brute(places.tolist(), penalties.tolist(), 32)


@pytest.mark.parametrize("block", [64, 1 << 18])
def test_pieces_are_whole(spark, block):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["word", "Sentence.", "naïve", "12", "x!"]) for _ in range(rnd.choice([0, 3, 40, 900])))) for i in range(60)]
    rows += [(None, "null id"), (7, None), (7, ""), (8, ODD[2]), (9, "nostop " * 3000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, length int").repartition(2)
    got = P.packed_pieces(docs, PATH, block=block, length=256).collect()
    sequences = {}
    for r in got:
        assert 0 < r.length <= 256
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    want = sorted((str(d), zlib.crc32(np.array([*ids_of(t), 1], "<u4").tobytes())) for d, t in rows)
    docs_seen = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        docs_seen.setdefault(str(r.doc_id), []).append(r)
    assert set(docs_seen) == {d for d, _ in want}
    assert sum(r.length for r in got) == sum(len(ids_of(t)) + 1 for _, t in rows)
    for d, t in rows:
        full = np.array([*ids_of(t), 1], "<u4")
        mine = [r for r in docs_seen[str(d)] if r.doc_tokens == len(full)]
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            if r.start == at:
                assert r.ids_crc32 == zlib.crc32(full[r.start : r.start + r.length].tobytes())
                at += r.length
        assert at == len(full)


def test_empty_table(spark):
    assert P.packed_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []

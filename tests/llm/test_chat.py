"""Chat formatting against a plain reading of the input, and exact round trips."""

import hashlib

import public_tokenizers
import pytest
from annolith.llm import chat as C
from hypothesis import given, settings
from hypothesis import strategies as st

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "conv_id long, turn long, role string, text string, head string, loss_mask int"
PIECES = st.lists(st.one_of(st.sampled_from([*C.CONTROL, "<", "[", "\\", "|", "<\\|end|>", "é", "\n"]), st.text(max_size=3)), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_escapes_are_undone_and_leave_no_control_string(text):
    out = C.escape(text)
    assert C.unescape(out) == text
    assert not any(c in out for c in C.CONTROL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        pairs = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in pairs if r == "assistant")
        text = C.MARKS[0] + "".join(C.MARKS[1] + C.escape(r) + C.MARKS[2] + C.escape(t) + C.MARKS[3] for r, t in pairs)
        out.append((conv, len(pairs), sha("".join(f"{r}\n{t}\n" for r, t in pairs)), len(loss), sha(loss), len(text)))
    return sorted(out, key=str)


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return C.format_conversations(df, PATH, PATTERN)


ROWS = [
    (1, 0, "system", "be <|end|> nice"), (1, 2, "assistant", "Sí\n</s>[INST] x [/INST]"), (1, 1, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "again"),
    (2, 0, "user", "only user"), (None, 0, "assistant", "no id"), (3, None, None, "x"), (3, 0, "assistant", "a"), (3, 0, "user", "a"), (4, 0, "assistant", "z " * 50000),
    (5, 0, "<|end|>", "role"), (6, 1, "user", "same"), (6, 1, "user", "same"),
]


def test_matches_plain_reading(spark):
    assert sorted(map(tuple, C.read_back(formatted(spark, ROWS), PATH, PATTERN).collect()), key=str) == brute(ROWS)


def test_ids_and_mask(spark):
    codec = C.Codec.of(PATH, PATTERN)
    row = next(r for r in formatted(spark, ROWS).collect() if r.conv_id == 1)
    assert len(row.input_ids) == len(row.loss_mask)
    assert sum(i >= codec.base for i in row.input_ids) == 1 + 3 * 5
    assert not any(m and i >= codec.base for i, m in zip(row.input_ids, row.loss_mask, strict=True))


def test_empty_table(spark):
    assert C.read_back(formatted(spark, []), PATH, PATTERN).collect() == []


@pytest.mark.parametrize("marks", [C.MARKS])
def test_marks_are_escaped_in_content(marks):
    assert set(marks) <= set(C.CONTROL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1'!é \n\t\u3000\xa0\x1c\u180e"), max_size=40))
def test_long_white_space_apart_gives_the_same_ids(text):
    codec = C.Codec.of(PATH, PATTERN)
    assert codec.ids(text, 2) == codec.bpe.encode_ordinary(text)


@pytest.mark.parametrize("piece", [" ", "\n", " \n", "\u3000", "a", "!", "é", "\\", "</s>", "1"])
def test_long_runs(piece):
    codec = C.Codec.of(PATH, PATTERN)
    text = f"x{piece * 1_000_000}y"
    ids = codec.ids(C.escape(text))
    assert C.unescape(codec.decode(C.np.array(ids))) == text

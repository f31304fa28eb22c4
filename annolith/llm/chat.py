r"""Chat formatting by token-level assembly.

A conversation becomes ``begin (turn ROLE text TEXT end)*``.  Roles and texts are encoded each on its
own, so no merge crosses a border, and the control marks are ids beyond the vocabulary, spliced in between: content
cannot produce them.  In the rendered text the marks are strings, so control strings that occur in content get
a backslash after their first character (one more if there are some already), which is undone by removing one.
The loss mask is a prefix sum: +1 after the ``text`` mark of an assistant turn, -1 at its ``end``.

Encoding runs where the rows are; only ids move, once, to lie by conversation and turn.  Assembly streams over the
sorted rows, a conversation at a time.

Cases: null roles and texts are empty; rows without a conversation id form one conversation; turns that tie (or are null,
which come first) are ordered by role, then by encoded text, so repeated rows each stay a turn.  Other columns are ignored, whatever their
names.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of common chat templates; content may hold any of them.
CONTROL = ("<|begin|>", "<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
MARKS = CONTROL[:4]
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")
#: White space so long is encoded apart: the encoder's own splitting recurses over it.
RUN = 4096
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_workers: dict = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


class Codec:
    """A byte-level BPE with the marks' ids after its vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.base = max(ranks.values()) + 2  # the id after the ranks is left free

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if path not in _workers:
            _workers[path] = cls(path, pattern)
        return _workers[path]

    def ids(self, text: str, run: int = RUN) -> list[int]:
        """The encoder's ids.  Before other text the last character of a run of white space belongs to what follows; the rest is a piece of its own."""
        out, at = [], 0
        for m in re.finditer(f"[{_WHITE}]{{{run},}}", text):
            begin, end = m.start(), m.end() - (m.end() < len(text))
            out += self.bpe.encode_ordinary(text[at:begin])
            out += self.bpe._encode_single_piece(text[begin:end].encode())
            at = end
        return out + self.bpe.encode_ordinary(text[at:])

    def encode(self, text: str | None) -> bytes:
        return np.array(self.ids(escape(text or "")), dtype="<i4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.bpe.decode_bytes(ids.tolist()).decode()

    def render(self, ids: np.ndarray) -> str:
        """The formatted text: marks as strings."""
        out, last = [], 0
        for i in np.flatnonzero(ids >= self.base).tolist():
            out += [self.decode(ids[last:i]), MARKS[ids[i] - self.base]]
            last = i + 1
        return "".join([*out, self.decode(ids[last:])])


def assemble(turns: list[tuple[str, bytes, bytes]], base: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of a conversation's (role, encoded role, encoded text) turns."""
    begin, turn, text, end = (np.array([base + i], dtype="<i4") for i in range(4))
    parts, marks, n = [begin], [], 1
    for role, head, body in turns:
        h, b = np.frombuffer(head, "<i4"), np.frombuffer(body, "<i4")
        parts += [turn, h, text, b, end]
        if role == "assistant":
            marks.append((n + len(h) + 2, n + len(h) + 2 + len(b)))
        n += len(h) + len(b) + 3
    step = np.zeros(n + 1, np.int64)
    for a, b in marks:
        step[a] += 1
        step[b] -= 1
    return np.concatenate(parts), np.cumsum(step)[:-1].astype(np.int8)


def format_conversations(rows: DataFrame, path: str, pattern: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv_id, input_ids, loss_mask."""
    rows = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    kind, order = rows.schema[0].dataType.simpleString(), rows.schema[1].dataType.simpleString()

    def encode(batches):
        codec = Codec.of(path, pattern)
        for batch in batches:
            roles = [r or "" for r in batch.column(2).to_pylist()]
            heads = {r: codec.encode(r) for r in set(roles)}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array([heads[r] for r in roles], pa.binary()), pa.array([codec.encode(t) for t in batch.column(3).to_pylist()], pa.binary())], ["conv_id", "turn", "role", "head", "body"])

    def join(batches):
        codec = Codec.of(path, pattern)
        at, held, any_yet = None, [], False

        def done():
            ids, mask = assemble(held, codec.base)
            return pa.RecordBatch.from_arrays([pa.array([at], types), pa.array([ids.tolist()], pa.list_(pa.int32())), pa.array([mask.tolist()], pa.list_(pa.int8()))], ["conv_id", "input_ids", "loss_mask"])

        for batch in batches:
            types = batch.column(0).type
            for conv, r, head, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if any_yet and conv != at:
                    yield done()
                    held = []
                at, any_yet = conv, True
                held.append((r, head, body))
        if any_yet:
            yield done()

    encoded = rows.mapInArrow(encode, f"conv_id {kind}, turn {order}, role string, head binary, body binary")
    return encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "body").mapInArrow(join, f"conv_id {kind}, input_ids array<int>, loss_mask array<tinyint>")


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per conversation, from ids and mask alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        codec = Codec.of(path, pattern)
        for batch in batches:
            out = []
            for ids, mask in zip(batch.column(1), batch.column(2), strict=True):
                ids, mask = np.array(ids.values, dtype=np.int32), np.array(mask.values, dtype=np.int8)
                turn, text, end = (np.flatnonzero(ids == codec.base + i) for i in (1, 2, 3))
                digest = hashlib.sha256()
                for a, b, c in zip(turn, text, end, strict=True):
                    digest.update(f"{unescape(codec.decode(ids[a + 1 : b]))}\n{unescape(codec.decode(ids[b + 1 : c]))}\n".encode())
                edge = np.flatnonzero(np.diff(mask, prepend=0, append=0))
                loss = [unescape(codec.decode(ids[a:b])) for a, b in zip(edge[::2], edge[1::2], strict=True)]
                out.append((len(turn), digest.hexdigest(), sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), len(codec.render(ids))))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, columns, strict=True)]], ["conv_id", *names])

    return formatted.select("conv_id", "input_ids", "loss_mask").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def escaped_length_sql(column: str) -> str:
    """DuckDB: code points of an escaped text."""
    pattern = rf"([<\[])(\\*)({_TAILS})".replace("'", "''")
    return rf"length(regexp_replace({column}, '{pattern}', '\1\\\2\3', 'g'))"

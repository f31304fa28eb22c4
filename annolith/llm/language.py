"""Language identification by multilingual mixture inference.

A document's words come from a mixture of languages.  A word's likelihood in a language is that of its
byte trigrams (with a blank before and after) and of the word as a whole, under smoothed
counts of a training sample; expectation-maximisation finds the mixture's proportions.  The set of
languages grows from the likeliest one, always by the one with the next largest share, while the
log-likelihood rises by more than ``PENALTY`` times the logarithm of the number of words.  The document's
language is that of the largest proportion, the score is this proportion.

A result depends on the row's text alone, to the last bit, whatever rows lie beside it: words' scores are sums of whole
numbers (log-likelihoods in steps of 1 / ``UNIT``), and each row's expectation-maximisation ends by its own change.  Of a text of over about a megabyte each distinct
word is held once with its count, so memory grows with its vocabulary; a word of over a megabyte is read in pieces.

Training: at most about ``sample`` rows of each language, those whose hash of text and id is
smallest; everything else covers all rows and whole texts.  A prediction reads the text only.

Cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if there
are no labelled rows.  More than ``MOST_LANGS`` distinct labels are refused.  Letters of no trained language give equal shares; ties go to the language
that sorts first.  Other columns are ignored, whatever their names, or kept by ``keep_identified``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm import _bytes as B
from annolith.llm._store import bounded, tidied

SAMPLE = 1500
BITS = 17
PENALTY = 3.0
#: No word speaks more strongly than this against a language (in nats).
CLIP = 8.0
ROUNDS = 25
UNIT = 1 << 16
#: Bytes that are read at once, however many languages there are.
LEAST = 1 << 14
#: Each language takes a megabyte of the model, which is broadcast.
MOST_LANGS = 200
UNKNOWN = "und"
_U = np.uint64
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)], dtype=bool)


def _folded(chunk: B.Chunk) -> np.ndarray:
    """Lower-cased bytes (ASCII and Latin-1 letters), blanks for all that is no letter."""
    buf = chunk.buf
    out = np.where(_LETTER[buf], B.LOWER[buf], np.uint8(32))
    lead = np.flatnonzero(buf[:-1] == 0xC3) + 1
    low = buf[lead]
    out[lead] = np.where((low >= 0x80) & (low <= 0x9E) & (low != 0x97), low + 32, low)
    return out


def _codes(folded: np.ndarray) -> np.ndarray:
    """Bucket of the trigram from each byte on, one blank put before and two after."""
    x = np.concatenate([[32], folded, [32, 32]]).astype(np.uint32)
    return ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _features(chunk: B.Chunk):
    """Words, trigram buckets by byte, and each word's hash.  A word's trigrams are at [start, end) of the buckets.

    A word at a row's edge has blanks beyond it, whatever the next row holds: words never touch across rows
    in the buckets of their first and last trigram but through these, so the edges are set by hand.
    """
    folded = _folded(chunk)
    w = B.words(chunk, _LETTER)
    codes = _codes(folded)
    h = B.word_hashes(folded, w) if len(w) else np.zeros(0, _U)
    touching = np.flatnonzero(w.start[1:] == w.end[:-1])  # words of neighbouring rows without anything between
    if len(touching):
        x = np.concatenate([folded, [32, 32]]).astype(np.uint32)
        code = lambda a, b, c: ((a << np.uint32(16) | b << np.uint32(8) | c) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        last, first = w.end[touching] - 1, w.start[touching + 1]
        blank = np.full(len(touching), 32, np.uint32)
        before = np.where(w.start[touching] < last, x[np.maximum(last - 1, 0)], blank)
        after = np.where(first + 1 < w.end[touching + 1], x[first + 1], blank)
        codes[last] = code(before, x[last], blank)
        codes[first] = code(blank, x[first], after)
    return w, codes, h


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - BITS)).astype(np.int64)


def _pieces(chunk: B.Chunk, limit: int):
    """A long row in chunks of about ``limit`` bytes, cut between words, or between characters where a word is longer."""
    a, n = 0, len(chunk.buf)
    while a < n:
        b = min(n, a + limit)
        if b < n:
            gaps = np.flatnonzero(~_LETTER[chunk.buf[a:b]])
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            while b < n and chunk.buf[b] & 0xC0 == 0x80:
                b -= 1
        yield B.Chunk(chunk.first, chunk.buf[a:b], np.array([0, b - a]))
        a = b


@dataclass
class Model:
    """Log-probabilities in whole steps by bucket and language; ``tables`` has trigrams, then whole words."""

    langs: list[str]
    tables: np.ndarray

    def word_scores(self, chunk: B.Chunk) -> tuple[B.Words, np.ndarray, np.ndarray]:
        """Words, each one's log-likelihood by language (the best being 0 and none below -CLIP), and its hash."""
        w, codes, h = _features(chunk)
        whole = _bucket(h)
        out = np.empty((len(w), len(self.langs)), np.int64)
        for k in range(len(self.langs)):
            sums = np.concatenate([[0], np.cumsum(self.tables[0, k][codes], dtype=np.int64)])
            out[:, k] = sums[w.end] - sums[w.start] + self.tables[1, k][whole]
        if out.size:
            out -= out.max(axis=1, keepdims=True)
            np.maximum(out, -int(CLIP * UNIT), out=out)
        return w, out / UNIT, h

    def _distinct(self, chunk: B.Chunk, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and counts of a long row's distinct words."""
        held = np.zeros(0, _U), np.zeros((0, len(self.langs))), np.zeros(0, np.int64)
        for piece in _pieces(chunk, limit):
            _, score, h = self.word_scores(piece)
            h, score, n = np.concatenate([held[0], h]), np.concatenate([held[1], score]), np.concatenate([held[2], np.ones(len(h), np.int64)])
            h, first, which = np.unique(h, return_index=True, return_inverse=True)
            total = np.zeros(len(h), np.int64)
            np.add.at(total, which, n)
            held = h, score[first], total
        return held[1], held[2]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        langs, scores = [], []
        limit = max(LEAST, B.CHUNK // max(1, len(self.langs) // 4))
        for chunk in B.chunks(texts, limit):
            if chunk.rows == 1 and len(chunk.buf) > limit:
                seen = [any(_has_letter(piece)[0] for piece in _pieces(chunk, limit))]
                words, weight = self._distinct(chunk, limit)
                counts = np.array([len(words)])
            else:
                seen = _has_letter(chunk)
                w, words, _ = self.word_scores(chunk)
                counts, weight = w.counts, np.ones(len(words), np.int64)
            share = shares(words, weight, counts)
            for i in range(chunk.rows):
                known = seen[i] and self.langs
                best = int(share[i].argmax()) if known else 0
                langs.append(self.langs[best] if known else UNKNOWN)
                scores.append(min(1.0, float(share[i, best])) if known else 0.0)
        return langs, np.array(scores, dtype=np.float64)


def shares(score: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Proportions by row and language within the chosen set of languages, from the words' scores and weights, ``counts`` words a row."""
    rows, n_langs = len(counts), score.shape[1]
    full = np.flatnonzero(counts)
    share = np.zeros((rows, n_langs))
    share[:, :1] = 1.0
    if not len(full) or not n_langs:
        return share
    n = counts[full]
    first = np.cumsum(n) - n
    total = np.add.reduceat(weight, first)
    p = np.exp(score)
    mixed, _ = em(p, weight, n, np.ones((len(full), n_langs), bool))
    rank = np.argsort(-mixed, axis=1, kind="stable")
    single = np.add.reduceat(score * weight[:, None], first, axis=0)
    # the likeliest language alone first, then the others by their shares
    top = single.argmax(axis=1)
    rank = np.concatenate([top[:, None], rank[rank != top[:, None]].reshape(len(full), n_langs - 1)], axis=1)
    allowed = np.zeros((len(full), n_langs), bool)
    allowed[np.arange(len(full)), top] = True
    chosen = allowed.astype(float)
    like = single.max(axis=1)
    live = np.arange(len(full))
    for size in range(1, n_langs):
        allowed[live, rank[live, size]] = True
        word = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in live])
        pi, ll = em(p[word], weight[word], n[live], allowed[live])
        better = ll - like[live] > PENALTY * np.log(total[live] + 1.0)
        chosen[live[better]] = pi[better]
        like[live[better]] = ll[better]
        live = live[better]
        if not len(live):
            break
    share[full] = chosen
    return share


def em(p: np.ndarray, weight: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents of ``n`` words each, whose likelihoods are the rows of p.  A document is done when its own proportions hardly move."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    ended, like = pi.copy(), np.zeros(len(n))
    live = np.arange(len(n))
    for step in range(ROUNDS + 1):
        first = np.cumsum(n) - n
        r = p * np.repeat(pi, n, axis=0)
        z = r.sum(axis=1)
        if step < ROUNDS:
            r *= (weight / z)[:, None]
            new = np.add.reduceat(r, first, axis=0) / np.add.reduceat(weight, first)[:, None]
            done = np.abs(new - pi).max(axis=1) < 1e-3
            pi = new
        else:
            done = np.ones(len(n), bool)
        if done.any():
            words = np.repeat(done, n)
            z = (p[words] * np.repeat(pi[done], n[done], axis=0)).sum(axis=1)
            ended[live[done]] = pi[done]
            like[live[done]] = np.add.reduceat(np.log(z) * weight[words], np.cumsum(n[done]) - n[done])
            if done.all():
                break
            live, p, weight, pi, n = live[~done], p[~words], weight[~words], pi[~done], n[~done]
    return ended, like


def _has_letter(chunk: B.Chunk) -> np.ndarray:
    ascii_letter = _LETTER[chunk.buf] & (chunk.buf < 128)
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = sums[chunk.at[1:]] > sums[chunk.at[:-1]]
    high = np.concatenate([[0], np.cumsum(chunk.buf >= 128)])
    for i in np.flatnonzero(~out & (high[chunk.at[1:]] > high[chunk.at[:-1]])):
        out[i] = any(c.isalpha() for c in chunk.buf[chunk.at[i] : chunk.at[i + 1]].tobytes().decode())
    return out


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Counts over a bounded sample of the rows whose language isn't null.

    The driver gets a count for each language and at most ``2 * 2**BITS`` counts of each.
    """
    rows = bounded(labelled).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text)), 1).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()}
    langs = sorted(sizes)
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not langs:
        return Model([], np.zeros((2, 0, 1 << BITS), np.int32))
    keep = F.lit(False)
    for name in langs:
        keep = keep | ((F.col("lang") == name) & (F.col("h") <= min(2**63 - 1, sample * 2**63 // sizes[name])))

    def count(batches):
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for name in set(names.tolist()):
                texts = batch.column(1).filter(pa.array(names == name))
                for chunk in B.chunks(texts):
                    w, codes, h = _features(chunk)
                    inside = np.zeros(len(codes) + 1, np.int64)
                    np.add.at(inside, w.start, 1)
                    np.add.at(inside, w.end, -1)
                    for kind, found in ((0, codes[np.cumsum(inside)[:-1] > 0]), (1, _bucket(h))):
                        held = total.setdefault((name, kind), np.zeros(1 << BITS, np.int64))
                        held += np.bincount(found, minlength=1 << BITS)
        for (name, kind), held in total.items():
            full = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array([kind] * len(full), pa.int32()), pa.array(full), pa.array(held[full])], ["lang", "kind", "bucket", "n"])

    counted = rows.where(keep).select("lang", "text").mapInArrow(tidied(count), "lang string, kind int, bucket long, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    tables = np.full((2, len(langs), 1 << BITS), 0.5)
    place = np.array([langs.index(x) for x in counted.column("lang").to_pylist()], dtype=np.int64)
    kind, bucket, n = (counted.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    tables[kind, place, bucket] += n
    return Model(langs, np.rint(np.log(tables / tables.sum(axis=2, keepdims=True)) * UNIT).astype(np.int32))


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced)."""
    docs = bounded(docs).drop("lang_pred", "score")
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, scores = held.value.predict(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidied(run), f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learnt from those documents that aren't held out."""
    model = train(docs.where(~held_out(F.col(doc_id))), lang, text, doc_id, sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.34) -> DataFrame:
    """``docs`` without the rows that have no language: no letter, or no language with a share of ``least``."""
    at = bounded(docs).columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, scores = held.value.predict(batch.column(at))
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)

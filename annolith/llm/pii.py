r"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in a text as it stands.  Then transducers rewrite disguises (homoglyphs, full-width and other
digits, spelled digits, ``at`` and ``dot`` in words or brackets, ``plus``) into plain characters.  They emit the normalised text in pieces, each with
the source range it stands for, so that identifiers found in it map back to source characters; what covers no rewritten piece or
overlaps a base identifier of its kind is left out.  Base identifiers always stay.

Offsets are code points, ends exclusive.  Kinds in order: email, ip, card, phone.

A bare ``at`` (or ``dot``) counts as a disguise only between word characters, and a bare ``at`` only if the domain's dots are disguised too;
bracketed forms always do.  Spelled digits count in runs, in English, German, French and Spanish.

Cases: a null text is empty and has no identifiers.  Repeated rows are each reported.  Texts are searched whole, however
long; all searches are linear in the text.  Other columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.llm._store import bounded, tidied

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never begins within a run of digits, nor gives a digit back: as the contract's pattern, but linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")

# Characters that look like an ASCII letter or sign (Cyrillic, Greek, Latin variants).
HOMOGLYPHS = dict(
    zip(
        "АВЕКМНОРСТХаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιɡıℓ。․‧∙·﹒﹫‐‑‒–−﹢",
        "ABEKMHOPCTXaeopcyxijshdqwABEZHIKMNOPTYXoigil......@-----+",
        strict=True,
    )
)
HOMOGLYPHS |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
# Digits as words.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_GAP = r"[\x20\t]"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
#: Alternatives in the order in which they are tried at a place.
_TRANSDUCER = re.compile(
    rf"(?P<at>{_GAP}?{_OPEN}{_GAP}?(?:at|@|ät|arroba){_GAP}?{_CLOSE}{_GAP}?)"
    rf"|(?P<dot>{_GAP}?{_OPEN}{_GAP}?(?:dot|\.|punkt|point|punto){_GAP}?{_CLOSE}{_GAP}?)"
    rf"|(?P<bareat>(?<=[\w%+-]){_GAP}(?:at|arroba){_GAP}(?=\w))"
    rf"|(?P<baredot>(?<=[\w-]){_GAP}(?:dot|punkt|point|punto){_GAP}(?=\w))"
    rf"|(?P<plus>(?<!\w)plus{_GAP}(?=(?:[0-9]|(?:{_WORD})(?!\w))))"
    rf"|(?P<digits>(?<!\w)(?:{_WORD})(?:[\x20-](?:{_WORD}))*(?!\w))"
    rf"|(?P<other>\d)"
    rf"|(?P<glyph>[{re.escape(''.join(HOMOGLYPHS))}])",
    re.IGNORECASE,
)
#: Pre-checks: no text in which transducers alone find an identifier fails them all.  A bare ``at`` counts with a disguised dot only.
_HINT_SIGN = re.compile(
    rf"{_OPEN}{_GAP}?(?:at|@|ät|arroba|dot|\.|punkt|point|punto){_GAP}?{_CLOSE}"
    rf"|{_GAP}(?:dot|punkt|point|punto){_GAP}"
    rf"|(?<!\w)plus{_GAP}(?:[0-9]|(?:{_WORD})(?!\w))",
    re.IGNORECASE,
)
#: A spelled digit belongs to a number with another one or a figure beside it, or from a plus on.
_HINT_DIGIT = re.compile(
    rf"(?<!\w)(?:{_WORD})[\x20.-](?:[0-9]|(?:{_WORD})(?!\w))"
    rf"|(?<=[0-9][\x20.-])(?:{_WORD})(?!\w)"
    rf"|\+[\x20().0-9-]*(?:{_WORD})(?!\w)",
    re.IGNORECASE,
)
#: In an address it only changes something if it isn't ASCII.
_HINT_MAIL = re.compile(rf"[@.%+-](?:{_WORD})(?!\w)|(?<!\w)(?:{_WORD})[@.%+-]", re.IGNORECASE)
_HINT_GLYPH = re.compile(rf"[{re.escape(''.join(HOMOGLYPHS))}]|(?![0-9])\d")
#: Letters that are s or i when case is ignored, but not lower-cased.
_FOLD = str.maketrans("ſıİ", "sii")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [local]+@domain(.domain)+ from left to right: each ``@`` with the local characters right before it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, at)  # a local part can't reach back over an at sign
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NO_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                yield m.span()


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Identifiers in the text as it stands."""
    digit = _DIGIT.search(text) is not None
    return [(kind, a, b) for kind, find in _FINDERS.items() if digit or kind == "email" for a, b in find(text)]


class Normalised:
    """A rewritten text whose positions map back: piece i stands from ``at[i]`` on and is the source from ``source[i]`` on."""

    def __init__(self, text: str):
        self.pieces: list[str] = []
        self.at: list[int] = []
        self.source: list[tuple[int, int]] = []
        self.kind: list[str | None] = []
        self.n = self.done = 0
        self.text = text

    def _put(self, piece: str, a: int, b: int, kind: str | None) -> None:
        if piece:
            self.pieces.append(piece)
            self.at.append(self.n)
            self.source.append((a, b))
            self.kind.append(kind)
            self.n += len(piece)

    def replace(self, a: int, b: int, by: str, kind: str) -> None:
        self._put(self.text[self.done : a], self.done, a, None)
        self._put(by, a, b, kind)
        self.done = b

    def finish(self) -> str:
        self._put(self.text[self.done :], self.done, len(self.text), None)
        return "".join(self.pieces)

    def back(self, a: int, b: int) -> tuple[int, int, set[str]]:
        """Source range of [a, b) and the kinds of rewritten pieces within; a rewritten piece is all or nothing, but edges of digits."""
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        start = self.source[i][0] + (a - self.at[i] if self.kind[i] is None else 0)
        end = self.source[j][1] if self.kind[j] is not None else self.source[j][0] + (b - self.at[j])
        return start, end, {k for k in self.kind[i : j + 1] if k}


def may_hide(text: str) -> bool:
    """False only if the transducers can't add an identifier."""
    if _HINT_SIGN.search(text) or _HINT_DIGIT.search(text):
        return True
    return not text.isascii() and bool(_HINT_GLYPH.search(text) or ("@" in text and _HINT_MAIL.search(text)))


def normalise(text: str) -> Normalised | None:
    """The transducers' output; None if nothing is disguised."""
    if not may_hide(text):
        return None
    out = Normalised(text)
    for m in _TRANSDUCER.finditer(text):
        kind, found = m.lastgroup, m.group()
        if kind in ("at", "bareat"):
            by = "@"
        elif kind in ("dot", "baredot"):
            by = "."
        elif kind == "plus":
            by = "+"
        elif kind == "digits":
            by = "".join(SPELLED[w.translate(_FOLD).lower()] for w in re.split(r"[\x20-]", found))
        elif kind == "other":
            if found.isascii():
                continue
            by = str(int(found))
        elif (by := HOMOGLYPHS.get(found)) is None:
            continue
        out.replace(*m.span(), by, kind)
    return out if out.kind else None


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Disguised identifiers that overlap no base identifier of their kind."""
    found = normalise(text)
    if found is None:
        return []
    plain, out = found.finish(), []
    known = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}  # ascending, apart from each other
    last = dict.fromkeys(KINDS, 0)
    for kind, a, b in base_spans(plain):
        start, end, through = found.back(a, b)
        i = bisect_left(known[kind], (end, 0)) - 1  # the last that begins before the end
        if not through or start < last[kind] or (i >= 0 and known[kind][i][1] > start):
            continue
        if "bareat" in through and not through & {"dot", "baredot"}:
            continue
        out.append((kind, start, end))
        last[kind] = end
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def find_identifiers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, base counts by kind, base_sha256, all spans, and how many the deobfuscation added."""
    docs = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = [f"n_{k}" for k in KINDS]

    def run(batches):
        for batch in batches:
            counts, digests, spans, added = [[] for _ in KINDS], [], [], []
            for value in batch.column(1):
                body = value.as_py() or ""
                base = base_spans(body)
                more = added_spans(body, base)
                for held, kind in zip(counts, KINDS, strict=True):
                    held.append(sum(k == kind for k, _, _ in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + more))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], ["doc_id", *names, "base_sha256", "spans", "n_added"])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(tidied(run), f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, base_sha256 string, spans string, n_added long")

"""A one-hash filter of bounded size in built-in functions: rows that can't match need no shuffle.

The bit table has about eight bits for each key that it was made for, but never more than ``MOST`` bits (a
million rows of 16 bytes), so it can be broadcast.  A full table only lets more rows through to the exact join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1 << 26


@dataclass
class Sieve:
    """``table``: (sieve_word, sieve_bits) of keys' bits."""

    bits: int
    table: DataFrame


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits))


def sieve(rows: DataFrame, key: Column, n: int) -> Sieve:
    """The filter of a 64-bit key column of about ``n`` rows."""
    bits = min(MOST, max(1 << 16, 1 << (8 * n).bit_length()))
    bit = _bit(key, bits)
    words = rows.select(F.shiftright(bit, 6).alias("sieve_word"), F.pmod(bit, F.lit(64)).cast("int").alias("sieve_i"))
    return Sieve(bits, words.groupBy("sieve_word").agg(F.bit_or(F.expr("shiftleft(1L, sieve_i)")).alias("sieve_bits")))


def maybe(df: DataFrame, key: Column, held: Sieve, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: false if the key surely isn't in the sieve."""
    out = df.withColumn("__sieve_bit", _bit(key, held.bits)).join(F.broadcast(held.table), F.shiftright("__sieve_bit", 6) == held.table["sieve_word"], "left")
    hit = F.expr("shiftright(sieve_bits, cast(pmod(__sieve_bit, 64) as int)) & 1") == 1
    return out.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__sieve_bit", "sieve_word", "sieve_bits")


def drop_rows(df: DataFrame, keys: dict[str, Column], dropped: DataFrame, screen: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys (name in ``dropped``: expression over ``df``) aren't in ``dropped``, a written table; nulls are equal.

    Rows that the sieve of the ``screen`` keys clears are passed on where they are, without their other keys being made; the others meet
    ``dropped`` in an exact anti join.
    """
    gone = dropped.select(*[F.col(k).alias(f"__drop_{k}") for k in keys])
    held = sieve(gone, F.xxhash64(*[F.col(f"__drop_{k}") for k in screen]), gone.count())
    marked = maybe(df.withColumns({f"__own_{k}": keys[k] for k in screen}), F.xxhash64(*[F.col(f"__own_{k}") for k in screen]), held, "__maybe")
    rest = marked.where("__maybe").withColumns({f"__own_{k}": c for k, c in keys.items() if k not in screen})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"__own_{k}").eqNullSafe(F.col(f"__drop_{k}"))
    return marked.where("not __maybe").select(*df.columns).unionByName(rest.join(gone, same, "left_anti").select(*df.columns))

"""Sharding by a Feistel permutation with cycle walking, in built-in functions only.

Rows get global numbers from 0 in the order of (id, text checksum, size): a range
partitioning, a sort within partitions and the running sum of the partitions' row
counts, so that no task sees more than its range.  The permutation works on the smallest
rectangle ``a x b`` of at least ``n`` numbers: a number is a cell, rounds add a keyed function of
one coordinate to the other, and results beyond ``n`` walk on along their cycle until they fall
below it.  Row ``p`` of the shuffled order is slot ``p div shards`` of shard ``p mod shards``: counts are at
most one apart, slots have no gaps, and both can be computed from a row's number, the number of rows and the seed alone.

Cases: a null text has no bytes and the checksum 0; null ids come first.  Repeated rows are
numbered one after another, and are dealt like others.  An empty table gives an empty result.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.llm._store import cut

ROUNDS = 6
#: A prime below 2^31, so that products of residues fit a long.
PRIME = 2147483629
#: Walks leave the rectangle's surplus after so many steps: the surplus is below a of a*b cells, and a walk never visits a cell twice.
WALK = 64


def keys(seed: int) -> list[int]:
    """Round keys from the seed."""
    x, out = seed % PRIME, []
    for i in range(ROUNDS):
        x = (x * 48271 + 11 * i + 1) % PRIME
        out.append(x)
    return out


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute(x: int, n: int, seed: int) -> int:
    """The permutation in Python, for tests and for finding single rows."""
    a, b = sides(n)
    while True:
        left, right = divmod(x, b)
        for i, k in enumerate(keys(seed)):
            if i % 2 == 0:
                left = (left + _mix(right, k)) % a
            else:
                right = (right + _mix(left, k)) % b
        x = left * b + right
        if x < n:
            return x


def _mix(v: int, k: int) -> int:
    t = (v * 40503 + k) % PRIME
    t = (t * t + k) % PRIME
    return (t * ((k | 1) % PRIME) + 12345) % PRIME // 1024


def _mix_sql(v: str, k: str) -> str:
    t = f"(({v} * 40503L + {k}) % {PRIME}L)"
    t = f"(({t} * {t} + {k}) % {PRIME}L)"
    return f"(({t} * (({k} | 1L) % {PRIME}L) + 12345L) % {PRIME}L) div 1024L"


def permuted(number: str, n: int, seed: int):
    """Column expression of ``permute`` over a column of row numbers below n."""
    a, b = sides(n)
    table = ", ".join(f"{k}L" for k in keys(seed))

    def once(x: str, s: str) -> str:
        even = f"named_struct('l', ({s}.l + ({_mix_sql(f'{s}.r', 'k')})) % {a}L, 'r', {s}.r, 'i', {s}.i + 1)"
        odd = f"named_struct('l', {s}.l, 'r', ({s}.r + ({_mix_sql(f'{s}.l', 'k')})) % {b}L, 'i', {s}.i + 1)"
        return f"aggregate(array({table}), named_struct('l', {x} div {b}L, 'r', {x} % {b}L, 'i', 0), ({s}, k) -> if({s}.i % 2 = 0, {even}, {odd}), {s} -> {s}.l * {b}L + {s}.r)"

    walk = f"aggregate(sequence(1, {WALK}), {once(number, 's')}, (v, step) -> if(v < {n}L, v, {once('v', 'u')}))"
    return F.expr(walk)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with a column ``number``, their place in the order from 0, and how many they are."""
    spread = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    at = spread.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = at.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = cut(counts.selectExpr("__p", "__n", "sum(__n) over (order by __p) - __n as __before"))
    n = before.agg(F.sum("__n")).first()[0] or 0
    return at.join(F.broadcast(before.select("__p", "__before")), "__p").withColumn("number", F.col("__before") + F.col("__i")).drop("__p", "__i", "__before"), n


def shuffled_shards(docs: DataFrame, shards: int, seed: int = 20240229, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    placed, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    placed = placed.withColumn("place", permuted("number", n, seed)).withColumn("place", F.expr(f"if(place < {n}L, place, raise_error('the walk did not end'))"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}L").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

"""Bootstrap confidence intervals, plain and stratified.

Portable draws: position ``k`` of replicate ``r`` takes row ``md5(seed:r:k)``'s first 32 bits modulo n, so any
engine gets the same.  Replay draws: NumPy's generator, metric by metric, then strata in first-seen order.
Percentiles interpolate linearly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: Column | str, replicate: Column, position: Column, n: Column) -> Column:
    text = F.concat_ws(":", F.lit(seed) if isinstance(seed, str | int) else seed, replicate, position)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % n


#: Ranges that rows are numbered in, and rows that may be broadcast (a few dozen bytes each).
RANGES, BROADCAST = 64, 200_000


def _numbered(rows: DataFrame, order: str, strata: list[str]) -> DataFrame:
    """``rows`` with their number in the order (within their stratum) and how many there are: numbered in ranges between a few marks, which
    are taken evenly from the data, and moved up by the counts of the ranges before."""
    marks = sorted(r[0] for r in rows.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(RANGES - 1).collect())
    above = sum([(F.col(order) > m).cast("int") for m in marks], F.lit(0))
    placed = rows.withColumn("__range", F.coalesce(above, F.lit(0)))
    counts = placed.groupBy(*strata, "__range").agg(F.count(F.lit(1)).alias("__rows"))
    every = Window.partitionBy(*(strata or [F.lit(0)]))  # a row for each range and stratum
    before = counts.select(*[F.col(s).alias(f"__of_{s}") for s in strata], F.col("__range").alias("__at"), (F.sum("__rows").over(every.orderBy("__range")) - F.col("__rows")).alias("__before"), F.sum("__rows").over(every).alias("__n"))
    on = placed["__range"] == before["__at"]
    for s in strata:
        on = on & placed[s].eqNullSafe(before[f"__of_{s}"])
    inner = F.row_number().over(Window.partitionBy(*strata, "__range").orderBy(order))
    out = placed.join(before, on).withColumn("__pos", (F.col("__before") + inner - 1).cast("bigint"))
    return out.drop("__range", "__at", "__before", *[f"__of_{s}" for s in strata])


def replicate_means(rows: DataFrame, metrics: list[str], order: str, replicates: int, seed: int, strata: list[str] | None = None) -> DataFrame:
    """(replicate, metrics): means over drawn rows; with strata, draws within each and the mean of their means.

    Rows are numbered once and each replicate joins its draws by position: by a broadcast of at most ``BROADCAST`` rows, so that draws are averaged
    where they are made, or else by a shuffle.
    """
    strata = strata or []
    base = _numbered(rows.select(order, *strata, *metrics), order, strata)
    held = base.select(*strata, "__pos", *metrics)
    if base.limit(BROADCAST + 1).count() <= BROADCAST:
        held = F.broadcast(held)
    slots = base.select(*strata, "__pos", "__n").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    text = [F.lit(str(seed)), F.col("replicate").cast("string"), F.col("__pos").cast("string")] + [F.col(s).cast("string") for s in strata]
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", *text).cast("binary")), 1, 8), 16, 10).cast("bigint") % F.col("__n")
    drawn = slots.select(*strata, "replicate", pick.alias("__pos")).join(held, [*strata, "__pos"])
    means = drawn.groupBy("replicate", *strata).agg(*[F.avg(m).alias(m) for m in metrics])
    return means if not strata else means.groupBy("replicate").agg(*[F.avg(m).alias(m) for m in metrics])


def intervals(rows: DataFrame, metrics: list[str], order: str, replicates: int = 2000, seed: int = 0, level: float = 0.95, strata: list[str] | None = None) -> DataFrame:
    """(metric, point, low, high)."""
    tail = (1 - level) / 2
    means = replicate_means(rows, metrics, order, replicates, seed, strata)
    ends = means.agg(*[F.percentile(m, F.array(F.lit(tail), F.lit(1 - tail))).alias(m) for m in metrics])
    points = rows.agg(*[F.avg(m).alias(m) for m in metrics]) if not strata else rows.groupBy(*strata).agg(*[F.avg(m).alias(m) for m in metrics]).agg(*[F.avg(m).alias(m) for m in metrics])
    long = lambda df, name: df.unpivot([], metrics, "metric", name)
    joined = long(points, "point").join(long(ends, "ends"), "metric")
    return joined.select("metric", "point", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))


def replay(pdf: pd.DataFrame, metrics: list[str], macro_metrics: list[str], cls: str, replicates: int, seed: int, level: float) -> pd.DataFrame:
    """Intervals from one NumPy generator; rows are in their order already."""
    rnd, tail, out = np.random.default_rng(seed), (1 - level) / 2, []

    def row(name, point, means):
        low, high = np.quantile(means, [tail, 1 - tail])
        out.append((name, float(point), float(low), float(high)))

    n = len(pdf)
    for m in metrics:
        x = pdf[m].to_numpy(np.float64)
        row(m, x.mean(), np.array([x[rnd.integers(0, n, n)].mean() for _ in range(replicates)]))
    groups = [np.flatnonzero(pdf[cls].to_numpy() == c) for c in dict.fromkeys(pdf[cls])]
    values = {m: pdf[m].to_numpy(np.float64) for m in macro_metrics}
    drawn = {m: np.empty(replicates) for m in macro_metrics}
    for r in range(replicates):
        picks = [g[rnd.integers(0, len(g), len(g))] for g in groups]
        for m, x in values.items():
            drawn[m][r] = np.mean([x[p].mean() for p in picks])
    for m, x in values.items():
        row(f"macro_{m}", np.mean([x[g].mean() for g in groups]), drawn[m])
    return pd.DataFrame(out, columns=["metric", "point", "low", "high"])


def replay_intervals(rows: DataFrame, metrics: list[str], macro_metrics: list[str], order: str, cls: str = "true_class", replicates: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """The same as ``intervals`` with NumPy's draws.  One generator means one task, which holds the score rows (one for each image)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return replay(pdf.sort_values(order, kind="stable"), metrics, macro_metrics, cls, replicates, seed, level)

    columns = list(dict.fromkeys([order, cls, *metrics, *macro_metrics]))
    return rows.select(*columns).groupBy().applyInPandas(run, "metric string, point double, low double, high double")

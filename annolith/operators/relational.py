"""Joins, rankings, set operations and reports of the audits, on DataFrames.

All joins are equi-joins on keys; sides whose size is fixed (views, splits, classes) are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTIFIER = r"(_aug[0-9]+|_v1|_v7)+$"


def normalized_id(name: Column, strict: bool = True) -> Column:
    """Lower-cased stem without trailing view and augmentation tags; must be ``isic_<digits>`` (else an error, or null)."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")), IDENTIFIER, "")
    wrong = F.raise_error(F.concat(F.lit("no identifier: "), name)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(bare.rlike(r"^isic_[0-9]+$"), bare).otherwise(wrong)


def output_stems(base: Column, split: Column) -> Column:
    """Stems that a source gives: both views for training, the first for other splits.  An array, to explode."""
    views = F.when(split == "train", F.array(F.lit("v1"), F.lit("v7"))).otherwise(F.array(F.lit("v1")))
    return F.transform(views, lambda v: F.concat(base, F.lit("_"), v))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with the side that has them."""
    both = left.select(*keys, F.lit(1).alias("l")).unionByName(right.select(*keys, F.lit(1).alias("r")), allowMissingColumns=True)
    seen = both.groupBy(*keys).agg(F.count("l").alias("l"), F.count("r").alias("r"))
    return seen.where("l = 0 or r = 0").select(*keys, F.when(F.col("r") == 0, "left").otherwise("right").alias("side"))


def layout_ok(images: DataFrame, labels: DataFrame, expected: dict[str, int]) -> bool:
    """Whether images and labels of each split have the same stems, as many as expected."""
    counts = {r["split"]: r["n"] for r in images.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts == {k: v for k, v in expected.items() if v} and not unmatched(images, labels, ["split", "stem"]).limit(1).count()


def presence(sides: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """A row for each key of any side, with a flag for each side: one aggregation instead of outer joins."""
    tagged = [df.select(*keys, *[F.lit(s == name).alias(f"has_{s}") for s in sides]) for name, df in sides.items()]
    every = reduce(DataFrame.unionByName, tagged)
    return every.groupBy(*keys).agg(*[F.max(f"has_{s}").alias(f"has_{s}") for s in sides])


def missing_required(pairs: DataFrame, records: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair with each required value (a small fixed table) that no record has."""
    return pairs.crossJoin(F.broadcast(values)).join(records, [*keys, *values.columns], "left_anti")


def unique_side(files: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once."""
    return files.join(files.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n"), keys, "left_semi")


def zip_by_position(left: DataFrame, right: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Rows with equal keys and ordinals; the longer side's surplus goes."""
    return left.join(right, [*keys, ordinal])


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first of each key, all others)."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank"), ranked.where("__rank > 1").drop("__rank")


def best_of(rows: DataFrame, keys: list[str], score: str, ordinal: str) -> DataFrame:
    """The row of the highest score of each key, a missing one counting 0; the first on ties.

    An aggregation of one struct, which combines before the shuffle, instead of a sorted window.
    """
    rank = F.struct(F.coalesce(F.col(score), F.lit(0.0)).alias("s"), (-F.col(ordinal)).alias("o"))
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(rest, rank).alias("__best")).select(*keys, "__best.*")


def with_truth(truth: DataFrame, best: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """Every truth row with its prediction, or defaults."""
    return truth.join(best, keys, "left").fillna(defaults)


def class_offset(predictions: DataFrame, n_classes: int) -> int:
    """1 if categories run from 1 on up to the number of classes, else 0."""
    low, high = predictions.agg(F.min("category_id"), F.max("category_id")).first()
    return int(low is not None and n_classes > 0 and low >= 1 and high == n_classes)


def cross_split_overlaps(names: DataFrame, order: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(left_split, right_split, ids): identifiers that two splits share, sorted."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("split"))
    held = names.groupBy("id").agg(F.array_sort(F.collect_set(F.struct(rank.alias("rank"), "split"))).alias("s")).where("size(s) > 1")
    pairs = held.select("id", F.expr("explode(flatten(transform(s, (a, i) -> transform(slice(s, i + 2, size(s)), b -> struct(a.split as left_split, b.split as right_split)))))").alias("p"))
    return pairs.groupBy("p.left_split", "p.right_split").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed, size or content; unchanged files have no row."""
    o = old.select("path", F.col("size").alias("old_size"), F.col("sha256").alias("old_sha"))
    n = new.select("path", F.col("size").alias("new_size"), F.col("sha256").alias("new_sha"))
    change = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "removed").when(F.col("old_size") != F.col("new_size"), "size").when(F.col("old_sha") != F.col("new_sha"), "content")
    return o.join(n, "path", "full").select("path", change.alias("change")).where("change is not null")


def key_transfer(source: DataFrame, destination: DataFrame, layers: dict[int, int]) -> DataFrame:
    """(key, status): source tensors under remapped layer numbers against destination tensors (key, shape)."""
    table = F.create_map(*[x for k, v in layers.items() for x in (F.lit(k), F.lit(v))])
    part = F.split("key", r"\.", 3)
    layer = F.when(part[0] == "model", F.element_at(table, F.expr(r"try_cast(split(key, '\\.', 3)[1] as int)")))
    mapped = source.select("shape", F.col("key").alias("from"), F.when(layer.isNotNull() & (F.size(part) == 3), F.concat(F.lit("model."), layer.cast("string"), F.lit("."), part[2])).alias("key"))
    s = mapped.where("key is not null").select("key", F.col("shape").alias("source_shape"))
    both = s.join(destination.select("key", F.col("shape").alias("own_shape")), "key", "full")
    status = F.when(F.col("source_shape").isNull(), "missing").when(F.col("own_shape").isNull(), "unmapped").when(F.col("source_shape") == F.col("own_shape"), "mapped").otherwise("shape_mismatch")
    lost = mapped.where("key is null").select(F.col("from").alias("key"), F.lit("unmapped").alias("status"))
    return both.select("key", status.alias("status")).unionByName(lost)


def eligible_to_build(images: DataFrame, polygons: DataFrame, keys: list[str], excluded: int = 5) -> DataFrame:
    """Images without a polygon of the excluded class, those without any polygon included."""
    return images.join(polygons.where(F.col("class_id") == excluded).select(*keys).distinct(), keys, "left_anti")


def eligible_in_audit(polygons: DataFrame, keys: list[str], excluded: int = 5) -> DataFrame:
    """Images with polygons, none of the excluded class."""
    return polygons.groupBy(*keys).agg(F.bool_and(F.col("class_id") != excluded).alias("ok")).where("ok").drop("ok")


def attempts(images: DataFrame, n: int = 3) -> DataFrame:
    """A row for each attempt at each image."""
    return images.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def attempt_accounting(eligible: DataFrame, saved: DataFrame, n: int = 3) -> DataFrame:
    """attempts, saved, skipped (not below 0), and whether all were saved."""
    a = eligible.agg((F.count(F.lit(1)) * n).alias("attempts"))
    s = saved.agg(F.count(F.lit(1)).alias("saved"))
    return a.crossJoin(s).select("attempts", "saved", F.greatest(F.lit(0).cast("bigint"), F.col("attempts") - F.col("saved")).alias("skipped"), (F.col("attempts") == F.col("saved")).alias("complete"))


def view_composition(files: DataFrame, name: str = "stem") -> DataFrame:
    """Files by kind in each split: v1, v7, augmented, others."""
    kind = lambda rule: F.count_if(F.col(name).rlike(rule))
    out = files.groupBy("split").agg(F.count(F.lit(1)).alias("total"), kind("_v1$").alias("v1"), kind("_v7$").alias("v7"), kind("_aug[0-9]+$").alias("aug"))
    return out.withColumn("other", F.expr("total - v1 - v7 - aug"))


def class_histogram(polygons: DataFrame, dataset: str = "dataset", cls: str = "class_id") -> DataFrame:
    """Counts by dataset and class, and by class over all datasets (dataset null)."""
    return polygons.groupingSets([[dataset, cls], [cls]], dataset, cls).agg(F.count(F.lit(1)).alias("n"))


def per_class(rows: DataFrame, metrics: list[str], cls: str = "true_class") -> DataFrame:
    return rows.groupBy(F.col(cls).alias("class_id")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])


def micro(rows: DataFrame, metrics: list[str]) -> DataFrame:
    return rows.agg(*[F.avg(m).alias(m) for m in metrics])


def macro(rows: DataFrame, metrics: list[str], cls: str = "true_class") -> DataFrame:
    """Unweighted means of the class means."""
    return per_class(rows, metrics, cls).agg(*[F.avg(m).alias(f"macro_{m}") for m in metrics])


def reason_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("reason").agg(F.sum("amount").alias("amount"))


def field_counts(issues: DataFrame) -> DataFrame:
    return issues.where("field is not null").groupBy("field").agg(F.sum("amount").alias("amount"))


def excluded_ids(issues: DataFrame) -> DataFrame:
    """Sorted distinct pairs by reason; those outside training carry their split."""
    name = F.when(F.col("split") == "train", F.col("pair_id")).otherwise(F.concat_ws("/", "split", "pair_id"))
    keyed = issues.where("pair_id is not null").select("reason", "split", "pair_id", name.alias("name")).distinct()
    order = F.array_sort(F.collect_list(F.struct("split", "pair_id", "name")))
    return keyed.groupBy("reason").agg(F.transform(order, lambda s: s["name"]).alias("ids"))


def gate(issues: DataFrame) -> DataFrame:
    """One row: whether no structural issue exists."""
    return issues.agg((~F.coalesce(F.bool_or("structural"), F.lit(False))).alias("publication_gate_passed"))


def artifact_proxies(crop_w: Column, crop_h: Column, w: Column, h: Column, hair: Column, gains: Column) -> Column:
    """Hair coverage, share of the source outside the crop, and how far gains are from 1."""
    far = F.sqrt(F.aggregate(gains, F.lit(0.0), lambda s, g: s + (g - 1) * (g - 1)))
    return F.struct(hair.alias("hair_mask_coverage"), (1 - crop_w * crop_h / (w * h)).alias("vignette_crop_ratio"), gains.alias("gray_world_gains"), far.alias("gray_world_correction_magnitude"))


def sorted_list(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: all rows as a sorted array of structs, for a report."""
    return rows.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))


def json_number(c: Column) -> Column:
    """Null for what JSON can't hold."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


"""Scoring predictions against labels, and confidence intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.functions import geometry as G
from annolith.functions.raster import mask_scores
from annolith.operators import relational as R
from annolith.operators.bootstrap import intervals, replay_intervals
from annolith.sources import files, labels, sinks

METRICS = ["top1_accuracy", "box_iou", "box_iou50", "mask_iou", "mask_dice", "mask_iou50", "strict_class_and_mask_iou50"]
MACRO = ["top1_accuracy", "mask_iou", "mask_dice", "strict_class_and_mask_iou50"]


def judged(rows: DataFrame) -> DataFrame:
    """Adds the 0/1 metrics to class, box_iou, mask_iou and mask_dice columns."""
    right = F.col("pred_class") == F.col("true_class")
    return rows.withColumns({
        "top1_accuracy": right.cast("int"), "box_iou50": (F.col("box_iou") >= 0.5).cast("int"), "mask_iou50": (F.col("mask_iou") >= 0.5).cast("int"),
        "strict_class_and_mask_iou50": (right & (F.col("mask_iou") >= 0.5)).cast("int"),
    })


def score(spark: SparkSession, labels_dir: str, predictions_path: str, n_classes: int, side: int) -> DataFrame:
    """A row for each label file: its class against the best prediction's, box and mask overlaps."""
    truth = labels.first_polygon(labels.read_lines(spark, labels_dir), side)
    predictions = files.read_predictions(spark, predictions_path)
    offset = R.class_offset(predictions, n_classes)
    best = R.best_of(predictions.withColumn("category_id", F.col("category_id") - offset), ["stem"], "score", "ordinal")
    joined = truth.withColumnRenamed("class_id", "true_class").join(best, "stem", "left")
    scored = joined.withColumn("mask", mask_scores(F.col("pixels"), F.col("segmentation"), F.lit(side)))
    found = F.col("category_id").isNotNull()
    box = F.expr(G.box_iou("box", "named_struct('x', bbox[0], 'y', bbox[1], 'w', bbox[2], 'h', bbox[3])"))
    rows = scored.select(
        F.col("stem").alias("image_id"), "true_class", F.coalesce("category_id", F.lit(-1)).alias("pred_class"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(found, box).otherwise(0.0).alias("box_iou"), F.when(found, F.col("mask.iou")).otherwise(0.0).alias("mask_iou"), F.when(found, F.col("mask.dice")).otherwise(0.0).alias("mask_dice"),
    )
    return judged(rows)


def summarize(rows: DataFrame, replicates: int = 2000, seed: int = 0, level: float = 0.95, replay: bool = False) -> DataFrame:
    """(metric, point, low, high): micro metrics and macro metrics by stratified draws."""
    if replay:
        return replay_intervals(rows, METRICS, MACRO, "image_id", "true_class", replicates, seed, level)
    micro = intervals(rows, METRICS, "image_id", replicates, seed, level)
    macro = intervals(rows, MACRO, "image_id", replicates, seed, level, ["true_class"])
    return micro.unionByName(macro.withColumn("metric", F.concat(F.lit("macro_"), "metric")))


def run(spark: SparkSession, config_path: str, predictions_path: str, out: str, side: int = 640, replicates: int = 2000, seed: int = 0, metrics_path: str | None = None) -> dict:
    """Scores, class table, intervals and their files."""
    config = files.dataset_config(config_path)
    rows = score(spark, config["labels"], predictions_path, len(config["names"]), side).cache()
    if not rows.limit(1).count():
        raise ValueError(f"no label files in {config['labels']}")
    summary = {
        "n_images": rows.count(), "n_boot": replicates, "seed": seed, "ci_level": 0.95, "image_size": side,
        "metrics": {r["metric"]: {"point": r["point"], "low": r["low"], "high": r["high"]} for r in summarize(rows, replicates, seed).collect()},
        "point_metrics": files.point_metrics(metrics_path) if metrics_path else {},
    }
    sinks.write_score_outputs(out, rows, summary, R.per_class(rows, MACRO))
    rows.unpersist()
    return summary

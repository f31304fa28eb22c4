"""Per-view metadata in JSON lines: identity, typing, first record wins.

JSON is read by Python inside Arrow UDFs, since typing must tell booleans from numbers, nulls from
wrong types, and accept repeated keys, which column functions don't.
"""

from __future__ import annotations

import json
import math
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolith.functions.udf import arrow_udf
from annolith.sources.files import SPLITS, VIEWS

IDENTITY = "struct<json:boolean,split:string,pair_id:string,view:string>"
ISSUE = "reason string, field string, structural boolean, amount bigint, split string, pair_id string"


@arrow_udf(IDENTITY)
def identity(raw: pd.Series) -> pd.DataFrame:
    """Whether a line is JSON, and its split, pair and view, each null unless valid."""
    out = []
    for text in raw:
        try:
            value = json.loads(text)
        except ValueError:
            out.append((False, None, None, None))
            continue
        value = value if isinstance(value, dict) else {}
        pick = lambda key, allowed: v if isinstance(v := value.get(key), str) and (v in allowed if allowed else v) else None
        out.append((True, pick("split", SPLITS), pick("pair_id", None), pick("view", VIEWS)))
    return pd.DataFrame(out, columns=["json", "split", "pair_id", "view"]).astype(object)


def number(v) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v)


def natural(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v >= 0


def _name(v) -> bool:
    return isinstance(v, str) and v != ""


def _pairs(v) -> bool:
    return isinstance(v, list) and all(isinstance(p, list) and len(p) == 2 and all(map(number, p)) for p in v)


def _fits(value, shape: dict) -> bool:
    """An object that has all keys of a shape, with values that satisfy its tests."""
    return isinstance(value, dict) and all(k in value and test(value[k]) for k, test in shape.items())


def _one(v) -> bool:
    return not isinstance(v, bool) and v == 1


def _numbers(n: int):
    return lambda v: isinstance(v, list) and len(v) == n and all(map(number, v))


def _whole(v) -> bool:
    return number(v) and v > 0 and float(v).is_integer()


_INTEGER = lambda v: isinstance(v, int) and not isinstance(v, bool)
_TRANSFORM = dict.fromkeys(("source_width", "source_height", "scale", "pad_x", "pad_y"), number) | {"schema_version": _one, "crop_box": _numbers(4), "resized_width": _INTEGER, "resized_height": _INTEGER, "canvas_width": _whole, "canvas_height": _whole}
_PROXIES = dict.fromkeys(("hair_mask_coverage", "vignette_crop_ratio", "gray_world_correction_magnitude"), number) | {"gray_world_gains": _numbers(3)}
_INSTANCE = dict.fromkeys(("source_polygon", "crop_intersection_polygon", "canvas_polygon"), _pairs) | dict.fromkeys(("source_area", "crop_intersection_area", "canvas_area"), number) | {"instance_id": _name, "class_id": _INTEGER, "status": lambda v: v in ("kept", "dropped") if isinstance(v, str) else False, "reason": lambda v: True}
_RECORD = {
    "schema_version": _one, "pair_id": _name, "split": lambda v: isinstance(v, str) and v in SPLITS, "view": lambda v: isinstance(v, str) and v in VIEWS, "source": _name, "preprocessing_version": _name,
    "input_instance_count": natural, "output_instance_count": natural, "transform": lambda v: _fits(v, _TRANSFORM), "artifact_proxies": lambda v: _fits(v, _PROXIES),
    "dropped_instance_reasons": lambda v: isinstance(v, dict) and all(k and natural(n) for k, n in v.items()),
    "instances": lambda v: isinstance(v, list) and all(_fits(i, _INSTANCE) and (i["reason"] is None if i["status"] == "kept" else _name(i["reason"])) for i in v),
}


def well_typed(record) -> bool:
    """Whether a record has all fields with values of their types, and derived sizes that don't overflow."""
    if not _fits(record, _RECORD):
        return False
    x, y, w, h = map(float, record["transform"]["crop_box"])
    s = float(record["transform"]["scale"])
    return all(map(math.isfinite, (x + w, y + h, w * s, h * s)))


@arrow_udf("boolean")
def typed(raw: pd.Series) -> pd.Series:
    return raw.map(lambda t: well_typed(json.loads(t)))


def issue_rows(rows: DataFrame, reason: str, field: str | None = None, structural: bool = True, amount=None) -> DataFrame:
    """Rows with split and pair_id as issues."""
    return rows.select(F.lit(reason).alias("reason"), F.lit(field).cast("string").alias("field"), F.lit(structural).alias("structural"), (F.lit(1) if amount is None else amount).cast("bigint").alias("amount"), "split", "pair_id")


def records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, issues) of (ordinal, raw) lines: records are split, pair_id, view, raw; the first of each key by ordinal wins.

    Lines that aren't JSON or have no identity are issues; so is each record of a pair and view that some split had before.
    """
    rows = lines.withColumn("id", identity("raw")).select("ordinal", "raw", "id.*")
    keyed = rows.where("split is not null and pair_id is not null and view is not null")
    bad = rows.where("json and (split is null or pair_id is null or view is null)").select(F.expr("if(split is null or pair_id is null, null, split)").alias("split"), F.expr("if(split is null or pair_id is null, null, pair_id)").alias("pair_id"))
    issues = issue_rows(rows.where("not json").select(F.lit(None).cast("string").alias("split"), F.lit(None).cast("string").alias("pair_id")), "MALFORMED_JSON", "malformed_json_count")
    issues = issues.unionByName(issue_rows(bad, "MALFORMED_METADATA", "malformed_record_count"))
    again = keyed.withColumn("n", F.row_number().over(Window.partitionBy("pair_id", "view").orderBy("ordinal"))).where("n > 1")
    issues = issues.unionByName(issue_rows(again, "DUPLICATE_VIEW", "duplicate_view_count"))
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("split", "pair_id", "view").orderBy("ordinal"))).where("n = 1")
    return first.select("split", "pair_id", "view", "raw"), issues


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``records`` of a file's lines, read in splits; a line's ordinal is its split's place in the file and its number there.

    A missing file, and one that isn't UTF-8, gives no records and one issue.
    """
    none = spark.createDataFrame([], "split string, pair_id string, view string, raw string")
    unkeyed = spark.range(1).select(F.lit(None).cast("string").alias("split"), F.lit(None).cast("string").alias("pair_id"))
    if not os.path.isfile(path):
        return none, issue_rows(unkeyed, "MISSING_METADATA_FILE", "malformed_record_count")
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")).alias("ordinal"), F.col("value").alias("raw"))
    if lines.where(~F.expr("is_valid_utf8(raw)")).limit(1).count():
        return none, issue_rows(unkeyed, "MALFORMED_METADATA", "malformed_record_count")
    return records(lines)

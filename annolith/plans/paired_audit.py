"""Audit of a paired dataset: metadata, images and labels of two views of each source.

Every check gives rows of one *issues* table (reason, field, structural, amount, split, pair_id); counters, exclusions
and the publication gate are three aggregations of it.  Checks of one record run in one Arrow pass
over that record, its label and its image's size; all that relates records is a join.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.functions import polygon as K
from annolith.functions.raster import pooled_mask
from annolith.operators import relational as R
from annolith.sources import files, labels, metadata

GEOMETRY, ROUNDTRIP, LABEL = 1e-5, 1e-5, 1.1e-6
MAX_SIDE, MAX_PIXELS = 8192, 64 * 1024 * 1024
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
OUTSIDE, DEGENERATE = "INSTANCE_OUTSIDE_V7_CROP", "INSTANCE_DEGENERATE_AFTER_CLIP"

#: The report's counters.
COUNTERS = (
    "malformed_json_count", "malformed_record_count", "duplicate_view_count", "missing_image_count", "missing_label_count", "missing_view_count",
    "instance_correspondence_error_count", "class_correspondence_error_count", "label_correspondence_error_count", "invalid_polygon_count",
    "zero_area_polygon_count", "out_of_canvas_polygon_count", "metadata_transform_mismatch_count", "roundtrip_error_count", "empty_p2_mask_count",
)
#: Which counter a reason adds to.
FIELD = {
    "INSTANCE_MISMATCH": "instance_correspondence_error_count", "CLASS_MISMATCH": "class_correspondence_error_count", "INVALID_POLYGON": "invalid_polygon_count",
    "ZERO_AREA_POLYGON": "zero_area_polygon_count", "METADATA_POLYGON_AREA_MISMATCH": "metadata_transform_mismatch_count", "OUT_OF_CANVAS_POLYGON": "out_of_canvas_polygon_count",
    "INVALID_DROPPED_INSTANCE": "instance_correspondence_error_count", "SOURCE_CROP_GEOMETRY_MISMATCH": "metadata_transform_mismatch_count",
    "METADATA_TRANSFORM_MISMATCH": "metadata_transform_mismatch_count", "ROUNDTRIP_ERROR": "roundtrip_error_count", "INSTANCE_COUNT_MISMATCH": "instance_correspondence_error_count",
    "DROPPED_REASON_MISMATCH": "instance_correspondence_error_count", "INVALID_LABEL": "label_correspondence_error_count", "ZERO_AREA_LABEL_POLYGON": "label_correspondence_error_count",
    "LABEL_METADATA_MISMATCH": "label_correspondence_error_count", "EMPTY_P2_MASK": "empty_p2_mask_count", "MALFORMED_METADATA": "malformed_record_count",
}


class Transform:
    """A view transform's maps; ``ok`` tells whether its invariants hold."""

    def __init__(self, t: dict):
        self.size = np.array([t["source_width"], t["source_height"]], float)
        self.crop = np.array(t["crop_box"], float)
        self.canvas = np.array([t["canvas_width"], t["canvas_height"]], float)
        self.pad = np.array([t["pad_x"], t["pad_y"]], float)
        resized = np.array([t["resized_width"], t["resized_height"]], float)
        with np.errstate(all="ignore"):
            self.scale = resized / self.crop[2:]
            asked = np.maximum(1.0, np.trunc(self.crop[2:] * float(t["scale"])))
        positive = (self.size > 0).all() and t["scale"] > 0 and (self.crop[2:] > 0).all() and (self.canvas > 0).all() and (self.crop[:2] >= 0).all() and (self.pad >= 0).all()
        self.ok = bool(positive and (self.crop[:2] + self.crop[2:] <= self.size).all() and (resized == asked).all() and (resized + self.pad <= self.canvas).all())

    def to_canvas(self, p: np.ndarray) -> np.ndarray:
        return (p - self.crop[:2]) * self.scale + self.pad

    def to_source(self, p: np.ndarray) -> np.ndarray:
        return (p - self.pad) / self.scale + self.crop[:2]


class RecordCheck:
    """All checks that need one record only."""

    def __init__(self, record: dict, stride: int):
        self.record, self.stride = record, stride
        self.found: Counter[tuple[str, str | None, bool]] = Counter()
        self.errors: list[float] = []
        self.valid = False

    def issue(self, reason: str, amount: int = 1, structural: bool = True, field: str | None = None) -> None:
        self.found[reason, field or FIELD.get(reason), structural] += amount

    def run(self, lines: list[dict] | None, label_errors: dict | None, image: tuple[int, int, bool] | None) -> RecordCheck:
        r = self.record
        t = Transform(r["transform"]) if metadata.well_typed(r) else None
        if t is None or not t.ok:
            self.issue("MALFORMED_METADATA")
            return self
        w, h = t.canvas
        if max(w, h) > MAX_SIDE or w * h > MAX_PIXELS:
            self.issue("CANVAS_DIMENSION_LIMIT")
            return self
        self.valid = True
        proxy = r["artifact_proxies"]
        neutral = proxy["hair_mask_coverage"] == proxy["vignette_crop_ratio"] == proxy["gray_world_correction_magnitude"] == 0.0 and proxy["gray_world_gains"] == [1.0, 1.0, 1.0]
        if r["view"] == "v1" and not (neutral and t.crop.tolist() == [0.0, 0.0, *t.size.tolist()]):
            self.issue("V1_TRANSFORM_SEMANTICS")
        if image is not None and not image[2]:
            self.issue("CORRUPT_IMAGE")
        elif image is not None and image[:2] != (int(h), int(w)):
            self.issue("IMAGE_DIMENSION_MISMATCH")
        kept = self._instances(t)
        for reason, n in sorted((label_errors or {}).items()):
            self.issue(reason, n)
            if reason == "ZERO_AREA_LABEL_POLYGON":
                self.found["", "zero_area_polygon_count", True] += n
        if lines is not None and not label_errors:
            self._label(lines, kept, t)
        return self

    def _instances(self, t: Transform) -> list[dict]:
        kept, drops, seen = [], Counter(), set()
        crop_rect = (*t.crop[:2], *(t.crop[:2] + t.crop[2:]))
        for i, item in enumerate(self.record["instances"]):
            if item["instance_id"] != f"{self.record['pair_id']}:{i}" or item["instance_id"] in seen:
                self.issue("INSTANCE_MISMATCH")
            seen.add(item["instance_id"])
            if not 0 <= item["class_id"] <= 6:
                self.issue("CLASS_MISMATCH")
            source = self._polygon(item, "source", (0.0, 0.0, *t.size))
            dropped = item["status"] == "dropped"
            crop = self._polygon(item, "crop_intersection", crop_rect, dropped)
            canvas = self._polygon(item, "canvas", (0.0, 0.0, *t.canvas), dropped)
            if dropped:
                drops[item["reason"]] += 1
                self._drop(item, source, crop, canvas, crop_rect)
                continue
            kept.append(item)
            if crop is None or canvas is None:
                continue
            if source is not None and not K.same_ring(K.clip(source, crop_rect), crop, GEOMETRY):
                self.issue("SOURCE_CROP_GEOMETRY_MISMATCH")
            if not K.same_points(canvas, t.to_canvas(crop), GEOMETRY):
                self.issue("METADATA_TRANSFORM_MISMATCH")
            if len(canvas) == len(crop):
                far = np.hypot(*(t.to_source(canvas) - crop).T)
                self.errors += far.tolist()
                if (far > ROUNDTRIP).any():
                    self.issue("ROUNDTRIP_ERROR")
            else:
                self.issue("ROUNDTRIP_ERROR")
        r = self.record
        for count, n in (("input_instance_count", len(r["instances"])), ("output_instance_count", len(kept))):
            if r[count] != n:
                self.issue("INSTANCE_COUNT_MISMATCH")
        if dict(drops) != r["dropped_instance_reasons"]:
            self.issue("DROPPED_REASON_MISMATCH")
        return kept

    def _polygon(self, item: dict, name: str, bounds, may_be_empty: bool = False) -> np.ndarray | None:
        raw, recorded = item[f"{name}_polygon"], float(item[f"{name}_area"])
        p = K.as_points(raw)
        if may_be_empty and not len(p):
            if abs(recorded) > GEOMETRY:
                self.issue("METADATA_POLYGON_AREA_MISMATCH")
            return p
        if len(p) < 3:
            self.issue("INVALID_POLYGON")
            self.issue("ZERO_AREA_POLYGON")
            return None
        size = K.area(p)
        if size <= 0.0:
            self.issue("ZERO_AREA_POLYGON")
        if abs(recorded - size) > GEOMETRY:
            self.issue("METADATA_POLYGON_AREA_MISMATCH")
        if not ((p >= bounds[:2]) & (p <= bounds[2:])).all():
            self.issue("OUT_OF_CANVAS_POLYGON")
        return p

    def _drop(self, item: dict, source, crop, canvas, rect) -> None:
        """Legitimate if geometry confirms the reason, in a cropped view, and nothing is left."""
        confirmed = None
        if source is not None:
            confirmed = OUTSIDE if not K.touches_rect(source, rect) else DEGENERATE if not len(K.clip(source, rect)) else None
        empty = crop is not None and canvas is not None and not len(crop) and not len(canvas)
        if self.record["view"] == "v7" and confirmed is not None and item["reason"] == confirmed and empty:
            self.issue(confirmed, structural=False)
        else:
            self.issue("INVALID_DROPPED_INSTANCE")

    def _label(self, lines: list[dict], kept: list[dict], t: Transform) -> None:
        if len(lines) != len(kept):
            self.issue("LABEL_METADATA_MISMATCH")
        for line, item in zip(lines, kept, strict=False):
            if line["class_id"] != item["class_id"]:
                self.issue("CLASS_MISMATCH")
                self.issue("LABEL_METADATA_MISMATCH")
            p, canvas = K.as_points(line["points"]), K.as_points(item["canvas_polygon"])
            if not K.same_points(p, canvas / t.canvas if len(canvas) >= 3 else canvas[:0], LABEL):
                self.issue("LABEL_METADATA_MISMATCH")
            if not pooled_mask(p, int(t.canvas[0]), int(t.canvas[1]), self.stride).any():
                self.issue("EMPTY_P2_MASK")


CHECKED = (
    "split string, pair_id string, view string, valid boolean, source string, width double, height double, version string, n_instances int, "
    "instances array<struct<id:string,class_id:bigint,polygon:array<array<double>>>>, errors array<double>, issues array<struct<reason:string,field:string,structural:boolean,amount:bigint>>"
)


def check_records(rows: DataFrame, stride: int) -> DataFrame:
    """(split, pair_id, view, raw, lines, label_errors, height, width, readable) to verdicts of single records."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                record = json.loads(row.raw)
                size = None if row.readable is None or pd.isna(row.readable) else (int(row.height), int(row.width), bool(row.readable))
                lines = None if row.lines is None else [{"class_id": x["class_id"], "points": [(v["x"], v["y"]) for v in x["points"]]} for x in row.lines]
                errors = None if row.label_errors is None else {e["reason"]: int(e["amount"]) for e in row.label_errors}
                check = RecordCheck(record, stride).run(lines, errors, size)
                t = record["transform"] if check.valid else {}
                items = [{"id": i["instance_id"], "class_id": i["class_id"], "polygon": i["source_polygon"]} for i in record["instances"]] if check.valid else []
                issues = [{"reason": r or None, "field": f, "structural": s, "amount": n} for (r, f, s), n in check.found.items()]
                out.append((row.split, row.pair_id, row.view, check.valid, record["source"] if check.valid else None, t.get("source_width"), t.get("source_height"), record["preprocessing_version"] if check.valid else None, len(items), items, check.errors, issues))
            yield pd.DataFrame(out, columns=["split", "pair_id", "view", "valid", "source", "width", "height", "version", "n_instances", "instances", "errors", "issues"])

    return rows.mapInPandas(run, CHECKED)


def compare_views(checked: DataFrame) -> DataFrame:
    """Issues between the two valid views of each training pair."""
    sides = [checked.where(f"valid and split = 'train' and view = '{v}'").select("split", "pair_id", *[F.col(c).alias(f"{c}{i}") for c in ("source", "width", "height", "version", "n_instances", "instances")]) for i, v in enumerate(files.VIEWS)]
    both = sides[0].join(sides[1], ["split", "pair_id"])
    last = "map_from_entries(transform(filter({0}, (x, i) -> not exists(slice({0}, i + 2, size({0})), y -> y.id = x.id)), x -> struct(x.id, x)))"
    both = both.withColumns({f"m{i}": F.expr(last.format(f"instances{i}")) for i in (0, 1)})
    both = both.withColumn("ids", F.expr("array_intersect(map_keys(m0), map_keys(m1))"))
    points = lambda m: f"transform({m}[k].polygon, p -> struct(p[0] as x, p[1] as y))"
    near = f"(size({points('m0')}) = size({points('m1')}) and size({points('m0')}) >= 3 and forall(zip_with({points('m0')}, {points('m1')}, (a, b) -> sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= {GEOMETRY}), z -> z))"
    amounts = {
        ("SOURCE_IDENTITY_MISMATCH", None): "if(source0 <> source1, 1, 0)",
        ("SOURCE_DIMENSION_MISMATCH", None): "if(width0 <> width1 or height0 <> height1, 1, 0)",
        ("PREPROCESSING_VERSION_MISMATCH", None): "if(version0 <> version1, 1, 0)",
        ("INSTANCE_MISMATCH", "instance_correspondence_error_count"): "if(size(ids) <> size(m0) or size(ids) <> size(m1) or n_instances0 <> n_instances1, 1, 0)",
        ("CLASS_MISMATCH", "class_correspondence_error_count"): "size(filter(ids, k -> m0[k].class_id <> m1[k].class_id))",
        ("SOURCE_POLYGON_MISMATCH", "instance_correspondence_error_count"): f"size(filter(ids, k -> not {near}))",
    }
    found = F.array(*[F.struct(F.lit(r).alias("reason"), F.lit(f).cast("string").alias("field"), F.lit(True).alias("structural"), F.expr(e).cast("bigint").alias("amount")) for (r, f), e in amounts.items()])
    return both.select("split", "pair_id", F.inline(found)).where("amount > 0").select("reason", "field", "structural", "amount", "split", "pair_id")


def audit(spark: SparkSession, root: str, metadata_path: str, stride: int = 4) -> dict:
    """The report: counters, reasons, excluded pairs, round-trip errors and the gate.  Nothing is modified."""
    if isinstance(stride, bool) or not isinstance(stride, int) or stride <= 0:
        raise ValueError("stride must be a positive integer")
    key, pair = ["split", "pair_id", "view"], ["split", "pair_id"]
    records, issues = metadata.load(spark, metadata_path)
    images = files.view_files(spark, f"{root}/images", IMAGE_SUFFIXES)
    texts = files.view_files(spark, f"{root}/labels", (".txt",), content=True)

    for side, reason in ((images, "DUPLICATE_IMAGE_VIEW"), (texts, "DUPLICATE_LABEL_VIEW")):
        again = side.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        issues = issues.unionByName(metadata.issue_rows(again, reason, "duplicate_view_count", amount=F.col("n") - 1))
    seen = R.presence({"record": records, "image": images, "label": texts}, key)
    for side, reason, field in (("record", "MISSING_METADATA_RECORD", None), ("image", "MISSING_IMAGE", "missing_image_count"), ("label", "MISSING_LABEL", "missing_label_count")):
        issues = issues.unionByName(metadata.issue_rows(seen.where(f"not has_{side}"), reason, field))
    candidates = seen.where("split = 'train'").select(*pair).distinct()
    views = spark.range(1).select(F.explode(F.array(*map(F.lit, files.VIEWS))).alias("view"))
    issues = issues.unionByName(metadata.issue_rows(R.missing_required(candidates, records, views, pair), "MISSING_VIEW", "missing_view_count"))

    # each record with its label and image, where there is exactly one
    one_label = R.unique_side(texts, key)
    unreadable = one_label.where(~F.expr("is_valid_utf8(cast(content as string))")).select(*key)
    text = F.regexp_replace(F.col("content").cast("string"), r"\r\n?", "\n")
    lines = one_label.select(*key, F.posexplode(F.split(text, "\n")).alias("line_no", "value"))
    good, errors = labels.error_counts(lines, *key)
    listed = good.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line_no", "class_id", "points"))).alias("lines"))
    counted = errors.unionByName(unreadable.select(*key, F.lit("INVALID_LABEL").alias("reason"), F.lit(1).cast("bigint").alias("amount"))).groupBy(*key).agg(F.collect_list(F.struct("reason", "amount")).alias("label_errors"))
    none = F.expr("cast(array() as array<struct<line_no:int,class_id:int,points:array<struct<x:double,y:double>>>>)")
    label = one_label.select(*key, F.lit(True).alias("has")).join(listed, key, "left").join(counted, key, "left").select(*key, F.coalesce("lines", none).alias("lines"), "label_errors")
    sizes = files.decode_images(spark, f"{root}/images").select(F.regexp_replace("path", "^file:/+", "/").alias("at"), "height", "width", "readable") if images.limit(1).count() else spark.createDataFrame([], "at string, height int, width int, readable boolean")
    picture = R.unique_side(images, key).withColumn("at", F.regexp_replace("path", "^file:/+", "/")).join(sizes, "at", "left").select(*key, "height", "width", F.coalesce("readable", F.lit(False)).alias("readable"))
    checked = check_records(records.join(label, key, "left").join(picture, key, "left").select(*key, "raw", "lines", "label_errors", "height", "width", "readable"), stride).cache()
    issues = issues.unionByName(checked.select("split", "pair_id", F.inline("issues")).select("reason", "field", "structural", "amount", "split", "pair_id"))
    issues = issues.unionByName(compare_views(checked)).cache()

    report = dict.fromkeys(COUNTERS, 0) | {r["field"]: int(r["amount"]) for r in R.field_counts(issues).collect()}
    far = checked.select(F.explode("errors").alias("e")).agg(F.coalesce(F.max("e"), F.lit(0.0)).alias("m"), F.coalesce(F.avg("e"), F.lit(0.0)).alias("a")).first()
    named = issues.where("reason is not null")
    lost = candidates.join(named.select(*pair).distinct(), pair, "left_semi").count()
    total = candidates.count()
    report |= {
        "candidate_pair_count": total, "avc_valid_pair_count": total - lost, "avc_excluded_pair_count": lost, "max_roundtrip_error": far["m"], "mean_roundtrip_error": far["a"],
        "reason_counts": {r["reason"]: int(r["amount"]) for r in R.reason_counts(named).orderBy("reason").collect()},
        "excluded_pair_ids": {r["reason"]: list(r["ids"]) for r in R.excluded_ids(named).orderBy("reason").collect()},
        "publication_gate_passed": R.gate(named).first()[0],
    }
    checked.unpersist(), issues.unpersist()
    return report

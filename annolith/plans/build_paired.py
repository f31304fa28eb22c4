"""Building the paired dataset: two views of each source image with labels and metadata; augmentation policy."""

from __future__ import annotations

import json
import os
import shutil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.functions import polygon as K
from annolith.functions import raster
from annolith.operators import relational as R
from annolith.plans.paired_audit import DEGENERATE, OUTSIDE, Transform
from annolith.sources import files, labels, sinks

VIEW_ROWS = "split string, stem string, view string, lines array<string>, metadata string, pixels binary"


def make_transform(width: int, height: int, crop, side: int) -> dict:
    """A crop fitted into a square."""
    x, y, w, h = map(float, crop)
    scale = min(side / w, side / h)
    nw, nh = max(1, int(w * scale)), max(1, int(h * scale))
    return {"schema_version": 1, "source_width": float(width), "source_height": float(height), "crop_box": [x, y, w, h], "scale": scale, "resized_width": nw, "resized_height": nh, "pad_x": float((side - nw) // 2), "pad_y": float((side - nh) // 2), "canvas_width": float(side), "canvas_height": float(side)}


def serialize(class_id: int, canvas: np.ndarray, size: np.ndarray) -> str:
    return " ".join([str(class_id), *(f"{v:.6f}" for v in np.clip(canvas / size, 0.0, 1.0).ravel())])


def place_instances(items: list[tuple[int, np.ndarray]], transform: dict, pair_id: str, clip: bool) -> tuple[list[str], list[dict]]:
    """Label lines and instance records of normalised polygons in a view; what the crop leaves nothing of is dropped with a reason."""
    t = Transform(transform)
    rect = (*t.crop[:2], *(t.crop[:2] + t.crop[2:]))
    lines, records = [], []
    for i, (class_id, p) in enumerate(items):
        source = p * t.size
        kept = K.clip(source, rect) if clip else source
        if not clip and K.area(source) <= 0.0:
            kept = source[:0]
        reason = None
        if not len(kept):
            reason = OUTSIDE if K.area(source) > K.EPS and not K.touches_rect(source, rect) else DEGENERATE
        canvas = t.to_canvas(kept) if len(kept) else kept
        if reason is None:
            lines.append(serialize(class_id, canvas, t.canvas))
        records.append({
            "instance_id": f"{pair_id}:{i}", "class_id": class_id, "source_polygon": source.tolist(), "crop_intersection_polygon": kept.tolist(), "canvas_polygon": canvas.tolist(),
            "source_area": K.area(source), "crop_intersection_area": K.area(kept), "canvas_area": K.area(canvas), "status": "kept" if reason is None else "dropped", "reason": reason,
        })
    return lines, records


def record(pair_id: str, split: str, view: str, source: str, transform: dict, instances: list[dict], proxies: dict, version: str) -> dict:
    drops: dict[str, int] = {}
    for i in instances:
        if i["reason"]:
            drops[i["reason"]] = drops.get(i["reason"], 0) + 1
    return {
        "schema_version": 1, "pair_id": pair_id, "split": split, "view": view, "source": source, "transform": transform, "preprocessing_version": version, "instances": instances,
        "input_instance_count": len(instances), "output_instance_count": sum(i["status"] == "kept" for i in instances), "dropped_instance_reasons": drops, "artifact_proxies": proxies,
    }


def proxies(crop_size: tuple[int, int], size: tuple[int, int], hair: float, gains: list[float]) -> dict:
    return {"hair_mask_coverage": hair, "vignette_crop_ratio": 1.0 - crop_size[0] * crop_size[1] / (size[0] * size[1]), "gray_world_gains": gains, "gray_world_correction_magnitude": float(np.linalg.norm(np.array(gains) - 1.0))}


NEUTRAL = {"hair_mask_coverage": 0.0, "vignette_crop_ratio": 0.0, "gray_world_gains": [1.0, 1.0, 1.0], "gray_world_correction_magnitude": 0.0}


def views(spark: SparkSession, root: str, side: int = 640, version: str = "annolith-1", eval_crops: bool = False) -> DataFrame:
    """(split, stem, view, lines, metadata JSON, pixels as BGR bytes) of all outputs; one pass over images with their labels."""
    pictures = spark.read.format("image").option("recursiveFileLookup", "true").load(f"{root}/images").select("image.*")
    pictures = pictures.select("origin", F.regexp_extract("origin", "([^/]+)/[^/]+$", 1).alias("split"), labels.stem(F.col("origin")).alias("stem"), "height", "width", "nChannels", "data")
    lines = labels.read_strict(spark, f"{root}/labels", recursive=True).groupBy("split", "stem").agg(F.array_sort(F.collect_list(F.struct("line_no", "class_id", "points"))).alias("items"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.width <= 0:
                    raise ValueError(f"unreadable image: {r.origin}")
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                image = np.repeat(image, 3, axis=2) if r.nChannels == 1 else image[..., :3]
                items = [] if r.items is None else [(i["class_id"], np.array([(v["x"], v["y"]) for v in i["points"]])) for i in r.items]
                source = r.origin.rsplit("/", 1)[-1]
                made = [("v1", image, (0, 0, r.width, r.height), NEUTRAL)]
                if r.split == "train" or eval_crops:
                    x, y, w, h = raster.roi_box(image)
                    part = image[y : y + h, x : x + w]
                    hair = raster.hair_mask(part)
                    part, gains = raster.gray_world(raster.inpainted(part, hair))
                    made.append(("v7", part, (x, y, w, h), proxies((w, h), (r.width, r.height), float(hair.mean()), gains)))
                for view, pixels, crop, found in made:
                    t = make_transform(r.width, r.height, crop, side)
                    text, instances = place_instances(items, t, r.stem, view == "v7")
                    out.append((r.split, f"{r.stem}_{view}", view, text, json.dumps(record(r.stem, r.split, view, source, t, instances, found, version), sort_keys=True, separators=(",", ":")), raster.letterboxed(pixels, side).tobytes()))
            yield pd.DataFrame(out, columns=["split", "stem", "view", "lines", "metadata", "pixels"])

    return pictures.join(lines, ["split", "stem"], "left").mapInPandas(run, VIEW_ROWS)


def build(spark: SparkSession, root: str, destination: str, side: int = 640, overwrite: bool = False, eval_crops: bool = False) -> int:
    """Publish views as image and label files with ``metadata/transforms.jsonl``, all or nothing; how many views there are.

    ``destination`` is in a folder that all executors share.  Crops of other splits than train go to their ``_v7_eval`` folder.
    """
    written = 0

    def write(staging: str) -> None:
        nonlocal written
        scratch = f"{staging}/.views"
        views(spark, root, side, eval_crops=eval_crops).write.parquet(scratch)  # made once, written as files from there
        made = spark.read.parquet(scratch)
        folder = F.when((F.col("split") != "train") & (F.col("view") == "v7"), F.concat("split", F.lit("_v7_eval"))).otherwise(F.col("split"))
        written = sinks.write_pairs(made.select(folder.alias("split"), "stem", _png_of(side)("pixels").alias("image"), F.array_join("lines", "\n").alias("text")), staging)
        lines = made.select("split", "stem", "metadata").repartitionByRange("split", "stem").sortWithinPartitions("split", "stem").select("metadata")
        os.makedirs(f"{staging}/metadata")
        with open(f"{staging}/metadata/transforms.jsonl", "w", encoding="utf-8", newline="\n") as f:  # a partition at a time on the driver
            f.writelines(f"{r.metadata}\n" for r in lines.toLocalIterator())
        shutil.rmtree(scratch)

    sinks.publish(destination, write, overwrite)
    return written


def _png_of(side: int):
    @F.pandas_udf("binary")
    def encode(pixels: pd.Series) -> pd.Series:
        return pixels.map(lambda b: raster.png(np.frombuffer(b, np.uint8).reshape(side, side, 3)))

    return encode


def augment(spark: SparkSession, source: str, destination: str, n: int = 3, least_area: float = 50.0, excluded: int = 5, overwrite: bool = False) -> dict:
    """Publish a built dataset with ``n`` augmented copies of each training image without a polygon of the excluded class; attempts and saved.

    Originals of all splits (and crops of val and test) pass through as they are, as does an image without labels.  An attempt that leaves no polygon of
    ``least_area`` is skipped.
    """
    found: dict = {}

    def write(staging: str) -> None:
        pictures = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(f"{source}/images").select("path", F.col("content").alias("image"))
        keyed = pictures.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("split"), labels.stem(F.col("path")).alias("stem"), "image")
        folders = [*files.SPLITS, *[f"{s}_v7_eval" for s in files.SPLITS[1:]]]
        texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{source}/labels").select("path", "content")
        texts = texts.unionByName(labels.empty_files(spark, f"{source}/labels")).select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("split"), labels.stem(F.col("path")).alias("stem"), F.col("content").cast("string").alias("text"))
        passed = keyed.where(F.col("split").isin(*folders)).join(texts, ["split", "stem"], "left")
        found["passed"] = sinks.write_pairs(passed, staging)

        polygons = labels.read_strict(spark, f"{source}/labels/train")
        items = polygons.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("line_no", "class_id", "points"))).alias("items"))
        drawn = spark.read.format("image").load(f"{source}/images/train").select("image.*").select(labels.stem(F.col("origin")).alias("stem"), "height", "width", "nChannels", "data", "origin")
        eligible = R.eligible_to_build(drawn, polygons, ["stem"], excluded).join(items, "stem", "left")
        tried = R.attempts(eligible, n).withColumn("seed", F.pmod(F.xxhash64("stem", "attempt"), F.lit(1 << 31)))
        found["attempts"] = n * eligible.count()
        found["saved"] = sinks.write_pairs(tried.mapInPandas(_attempts(least_area), "split string, stem string, image binary, text string"), staging)
        found["skipped"] = found["attempts"] - found["saved"]

    sinks.publish(destination, write, overwrite)
    return found


def _attempts(least_area: float):
    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.width <= 0:
                    raise ValueError(f"unreadable image: {r.origin}")
                draw, lines = raster.Augmentation(r.width, r.height, int(r.seed)), []
                size = np.array([r.width, r.height], float)
                for i in r.items if r.items is not None else ():
                    moved = draw.points(np.array([(v["x"], v["y"]) for v in i["points"]]) * size)
                    if len(moved) >= 3 and raster.area_float32(moved) >= least_area:
                        lines.append(serialize(i["class_id"], moved, size))
                if lines:
                    image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                    image = np.repeat(image, 3, axis=2) if r.nChannels == 1 else image[..., :3]
                    out.append(("train", f"{r.stem}_aug{r.attempt}", raster.png(draw.image(image)), "\n".join(lines)))
            yield pd.DataFrame(out, columns=["split", "stem", "image", "text"])

    return run


def augmented_labels(images: DataFrame, polygons: DataFrame, side: int, n: int = 3, least_area: float = 50.0) -> DataFrame:
    """(stem, attempt, class_id, points): seeded geometry for each attempt at each eligible image; small polygons and empty attempts go."""
    eligible = R.attempts(R.eligible_to_build(images, polygons, ["stem"]), n)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                p = np.array([(v["x"], v["y"]) for v in r.points]) * side
                moved = raster.augment_points(p, side, side, int(r.seed))
                if len(moved) >= 3 and raster.area_float32(moved) >= least_area:
                    out.append((r.stem, r.attempt, r.class_id, [{"x": x, "y": y} for x, y in (np.clip(moved, 0, side) / side).tolist()]))
            yield pd.DataFrame(out, columns=["stem", "attempt", "class_id", "points"])

    seed = F.pmod(F.xxhash64("stem", "attempt"), F.lit(1 << 31))
    rows = eligible.select("stem", "attempt", seed.alias("seed")).join(polygons.select("stem", "class_id", "points"), "stem")
    return rows.mapInPandas(run, "stem string, attempt int, class_id int, points array<struct<x:double,y:double>>")

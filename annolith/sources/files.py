"""Images, view files, manifests, predictions and driver-side configuration."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.sources.labels import empty_files, stem

SPLITS = ("train", "val", "test")
VIEWS = ("v1", "v7")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def list_images(spark: SparkSession, root: str, glob: str = "*.jpg") -> DataFrame:
    """Paths and stems of a folder's images; contents aren't read.  Sort at the sink."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(root).select("path", stem(F.col("path")).alias("stem"))


def decode_images(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """(path, stem, height, width, readable); strict: an unreadable one ends the query."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.origin", "image.height", "image.width")
    ok = F.col("width") > 0
    if strict:
        ok = F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("unreadable image: "), "origin")).cast("boolean"))
    return rows.select(F.col("origin").alias("path"), stem(F.col("origin")).alias("stem"), "height", "width", ok.alias("readable"))


def view_files(spark: SparkSession, root: str, suffixes: tuple[str, ...], content: bool = False) -> DataFrame:
    """(path, split, pair_id, view) of files named ``<pair>_<view>.<suffix>`` in a split's folder or its ``_v7_eval`` sibling."""
    empty = spark.createDataFrame([], "path string, split string, pair_id string, view string" + ", content binary" * content)
    if not os.path.isdir(root):
        return empty
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content").unionByName(empty_files(spark, root))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    kind = "|".join(s.lstrip(".") for s in suffixes)
    rule = rf"(?i)^(.+)_(v1|v7)\.({kind})$"
    keyed = files.select(
        "path",
        F.regexp_replace(F.lower(F.regexp_extract("path", "([^/]+)/[^/]+$", 1)), "_v7_eval$", "").alias("split"),
        F.regexp_extract(name, rule, 1).alias("pair_id"),
        F.lower(F.regexp_extract(name, rule, 2)).alias("view"),
        *(["content"] if content else []),
    )
    return keyed.where(F.col("split").isin(*SPLITS) & (F.col("view") != ""))


def manifest(spark: SparkSession, root: str, without: str | None = None) -> DataFrame:
    """(path below root, size, sha256) of all files, except below ``without``."""
    base = os.path.realpath(root).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content").unionByName(empty_files(spark, root))
    rows = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))
    rows = rows.where(F.col("path").startswith(base)).withColumn("path", F.expr(f"substring(path, {len(base) + 1})"))
    return rows if without is None else rows.where(~F.col("path").startswith(without.strip("/") + "/"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest written before, from JSON lines."""
    return spark.read.schema("path string, size bigint, sha256 string").json(path)


PREDICTION = "image_id string, file_name string, category_id double, score double, bbox array<double>, segmentation string"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, stem, category_id, score, bbox, segmentation as JSON) of a JSON array, in file order; an error if it is no JSON.

    An array can't be split, so one task streams it, a row for each element.
    """
    items = spark.read.schema(PREDICTION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    got = items.select(F.monotonically_increasing_id().alias("ordinal"), F.struct(*items.columns).alias("p"))
    name = F.coalesce(F.when(F.col("p.file_name") != "", F.col("p.file_name")), F.concat(F.col("p.image_id"), F.lit(".jpg")))
    return got.select(
        "ordinal", stem(name).alias("stem"), F.col("p.category_id").cast("int").alias("category_id"), F.coalesce("p.score", F.lit(0.0)).alias("score"),
        F.coalesce("p.bbox", F.array(*[F.lit(0.0)] * 4)).alias("bbox"), F.col("p.segmentation").alias("segmentation"),
    )


def _plain(text: str) -> str:
    """A scalar without its comment and quotes."""
    text = text.strip()
    if text[:1] in "'\"" and text[:1] and (end := text.find(text[0], 1)) > 0:
        return text[1:end]
    return text.split(" #")[0].strip()


def _flow(text: str) -> dict[int, str]:
    """Names of a flow list or a flow map."""
    inner = text.strip()[1:].rsplit("]" if text.strip()[0] == "[" else "}", 1)[0]
    parts = [p for p in inner.split(",") if p.strip()]
    if text.strip()[0] == "[":
        return {i: _plain(p) for i, p in enumerate(parts)}
    return {int(_plain(k)): _plain(v) for k, _, v in (p.partition(":") for p in parts)}


def dataset_config(path: str) -> dict:
    """Folders and class names of a dataset description; the test folders must exist.

    The description is flat ``key: value`` lines; ``names`` is a map or a list, in block or flow style, in which no name has a comma or a colon.
    """
    config: dict = {"names": {}}
    inside = False
    with open(path, encoding="utf-8") as f:
        for line in f:
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            item = line.strip()
            if inside and item.startswith("- "):
                config["names"][len(config["names"])] = _plain(item[2:])
                continue
            key, colon, value = line.rstrip().partition(":")
            if not colon:
                continue
            if line[0] in " \t":
                if inside:
                    config["names"][int(_plain(key))] = _plain(value)
                continue
            inside = key.strip() == "names"
            if inside and value.strip()[:1] in ("[", "{"):
                config["names"] = _flow(value)
            elif not inside and _plain(value):
                config[key.strip()] = _plain(value)
    root = os.path.join(os.path.dirname(os.path.abspath(path)), config.get("path", "."))
    test = config.get("test", "images/test")
    out = {"root": root, "images": os.path.join(root, test), "labels": os.path.join(root, test.replace("images/", "labels/", 1)), "names": [config["names"][k] for k in sorted(config["names"])]}
    for kind in ("images", "labels"):
        if not os.path.isdir(out[kind]):
            raise FileNotFoundError(f"no {kind} folder: {out[kind]}")
    return out


def check_layout(root: str) -> None:
    """Three splits, each with images and labels."""
    missing = [p for s in SPLITS for k in ("images", "labels") if not os.path.isdir(p := os.path.join(root, k, s))]
    if missing:
        raise FileNotFoundError(f"missing folders: {missing}")


def check_inputs(*paths: str) -> None:
    """All must exist: a checkpoint, a description, folders."""
    missing = [p for p in paths if not os.path.exists(p)]
    if missing:
        raise FileNotFoundError(f"missing inputs: {missing}")


def point_metrics(path: str) -> dict:
    """Numbers of a JSON file; empty if there is none."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    return held.get("metrics", held)

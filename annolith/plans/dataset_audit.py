"""Audit of a dataset and its processed trees: layout, leakage, counts, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.operators import relational as R
from annolith.sources import files, labels, sinks


def tree(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, label files, polygons) of a dataset with split and stem."""
    files.check_layout(root)
    split = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)

    def listed(kind: str, suffix: str) -> DataFrame:
        """Files that aren't hidden, those of no bytes too."""
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(f"{root}/{kind}").select("path")
        empty = files.empty_files(spark, f"{root}/{kind}").select("path").where(F.col("path").rlike(r"/[^/._][^/]*$") & F.col("path").endswith(suffix))
        return found.unionByName(empty).select("path", split.alias("split"), labels.stem(F.col("path")).alias("stem"), F.lit(name).alias("dataset"))

    polygons = labels.parse(labels.read_lines(spark, f"{root}/labels", recursive=True)).withColumn("dataset", F.lit(name))
    keep = F.col("split").isin(*files.SPLITS)
    return listed("images", ".jpg").where(keep), listed("labels", ".txt").where(keep), polygons.where(keep)


def check_leakage(images: DataFrame, fail: bool = True) -> list:
    """Source identifiers that two splits share."""
    found = R.cross_split_overlaps(images.select("split", R.normalized_id(F.concat("stem", F.lit(".jpg"))).alias("id")).distinct()).collect()
    if found and fail:
        raise ValueError(f"identifiers in two splits: {[(r.left_split, r.right_split, r.ids[:5]) for r in found]}")
    return found


def audit_project(spark: SparkSession, trees: dict[str, str], per_image: int = 3) -> dict:
    """Counts over named trees; the tree ``augmented`` and the tree ``paired`` give the attempt accounting."""
    report: dict = {"datasets": {}, "cross_split_overlaps": {}, "invalid_files": []}
    every = None
    for name, root in trees.items():
        images, texts, polygons = tree(spark, root, name)
        readable = files.decode_images(spark, f"{root}/images")
        broken = readable.where("not readable").select("path").orderBy("path").collect()
        broken += labels.parse(labels.read_lines(spark, f"{root}/labels", recursive=True)).where("error is not null").select("path").distinct().orderBy("path").collect()
        report["invalid_files"] += [r.path for r in broken]
        report["datasets"][name] = {
            "split_counts": {r.split: r.n for r in images.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()},
            "composition": {r.split: r.asDict() for r in R.view_composition(images).collect()},
            "unmatched": R.unmatched(images, texts, ["split", "stem"]).count(),
        }
        report["cross_split_overlaps"][name] = [r.asDict() for r in check_leakage(images, fail=False)]
        every = polygons if every is None else every.unionByName(polygons)
        if name == "paired":
            report["eligible"] = R.eligible_in_audit(polygons.where("split = 'train' and error is null"), ["stem"]).count()
    counts = R.class_histogram(every.where("error is null")).collect()
    report["class_polygons"] = {r.class_id: r.n for r in counts if r.dataset is None}
    report["class_polygons_by_dataset"] = {f"{r.dataset}:{r.class_id}": r.n for r in counts if r.dataset is not None}
    if "eligible" in report and "augmented" in report["datasets"]:
        saved = report["datasets"]["augmented"]["composition"].get("train", {}).get("aug", 0)
        tried = per_image * report["eligible"]
        report["augmentation"] = {"attempts": tried, "saved": saved, "skipped": max(0, tried - saved), "complete": tried == saved}
    report["invalid_files"].sort()
    return report


def compare_to(spark: SparkSession, root: str, previous: str) -> DataFrame:
    """Changes since a manifest."""
    return R.manifest_diff(files.read_manifest(spark, previous), files.manifest(spark, root))


def write_report(path: str, folder: str, report: dict) -> None:
    sinks.write_json(str(sinks.within(path, folder)), report)

"""Polygon label files: one line per polygon, ``class x y x y ...`` in [0, 1]."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.functions import geometry as G

#: Plain decimal numbers only: what this and other engines parse alike.
NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
STEM = r"([^/]*?)(?:\.[^./]*)?$"


def stem(path):
    """File name without its last suffix."""
    return F.regexp_extract(path, STEM, 1)


def empty_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, content): files of no bytes in a folder (and below), which Spark's file sources leave out; from the same listing that they start with."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    found, listed = [], base.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(base, recursive)
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0:
            found.append((status.getPath().toString(), bytearray()))
    return spark.createDataFrame(found, "path string, content binary")


def read_lines(spark: SparkSession, root: str, glob: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(path, stem, split, line_no, value): lines in file order, the folder's name being the split.  A file of no bytes has one empty line."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    visible = F.col("path").rlike(r"/[^/._][^/]*$") & F.regexp_extract("path", "([^/]*)$", 1).rlike(fnmatch.translate(glob))
    files = files.select("path", "content").unionByName(empty_files(spark, root, recursive).where(visible))
    text = files.select("path", F.regexp_replace(F.col("content").cast("string"), r"\r\n?", "\n").alias("t"))
    lines = text.select("path", F.posexplode(F.split("t", "\n")).alias("at", "value"))
    return lines.select("path", stem(F.col("path")).alias("stem"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("split"), (F.col("at") + 1).alias("line_no"), "value")


def parse(lines: DataFrame, value: str = "value", strict_shape: bool = False) -> DataFrame:
    """``lines`` with class_id, points and error (null if good); blank lines go.

    strict_shape: a polygon also needs three distinct vertices and an area, as the audit asks.
    """
    parts = lines.withColumn("tokens", F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")).where("tokens[0] <> ''")
    numbers = f"forall(slice(tokens, 2, size(tokens)), t -> t rlike '^{NUMBER}$')".replace("\\", "\\\\")
    parts = parts.withColumn("numeric", F.expr(numbers))
    parts = parts.withColumn("coords", F.expr("if(numeric, transform(slice(tokens, 2, size(tokens)), t -> cast(t as double)), null)"))
    parts = parts.withColumn("class_id", F.expr(r"if(tokens[0] rlike '^[+-]?[0-9]{1,9}$', cast(tokens[0] as int), null)"))
    points = F.expr(f"if(coords is null, null, {G.from_floats('coords')})")
    bad = (
        F.when((F.size("tokens") < 7) | (F.size("tokens") % 2 == 0), "INVALID_LABEL: coordinate count")
        .when(F.col("class_id").isNull(), "INVALID_LABEL: class is no integer")
        .when(~F.col("class_id").between(0, 6), "INVALID_LABEL: class outside 0..6")
        .when(F.col("coords").isNull(), "INVALID_LABEL: coordinate is no number")
        .when(F.expr("exists(coords, c -> isnan(c) or c < 0 or c > 1)"), "INVALID_LABEL: coordinate outside the canvas")
    )
    out = parts.withColumn("points", points)
    if strict_shape:
        # the one-element array binds the vertices to a name, so that they are made once
        flat = f"transform(array(points), p -> size(array_distinct(p)) < 3 or {G.area('p')} <= 0)[0]"
        bad = bad.when(F.expr(flat), "ZERO_AREA_LABEL_POLYGON")
    return out.withColumn("error", bad).drop("tokens", "numeric", "coords")


def read_strict(spark: SparkSession, root: str, **options) -> DataFrame:
    """Parsed lines; the first bad one ends the query with its file and line.  Points are the coordinates in pairs."""
    rows = parse(read_lines(spark, root, **options))
    checked = F.when(F.col("error").isNull(), F.col("class_id")).otherwise(F.raise_error(F.concat_ws(": ", F.concat(F.col("path"), F.lit(":"), F.col("line_no").cast("string")), "error")).cast("int"))
    return rows.withColumn("class_id", checked).drop("error")


def error_counts(lines: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """(polygons, counts): a file with any bad line gives no polygons; its bad lines are counted by reason."""
    rows = parse(lines, strict_shape=True).withColumn("reason", F.regexp_extract("error", "^[A-Z_]+", 0))
    errors = rows.where("error is not null").groupBy(*key, "reason").agg(F.count(F.lit(1)).alias("amount"))
    good = rows.join(errors.select(*key).distinct(), list(key), "left_anti").drop("error", "reason")
    return good, errors


def first_polygon(lines: DataFrame, side: int) -> DataFrame:
    """For scoring: each file's first line that isn't blank, leniently; class_id, pixel coordinates and box.  An empty file is an error."""
    first = lines.groupBy("path", "stem").agg(F.min_by("value", F.when(F.trim(F.regexp_replace("value", r"\s+", " ")) != "", F.col("line_no"))).alias("value"), F.max(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").alias("any"))
    first = first.withColumn("value", F.when(F.col("any"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("empty label file: "), "path"))))
    parts = first.withColumn("tokens", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "))
    pixels = parts.withColumn("pixels", F.expr(f"transform(slice(tokens, 2, size(tokens)), t -> cast(t as double) * {side})")).withColumn("p", F.expr(G.from_floats("pixels")))
    return pixels.select("stem", F.expr("cast(cast(tokens[0] as double) as int)").alias("class_id"), "pixels", F.expr(G.bbox("p")).alias("box"))


def label_text(polygons: DataFrame, *key: str) -> DataFrame:
    """(key, text): the lines of each file in order, joined by newlines, none at the end."""
    return polygons.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("text"))

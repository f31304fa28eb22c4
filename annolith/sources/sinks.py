"""Writers: atomic reports, label files, JSON lines, tables; transactional publication of folders.

Files are written on the driver where a result is a report by nature; data go through Spark's writers into a
staging folder, which a rename publishes.
"""

from __future__ import annotations

import contextlib
import datetime
import hashlib
import json
import math
import os
import shutil
import sys
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_scalar(value):
    """A number that JSON can hold; null for what isn't finite or no number."""
    try:
        value = float(value)
    except (TypeError, ValueError):
        return None
    return value if math.isfinite(value) else None


def write_json(path: str, payload) -> None:
    """All or nothing: a sibling file, synced, then renamed.  NaN is an error and leaves nothing behind."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    staging = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    try:
        with staging.open("w", encoding="utf-8") as f:
            json.dump(payload, f, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False)
            f.write("\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(staging, target)
    finally:
        staging.unlink(missing_ok=True)


def within(path: str, folder: str) -> Path:
    """The resolved path, if it lies below a folder; else an error."""
    resolved, base = Path(path).resolve(), Path(folder).resolve()
    if base not in resolved.parents:
        raise ValueError(f"{path} isn't below {folder}")
    return resolved


def allowed_destination(path: str, root: str, intended: str) -> Path:
    """Only the intended folder may be built, below ``data``, after links are resolved."""
    resolved = within(path, str(Path(root) / "data"))
    if resolved != (Path(root) / "data" / intended).resolve():
        raise ValueError(f"{path} isn't the intended destination")
    return resolved


def single_name(name: str) -> str:
    """A name of one path segment."""
    if not name or name in (".", "..") or Path(name).name != name or "\\" in name:
        raise ValueError(f"no plain name: {name!r}")
    return name


def prepare_destination(path: str, overwrite: bool) -> None:
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)


def publish(destination: str, build: Callable[[str], None], overwrite: bool = False) -> None:
    """Build in a sibling folder, move an old destination to a backup of a unique name, rename; roll back on failure."""
    prepare_destination(destination, overwrite)
    staging, backup = (f"{destination}.{kind}-{uuid.uuid4().hex}" for kind in ("tmp", "old"))
    os.makedirs(staging)
    try:
        build(staging)
        moved = os.path.exists(destination)
        if moved:
            os.rename(destination, backup)
        try:
            os.rename(staging, destination)
        except BaseException:
            if moved:
                os.rename(backup, destination)
            raise
        if moved:
            shutil.rmtree(backup)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


@contextlib.contextmanager
def exclusive(path: str) -> Iterator[None]:
    """A lock file for the length of a run; an error if another run holds it."""
    handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    try:
        os.write(handle, str(os.getpid()).encode())
        yield
    finally:
        os.close(handle)
        os.unlink(path)


def write_pairs(rows: DataFrame, folder: str, suffix: str = ".png") -> int:
    """(split, stem, image, text) rows as ``images/<split>/<stem><suffix>`` and ``labels/<split>/<stem>.txt``; how many there were.

    ``folder`` must be one that all executors share.  A file appears whole (a task that is run again replaces it by the same), an image whose label can't
    be written goes, and a null text makes no label file.
    """

    def put(path: Path, data: bytes) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
        try:
            part.write_bytes(data)
            os.replace(part, path)
        finally:
            part.unlink(missing_ok=True)

    def write(batches):
        n = 0
        for pdf in batches:
            for split, name, image, text in zip(pdf["split"], pdf["stem"], pdf["image"], pdf["text"], strict=True):
                picture = Path(folder, "images", split, f"{name}{suffix}")
                put(picture, image)
                try:
                    if text is not None:
                        put(Path(folder, "labels", split, f"{name}.txt"), text.encode())
                except OSError:
                    picture.unlink(missing_ok=True)
                    raise
                n += 1
        yield pd.DataFrame({"n": [n]})

    return rows.select("split", "stem", "image", "text").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def json_lines(records: DataFrame) -> DataFrame:
    """One column ``value``: JSON with sorted keys, nulls kept."""
    return records.select(F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(records: DataFrame, path: str, *order: str) -> None:
    """One file of sorted rows."""
    json_lines(records.orderBy(*order)).coalesce(1).write.mode("error").text(path)


def write_score_outputs(folder: str, rows: DataFrame, summary: dict, per_class: DataFrame) -> None:
    """Scores and class table as CSV by Spark's writer; the summary as JSON, CSV and a Markdown table of four decimals."""
    os.makedirs(folder, exist_ok=True)
    rows.orderBy("image_id").coalesce(1).write.mode("overwrite").csv(f"{folder}/per_image_metrics", header=True)
    per_class.orderBy("class_id").coalesce(1).write.mode("overwrite").csv(f"{folder}/per_class_metrics", header=True)
    write_json(f"{folder}/bootstrap_ci.json", summary)
    lines = ["metric,point,low,high"] + [f"{k},{v['point']},{v['low']},{v['high']}" for k, v in summary["metrics"].items()]
    Path(folder, "bootstrap_ci.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    marks = ["| metric | point | low | high |", "|---|---:|---:|---:|"] + [f"| {k} | {v['point']:.4f} | {v['low']:.4f} | {v['high']:.4f} |" for k, v in summary["metrics"].items()]
    Path(folder, "bootstrap_ci.md").write_text("\n".join(marks) + "\n", encoding="utf-8")


#: Metrics that a validation run reports, by their keys there.
METRIC_KEYS = ("metrics/precision(B)", "metrics/recall(B)", "metrics/mAP50(B)", "metrics/mAP50-95(B)", "metrics/precision(M)", "metrics/recall(M)", "metrics/mAP50(M)", "metrics/mAP50-95(M)")


def extract_metrics(found: dict) -> tuple[dict, list[str]]:
    """The fixed metrics as JSON-safe numbers, and those that are missing."""
    got = {k: json_scalar(found[k]) for k in METRIC_KEYS if k in found}
    return got, [k for k in METRIC_KEYS if got.get(k) is None]


def file_sha256(path: str, block: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            digest.update(part)
    return digest.hexdigest()


def provenance(checkpoint: str, metrics: dict, arguments: dict, versions: dict, effective: dict | None = None) -> dict:
    """A run's record: of what, with which arguments and versions, and what it found.

    arguments: those asked for, of which batch, data, device, resolved_device, save_dir, seed and workers have fields of their own.  effective: those
    that the run itself reports, if it does.
    """
    got, missing = extract_metrics(metrics)
    plain = lambda found: {k: v if isinstance(v, str | bool | type(None)) else json_scalar(v) for k, v in sorted(found.items())}
    asked = plain(arguments)
    return {
        "schema_version": 1, "timestamp_utc": datetime.datetime.now(datetime.timezone.utc).isoformat(),
        "checkpoint": os.path.abspath(checkpoint), "checkpoint_sha256": file_sha256(checkpoint), "checkpoint_size": os.path.getsize(checkpoint),
        "data": asked.get("data"), "split": asked.get("split", "test"), "imgsz": asked.get("imgsz", 640), "batch": asked.get("batch"), "workers": asked.get("workers"), "seed": asked.get("seed"),
        "requested_device": asked.get("device"), "resolved_device": asked.get("resolved_device", asked.get("device")), "save_dir": asked.get("save_dir"),
        "python_version": sys.version, "versions": dict(sorted(versions.items())), "requested_val_args": asked,
        "effective_val_args": asked if effective is None else plain(effective), "effective_args_source": "requested" if effective is None else "run",
        "metrics": got, "missing_metrics": missing, "complete": not missing,
    }


def positive_int(value) -> int:
    """A whole number above 0; else an error."""
    return _whole(value, 1, "positive")


def natural_int(value) -> int:
    """A whole number from 0 on; else an error."""
    return _whole(value, 0, "nonnegative")


def _whole(value, least: int, kind: str) -> int:
    if isinstance(value, bool) or not (isinstance(value, int) or isinstance(value, str) and value.strip().lstrip("+-").isdecimal()) or int(value) < least:
        raise ValueError(f"must be a {kind} integer: {value!r}")
    return int(value)

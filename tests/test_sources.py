"""Readers, rasters, scoring, publication."""

import hashlib
import json

import numpy as np
import pytest
from annolith.functions import raster as M
from annolith.operators import relational as R
from annolith.operators.bootstrap import replay
from annolith.plans import build_paired, dataset_audit, paired_audit, scoring
from annolith.sources import files, labels, sinks
from dataset import png
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def parsed(spark, text, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(text)], "line_no int, value string")
    return [r.error for r in labels.parse(df, **options).orderBy("line_no").collect()]


def test_label_lines(spark):
    bad = ["7 0 0 1 0 1 1", "1.5 0 0 1 0 1 1", "1 0 0 1 1", "1 0 0 1 0 1", "1 nan 0 1 0 1 1", "1 -0.1 0 1 0 1 1", "1 0x1 0 1 0 1 1"]
    assert all(parsed(spark, bad))
    assert parsed(spark, ["2 0 0 1 0 1 1", "", " 3\t0 0 1e-6 0 0 1e-6 ", "0 0 0 0 0 0 0"], strict_shape=True) == [None, None, "ZERO_AREA_LABEL_POLYGON"]


def test_label_files(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train/a.b.txt").write_text("1 0 0 1 0 1 1\r\n2 0 0 1 0 1 1")
    (tmp_path / "train/c.txt").write_text("1 0 0 1 0 1 1\nbad\n")
    lines = labels.read_lines(spark, str(tmp_path), recursive=True)
    good, errors = labels.error_counts(lines, "stem")
    assert sorted((r.stem, r.line_no, r.class_id) for r in good.collect()) == [("a.b", 1, 1), ("a.b", 2, 2)]
    assert [tuple(r) for r in errors.collect()] == [("c", "INVALID_LABEL", 1)]
    with pytest.raises(Exception, match="coordinate count"):
        labels.read_strict(spark, str(tmp_path), recursive=True).collect()


@pytest.mark.parametrize(("name", "want"), [("ISIC_0001234.JPG", "isic_0001234"), ("d/ISIC_0001234_v7_aug12.jpg", "isic_0001234"), ("isic_0001234_v1_v7_aug2", "isic_0001234"), ("patient_1_v1.jpg", None)])
def test_identifiers(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(R.normalized_id(F.col("n"), strict=False).alias("i")).first().i == want


def test_overlaps_and_manifests(spark, tmp_path):
    names = spark.createDataFrame([("train", "x"), ("val", "x"), ("test", "x"), ("val", "y"), ("test", "y")], "split string, id string")
    assert sorted((r.left_split, r.right_split, r.ids) for r in R.cross_split_overlaps(names).collect()) == [("train", "test", ["x"]), ("train", "val", ["x"]), ("val", "test", ["x", "y"])]
    (tmp_path / "d").mkdir()
    for n, t in (("same", "1"), ("gone", "1"), ("size", "1"), ("content", "1")):
        (tmp_path / "d" / n).write_text(t)
    old = files.manifest(spark, str(tmp_path / "d"))
    old.write.json(str(tmp_path / "old"))
    (tmp_path / "d/gone").unlink()
    (tmp_path / "d/new").write_text("1"), (tmp_path / "d/size").write_text("12"), (tmp_path / "d/content").write_text("2")
    got = dataset_audit.compare_to(spark, str(tmp_path / "d"), str(tmp_path / "old"))
    assert sorted(map(tuple, got.collect())) == [("content", "content"), ("gone", "removed"), ("new", "added"), ("size", "size")]


def test_empty_files_are_in_manifests_and_trees(spark, tmp_path):
    d = tmp_path / "d"
    for split in files.SPLITS:
        (d / "images" / split).mkdir(parents=True), (d / "labels" / split).mkdir(parents=True)
    png(d / "images/train/a.jpg", np.zeros((2, 2, 3)))
    (d / "labels/train/a.txt").write_text(""), (d / "labels/train/gone.txt").write_text(""), (d / "labels/train/emptied.txt").write_text("1")
    old = files.manifest(spark, str(d))
    assert {r.path: (r.size, r.sha256) for r in old.collect()}["labels/train/a.txt"] == (0, hashlib.sha256(b"").hexdigest())
    old.write.json(str(tmp_path / "old"))
    (d / "labels/train/gone.txt").unlink(), (d / "labels/train/emptied.txt").write_text(""), (d / "labels/val/new.txt").write_text("")
    got = dataset_audit.compare_to(spark, str(d), str(tmp_path / "old"))
    assert sorted(map(tuple, got.collect())) == [("labels/train/emptied.txt", "size"), ("labels/train/gone.txt", "removed"), ("labels/val/new.txt", "added")]
    images, texts, polygons = dataset_audit.tree(spark, str(d), "x")
    assert sorted((r.split, r.stem) for r in texts.collect()) == [("train", "a"), ("train", "emptied"), ("val", "new")]
    assert sorted(r.stem for r in R.unmatched(images, texts, ["split", "stem"]).collect()) == ["emptied", "new"]
    assert polygons.collect() == []


def test_known_rasters():
    assert M.pooled_mask([(-0.1, -0.1), (0.49, 0.49), (1.1, 0.49)], 5, 6).shape == (2, 2)
    assert M.pooled_mask([(-0.1, -0.1), (0.49, 0.49), (1.1, 0.49)], 5, 6).all()
    assert M.pooled_mask([(0.2, 0.2), (0.21, 0.2), (0.2, 0.21)], 8, 8).sum() == 1
    assert M.polygon_mask([1, 1, 6, 1, 6, 6, 1, 6], 8).sum() == 36
    image = np.zeros((4, 4, 3), np.uint8)
    image[..., 0], image[..., 1], image[..., 2] = 10, 20, 30
    assert np.allclose(M.gray_world(image)[1], [2, 1, 2 / 3])
    image[:] = 0
    image[1:3, 1:4] = 200
    assert M.roi_box(image) == (1, 1, 3, 2) and M.letterboxed(image[1:3, 1:4], 6).shape == (6, 6, 3)
    assert M.hair_mask(np.full((9, 9, 3), 200, np.uint8)).sum() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=20))
def test_runs_round_trip(counts):
    assert M.rle_counts(M.rle_text(counts)) == counts


def test_run_masks():
    assert M.rle_mask(2, 3, [1, 2, 9]).tolist() == [[False, True, False], [True, False, False]]
    with pytest.raises(ValueError, match="negative"):
        M.rle_mask(2, 2, [1, -1])
    assert M.segmentation_mask({"size": [2, 2], "counts": [0, 4]}, 4).all() and not M.segmentation_mask(None, 4).any()


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_overlap_properties(seed):
    a, b = np.random.default_rng(seed).random((2, 6, 6)) < 0.4
    iou, dice = M.iou_and_dice(a, b)
    assert M.iou_and_dice(b, a) == (iou, dice) and 0 <= iou <= 1 and dice == pytest.approx(2 * iou / (1 + iou))


def test_scoring_end_to_end(spark, tmp_path):
    for kind in ("images", "labels"):
        (tmp_path / kind / "test").mkdir(parents=True)
    square = lambda a, b: " ".join(map(str, (a, a, b, a, b, b, a, b)))
    (tmp_path / "labels/test/img_a.txt").write_text(f"1 {square(0.25, 0.75)}\n")
    (tmp_path / "labels/test/img_b.txt").write_text(f"\n2 {square(0.1, 0.4)}\n")
    (tmp_path / "labels/test/img_c.txt").write_text(f"0 {square(0.1, 0.4)}\n")
    (tmp_path / "d.yaml").write_text("path: .\ntest: images/test\nnames:\n  0: x\n  1: y\n  2: z\n")
    polygon = [16, 16, 48, 16, 48, 48, 16, 48]
    predictions = [
        {"image_id": "img_a", "category_id": 1, "score": 0.9, "bbox": [16, 16, 32, 32], "segmentation": [polygon]},
        {"image_id": "img_a", "category_id": 2, "score": 0.9, "bbox": [0, 0, 1, 1], "segmentation": None},
        {"image_id": "x", "file_name": "img_b.jpg", "category_id": 1, "score": 0.5, "bbox": [0, 0, 20, 20], "segmentation": {"size": [64, 64], "counts": [0, 4096]}},
    ]
    (tmp_path / "p.json").write_text(json.dumps(predictions))
    summary = scoring.run(spark, str(tmp_path / "d.yaml"), str(tmp_path / "p.json"), str(tmp_path / "out"), side=64, replicates=50)
    rows = {r.image_id: r for r in scoring.score(spark, str(tmp_path / "labels/test"), str(tmp_path / "p.json"), 3, 64).collect()}
    assert rows["img_a"].top1_accuracy == 1 and rows["img_a"].box_iou == 1 and rows["img_a"].mask_iou == 1
    assert rows["img_b"].pred_class == 1 and 0 < rows["img_b"].mask_iou < 0.2
    assert rows["img_c"].pred_class == -1 and rows["img_c"].mask_dice == 0
    assert summary["metrics"]["top1_accuracy"]["point"] == pytest.approx(1 / 3) and summary["metrics"]["macro_top1_accuracy"]["point"] == pytest.approx(1 / 3)
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"bootstrap_ci.json", "bootstrap_ci.csv", "bootstrap_ci.md", "per_image_metrics", "per_class_metrics"}
    assert R.class_offset(spark.createDataFrame([(5,), (7,)], "category_id int"), 7) == 1


def test_replay_matches_numpy():
    import pandas as pd

    pdf = pd.DataFrame({"m": [0.0, 1.0, 1.0, 0.0, 1.0], "c": [2, 1, 2, 1, 2]})
    got = replay(pdf, ["m"], ["m"], "c", 30, 3, 0.95).set_index("metric")
    rnd, x = np.random.default_rng(3), pdf["m"].to_numpy()
    plain = [x[rnd.integers(0, 5, 5)].mean() for _ in range(30)]
    assert np.allclose(got.loc["m", ["low", "high"]].to_numpy(float), np.quantile(plain, [0.025, 0.975]))
    assert got.loc["macro_m", "point"] == pytest.approx((2 / 3 + 0.5) / 2)


#: Published class means of a 1,007-image test: class, images, top-1, mask IoU, Dice, strict (rounded to four decimals).
PUBLISHED = [(0, 34, 0.7647, 0.8538, 0.9197, 0.7647), (1, 52, 0.8077, 0.7697, 0.8588, 0.75), (2, 111, 0.8288, 0.8648, 0.9197, 0.8018), (3, 12, 0.75, 0.8487, 0.9158, 0.75), (4, 112, 0.5625, 0.9024, 0.9403, 0.5536), (5, 671, 0.9881, 0.927, 0.9578, 0.9776), (6, 15, 1.0, 0.7884, 0.8454, 0.8667)]


def test_published_means(spark):
    df = spark.createDataFrame([(c, *m) for c, n, *m in PUBLISHED for _ in range(n)], "true_class int, top1_accuracy double, mask_iou double, mask_dice double, strict_class_and_mask_iou50 double")
    micro, macro = R.micro(df, scoring.MACRO).first(), R.macro(df, scoring.MACRO).first()
    assert list(micro) == pytest.approx([0.9037, 0.9038, 0.9431, 0.8878], abs=1e-4)
    assert list(macro) == pytest.approx([0.8145, 0.8507, 0.9082, 0.7806], abs=1e-4)


def test_publication(tmp_path):
    target = tmp_path / "out"
    build = lambda text: lambda d: open(f"{d}/f", "w").write(text) and None  # noqa: E731, SIM115
    sinks.publish(str(target), build("1"))
    with pytest.raises(FileExistsError):
        sinks.publish(str(target), build("2"))

    def fails(d):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        sinks.publish(str(target), fails, overwrite=True)
    assert (target / "f").read_text() == "1"
    sinks.publish(str(target), build("2"), overwrite=True)
    assert (target / "f").read_text() == "2" and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_reports_and_guards(tmp_path):
    sinks.write_json(str(tmp_path / "r.json"), {"a": 1})
    with pytest.raises(ValueError, match="JSON"):
        sinks.write_json(str(tmp_path / "r.json"), {"a": float("nan")})
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1} and len(list(tmp_path.iterdir())) == 1
    for bad in ("", "..", "a/b"):
        with pytest.raises(ValueError, match="plain name"):
            sinks.single_name(bad)
    with pytest.raises(ValueError, match="below"):
        sinks.within(str(tmp_path / ".." / "x"), str(tmp_path))
    with sinks.exclusive(str(tmp_path / "lock")), pytest.raises(FileExistsError), sinks.exclusive(str(tmp_path / "lock")):
        pass
    assert not (tmp_path / "lock").exists()
    got = sinks.provenance(str(tmp_path / "r.json"), {"metrics/mAP50(B)": float("inf")}, {"a": 1}, {"v": "1"})
    assert got["metrics"] == {"metrics/mAP50(B)": None} and not got["complete"] and len(got["checkpoint_sha256"]) == 64


def test_building_views(spark, tmp_path):
    rnd = np.random.default_rng(0)
    for split, stem in (("train", "isic_1"), ("val", "isic_2")):
        png(tmp_path / "images" / split / f"{stem}.png", rnd.integers(30, 255, (30, 40, 3)))
        (tmp_path / "labels" / split).mkdir(parents=True)
        (tmp_path / "labels" / split / f"{stem}.txt").write_text("2 0.1 0.1 0.9 0.1 0.9 0.9 0.1 0.9\n5 0.2 0.2 0.4 0.2 0.3 0.4")
    rows = build_paired.views(spark, str(tmp_path), side=64).collect()
    assert sorted(r.stem for r in rows) == ["isic_1_v1", "isic_1_v7", "isic_2_v1"]
    for r in rows:
        m = json.loads(r.metadata)
        assert len(r.pixels) == 64 * 64 * 3 and len(r.lines) == m["output_instance_count"] == 2 and m["input_instance_count"] == 2
    assert build_paired.build(spark, str(tmp_path), str(tmp_path / "out"), side=64) == 3
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.*")) == sorted([f"{s}.{e}" for s in ("isic_1_v1", "isic_1_v7", "isic_2_v1") for e in ("png", "txt")] + ["transforms.jsonl"])
    polygons = labels.parse(labels.read_lines(spark, str(tmp_path / "labels"), recursive=True)).where("stem = 'isic_1'")
    images = spark.createDataFrame([("isic_1",), ("isic_9",)], "stem string")
    assert build_paired.augmented_labels(images, polygons, 640).count() == 0
    made = build_paired.augmented_labels(images, polygons.where("class_id = 2"), 640)
    again = build_paired.augmented_labels(images, polygons.where("class_id = 2"), 640)
    assert sorted(map(str, made.collect())) == sorted(map(str, again.collect())) and made.count() == 3


def test_dataset_audit(spark, tmp_path):
    for name, stems in (("paired", ["isic_1_v1", "isic_1_v7"]), ("augmented", ["isic_1_v1", "isic_1_v7_aug0"])):
        for split in files.SPLITS:
            for kind in ("images", "labels"):
                (tmp_path / name / kind / split).mkdir(parents=True)
        for stem in stems:
            (tmp_path / name / "images/train" / f"{stem}.jpg").write_bytes(b"no image")
            (tmp_path / name / "labels/train" / f"{stem}.txt").write_text("2 0 0 1 0 1 1\n")
    report = dataset_audit.audit_project(spark, {n: str(tmp_path / n) for n in ("paired", "augmented")})
    assert report["augmentation"] == {"attempts": 6, "saved": 1, "skipped": 5, "complete": False}
    assert report["class_polygons"] == {2: 4} and report["class_polygons_by_dataset"] == {"paired:2": 2, "augmented:2": 2}
    assert len(report["invalid_files"]) == 4 and report["datasets"]["paired"]["composition"]["train"]["v7"] == 1


def test_transfer(spark):
    s = spark.createDataFrame([("model.1.a", "3"), ("model.2.b", "4"), ("model.99.c", "1"), ("head", "1")], "key string, shape string")
    d = spark.createDataFrame([("model.2.a", "3"), ("model.3.b", "5"), ("model.7.z", "1")], "key string, shape string")
    got = {r.key: r.status for r in R.key_transfer(s, d, {1: 2, 2: 3}).collect()}
    assert got == {"model.2.a": "mapped", "model.3.b": "shape_mismatch", "model.7.z": "missing", "model.99.c": "unmapped", "head": "unmapped"}


def test_empty_label_files_are_errors_in_scoring(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    (tmp_path / "b.txt").write_text("1 0.1 0.1 0.5 0.1 0.5 0.5\n")
    (tmp_path / "notes.md").write_text("")
    (tmp_path / ".hidden.txt").write_text("")
    lines = labels.read_lines(spark, str(tmp_path))
    assert {r.stem for r in lines.collect()} == {"a", "b"}
    with pytest.raises(Exception, match="empty label file"):
        labels.first_polygon(lines, 640).collect()
    assert [r.stem for r in labels.parse(lines).collect()] == ["b"]  # strict readers see no line in it


def test_build_audit_and_augment(spark, tmp_path):
    """What the build writes passes its own audit, is augmented, and the originals pass through."""
    rnd = np.random.default_rng(5)
    lines = {"isic_1": "2 0.1 0.1 0.9 0.1 0.9 0.9 0.1 0.9", "isic_2": "5 0.2 0.2 0.8 0.2 0.5 0.7", "isic_3": "", "isic_4": "1 0.3 0.3 0.6 0.3 0.6 0.6", "isic_5": "0 0.1 0.2 0.5 0.2 0.3 0.6"}
    for stem, split in (("isic_1", "train"), ("isic_2", "train"), ("isic_3", "train"), ("isic_4", "val"), ("isic_5", "test")):
        png(tmp_path / "src/images" / split / f"{stem}.png", rnd.integers(30, 255, (44, 60, 3)))
        (tmp_path / "src/labels" / split).mkdir(parents=True, exist_ok=True)
        (tmp_path / "src/labels" / split / f"{stem}.txt").write_text(lines[stem])
    built = tmp_path / "built"
    assert build_paired.build(spark, str(tmp_path / "src"), str(built), side=96, eval_crops=True) == 10
    report = paired_audit.audit(spark, str(built), str(built / "metadata/transforms.jsonl"))
    assert report["reason_counts"] == {} and report["publication_gate_passed"]
    found = build_paired.augment(spark, str(built), str(tmp_path / "more"))
    assert found == {"passed": 10, "attempts": 12, "saved": 6, "skipped": 6}  # both views of isic_1; isic_3 has no polygon to draw
    for kind in ("images", "labels"):
        assert {p.name: p.read_bytes() for p in (built / kind).rglob("*.*")}.items() <= {p.name: p.read_bytes() for p in (tmp_path / "more" / kind).rglob("*.*")}.items()
    made = sorted(p.stem for p in (tmp_path / "more/images/train").glob("*_aug*"))
    assert made == sorted(f"isic_1_{v}_aug{k}" for v in ("v1", "v7") for k in range(3))
    assert files.decode_images(spark, str(tmp_path / "more/images"), strict=True).where("readable").count() == 16
    assert labels.read_strict(spark, str(tmp_path / "more/labels"), recursive=True).count() == 8 + 6
    again = build_paired.augment(spark, str(built), str(tmp_path / "again"))
    assert again == found
    assert {p.name: p.read_bytes() for p in (tmp_path / "again").rglob("*.png")} == {p.name: p.read_bytes() for p in (tmp_path / "more").rglob("*.png")}


def test_augmented_pixels_follow_their_points():
    image = np.zeros((90, 90, 3), np.uint8)
    image[40:51, 60:71] = 255
    for seed in range(40):
        draw = M.Augmentation(90, 90, seed)
        x, y = np.rint(draw.points([[65, 45]])[0]).astype(int)
        out = draw.image(image)
        assert out.shape == image.shape and out.dtype == np.uint8
        if 0 <= x < 90 and 0 <= y < 90:
            assert out[y, x].min() > 150
    assert len({M.Augmentation(90, 90, s).points([[1.0, 2.0]]).tobytes() for s in range(40)}) > 30


def test_inpainting_fills_from_the_edge():
    image = np.full((20, 30, 3), (10, 120, 200), np.uint8)
    mask = np.zeros((20, 30), bool)
    mask[8:12, 3:27] = True
    spoiled = image.copy()
    spoiled[mask] = 0
    assert (M.inpainted(spoiled, mask) == image).all()
    image[:, 15:] = 90
    assert (M.inpainted(image, np.ones((20, 30), bool)) == image).all()
    assert set(np.unique(M.inpainted(image, mask)[9, :5])) <= {10, 120, 200}


@pytest.mark.parametrize("names", ["names: [a, 'b c', d]  # three", "names: {0: a, 2: d, 1: \"b c\"}", "names:\n- a\n- b c\n- d", "names:\n  - a\n  - b c\n  - d", "names:\n  0: a\n  1: b c\n  2: d"])
def test_descriptions(tmp_path, names):
    for kind in ("images", "labels"):
        (tmp_path / "d" / kind / "test").mkdir(parents=True, exist_ok=True)
    (tmp_path / "d.yaml").write_text(f"# about\npath: d\n{names}\nnc: 3\n")
    got = files.dataset_config(str(tmp_path / "d.yaml"))
    assert got["names"] == ["a", "b c", "d"] and got["labels"].endswith("labels/test")


def test_numeric_domains_and_records(tmp_path):
    assert [sinks.positive_int(v) for v in (1, "7", " 3 ")] == [1, 7, 3] and sinks.natural_int("0") == 0
    for bad in (0, -1, "x", 1.5, True, None, "1.0", ""):
        with pytest.raises(ValueError, match="integer"):
            sinks.positive_int(bad)
    (tmp_path / "w").write_bytes(b"x")
    got = sinks.provenance(str(tmp_path / "w"), {}, {"batch": 4, "seed": 0, "device": None, "data": "d.yaml", "workers": 2, "save_dir": "s"}, {"v": "1"})
    assert (got["schema_version"], got["batch"], got["seed"], got["workers"], got["split"], got["imgsz"], got["effective_args_source"]) == (1, 4, 0, 2, "test", 640, "requested")
    assert sinks.provenance(str(tmp_path / "w"), {}, {"batch": 4}, {}, {"batch": 8})["effective_val_args"] == {"batch": 8}

"""The paired audit on miniature datasets: families of reason codes, exclusions, the gate."""

import json

import pytest
from annolith.plans import paired_audit as P
from dataset import CANVAS, TENT, WEDGE, area, black, instance, line, png, record, write


def audit(spark, root):
    return P.audit(spark, str(root), str(root / "metadata.jsonl"))


def pair(**v7):
    return [record("v1"), record("v7", **v7)]


def test_valid_dataset_passes(spark, tmp_path):
    report = audit(spark, write(tmp_path, pair()))
    assert report["reason_counts"] == {} and report["publication_gate_passed"]
    assert (report["candidate_pair_count"], report["avc_valid_pair_count"], report["avc_excluded_pair_count"]) == (1, 1, 0)
    assert report["max_roundtrip_error"] <= 1e-9


def test_files_and_lines(spark, tmp_path):
    root = write(tmp_path, [record("v1"), record("v1", "b"), record("v7", "b"), record("v1", "c", "val")], json.dumps(record("v1")) + "\n{bad\n[]\n" + json.dumps({"pair_id": "a", "split": "train"}) + "\n")
    (root / "images/train/b_v1.png").unlink()
    (root / "labels/train/b_v7.txt").unlink()
    (root / "labels/train/sub").mkdir()
    png(root / "images/train_v7_eval/a_V1.PNG", black())
    got = audit(spark, root)
    assert got["reason_counts"] == {"DUPLICATE_IMAGE_VIEW": 1, "DUPLICATE_VIEW": 1, "MALFORMED_JSON": 1, "MALFORMED_METADATA": 2, "MISSING_IMAGE": 1, "MISSING_LABEL": 1, "MISSING_VIEW": 1}
    assert got["excluded_pair_ids"]["MISSING_VIEW"] == ["a"] and got["excluded_pair_ids"]["MISSING_IMAGE"] == ["b"]
    assert not got["publication_gate_passed"] and got["duplicate_view_count"] == 2


def test_untrusted_files(spark, tmp_path):
    root = write(tmp_path, pair())
    (root / "metadata.jsonl").write_bytes(b"\xff\xfe{}\n")
    assert audit(spark, root)["reason_counts"] == {"MALFORMED_METADATA": 1, "MISSING_METADATA_RECORD": 2, "MISSING_VIEW": 2}
    (root / "metadata.jsonl").unlink()
    assert audit(spark, root)["reason_counts"]["MISSING_METADATA_FILE"] == 1


GONE = {"status": "dropped", "crop_intersection_polygon": [], "canvas_polygon": [], "crop_intersection_area": 0.0, "canvas_area": 0.0}


def first(pair, **changes):
    """The v7 view's instances, the first of them changed."""
    whole = instance("v7", pair)
    return {"instances": [whole | {k: v(whole) if callable(v) else v for k, v in changes.items()}, instance("v7", pair, 1)]}


def bent(polygon, at, x, y):
    return [[x, y] if i == at else p for i, p in enumerate(polygon)]


def turn(key):
    return lambda whole: whole[key][3:] + whole[key][:3]


#: What changes in the v7 record of a pair, and the reasons that exclude the pair for it.
EDITS = {
    "ring_turned": (lambda p: first(p, crop_intersection_polygon=turn("crop_intersection_polygon"), canvas_polygon=turn("canvas_polygon")), set()),
    "crop_moved": (lambda p: first(p, crop_intersection_polygon=bent(TENT, 1, 13.0, 3.5), crop_intersection_area=area(bent(TENT, 1, 13.0, 3.5))), {"SOURCE_CROP_GEOMETRY_MISMATCH", "METADATA_TRANSFORM_MISMATCH", "ROUNDTRIP_ERROR"}),
    "beyond_canvas": (lambda p: first(p, canvas_polygon=lambda w: bent(w["canvas_polygon"], 2, 19.5, 7.0)), {"OUT_OF_CANVAS_POLYGON"}),
    "wrong_area": (lambda p: first(p, source_area=1.25), {"METADATA_POLYGON_AREA_MISMATCH"}),
    "class": (lambda p: first(p, class_id=5), {"CLASS_MISMATCH", "LABEL_METADATA_MISMATCH"}),
    "counts": (lambda p: {"input_instance_count": 3, "output_instance_count": 0}, {"INSTANCE_COUNT_MISMATCH"}),
    "false_drop": (lambda p: first(p, reason=P.OUTSIDE, **GONE) | {"output_instance_count": 1, "dropped_instance_reasons": {P.OUTSIDE: 1}}, {"INVALID_DROPPED_INSTANCE"}),
    "drop_reasons": (lambda p: {"dropped_instance_reasons": {"OTHER": 2}}, {"DROPPED_REASON_MISMATCH"}),
    "bool_count": (lambda p: {"input_instance_count": True}, {"MALFORMED_METADATA"}),
    "null_instances": (lambda p: {"instances": None}, {"MALFORMED_METADATA"}),
    "overflow": (lambda p: {"transform": record("v7")["transform"] | {"crop_box": [1e308, 2, 1e308, 8]}}, {"MALFORMED_METADATA"}),
    "huge_canvas": (lambda p: {"transform": record("v7")["transform"] | {"canvas_width": 9000, "canvas_height": 8500}}, {"CANVAS_DIMENSION_LIMIT"}),
    "source_differs": (lambda p: {"source": "elsewhere.jpg", "preprocessing_version": "made-4"}, {"SOURCE_IDENTITY_MISMATCH", "PREPROCESSING_VERSION_MISMATCH"}),
    "polygon_differs": (lambda p: first(p, source_polygon=TENT[::-1]), {"SOURCE_POLYGON_MISMATCH"}),
    "id": (lambda p: first(p, instance_id=f"{p}:7"), {"INSTANCE_MISMATCH"}),
    "empty_polygon": (lambda p: first(p, canvas_polygon=[], canvas_area=0), {"INVALID_POLYGON", "ZERO_AREA_POLYGON"}),
}


@pytest.fixture(scope="module")
def edited(spark, tmp_path_factory):
    """All edits as pairs of one dataset, audited once.  Images and labels are those of unedited records, but for what is dropped or turned."""
    root, records = tmp_path_factory.mktemp("edited"), []
    for name, (change, _) in EDITS.items():
        for view, own in (("v1", {}), ("v7", change(name))):
            records.append(record(view, name) | own)
            png(root / "images/train" / f"{name}_{view}.png", black())
            kept = [i for i, item in enumerate(records[-1]["instances"] or []) if item["status"] == "kept"]
            shown = records[-1] if name == "ring_turned" else record(view, name)
            label = root / "labels/train" / f"{name}_{view}.txt"
            label.parent.mkdir(parents=True, exist_ok=True)
            label.write_text("\n".join(line(shown["instances"][i]) for i in kept))
    (root / "metadata.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))
    return audit(spark, root)


@pytest.mark.parametrize("name", EDITS)
def test_edits(edited, name):
    mine = {reason for reason, ids in edited["excluded_pair_ids"].items() if name in ids}
    want = EDITS[name][1]
    assert want <= mine and (want or not mine)
    assert not edited["publication_gate_passed"]


def test_counts_of_edits(edited):
    assert edited["reason_counts"]["MALFORMED_METADATA"] == 3
    assert edited["reason_counts"]["INSTANCE_COUNT_MISMATCH"] >= 2
    assert edited["candidate_pair_count"] == len(EDITS)


def test_legitimate_drops_exclude_but_pass(spark, tmp_path):
    """Left and above of the crop, and meeting it in its corner only."""
    outside, corner = (2, [[0.5, 0.5], [2.5, 0.5], [1.5, 1.5]], []), (3, [[1.0, 0.0], [4.0, 0.0], [4.0, 2.0], [1.0, 2.0]], [])
    shapes = [(outside, P.OUTSIDE), (corner, P.DEGENERATE)]
    v1 = record("v1", instances=[instance("v1", index=i, shape=s) for i, (s, _) in enumerate(shapes)])
    v7 = record("v7", instances=[instance("v1", index=i, shape=s, reason=why, **GONE) for i, (s, why) in enumerate(shapes)], output_instance_count=0, dropped_instance_reasons={P.OUTSIDE: 1, P.DEGENERATE: 1})
    got = audit(spark, write(tmp_path, [v1, v7]))
    assert got["reason_counts"] == {P.DEGENERATE: 1, P.OUTSIDE: 1}
    assert got["publication_gate_passed"] and got["avc_valid_pair_count"] == 0


def test_labels_and_images(spark, tmp_path):
    root = write(tmp_path, [record(view, p) for p in "abcd" for view in ("v1", "v7")])
    (root / "labels/train/a_v1.txt").write_text("4 0 0 0 0 0 0\n1 0.1 0.1 0.1 0.1 0.1 0.1\n")
    (root / "labels/train/b_v1.txt").write_text("9 0 0 1 0 1 1\n")
    (root / "images/train/c_v1.png").write_bytes(b"no image")
    png(root / "images/train/d_v1.png", black(CANVAS[::-1]))
    got = audit(spark, root)
    assert got["reason_counts"] == {"CORRUPT_IMAGE": 1, "IMAGE_DIMENSION_MISMATCH": 1, "INVALID_LABEL": 1, "ZERO_AREA_LABEL_POLYGON": 2}
    assert got["zero_area_polygon_count"] == 2 and got["label_correspondence_error_count"] == 3


def test_cut_instances_are_cut_alike():
    assert area(WEDGE) == 12 and area(instance("v7", index=1)["crop_intersection_polygon"]) == pytest.approx(12 - 2 * 4 / 3 / 2)


@pytest.mark.parametrize("stride", [0, -1, True, 1.5])
def test_bad_stride(spark, tmp_path, stride):
    with pytest.raises(ValueError, match="stride"):
        P.audit(spark, str(tmp_path), "x", stride)

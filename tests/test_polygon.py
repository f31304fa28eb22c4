"""Polygon kernel and expressions: known cases and properties."""

import math

import numpy as np
import pytest
from annolith.functions import geometry as G
from annolith.functions import polygon as K
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]
U_SHAPE = [(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)]


@pytest.mark.parametrize(
    ("points", "rect", "expected"),
    [
        ([(4, 1), (9, 2), (7, 5), (5, 4)], (3, 0, 10, 6), [(4, 1), (9, 2), (7, 5), (5, 4)]),
        ([(0, 7), (2, 9), (1, 12)], (3, 0, 10, 6), []),
        ([(6, -20), (40, 3), (6, 26), (-28, 3)], (5, 2, 7, 4), [(5, 2), (7, 2), (7, 4), (5, 4)]),
        ([(1, 3), (5, 1), (5, 5)], (3, 0, 10, 6), [(3, 2), (5, 1), (5, 5), (3, 4)]),
        ([(0, 0), (1, 1)], (0, 0, 2, 2), []),
        ([(0, 0), (1, 1), (2, 2)], (0, 0, 2, 2), []),
        (U_SHAPE, (0, 2, 3, 3), []),
        ([(0, 0), (5, 5), (0, 10)], (2, 0, 10, 10), [(2, 2), (5, 5), (2, 8)]),
    ],
)
def test_clip(points, rect, expected):
    got = K.clip(K.as_points(points), rect)
    assert K.same_ring(got, K.as_points(expected), 1e-9)


@pytest.mark.parametrize("rect", [(0, 0, 0, 1), (1, 0, 0, 1), (0, 0, math.nan, 1), (0, 0, math.inf, 1)])
def test_bad_rectangles(rect):
    with pytest.raises(ValueError, match="rectangle"):
        K.clip(K.as_points(SQUARE), rect)


def test_dedup_and_area():
    assert len(K.dedup(K.as_points([*SQUARE[:2], SQUARE[1], *SQUARE[2:], SQUARE[0]]))) == 4
    assert K.area(K.as_points(SQUARE)) == K.area(K.as_points(SQUARE[::-1])) == 1
    assert K.area(K.as_points(SQUARE[:2])) == 0


@pytest.mark.parametrize(("points", "rect", "touch"), [([(0, 0), (4, 0), (0, 4)], (3, 3, 4, 4), False), ([(0, 0), (4, 0), (0, 4)], (2, 2, 3, 3), True), (SQUARE, (0.2, 0.2, 0.3, 0.3), True), (SQUARE, (-1, 0.4, 2, 0.6), True), (SQUARE[:2], (0, 0, 1, 1), False)])
def test_contact(points, rect, touch):
    assert K.touches_rect(K.as_points(points), rect) is touch


coordinate = st.floats(-10, 10).map(lambda v: round(v, 3))
polygons = st.lists(st.tuples(coordinate, coordinate), min_size=3, max_size=8).map(K.as_points)


@settings(max_examples=150, deadline=None)
@given(polygons, st.tuples(coordinate, coordinate), st.floats(0.1, 8), st.floats(0.1, 8))
def test_clip_stays_within(p, corner, w, h):
    rect = (*corner, corner[0] + w, corner[1] + h)
    got = K.clip(p, rect)
    if len(got):
        assert (got >= np.array(rect[:2]) - 1e-9).all() and (got <= np.array(rect[2:]) + 1e-9).all()
        assert K.area(got) <= w * h + 1e-6
        assert K.touches_rect(p, rect)


@settings(max_examples=100, deadline=None)
@given(polygons, st.integers(0, 7))
def test_area_and_ring_ignore_start_and_direction(p, k):
    q = np.roll(p, k, axis=0)[::-1]
    assert K.area(p) == pytest.approx(K.area(q), abs=1e-9)
    assert K.same_ring(p, q, 1e-9)


def test_expressions_match_the_kernel(spark):
    rnd = np.random.default_rng(1)
    shapes = [rnd.uniform(-1, 1, (rnd.integers(0, 9), 2)).round(3) for _ in range(40)] + [K.as_points(SQUARE * 2), K.as_points([(0, 0)] * 3)]
    rows = [(i, [{"x": float(x), "y": float(y)} for x, y in s]) for i, s in enumerate(shapes)]
    df = spark.createDataFrame(rows, f"id int, p {G.POINTS}")
    got = df.select(
        "id", F.expr(G.area("p")).alias("area"), F.expr(G.dedup("p")).alias("dedup"), F.expr(G.half_plane("p", "y", "0.1D", False)).alias("half"), F.expr(G.contains("p", "0.1D", "0.2D")).alias("inside"),
        F.expr(G.same_ring("p", "reverse(p)", "1e-9D")).alias("ring"), G.clip_to_rect(F.col("p"), F.expr("array(-0.5D, -0.5D, 0.5D, 0.5D)")).alias("clip"), G.touches_rect(F.col("p"), F.expr("array(-0.5D, -0.5D, 0.5D, 0.5D)")).alias("touch"),
    ).collect()
    flat = lambda ps: np.array([(v.x, v.y) for v in ps]).reshape(-1, 2)
    for r in got:
        s = shapes[r.id]
        assert r.area == pytest.approx(K.area(s), abs=1e-12)
        assert np.allclose(flat(r.dedup), K.dedup(s)) and np.allclose(flat(r.half), K.half_plane(s, 1, 0.1, False))
        assert r.inside == (bool(K.contains(s, np.array([(0.1, 0.2)]))[0]) if len(s) else False)
        assert r.ring and np.allclose(flat(r.clip), K.clip(s, (-0.5, -0.5, 0.5, 0.5))) and r.touch == K.touches_rect(s, (-0.5, -0.5, 0.5, 0.5))


T = dict(schema_version=1, source_width=1600.0, source_height=1200.0, crop_box=[200.0, 100.0, 800.0, 600.0], scale=0.5, resized_width=400, resized_height=300, pad_x=10.0, pad_y=20.0, canvas_width=420.0, canvas_height=340.0)
T_TYPE = "struct<schema_version:int,source_width:double,source_height:double,crop_box:array<double>,scale:double,resized_width:int,resized_height:int,pad_x:double,pad_y:double,canvas_width:double,canvas_height:double>"


def test_view_transforms(spark):
    bad = [{"source_width": 0.0}, {"source_width": math.nan}, {"scale": -1.0}, {"crop_box": [900.0, 0.0, 800.0, 600.0]}, {"crop_box": [0.0, 0.0, 0.0, 600.0]}, {"pad_x": -1.0}, {"resized_width": 401}, {"canvas_width": 300.0}, {"schema_version": 2}, {"crop_box": [0.0] * 3}, {"canvas_height": math.inf}]
    rows = [(i, T | b) for i, b in enumerate([{}, *bad])]
    df = spark.createDataFrame(rows, f"id int, t {T_TYPE}").withColumn("p", F.expr("array(named_struct('x', 200D, 'y', 100D), named_struct('x', 1000D, 'y', 700D))"))
    got = df.select("id", F.expr(G.transform_valid("t")).alias("ok")).orderBy("id").collect()
    assert [r.ok for r in got] == [True] + [False] * len(bad)
    one = df.where("id = 0").withColumn("q", F.expr(G.source_to_canvas("p", "t"))).withColumn("r", F.expr(G.canvas_to_source("q", "t"))).first()
    assert [(v.x, v.y) for v in one.q] == [(10, 20), (410, 320)] and [(v.x, v.y) for v in one.r] == [(200, 100), (1000, 700)]
    made = spark.range(1).select(F.expr(G.make_transform("1000", "333", "array(0D, 0D, 1000D, 333D)", 640)).alias("t")).select("t", F.expr(G.transform_valid("t")).alias("ok")).first()
    assert made.ok and (made.t.resized_width, made.t.resized_height, made.t.pad_y) == (640, 213, 213)


def test_label_line(spark):
    df = spark.createDataFrame([(2, [{"x": 0.0, "y": 3.0}, {"x": 7.0, "y": 12.0}, {"x": 0.0, "y": -1.0}])], f"c int, p {G.POINTS}")
    assert df.select(G.label_line("c", "p", F.lit(10.0), F.lit(10.0)).alias("t")).first().t == "2 0.000000 0.300000 0.700000 1.000000 0.000000 0.000000"

"""Geometry on vertex columns, ``ARRAY<STRUCT<x, y>>``, as higher-order functions; clipping as an Arrow UDF.

All take SQL text of a column or expression and give an expression, so that they nest.
Null in, null out; a polygon of fewer than three vertices has no area.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from annolith.functions import polygon as K
from annolith.functions.udf import arrow_udf

POINTS = "array<struct<x:double,y:double>>"
EPS = "1e-9D"


def _indices(p: str) -> str:
    """0 .. n - 1; none for an empty array (a sequence down to -1 otherwise)."""
    return f"if(size({p}) > 0, sequence(0, size({p}) - 1), cast(array() as array<int>))"


def from_floats(a: str) -> str:
    """x0, y0, x1, y1, ... as vertices."""
    return f"transform(if(size({a}) > 1, sequence(0, size({a}) div 2 - 1), cast(array() as array<int>)), i -> named_struct('x', cast({a}[2 * i] as double), 'y', cast({a}[2 * i + 1] as double)))"


def area(p: str) -> str:
    """Unsigned shoelace area."""
    return (
        f"if(size({p}) < 3, 0D, abs(aggregate({_indices(p)}, 0D, (s, i) -> s + {p}[i].x * {p}[(i + 1) % size({p})].y - {p}[(i + 1) % size({p})].x * {p}[i].y)) / 2)"
    )


def bbox(p: str) -> str:
    """Axis-aligned box: x, y, w, h."""
    x, y = f"transform({p}, v -> v.x)", f"transform({p}, v -> v.y)"
    return f"named_struct('x', array_min({x}), 'y', array_min({y}), 'w', array_max({x}) - array_min({x}), 'h', array_max({y}) - array_min({y}))"


def dedup(p: str) -> str:
    """Without vertices near the one kept last, nor a closing vertex."""
    near = lambda a, b: f"(abs({a}.x - {b}.x) <= {EPS} and abs({a}.y - {b}.y) <= {EPS})"
    kept = f"aggregate({p}, cast(array() as {POINTS}), (s, v) -> if(size(s) > 0 and {near('element_at(s, -1)', 'v')}, s, array_append(s, v)))"
    return f"aggregate(array(0), {kept}, (s, z) -> if(size(s) > 1 and {near('s[0]', 'element_at(s, -1)')}, slice(s, 1, size(s) - 1), s))"


def half_plane(p: str, axis: str, bound: str, upper: bool) -> str:
    """What lies on one side of a line; a crossing's coordinate is the bound exactly."""
    other = "y" if axis == "x" else "x"
    inside = lambda v: f"({v}.{axis} {'>=' if upper else '<='} {bound})"
    before, here = f"{p}[(i + size({p}) - 1) % size({p})]", f"{p}[i]"
    step = f"({here}.{axis} - {before}.{axis})"
    cross = f"if({step} = 0D, {before}.{other}, {before}.{other} + ({bound} - {before}.{axis}) / {step} * ({here}.{other} - {before}.{other}))"
    point = f"named_struct('x', {f'cast({bound} as double)' if axis == 'x' else cross}, 'y', {f'cast({bound} as double)' if axis == 'y' else cross})"
    none = f"cast(array() as {POINTS})"
    return f"flatten(transform({_indices(p)}, i -> concat(if({inside(here)} <> {inside(before)}, array({point}), {none}), if({inside(here)}, array({here}), {none}))))"


def contains(p: str, x: str, y: str) -> str:
    """Whether a point lies in or on a polygon."""
    a, b = f"{p}[(i + size({p}) - 1) % size({p})]", f"{p}[i]"
    turn = f"(({b}.x - {a}.x) * ({y} - {a}.y) - ({b}.y - {a}.y) * ({x} - {a}.x))"
    on = f"(abs({turn}) <= {EPS} and {x} between least({a}.x, {b}.x) - {EPS} and greatest({a}.x, {b}.x) + {EPS} and {y} between least({a}.y, {b}.y) - {EPS} and greatest({a}.y, {b}.y) + {EPS})"
    spans = f"(({b}.y > {y}) <> ({a}.y > {y}) and {x} < ({a}.x - {b}.x) * ({y} - {b}.y) / nullif({a}.y - {b}.y, 0D) + {b}.x)"
    return f"(size({p}) > 0 and (exists({_indices(p)}, i -> {on}) or aggregate({_indices(p)}, 0, (s, i) -> s + if({spans}, 1, 0)) % 2 = 1))"


def affine(p: str, sx: str, sy: str, dx: str, dy: str) -> str:
    return f"transform({p}, v -> named_struct('x', v.x * {sx} + {dx}, 'y', v.y * {sy} + {dy}))"


def source_to_canvas(p: str, t: str) -> str:
    """Through a view transform (struct column): effective scales, resized over cropped size."""
    x = f"(v.x - {t}.crop_box[0]) * ({t}.resized_width / {t}.crop_box[2]) + {t}.pad_x"
    y = f"(v.y - {t}.crop_box[1]) * ({t}.resized_height / {t}.crop_box[3]) + {t}.pad_y"
    return f"transform({p}, v -> named_struct('x', {x}, 'y', {y}))"


def canvas_to_source(p: str, t: str) -> str:
    x = f"(v.x - {t}.pad_x) / ({t}.resized_width / {t}.crop_box[2]) + {t}.crop_box[0]"
    y = f"(v.y - {t}.pad_y) / ({t}.resized_height / {t}.crop_box[3]) + {t}.crop_box[1]"
    return f"transform({p}, v -> named_struct('x', {x}, 'y', {y}))"


def transform_valid(t: str) -> str:
    """The invariants of a view transform as one condition."""
    numbers = [f"{t}.{n}" for n in ("source_width", "source_height", "scale", "pad_x", "pad_y", "canvas_width", "canvas_height")] + [f"get({t}.crop_box, {i})" for i in range(4)]
    finite = " and ".join(f"(not isnan({n}) and abs({n}) < double('infinity'))" for n in numbers)
    inside = f"get({t}.crop_box, 0) + get({t}.crop_box, 2) <= {t}.source_width and get({t}.crop_box, 1) + get({t}.crop_box, 3) <= {t}.source_height"
    sized = " and ".join(f"{t}.resized_{n} >= 1 and {t}.resized_{n} = greatest(1, cast(get({t}.crop_box, {i}) * {t}.scale as int))" for n, i in (("width", 2), ("height", 3)))
    fits = f"{t}.resized_width + {t}.pad_x <= {t}.canvas_width and {t}.resized_height + {t}.pad_y <= {t}.canvas_height"
    signs = f"{t}.source_width > 0 and {t}.source_height > 0 and {t}.scale > 0 and get({t}.crop_box, 2) > 0 and get({t}.crop_box, 3) > 0 and get({t}.crop_box, 0) >= 0 and get({t}.crop_box, 1) >= 0 and {t}.pad_x >= 0 and {t}.pad_y >= 0 and {t}.canvas_width > 0 and {t}.canvas_height > 0"
    return f"coalesce({t}.schema_version = 1 and size({t}.crop_box) = 4 and {finite} and {signs} and {inside} and {sized} and {fits}, false)"


def letterbox(w: str, h: str, side: int) -> str:
    """Scale, resized size and paddings that fit w x h into a square."""
    scale = f"least({side} / cast({w} as double), {side} / cast({h} as double))"
    nw, nh = f"greatest(1, cast({w} * {scale} as int))", f"greatest(1, cast({h} * {scale} as int))"
    return f"named_struct('scale', {scale}, 'resized_width', {nw}, 'resized_height', {nh}, 'pad_x', ({side} - {nw}) div 2, 'pad_y', ({side} - {nh}) div 2)"


def make_transform(w: str, h: str, crop: str, side: int) -> str:
    """A view transform of a crop (array x, y, w, h) letterboxed into a square."""
    b = letterbox(f"{crop}[2]", f"{crop}[3]", side)
    return (
        f"aggregate(array(0), {b}, (s, z) -> s, s -> named_struct('schema_version', 1, 'source_width', cast({w} as double), 'source_height', cast({h} as double), 'crop_box', {crop}, 'scale', s.scale, "
        f"'resized_width', s.resized_width, 'resized_height', s.resized_height, 'pad_x', cast(s.pad_x as double), 'pad_y', cast(s.pad_y as double), 'canvas_width', {float(side)}D, 'canvas_height', {float(side)}D))"
    )


def same_points(a: str, b: str, tolerance: str) -> str:
    return f"(size({a}) = size({b}) and forall(zip_with({a}, {b}, (u, v) -> sqrt(pow(u.x - v.x, 2) + pow(u.y - v.y, 2)) <= {tolerance}), t -> t))"


def same_ring(a: str, b: str, tolerance: str) -> str:
    """Equal up to the first vertex and the direction."""
    near = lambda at: f"sqrt(pow({a}[i].x - {b}[{at}].x, 2) + pow({a}[i].y - {b}[{at}].y, 2)) <= {tolerance}"
    ahead, back = near(f"(i + k) % size({b})"), near(f"(k - i + size({b})) % size({b})")
    # a first vertex that differs ends a comparison, so most of them take one step
    return f"(size({a}) = size({b}) and (size({a}) = 0 or exists({_indices(b)}, k -> forall({_indices(b)}, i -> {ahead}) or forall({_indices(b)}, i -> {back}))))"


def box_iou(a: str, b: str) -> str:
    """IoU of two x, y, w, h structs; 0 if the union is empty."""
    inter = f"greatest(0D, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0D, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"if({a}.w * {a}.h + {b}.w * {b}.h - {inter} <= 0, 0D, {inter} / ({a}.w * {a}.h + {b}.w * {b}.h - {inter}))"


def _points_of(value) -> K.Points:
    return K.as_points([(v["x"], v["y"]) for v in value])


@arrow_udf(POINTS)
def clip_to_rect(polygons: pd.Series, rects: pd.Series) -> pd.Series:
    """The part of a polygon in a rectangle (array x_min, y_min, x_max, y_max)."""
    out = [None if p is None or r is None else [{"x": x, "y": y} for x, y in K.clip(_points_of(p), r).tolist()] for p, r in zip(polygons, rects, strict=True)]
    return pd.Series(out, dtype=object)


@arrow_udf(POINTS)
def cut_to_rect(polygons: pd.Series, rects: pd.Series) -> pd.Series:
    """What four half planes leave of a polygon, where ``clip_to_rect`` gives nothing unless that is one simple polygon."""
    out = [None if p is None or r is None else [{"x": x, "y": y} for x, y in K.cut(_points_of(p), r).tolist()] for p, r in zip(polygons, rects, strict=True)]
    return pd.Series(out, dtype=object)


@arrow_udf("boolean")
def touches_rect(polygons: pd.Series, rects: pd.Series) -> pd.Series:
    """Whether a polygon and a rectangle have a point in common."""
    return pd.Series([None if p is None or r is None else K.touches_rect(_points_of(p), r) for p, r in zip(polygons, rects, strict=True)], dtype=object)


@arrow_udf("boolean")
def crosses_itself(polygons: pd.Series) -> pd.Series:
    """Whether two edges without a common vertex meet."""
    return pd.Series([None if p is None else K.crosses_itself(_points_of(p)) for p in polygons], dtype=object)


@arrow_udf("string")
def label_line(classes: pd.Series, polygons: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """A label line: class, then coordinates over the canvas size, clipped to [0, 1], with six decimals (rounded as binary values)."""
    out = []
    for c, p, w, h in zip(classes, polygons, width, height, strict=True):
        if p is None:
            out.append(None)
            continue
        flat = [min(1.0, max(0.0, z)) for v in p for z in (v["x"] / w, v["y"] / h)]
        out.append(" ".join([str(int(c)), *(f"{z:.6f}" for z in flat)]))
    return pd.Series(out, dtype=object)


def expr(sql: str) -> Column:
    return F.expr(sql)

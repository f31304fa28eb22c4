"""Polygon kernel on NumPy vertex arrays (n, 2): what higher-order functions can't express well.

A polygon is implicitly closed.  Two vertices are the same within ``EPS`` per axis.
"""

from __future__ import annotations

import math

import numpy as np

EPS = 1e-9
Points = np.ndarray


def as_points(values) -> Points:
    return np.asarray([tuple(map(float, v)) for v in values], dtype=np.float64).reshape(-1, 2)


def check_rect(rect) -> tuple[float, float, float, float]:
    x0, y0, x1, y1 = map(float, rect)
    if not all(map(math.isfinite, (x0, y0, x1, y1))) or x0 >= x1 or y0 >= y1:
        raise ValueError("a rectangle needs finite bounds with x_min < x_max and y_min < y_max")
    return x0, y0, x1, y1


def _near(a, b) -> np.ndarray:
    return (np.abs(np.asarray(a) - np.asarray(b)) <= EPS).all(axis=-1)


def dedup(p: Points) -> Points:
    """Without vertices that repeat the one kept last, nor a closing vertex."""
    kept: list[int] = []
    for i in range(len(p)):
        if not kept or not _near(p[kept[-1]], p[i]):
            kept.append(i)
    if len(kept) > 1 and _near(p[kept[0]], p[kept[-1]]):
        kept.pop()
    return p[kept]


def area(p: Points) -> float:
    if len(p) < 3:
        return 0.0
    q = np.roll(p, -1, axis=0)
    total = 0.0
    for term in p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]:
        total += float(term)
    return abs(total) / 2.0


def turn(a: Points, b: Points, c: Points) -> np.ndarray:
    """Twice the signed area of triangles a, b, c."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _within(a: Points, b: Points, c: Points) -> np.ndarray:
    """Whether c lies in the (slightly enlarged) bounding box of a and b."""
    return ((np.minimum(a, b) - EPS <= c) & (c <= np.maximum(a, b) + EPS)).all(axis=-1)


def segments_meet(a: Points, b: Points, c: Points, d: Points) -> np.ndarray:
    """Whether segments ab and cd cross, touch or overlap; arrays broadcast."""
    t = [turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)]
    ends = [(a, b, c), (a, b, d), (c, d, a), (c, d, b)]
    touch = np.zeros(np.broadcast_shapes(*(x.shape for x in t)), bool)
    for value, (p, q, r) in zip(t, ends, strict=True):
        touch |= (np.abs(value) <= EPS) & _within(p, q, r)
    return touch | (((t[0] > EPS) != (t[1] > EPS)) & ((t[2] > EPS) != (t[3] > EPS)))


def contains(p: Points, points: Points) -> np.ndarray:
    """Whether points lie in or on the polygon (even-odd)."""
    a, b, c = np.roll(p, 1, axis=0)[None], p[None], points[:, None]
    on = ((np.abs(turn(a, b, c)) <= EPS) & _within(a, b, c)).any(axis=1)
    spans = (b[..., 1] > c[..., 1]) != (a[..., 1] > c[..., 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (a[..., 0] - b[..., 0]) * (c[..., 1] - b[..., 1]) / (a[..., 1] - b[..., 1]) + b[..., 0]
    return on | ((spans & (c[..., 0] < cross)).sum(axis=1) % 2 == 1)


def repeats_vertex(p: Points) -> bool:
    i, j = np.triu_indices(len(p), 1)
    return bool(_near(p[i], p[j]).any())


def crosses_itself(p: Points) -> bool:
    """Whether two edges without a common vertex meet."""
    n = len(p)
    i, j = np.triu_indices(n, 2)
    apart = (j + 1) % n != i
    i, j = i[apart], j[apart]
    return bool(segments_meet(p[i], p[(i + 1) % n], p[j], p[(j + 1) % n]).any())


def bridges(result: Points, source: Points, rect) -> bool:
    """Whether an edge of the result runs along the rectangle where the source isn't."""
    x0, y0, x1, y1 = rect
    q = np.roll(result, -1, axis=0)
    along = np.zeros(len(result), bool)
    for axis, bound in ((0, x0), (0, x1), (1, y0), (1, y1)):
        along |= (np.abs(result[:, axis] - bound) <= EPS) & (np.abs(q[:, axis] - bound) <= EPS)
    middle = ((result + q) / 2.0)[along]
    return bool(len(middle)) and not contains(source, middle).all()


def half_plane(p: Points, axis: int, bound: float, upper: bool) -> Points:
    """What of a polygon lies on one side of an axis-parallel line; crossings lie exactly on it."""
    if not len(p):
        return p
    inside = p[:, axis] >= bound if upper else p[:, axis] <= bound
    before, crosses = np.roll(p, 1, axis=0), inside != np.roll(inside, 1)
    step = np.where(crosses, p[:, axis] - before[:, axis], 1.0)
    cut = before + ((bound - before[:, axis]) / step)[:, None] * (p - before)
    cut[:, axis] = bound
    return np.stack([cut, p], axis=1)[np.stack([crosses, inside], axis=1)]


def cut(p: Points, rect) -> Points:
    """A polygon cut by a rectangle's four half planes, whatever is left of it: nothing is judged, and no vertex left out."""
    x0, y0, x1, y1 = check_rect(rect)
    for axis, bound, upper in ((0, x0, True), (0, x1, False), (1, y0, True), (1, y1, False)):
        p = half_plane(p, axis, bound, upper)
    return p


def clip(p: Points, rect) -> Points:
    """The part of a polygon in a rectangle; empty if that isn't one simple polygon of its own edges."""
    rect = check_rect(rect)
    source = result = dedup(p)
    for axis, bound, upper in ((0, rect[0], True), (0, rect[2], False), (1, rect[1], True), (1, rect[3], False)):
        if len(result) < 3:
            break
        result = dedup(half_plane(result, axis, bound, upper))
    bad = len(result) < 3 or area(result) <= EPS or repeats_vertex(result) or crosses_itself(result) or bridges(result, source, rect)
    return result[:0] if bad else result


def touches_rect(p: Points, rect) -> bool:
    """Whether a polygon and a rectangle have any point in common."""
    x0, y0, x1, y1 = check_rect(rect)
    p = dedup(p)
    if len(p) < 3:
        return False
    if ((p >= (x0, y0)) & (p <= (x1, y1))).all(axis=1).any():
        return True
    corners = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
    if contains(p, corners).any():
        return True
    return bool(segments_meet(p[:, None], np.roll(p, -1, axis=0)[:, None], corners[None], np.roll(corners, -1, axis=0)[None]).any())


def same_points(a: Points, b: Points, tolerance: float) -> bool:
    return len(a) == len(b) and bool((np.hypot(*(a - b).T) <= tolerance).all()) if len(a) else len(b) == 0


def same_ring(a: Points, b: Points, tolerance: float) -> bool:
    """Equal up to the first vertex and the direction."""
    if len(a) != len(b):
        return False
    return not len(a) or any(same_points(a, np.roll(ring, -k, axis=0), tolerance) for ring in (b, b[::-1]) for k in range(len(b)))

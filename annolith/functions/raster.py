"""Raster kernels in NumPy (masks are boolean (height, width) arrays), and their Arrow UDFs.

Filling is boundary-inclusive on integer vertices; parity with native libraries is pinned by a few
known cases only.  Inpainting goes inward from the mask's edge by distance-weighted means, and augmentation draws from a seed: neither gives
a native library's very pixels.
"""

from __future__ import annotations

import json
import math
import struct
import zlib

import numpy as np
import pandas as pd
from annolith.functions.udf import arrow_udf


def fill(vertices: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels inside (even-odd) or on the edges of a polygon of integer vertices within the grid."""
    mask = np.zeros((height, width), bool)
    v = np.asarray(vertices, np.int64).reshape(-1, 2)
    if not len(v):
        return mask
    a, b = v, np.roll(v, -1, axis=0)
    n = np.maximum(np.abs(b - a).max(axis=1), 1)
    edge = np.repeat(np.arange(len(v)), n + 1)
    t = (np.arange(len(edge)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1))[:, None]
    drawn = np.floor(a[edge] + (b - a)[edge] * t / n[edge, None] + 0.5).astype(int)
    mask[drawn[:, 1], drawn[:, 0]] = True
    low, high = max(0, v[:, 1].min()), min(height - 1, v[:, 1].max())
    rise = np.where(a[:, 1] == b[:, 1], 1, b[:, 1] - a[:, 1])
    xs = np.arange(width)
    rows = max(1, (1 << 22) // (len(v) * max(1, width)))  # rows at a time
    for first in range(low, high + 1, rows):
        y = np.arange(first, min(high + 1, first + rows))[:, None]
        spans = (a[:, 1] <= y) != (b[:, 1] <= y)
        cross = np.where(spans, a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / rise, np.inf)
        mask[y[:, 0]] |= (cross[:, :, None] <= xs).sum(axis=1) % 2 == 1
    return mask


def polygon_mask(flat, side: int) -> np.ndarray:
    """Pixel coordinates x0, y0, ... rounded half to even and clamped to a square, filled."""
    if flat is None or not len(flat):
        return np.zeros((side, side), bool)
    p = np.clip(np.rint(np.asarray(flat, np.float64).reshape(-1, 2)), 0, side - 1)
    return fill(p, side, side)


def pooled_mask(points, width: int, height: int, stride: int = 4) -> np.ndarray:
    """A normalised polygon filled on its canvas, then max-pooled to ceil(size / stride)."""
    if isinstance(stride, bool) or not isinstance(stride, int) or stride <= 0:
        raise ValueError("stride must be a positive integer")
    if width <= 0 or height <= 0:
        raise ValueError("canvas must be positive")
    p = np.asarray(points, np.float64).reshape(-1, 2) * (width, height)
    p = np.clip(np.rint(p), 0, (width - 1, height - 1))
    mask = fill(p, height, width) if len(p) >= 3 else np.zeros((height, width), bool)
    rows, cols = math.ceil(height / stride), math.ceil(width / stride)
    # adaptive windows: floor(i * n / m) up to ceil((i + 1) * n / m)
    rows_of = [(i * height // rows, -(-(i + 1) * height // rows)) for i in range(rows)]
    cols_of = [(i * width // cols, -(-(i + 1) * width // cols)) for i in range(cols)]
    return np.array([[mask[a:b, c:d].any() for c, d in cols_of] for a, b in rows_of])


def rle_counts(text: str) -> list[int]:
    """Compressed run lengths: groups of five bits, a continuation bit, a sign bit; from the fourth on relative to the one two before."""
    out: list[int] = []
    value = shift = 0
    for c in text:
        code = ord(c) - 48
        value |= (code & 31) << shift
        shift += 5
        if not code & 32:
            if code & 16:
                value -= 1 << shift
            out.append(value + (out[-2] if len(out) > 2 else 0))
            value = shift = 0
    return out


def rle_text(counts: list[int]) -> str:
    """The inverse of ``rle_counts``."""
    out = []
    for i, n in enumerate(counts):
        value = n - (counts[i - 2] if i > 2 else 0)
        while True:
            code, value = value & 31, value >> 5
            done = value == (-1 if code & 16 else 0)
            out.append(chr(48 + code + (0 if done else 32)))
            if done:
                break
    return "".join(out)


def rle_mask(height: int, width: int, counts) -> np.ndarray:
    """Alternating runs, off first, in column order; what exceeds the mask is cut."""
    flat, at = np.zeros(height * width, bool), 0
    runs = [int(n) for n in (rle_counts(counts) if isinstance(counts, str) else counts)]
    if any(n < 0 for n in runs):
        raise ValueError("negative run length")
    for i, n in enumerate(runs):
        if at >= len(flat):
            break
        flat[at : at + n] = i % 2 == 1
        at += n
    return flat.reshape(width, height).T


def segmentation_mask(value, side: int) -> np.ndarray:
    """A mask from null, an object of run lengths or a list of polygons; other sizes are resized by nearest pixels."""
    if isinstance(value, dict):
        mask = rle_mask(*value["size"], value["counts"])
        h, w = mask.shape
        return mask if (h, w) == (side, side) else mask[np.arange(side) * h // side][:, np.arange(side) * w // side]
    out = np.zeros((side, side), bool)
    for polygon in value if isinstance(value, list) else []:
        out |= polygon_mask(polygon, side)
    return out


def iou_and_dice(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    both, total = int((a & b).sum()), int(a.sum()) + int(b.sum())
    return (both / (total - both) if total - both else 0.0), (2 * both / total if total else 0.0)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR image, rounded."""
    b, g, r = (image[..., i].astype(np.float64) for i in range(3))
    return np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5).astype(np.uint8)


def components(on: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, begins, ends (exclusive) and component numbers of a mask's runs, by union-find over runs of neighbouring rows; 8- or 4-connected."""
    step = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, x0 = np.nonzero(step == 1)
    x1 = np.nonzero(step == -1)[1]
    parent = list(range(len(y)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    row = np.searchsorted(y, np.arange(on.shape[0] + 1))
    reach = int(diagonal)
    for r in range(1, on.shape[0]):
        above, here = slice(row[r - 1], row[r]), slice(row[r], row[r + 1])
        first = row[r - 1] + np.searchsorted(x1[above], x0[here] - reach, "right")
        last = row[r - 1] + np.searchsorted(x0[above], x1[here] + reach, "left")
        for i, a, b in zip(range(row[r], row[r + 1]), first.tolist(), last.tolist(), strict=True):
            for j in range(a, b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return y, x0, x1, np.array([root(i) for i in range(len(y))], dtype=np.int64)


def _drawn(shape, y, x0, x1) -> np.ndarray:
    step = np.zeros((shape[0], shape[1] + 1), np.int8)
    step[y, x0] += 1
    step[y, x1] -= 1
    return np.cumsum(step[:, :-1], axis=1).astype(bool)


def contour_area(part: np.ndarray) -> float:
    """Area within the outer contour through the centres of a connected region's edge pixels; holes count."""
    y, x0, x1, label = components(~np.pad(part, 1), diagonal=False)
    outside = label == label[0]  # the run that holds the padding's corner
    full = ~_drawn((part.shape[0] + 2, part.shape[1] + 2), y[outside], x0[outside], x1[outside])
    corners = full[:-1, :-1].astype(int) + full[1:, :-1] + full[:-1, 1:] + full[1:, 1:]
    return float((corners == 4).sum() + 0.5 * (corners == 3).sum())


def roi_box(image: np.ndarray, threshold: int = 15) -> tuple[int, int, int, int]:
    """Box (x, y, w, h) of the bright region of the largest contour area (the first on ties); the whole image if there is none."""
    on = gray(image) > threshold
    if not on.any():
        return 0, 0, image.shape[1], image.shape[0]
    y, x0, x1, label = components(on)
    names, of = np.unique(label, return_inverse=True)
    top, left, bottom, right = np.full(len(names), on.shape[0]), np.full(len(names), on.shape[1]), np.zeros(len(names), int), np.zeros(len(names), int)
    np.minimum.at(top, of, y)
    np.minimum.at(left, of, x0)
    np.maximum.at(bottom, of, y + 1)
    np.maximum.at(right, of, x1)
    bound = (bottom - top - 1) * (right - left - 1)
    best, box = -1.0, None
    for k in np.argsort(-bound, kind="stable").tolist():  # no contour is larger than its box
        if bound[k] < best or (box is not None and bound[k] == 0):
            break
        mine = of == k
        found = contour_area(_drawn((bottom[k] - top[k], right[k] - left[k]), y[mine] - top[k], x0[mine] - left[k], x1[mine] - left[k]))
        if found > best:
            best, box = found, (int(left[k]), int(top[k]), int(right[k] - left[k]), int(bottom[k] - top[k]))
    return box


def _cross_extreme(a: np.ndarray, size: int, pick) -> np.ndarray:
    r = size // 2
    pad = 255 if pick is np.min else 0
    wide = np.pad(a, r, constant_values=pad)
    h, w = a.shape
    rows = pick(np.stack([wide[r : r + h, i : i + w] for i in range(size)]), axis=0)
    cols = pick(np.stack([wide[i : i + h, r : r + w] for i in range(size)]), axis=0)
    return pick(np.stack([rows, cols]), axis=0)


def hair_mask(image: np.ndarray, size: int = 17, threshold: int = 10) -> np.ndarray:
    """Dark thin structures: closing with a cross, minus the image, above a threshold."""
    g = gray(image)
    closed = _cross_extreme(_cross_extreme(g, size, np.max), size, np.min)
    return closed.astype(int) - g > threshold


def inpainted(image: np.ndarray, mask: np.ndarray, radius: int = 3) -> np.ndarray:
    """Masked pixels from the mask's edge inward: each the mean of known pixels within the radius, weighted by the inverse square of their distance.

    An image without a known pixel stays.
    """
    out, known = image.astype(np.float64), np.pad(~mask, radius)
    reach = range(-radius, radius + 1)
    offsets = [(dy, dx) for dy in reach for dx in reach if 0 < dy * dy + dx * dx <= radius * radius]
    todo = np.argwhere(mask)
    while len(todo):
        y, x = todo.T
        edge = np.zeros(len(todo), bool)
        for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            edge |= known[y + radius + dy, x + radius + dx]
        if not edge.any():
            break
        y, x = y[edge], x[edge]
        total, weight = np.zeros((len(y), image.shape[2])), np.zeros(len(y))
        for dy, dx in offsets:
            w = known[y + radius + dy, x + radius + dx] / (dy * dy + dx * dx)
            total += w[:, None] * out[np.clip(y + dy, 0, mask.shape[0] - 1), np.clip(x + dx, 0, mask.shape[1] - 1)]
            weight += w
        out[y, x] = total / weight[:, None]
        known[y + radius, x + radius] = True
        todo = todo[~edge]
    return np.floor(out + 0.5).astype(np.uint8)


def gray_world(image: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Channels scaled to a common mean, and the gains; unchanged if a channel is black."""
    means = image.reshape(-1, 3).mean(axis=0)
    if (means == 0).any():
        return image, [1.0, 1.0, 1.0]
    gains = means.mean() / means
    return np.clip(image * gains, 0, 255).astype(np.uint8), gains.tolist()


def letterboxed(image: np.ndarray, side: int, pad: int = 114) -> np.ndarray:
    """Resized by bilinear sampling at pixel centres, centred on a padded square."""
    h, w = image.shape[:2]
    scale = min(side / w, side / h)
    nw, nh = max(1, int(w * scale)), max(1, int(h * scale))

    def axis(n, m):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(h, nh)
    x0, x1, fx = axis(w, nw)
    f = image.astype(np.float64)
    top = f[y0][:, x0] * (1 - fx)[None, :, None] + f[y0][:, x1] * fx[None, :, None]
    low = f[y1][:, x0] * (1 - fx)[None, :, None] + f[y1][:, x1] * fx[None, :, None]
    out = np.full((side, side, 3), pad, np.uint8)
    py, px = (side - nh) // 2, (side - nw) // 2
    out[py : py + nh, px : px + nw] = np.floor(top * (1 - fy)[:, None, None] + low * fy[:, None, None] + 0.5)
    return out


def _sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples at (x, y), black beyond the image."""
    h, w = image.shape[:2]
    f = np.pad(image.astype(np.float64), ((1, 1), (1, 1), (0, 0)))
    x, y = np.clip(x, -1, w), np.clip(y, -1, h)
    x0, y0 = np.minimum(np.floor(x).astype(int), w - 1), np.minimum(np.floor(y).astype(int), h - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    at = lambda dy, dx: f[y0 + 1 + dy, x0 + 1 + dx]
    return (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy


def _shifted_hsv(image: np.ndarray, hue: float, saturation: float, value: float) -> np.ndarray:
    """BGR with its hue turned (in half degrees) and its saturation and value moved (of 255)."""
    f = image.astype(np.float64)
    high, low = f.max(axis=2), f.min(axis=2)
    span = np.where(high > low, high - low, 1.0)
    b, g, r = (f[..., i] for i in range(3))
    turn = np.where(high == r, (g - b) / span, np.where(high == g, 2 + (b - r) / span, 4 + (r - g) / span)) * 30
    turn = np.where(high > low, turn + hue, 0.0) % 180 / 30
    s = np.clip(np.where(high > 0, (high - low) / np.where(high > 0, high, 1) * 255, 0.0) + saturation, 0, 255) / 255
    v = np.clip(high + value, 0, 255)
    part = lambda n: v - v * s * np.clip(np.minimum((n + turn) % 6, 4 - (n + turn) % 6), 0, 1)
    return np.stack([part(1), part(3), part(5)], axis=2)


def _blurred(image: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    weights = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    weights /= weights.sum()
    for axis in (0, 1):
        if image.shape[axis] > r:
            pad = [(r, r) if a == axis else (0, 0) for a in range(3)]
            wide = np.pad(image, pad, mode="reflect")
            image = sum(w * np.take(wide, np.arange(i, i + image.shape[axis]), axis=axis) for i, w in enumerate(weights))
    return image


class Augmentation:
    """One draw: a map of the canvas onto itself, and changes of colour and sharpness.  The same seed gives the same."""

    # Probabilities and ranges of the policy.
    FLIP_X, FLIP_Y, AFFINE, SHEAR, LIGHT, COLOUR, BLUR = 0.5, 0.25, 0.9, 0.35, 0.5, 0.25, 0.15
    SCALE, SHIFT, TURN, SLANT, BRIGHT, HSV, BLUR_SIZES = (0.85, 1.15), 0.05, 30, 10, 0.12, (5, 8, 5), (3, 5)

    def __init__(self, width: int, height: int, seed: int):
        rnd = np.random.default_rng(seed)
        chance = lambda p: rnd.random() < p
        middle = np.array([(width - 1) / 2, (height - 1) / 2])
        m = np.diag([-1.0 if chance(self.FLIP_X) else 1.0, -1.0 if chance(self.FLIP_Y) else 1.0])
        shift = np.zeros(2)
        if chance(self.AFFINE):
            angle, scale = np.deg2rad(rnd.uniform(-self.TURN, self.TURN)), rnd.uniform(*self.SCALE)
            m = scale * np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]]) @ m
            shift = rnd.uniform(-self.SHIFT, self.SHIFT, 2) * (width, height)
        if chance(self.SHEAR):
            slant = np.array([[1.0, np.tan(np.deg2rad(rnd.uniform(-self.SLANT, self.SLANT)))], [np.tan(np.deg2rad(rnd.uniform(-self.SLANT, self.SLANT))), 1.0]])
            m, shift = slant @ m, slant @ shift
        self.matrix, self.offset = m, middle + shift - m @ middle
        self.contrast, self.brightness = (rnd.uniform(1 - self.BRIGHT, 1 + self.BRIGHT), rnd.uniform(-self.BRIGHT, self.BRIGHT)) if chance(self.LIGHT) else (1.0, 0.0)
        self.hsv = tuple(rnd.uniform(-x, x) for x in self.HSV) if chance(self.COLOUR) else None
        self.blur = int(rnd.choice(self.BLUR_SIZES)) if chance(self.BLUR) else 0

    def points(self, points) -> np.ndarray:
        return np.asarray(points, np.float64).reshape(-1, 2) @ self.matrix.T + self.offset

    def image(self, image: np.ndarray) -> np.ndarray:
        h, w = image.shape[:2]
        grid = np.stack(np.meshgrid(np.arange(w), np.arange(h)), axis=-1) - self.offset
        source = grid @ np.linalg.inv(self.matrix).T
        out = np.clip(_sampled(image, source[..., 0], source[..., 1]) * self.contrast + 255 * self.brightness, 0, 255)
        if self.hsv is not None:
            out = _shifted_hsv(out, *self.hsv)
        if self.blur:
            out = _blurred(out, self.blur)
        return np.floor(np.clip(out, 0, 255) + 0.5).astype(np.uint8)


def augment_points(points: np.ndarray, width: int, height: int, seed: int) -> np.ndarray:
    """The geometric part of an augmentation."""
    return Augmentation(width, height, seed).points(points)


def area_float32(points: np.ndarray) -> float:
    """Polygon area in single precision, by which augmented polygons are kept."""
    p = np.asarray(points, np.float32).reshape(-1, 2)
    x, y = p.T
    return float(np.float32(0.5) * np.abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))))


def png(image: np.ndarray) -> bytes:
    """A BGR image as PNG."""
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image[..., ::-1]).reshape(h, w * 3)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


@arrow_udf("struct<iou:double,dice:double>")
def mask_scores(truth: pd.Series, predicted: pd.Series, side: pd.Series) -> pd.DataFrame:
    """IoU and Dice of a polygon in pixels and a segmentation as JSON text."""
    out = [iou_and_dice(polygon_mask(t, int(n)), segmentation_mask(None if s is None else json.loads(s), int(n))) for t, s, n in zip(truth, predicted, side, strict=True)]
    return pd.DataFrame(out, columns=["iou", "dice"])


@arrow_udf("boolean")
def pooled_empty(points: pd.Series, width: pd.Series, height: pd.Series, stride: pd.Series) -> pd.Series:
    """Whether a normalised polygon leaves no pixel on its pooled canvas."""
    return pd.Series([None if p is None else not pooled_mask([(v["x"], v["y"]) for v in p], int(w), int(h), int(s)).any() for p, w, h, s in zip(points, width, height, stride, strict=True)], dtype=object)


@arrow_udf("array<int>")
def rle_decode(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else rle_counts(t) for t in text], dtype=object)


@arrow_udf("string")
def rle_encode(counts: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else rle_text([int(n) for n in c]) for c in counts], dtype=object)


@arrow_udf("array<int>")
def fill_runs(flat: pd.Series, side: pd.Series) -> pd.Series:
    """A filled polygon as run lengths in column order."""
    out = []
    for f, n in zip(flat, side, strict=True):
        bits = polygon_mask(f, int(n)).T.ravel()
        edges = np.flatnonzero(np.diff(bits, prepend=False))
        out.append(np.diff(np.concatenate([[0], edges, [bits.size]])).astype(int).tolist())
    return pd.Series(out, dtype=object)

"""Regions, contours and run lengths against plain loops."""

import numpy as np
import pytest
from annolith.functions import raster as R


def flooded(on, diagonal):
    """Component numbers by flood filling."""
    out, n = np.zeros(on.shape, int), 0
    for at in zip(*np.nonzero(on), strict=True):
        if out[at]:
            continue
        n += 1
        held = [at]
        out[at] = n
        while held:
            y, x = held.pop()
            for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)) + ((-1, -1), (-1, 1), (1, -1), (1, 1)) * diagonal:
                a, b = y + dy, x + dx
                if 0 <= a < on.shape[0] and 0 <= b < on.shape[1] and on[a, b] and not out[a, b]:
                    out[a, b] = n
                    held.append((a, b))
    return out


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_match_flood_filling(diagonal):
    rng = np.random.default_rng(1)
    for _ in range(200):
        on = rng.random(rng.integers(1, 14, 2)) < rng.random()
        want = flooded(on, diagonal)
        got = np.full(on.shape, -1)
        for y, a, b, k in zip(*R.components(on, diagonal), strict=True):
            got[y, a:b] = k
        assert ((got >= 0) == on).all()
        assert len({*zip(want[on], got[on], strict=True)}) == want.max() == len(set(got[on].tolist()))


@pytest.mark.parametrize(
    ("rows", "area"),
    [(["#########"], 0), (["####"] * 3, 6), (["#..", ".#.", "..#"], 0), ([".#.", "###", ".#."], 2), (["#####", "#...#", "#...#", "#####"], 12), (["##..", "####", "##.."], 2 + 0.5 + 0.5)],
)
def test_contour_areas(rows, area):
    assert R.contour_area(np.array([[c == "#" for c in r] for r in rows])) == area


def test_a_ring_is_larger_than_a_block_of_more_pixels():
    image = np.zeros((60, 60, 3), np.uint8)
    image[5:25, 5:25] = 200
    image[7:23, 7:23] = 0  # 144 pixels around 361
    image[40:53, 40:53] = 200  # 169 pixels, area 144
    assert R.roi_box(image) == (5, 5, 20, 20)
    assert R.roi_box(np.zeros((4, 6, 3), np.uint8)) == (0, 0, 6, 4)
    image[:] = 0
    image[9, 3] = 255
    assert R.roi_box(image) == (3, 9, 1, 1)


def test_over_long_runs_are_cut_before_they_are_made():
    assert R.rle_mask(2, 3, [1, 10**30, 5]).tolist() == [[False, True, True], [True, True, True]]
    assert R.rle_mask(2, 2, []).sum() == R.rle_mask(0, 5, [3, 4]).sum() == 0
    with pytest.raises(ValueError, match="negative"):
        R.rle_mask(2, 2, [1, -1])

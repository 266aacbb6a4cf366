"""Numpy kernels against direct loops."""

import numpy as np
import pytest

from skyquilt.functions import kernels as k

RNG = np.random.default_rng(3)


def test_blur_matches_direct_sum_with_mirrored_edges():
    a = RNG.integers(0, 255, (9, 11)).astype(float)
    w = k.gaussian_weights(5, 1.2)
    got = k.blur(a, w, (0, 0), a.shape)
    pad = np.pad(a, 2, mode="reflect")
    want = np.zeros_like(a)
    for r in range(9):
        for c in range(11):
            want[r, c] = sum(w[i] * w[j] * pad[r + i, c + j] for i in range(5) for j in range(5))
    assert np.allclose(got, want)


def test_erosion_and_dilation_ignore_pixels_outside():
    a = (RNG.random((12, 13)) > 0.4).astype(np.uint8)
    for low, high in ((-1, 0), (-3, 2)):
        for take_max in (False, True):
            want = np.zeros_like(a)
            for r in range(12):
                for c in range(13):
                    box = a[max(r + low, 0):r + high + 1, max(c + low, 0):c + high + 1]
                    want[r, c] = box.max() if take_max else box.min()
            assert (k.rank_filter(a, low, high, take_max) == want).all()


@pytest.mark.parametrize("conn", [4, 8])
def test_labels_match_flood_fill(conn):
    m = RNG.random((15, 17)) > 0.55
    lab = k.label(m, conn)
    seen, n = np.zeros(m.shape, int), 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    for r in range(15):
        for c in range(17):
            if m[r, c] and not seen[r, c]:
                n += 1
                todo = [(r, c)]
                seen[r, c] = n
                while todo:
                    y, x = todo.pop()
                    for dy, dx in steps:
                        yy, xx = y + dy, x + dx
                        if 0 <= yy < 15 and 0 <= xx < 17 and m[yy, xx] and not seen[yy, xx]:
                            seen[yy, xx] = n
                            todo.append((yy, xx))
    assert (lab == seen).all()


def _peaks_by_loop(heat, limit):
    out = []
    top = float(heat.max())
    if top < limit:
        return out
    out += [tuple(map(int, p)) for p in np.argwhere(heat == heat.max())]
    level, levels = top - 0.01, []
    while level > limit:
        levels.append(level)
        level -= 0.01
    for v in levels + [limit]:
        lab = k.label(heat >= np.float32(v))
        for i in range(1, lab.max() + 1):
            best = max(((heat[r, c], -r, -c) for r, c in np.argwhere(lab == i)))
            cell = (-best[1], -best[2])
            if cell not in out:
                out.append(cell)
    return out


def test_peaks_of_a_batch_match_direct_search():
    rng = np.random.default_rng(1)
    maps = (rng.random((40, 9, 9)) ** 3).astype(np.float32)
    maps[20:30] = np.round(maps[20:30], 1)  # equal cells and flat zones
    maps[30] = 0.5
    maps[31] = 0.1
    assert k.heatmap_peaks(maps, 0.17) == [_peaks_by_loop(m, 0.17) for m in maps]
    tall = rng.random((3, 4, 7)).astype(np.float32)
    assert k.heatmap_peaks(tall, 0.3) == [_peaks_by_loop(m, 0.3) for m in tall]
    assert k.heatmap_peaks(maps[:0], 0.17) == []


def test_peaks_edge_cases():
    low = np.full((5, 5), 0.1, np.float32)
    two = low.copy()
    two[1, 3] = two[4, 0] = 0.9
    assert k.heatmap_peaks(np.stack([low, two]), 0.17) == [[], [(1, 3), (4, 0)]]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 25])
def test_sliding_median_equals_the_restacked_window(n):
    rng = np.random.default_rng(n)
    frames = [rng.integers(0, 256, 50).astype(np.uint8) for _ in range(40)] + [np.full(50, v, np.uint8) for v in (0, 255, 0, 255, 7)]
    m = k.SlidingMedian(n, 50)
    with pytest.raises(ValueError):
        m.value()
    for i, f in enumerate(frames):
        m.push(f)
        if i + 1 >= n:
            assert (m.value() == np.median(np.stack(frames[i + 1 - n:i + 1]), axis=0)).all()


@pytest.mark.parametrize("low,high", [(-40, 40), (-3, 9), (2, 5), (-9, -2), (0, 0)])
def test_rank_filter_of_any_window_equals_a_direct_search(low, high):
    a = np.random.default_rng(3).integers(0, 256, (23, 31)).astype(np.uint8)
    for take_max in (True, False):
        want = np.full(a.shape, 0 if take_max else 255, np.uint8)
        for r in range(23):
            for c in range(31):
                rows = a[max(0, r + low):max(0, r + high + 1), max(0, c + low):max(0, c + high + 1)]
                if rows.size:
                    want[r, c] = rows.max() if take_max else rows.min()
        assert (k.rank_filter(a, low, high, take_max) == want).all()


def test_disc_rows_shrink_and_cover_the_axis():
    from skyquilt.operators.labels import disc_half_widths

    half = disc_half_widths(30)
    assert half[0] == 30 and half[30] >= 0 and half == sorted(half, reverse=True)
    assert disc_half_widths(1) == [1, 0]

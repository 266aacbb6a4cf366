"""Small numpy kernels that run on one tile or one patch inside a task."""

from __future__ import annotations

import numpy as np


def affine3(gt) -> np.ndarray:
    """Six geotransform coefficients -> 3x3 matrix on (x, y, 1)."""
    return np.array([[gt[1], gt[2], gt[0]], [gt[4], gt[5], gt[3]], [0.0, 0.0, 1.0]])


def gaussian_weights(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    w = np.exp(-(x * x) / (2 * sigma * sigma))
    return w / w.sum()


def blur_halo(sigma: float, depth_u8: bool = False) -> int:
    """Half width of the automatic kernel for a sigma (float images: 4 sigma)."""
    return int(round(sigma * (3 if depth_u8 else 4) * 2 + 1) | 1) // 2


def reflect101(i: np.ndarray, n: int) -> np.ndarray:
    """Index mirrored at the frame's edge without repeating the edge pixel."""
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * (n - 1))
    return np.where(i >= n, 2 * (n - 1) - i, i)


def blur(a: np.ndarray, weights: np.ndarray, origin: tuple[int, int], shape: tuple[int, int]) -> np.ndarray:
    """Separable blur of a halo'd tile; mirrors only at the frame's own edge.

    Pixels whose window leaves the array inside the frame are not valid; they
    lie in the halo that the caller drops.
    """
    k = len(weights) // 2

    def along(x, axis):
        n, o, full = x.shape[axis], origin[axis], shape[axis]
        idx = reflect101(np.arange(o - k, o + n + k), full) - o
        idx = np.clip(idx, 0, n - 1)
        padded = np.take(x, idx, axis=axis)
        out = np.zeros(x.shape, np.float64)
        for j, w in enumerate(weights):
            out += w * (padded[j:j + n] if axis == 0 else padded[:, j:j + n])
        return out

    return along(along(a.astype(np.float64), 0), 1)


def rank_filter(a: np.ndarray, low: int, high: int, take_max: bool) -> np.ndarray:
    """Min or max over the square of offsets low..high; outside pixels are ignored.

    Each axis is cut into blocks as long as the window. A window is the end of one
    block and the beginning of the next, so running extremes from both ends of the
    blocks give it at a cost that does not depend on its length.
    """
    fill = 0 if take_max else (1 if a.dtype == np.bool_ else np.iinfo(a.dtype).max)
    pick, size, out = np.maximum if take_max else np.minimum, high - low + 1, a
    for axis in (0, 1):
        x = np.moveaxis(out, axis, -1)
        n = x.shape[-1]
        # offset 0 of a row sits at place p, so that all windows lie inside
        p, whole = max(0, -low), -(-(max(0, -low) + n + max(0, high)) // size) * size
        wide = np.full((*x.shape[:-1], whole), fill, a.dtype)
        wide[..., p:p + n] = x
        blocks = wide.reshape(*x.shape[:-1], -1, size)
        ahead = pick.accumulate(blocks, axis=-1).reshape(wide.shape)
        back = pick.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(wide.shape)
        at = np.arange(p, p + n)
        out = np.moveaxis(pick(back[..., at + low], ahead[..., at + high]), -1, axis)
    return np.ascontiguousarray(out)


def open_2x2(a: np.ndarray) -> np.ndarray:
    """Opening by a 2x2 square, anchor at its lower right for both steps."""
    return rank_filter(rank_filter(a, -1, 0, False), -1, 0, True)


def bilinear(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Resize with half-pixel centres and clamped edges."""
    def weights(n, m):
        x = (np.arange(m) + 0.5) * n / m - 0.5
        i = np.floor(x).astype(int)
        f = x - i
        out = np.zeros((m, n))
        np.add.at(out, (np.arange(m), np.clip(i, 0, n - 1)), 1 - f)
        np.add.at(out, (np.arange(m), np.clip(i + 1, 0, n - 1)), f)
        return out

    return weights(a.shape[0], h) @ a.astype(np.float64) @ weights(a.shape[1], w).T


def nearest(a: np.ndarray, h: int, w: int) -> np.ndarray:
    r = np.minimum(np.arange(h) * a.shape[0] // h, a.shape[0] - 1)
    c = np.minimum(np.arange(w) * a.shape[1] // w, a.shape[1] - 1)
    return a[np.ix_(r, c)]


def merge_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, for nodes 0..n-1 and edges a-b."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:  # shorten the chains
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab


def label(mask: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """Components numbered 1.. by first pixel in row-major order; 0 is outside."""
    h, w = mask.shape
    node = np.full((h, w), -1)
    n = int(np.count_nonzero(mask))
    node[mask] = np.arange(n)
    steps = [(0, 1), (1, 0)] if connectivity == 4 else [(0, 1), (1, 0), (1, 1), (1, -1)]
    pairs = []
    for dr, dc in steps:
        p = node[: h - dr, max(-dc, 0): w - max(dc, 0)]
        q = node[dr:, max(dc, 0): w + min(dc, 0)]
        both = (p >= 0) & (q >= 0)
        pairs.append((p[both], q[both]))
    roots = merge_labels(n, np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs]))
    out = np.zeros((h, w), np.int64)
    if n:
        out[mask] = np.unique(roots, return_inverse=True)[1] + 1
    return out


def warp_coords(inv, r0: int, c0: int, h: int, w: int, centre: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Source (x, y) of each pixel of a target tile; -10 for those at or beyond the horizon.

    ``inv`` maps a target (x, y) to the source. ``centre`` = 0.5 when coordinates
    address pixel corners instead of centres.
    """
    cc, rr = np.meshgrid(np.arange(c0, c0 + w) + centre, np.arange(r0, r0 + h) + centre)
    den = inv[2, 0] * cc + inv[2, 1] * rr + inv[2, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (inv[0, 0] * cc + inv[0, 1] * rr + inv[0, 2]) / den - centre
        y = (inv[1, 0] * cc + inv[1, 1] * rr + inv[1, 2]) / den - centre
    far = ~np.isfinite(x) | ~np.isfinite(y) | (np.abs(x) > 1e7) | (np.abs(y) > 1e7)
    return np.where(far, -10.0, np.round(x, 9)), np.where(far, -10.0, np.round(y, 9))


def corners_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the four source pixels around each sample, on a first axis of four."""
    r, c = np.floor(y).astype(int), np.floor(x).astype(int)
    return np.stack([r, r, r + 1, r + 1]), np.stack([c, c + 1, c, c + 1])


def tiles_hit(x: np.ndarray, y: np.ndarray, tile: int, height: int, width: int) -> np.ndarray:
    """(row, column) of the source tiles that hold a pixel around a sample."""
    r, c = corners_of(x, y)
    ok = (r >= 0) & (r < height) & (c >= 0) & (c < width)
    across = (width - 1) // tile + 1
    return np.stack(np.divmod(np.unique(r[ok] // tile * across + c[ok] // tile), across), axis=1)


def blend(four: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear value of the four pixels around each sample, rounded half up."""
    v, fx, fy = four.astype(np.float64), x - np.floor(x), y - np.floor(y)
    return np.floor((v[0] * (1 - fx) + v[1] * fx) * (1 - fy) + (v[2] * (1 - fx) + v[3] * fx) * fy + 0.5).astype(np.uint8)


def warp_tile(strips, inv, r0, c0, h, w, height, width, fill, centre: float = 0.0) -> np.ndarray:
    """Bilinear samples of a source frame (given as pieces) on one target tile; samples outside count as ``fill``."""
    x, y = warp_coords(inv, r0, c0, h, w, centre)
    r, c = corners_of(x, y)
    four = np.full(r.shape, fill, np.uint8)
    for s in strips:
        pick_corners(s, r, c, four)
    return blend(four, x, y)


def pick_corners(piece, r: np.ndarray, c: np.ndarray, four: np.ndarray) -> np.ndarray:
    """Set the corners that lie in one source piece; returns which they are."""
    ok = (r >= piece["pr"]) & (r < piece["pr"] + piece["ph"]) & (c >= piece["pc"]) & (c < piece["pc"] + piece["pw"])
    four[ok] = np.frombuffer(piece["px"], np.uint8).reshape(piece["ph"], piece["pw"])[r[ok] - piece["pr"], c[ok] - piece["pc"]]
    return ok


def _levels(top: float, limit: float, dtype) -> np.ndarray:
    """Levels from just under the maximum down to ``limit`` in accumulated steps of 0.01."""
    levels, level = [], top - 0.01
    while level > limit:
        levels.append(level)
        level -= 0.01
    return np.array([*levels, limit], np.float64).astype(dtype)


def heatmap_peaks(maps: np.ndarray, limit: float) -> list[list[tuple[int, int]]]:
    """Peak cells of each map of a batch (maps, rows, columns), in the order they are found.

    All cells at the maximum come first. Then the level goes down in steps of
    0.01 (accumulated) to ``limit``; at each level every 4-connected blob gives
    its highest cell, row-major first on ties. A cell is listed once.

    A blob gives a new cell at the level where it appears: it is then a zone of
    cells first met at one level, with no neighbour that was met before. So one
    labelling of these zones, of all maps at once, stands for all levels.
    """
    b, h, w = maps.shape
    met = np.empty(maps.shape, np.int64)  # number of the level at which a cell is met
    ends = np.zeros(b, np.int64)
    for i, one in enumerate(maps):
        levels = _levels(float(one.max()), limit, maps.dtype) if one.size and one.max() >= limit else np.zeros(0, maps.dtype)
        met[i] = len(levels) - np.searchsorted(levels[::-1], one, side="right")
        ends[i] = len(levels)
    node = np.arange(maps.size).reshape(maps.shape)
    pairs = [(node[:, :-1].ravel(), node[:, 1:].ravel()), (node[:, :, :-1].ravel(), node[:, :, 1:].ravel())]
    x, y = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    level = met.ravel()
    even = level[x] == level[y]
    zone = merge_labels(maps.size, x[even], y[even])  # named by its first cell
    low = np.where(level[x] > level[y], x, y)[~even]
    old = np.zeros(maps.size, bool)
    old[zone[low]] = True
    of, value = np.repeat(np.arange(b), h * w), maps.ravel()
    born = np.flatnonzero((level < ends[of]) & ~old[zone])
    # the highest cell of each zone, then zones by map, level and first cell
    born = born[np.lexsort((born, -value[born], zone[born]))]
    born = born[np.concatenate([[True], zone[born][1:] != zone[born][:-1]])] if len(born) else born
    born = born[np.lexsort((zone[born], level[born], of[born]))]
    found = []
    for i, one in enumerate(maps):
        top = np.flatnonzero(one.ravel() == one.max()) if ends[i] else np.zeros(0, np.int64)
        own = born[np.searchsorted(of[born], i):np.searchsorted(of[born], i, side="right")] - i * h * w
        found.append([divmod(c, w) for c in dict.fromkeys([*top.tolist(), *own.tolist()])])
    return found


class SlidingMedian:
    """Median of the last ``n`` arrays of bytes, of a histogram per cell that gains and loses one array a step.

    The two middle values keep their place and move by the few bins that a step
    shifts them, so a step costs the same for any ``n``.
    """

    def __init__(self, n: int, size: int):
        self.n, self.hist = n, np.zeros((size, 256), np.int16)
        self.at = np.zeros((2, size), np.int64)  # bins of the middle values
        self.below = np.zeros((2, size), np.int64)  # members in smaller bins
        self.cell = np.arange(size)
        self.held: list[np.ndarray] = []

    def push(self, a: np.ndarray) -> None:
        if len(self.held) == self.n:
            out = self.held.pop(0)
            self.hist[self.cell, out] -= 1
            self.below -= out < self.at
        self.held.append(a)
        self.hist[self.cell, a] += 1
        self.below += a < self.at

    def value(self) -> np.ndarray:
        """Median of ``n`` arrays as float64 (even ``n`` averages); fewer arrays are an error."""
        if len(self.held) < self.n:
            raise ValueError("the window is not full")
        for k, rank in enumerate(((self.n - 1) // 2, self.n // 2)):
            at, below = self.at[k], self.below[k]
            move = np.flatnonzero(below > rank)
            while len(move):
                at[move] -= 1
                below[move] -= self.hist[move, at[move]]
                move = move[below[move] > rank]
            move = np.flatnonzero(below + self.hist[self.cell, at] <= rank)
            while len(move):
                below[move] += self.hist[move, at[move]]
                at[move] += 1
                move = move[below[move] + self.hist[move, at[move]] <= rank]
        return self.at.sum(axis=0) / 2

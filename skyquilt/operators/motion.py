"""Motion maps: frame difference, block motion, warm-up and fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt import schemas
from skyquilt.functions import kernels
from skyquilt.functions.batches import map_slices
from skyquilt.operators import ordering, tiles as tl

METHODS = ("frame_diff", "block")


def with_previous(tiles: DataFrame) -> DataFrame:
    """Attach the previous frame's tile at the same place (``prev_px``)."""
    d = ordering.neighbours(
        tiles, ["aoi", "ty", "tx"], ["frame"], ordering.by_width("frame", 64), F.struct("px"), prev="_p"
    )
    return d.withColumn("prev_px", F.col("_p.px")).drop("_p").where("prev_px is not null")


def _pair_stack(tiles: DataFrame, tile: int, halo: int) -> DataFrame:
    p = with_previous(tiles)
    keys = ("aoi", "frame", "slot")
    cur = tl.pieces(p.withColumn("slot", F.lit(0)), tile, halo, "u1", keys)
    old = tl.pieces(p.withColumn("slot", F.lit(1)).withColumn("px", F.col("prev_px")), tile, halo, "u1", keys)
    return cur.unionByName(old).groupBy("aoi", "frame", "ty", "tx", "height", "width").agg(
        F.collect_list(F.struct("slot", "pr", "pc", "ph", "pw", "px")).alias("strips")
    )


def _pair(t, tile, halo):
    sides = []
    for slot in (0, 1):
        part = [s for s in t.strips if s["slot"] == slot]
        a, ra, ca = tl.assemble(part, t.ty, t.tx, tile, halo, t.height, t.width, np.uint8)
        sides.append(a)
    return sides[0], sides[1], ra, ca


def _axis(n_from: int, n_to: int, lo: int, hi: int):
    """Source indices and fraction of a bilinear resize for targets lo..hi-1."""
    x = (np.arange(lo, hi) + 0.5) * n_from / n_to - 0.5
    i = np.floor(x).astype(int)
    return np.clip(i, 0, n_from - 1), np.clip(i + 1, 0, n_from - 1), x - i


def _resize_part(a, origin, shape, to, box):
    """Targets ``box`` of a frame-wide bilinear resize, from a part of the frame."""
    r0, r1, fr = _axis(shape[0], to[0], box[0], box[1])
    c0, c1, fc = _axis(shape[1], to[1], box[2], box[3])
    a = a.astype(np.float64)
    rows = a[r0 - origin[0]] * (1 - fr)[:, None] + a[r1 - origin[0]] * fr[:, None]
    return rows[:, c0 - origin[1]] * (1 - fc) + rows[:, c1 - origin[1]] * fc


def frame_difference(tiles: DataFrame, tile: int, ratio: float = 1.0) -> DataFrame:
    """Flow magnitude of the quick method as float32 tiles.

    Both flow parts equal the absolute difference, so the magnitude is
    sqrt(2) * difference. With ``ratio`` < 1 the frames are compared at a
    reduced size and the difference is scaled back.
    """
    halo = 0 if ratio >= 1 else int(np.ceil(3 / ratio))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                a, b, ra, ca = _pair(t, tile, halo)
                r0, c0 = t.ty * tile, t.tx * tile
                r1, c1 = min(r0 + tile, t.height), min(c0 + tile, t.width)
                if ratio >= 1:
                    d = np.abs(a.astype(np.float32) - b)
                else:
                    shape = (t.height, t.width)
                    small = (int(round(t.height * ratio)), int(round(t.width * ratio)))
                    i0, i1, _ = _axis(small[0], t.height, r0, r1)
                    j0, j1, _ = _axis(small[1], t.width, c0, c1)
                    box = (i0.min(), i1.max() + 1, j0.min(), j1.max() + 1)
                    pa, pb = (np.floor(_resize_part(x, (ra, ca), shape, small, box) + 0.5) for x in (a, b))
                    d = _resize_part(np.abs(pa - pb), (box[0], box[2]), small, shape, (r0, r1, c0, c1))
                m = np.hypot(d, d).astype(np.float32)
                rows.append((t.aoi, t.frame, t.ty, t.tx, r0, c0, *m.shape, t.height, t.width, m.tobytes()))
            yield pd.DataFrame(rows, columns=tl.COLS)

    aoi = dict(tiles.dtypes)["aoi"]
    return map_slices(_pair_stack(tiles, tile, halo), run, schemas.TILE.replace("aoi STRING", f"aoi {aoi}"))


def block_motion(tiles: DataFrame, tile: int, block: int = 8, reach: int = 4) -> DataFrame:
    """Motion (dr, dc) of every block: the shift of least absolute difference.

    A block at (r, c) is compared with the previous frame at (r - dr, c - dc);
    shifts that leave the frame do not count. Ties: the shortest shift, then
    row-major. Blocks must not cross tiles (``tile`` is a multiple of ``block``).
    """
    if tile % block:
        raise ValueError("tile must be a multiple of block")
    shifts = sorted(
        ((dr, dc) for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1)),
        key=lambda s: (s[0] ** 2 + s[1] ** 2, s),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                a, b, ra, ca = _pair(t, tile, reach)
                r0, c0 = t.ty * tile, t.tx * tile
                r1, c1 = min(r0 + tile, t.height), min(c0 + tile, t.width)
                now = a[r0 - ra:r1 - ra, c0 - ca:c1 - ca].astype(np.int64)
                # the previous frame round the tile; what lies outside the frame is never used
                before = np.zeros((r1 - r0 + 2 * reach, c1 - c0 + 2 * reach), np.int64)
                top, left = ra - r0 + reach, ca - c0 + reach
                before[top:top + b.shape[0], left:left + b.shape[1]] = b
                r, c = np.arange(r0, r1, block), np.arange(c0, c1, block)
                sad = np.full((len(r), len(c)), np.iinfo(np.int64).max)
                u, v = np.zeros_like(sad), np.zeros_like(sad)
                for dr, dc in shifts:
                    inside = np.logical_and.outer((r - dr >= 0) & (np.minimum(r + block, t.height) - dr <= t.height),
                                                  (c - dc >= 0) & (np.minimum(c + block, t.width) - dc <= t.width))
                    gap = np.abs(now - before[reach - dr:reach - dr + now.shape[0], reach - dc:reach - dc + now.shape[1]])
                    gap = np.add.reduceat(np.add.reduceat(gap, r - r0, 0), c - c0, 1)
                    better = inside & (gap < sad)
                    sad[better], u[better], v[better] = gap[better], dr, dc
                rows.append(pd.DataFrame({
                    "aoi": t.aoi, "frame": t.frame, "r": np.repeat(r, len(c)), "c": np.tile(c, len(r)),
                    "u": u.ravel(), "v": v.ravel(), "sad": sad.ravel()}))
            if rows:
                yield pd.concat(rows)

    aoi = dict(tiles.dtypes)["aoi"]
    return map_slices(_pair_stack(tiles, tile, reach),
        run, f"aoi {aoi}, frame int, r int, c int, u int, v int, sad long"
    )


def block_magnitude(tiles: DataFrame, flow: DataFrame, tile: int, block: int = 8) -> DataFrame:
    """Spread block motion over its pixels as float32 magnitude tiles."""
    per_tile = flow.groupBy(
        "aoi", "frame", F.floor(F.col("r") / tile).cast("int").alias("ty"), F.floor(F.col("c") / tile).cast("int").alias("tx")
    ).agg(F.collect_list(F.struct("r", "c", "u", "v")).alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            px = []
            for t in pdf.itertuples(index=False):
                a = np.zeros((t.h, t.w), np.float32)
                for k in t.blocks:
                    r, c = k["r"] - t.r0, k["c"] - t.c0
                    a[r:r + block, c:c + block] = np.hypot(k["u"], k["v"])
                px.append(a.tobytes())
            yield pdf.assign(px=px).drop(columns="blocks")

    fed = tiles.drop("px").join(per_tile, ["aoi", "frame", "ty", "tx"]).withColumn("px", F.lit(None).cast("binary"))
    fed = fed.select(*tl.COLS, "blocks")
    return map_slices(fed, run, tiles.select(*tl.COLS).schema)


def motion_map(magnitude: DataFrame, tile: int, sigma: float = 3.0) -> DataFrame:
    """Blur a magnitude and divide by its frame maximum (if above 1e-6)."""
    if sigma > 0:
        half = kernels.blur_halo(sigma)
        w = kernels.gaussian_weights(2 * half + 1, sigma)
        magnitude = tl.map_halo(magnitude, tile, half, lambda a, o, s: kernels.blur(a, w, o, s), "f4", "f4")
    return tl.frame_max_scaled(magnitude)


def flow_magnitude(tiles: DataFrame, flow: DataFrame) -> DataFrame:
    """Length of an outside flow field as float32 magnitude tiles.

    ``flow``: aoi, frame, r, c, u, v, a row for each pixel; it meets its tile by the
    tile's index, which follows from the frame's tile side. Pixels without a row do
    not move; frames without one have no magnitude.
    """
    side = tiles.groupBy("aoi", "frame").agg(F.max("h").alias("_th"), F.max("w").alias("_tw"))
    at = flow.join(side, ["aoi", "frame"]).select(
        "aoi", "frame", F.floor(F.col("r") / F.col("_th")).cast("int").alias("ty"), F.floor(F.col("c") / F.col("_tw")).cast("int").alias("tx"),
        F.struct(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.hypot(F.col("u").cast("double"), F.col("v").cast("double")).alias("m")).alias("e"))
    per_tile = at.groupBy("aoi", "frame", "ty", "tx").agg(F.collect_list("e").alias("e")).select(
        "aoi", "frame", "ty", "tx", F.col("e.r").alias("_r"), F.col("e.c").alias("_c"), F.col("e.m").alias("_m"))
    moving = tiles.drop("px").join(flow.select("aoi", "frame").distinct(), ["aoi", "frame"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            px = []
            for t in pdf.itertuples(index=False):
                a = np.zeros((t.h, t.w), np.float32)
                if t.m is not None:
                    a[np.asarray(t.r) - t.r0, np.asarray(t.c) - t.c0] = t.m
                px.append(a.tobytes())
            yield pdf.drop(columns=["r", "c", "m"]).assign(px=px)

    fed = moving.join(per_tile, ["aoi", "frame", "ty", "tx"], "left")
    fed = fed.select(*[c for c in tl.COLS if c != "px"], *[F.col(f"_{c}").alias(c) for c in ("r", "c", "m")])
    return map_slices(fed, run, tiles.select(*tl.COLS).schema)


def estimate(tiles: DataFrame, tile: int, method: str = "block", sigma: float = 3.0, **kw) -> DataFrame:
    """Motion map of every frame that has a predecessor (``table``: that the table ``flow`` names)."""
    if method == "frame_diff":
        mag = frame_difference(tiles, tile, **kw)
    elif method == "block":
        mag = block_magnitude(tiles, block_motion(tiles, tile, **kw), tile, kw.get("block", 8))
    elif method == "table":
        mag = flow_magnitude(tiles, **kw)
    else:
        raise ValueError(f"unsupported motion method: {method}")
    return motion_map(mag, tile, sigma)


def warm_up(position: Column, value: Column) -> Column:
    """First processed frame: 1; second: 0; from the third on the real value."""
    return F.when(position == 0, F.lit(1.0)).when(position == 1, F.lit(0.0)).otherwise(value)


def warmed_tiles(motion: DataFrame, tiles: DataFrame, positions: DataFrame) -> DataFrame:
    """Motion tiles with the warm-up rule; ``positions``: aoi, frame, pos (0-based, processed)."""
    @F.pandas_udf("binary")
    def constant(h: pd.Series, w: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([np.full(a * b, x, np.float32).tobytes() for a, b, x in zip(h, w, v)])

    early = tiles.join(positions.where("pos < 2"), ["aoi", "frame"]).withColumn(
        "px", constant("h", "w", warm_up(F.col("pos"), F.lit(0.0)).cast("double"))
    )
    late = motion.join(positions.where("pos >= 2"), ["aoi", "frame"])
    return early.select(*tl.COLS).unionByName(late.select(*tl.COLS))


def fuse(diff: Column, motion: Column, invalid: Column, alpha: float, tau: float) -> Column:
    """clip(D + alpha * (M - tau), 0, 255) truncated; D inside the invalid area."""
    lifted = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), diff + alpha * (motion - tau))))
    return F.when(invalid, F.floor(diff)).otherwise(lifted).cast("int")

"""Tiled frames: halo exchange, re-tiling, temporal median and warping.

A frame of any size is a set of tiles, so a task never holds a whole frame.
Each operator sends to a target tile only the strips of pixels it needs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt import schemas
from skyquilt.functions import kernels
from skyquilt.functions.batches import map_slices
from skyquilt.operators import ordering

KEY = list(schemas.TILE_KEY)
COLS = [c.split()[0] for c in schemas.TILE.split(", ")]
_DTYPES = {"u1": np.uint8, "f4": np.float32, "f8": np.float64, "i8": np.int64}


def pieces(tiles: DataFrame, tile: int, halo: int, dtype: str = "u1", keys: tuple[str, ...] = ("aoi", "frame")) -> DataFrame:
    """Strips of every tile for every target tile of side ``tile`` plus ``halo``.

    Rows: keys, ty, tx (target), height, width, pr, pc, ph, pw (strip), px.
    """
    np_type = _DTYPES[dtype]
    keys = list(keys)
    types = dict(tiles.dtypes)
    fields = ", ".join(f"{k} {types[k]}" for k in keys)
    cols = [*keys, "ty", "tx", "height", "width", "pr", "pc", "ph", "pw", "px"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                a = np.frombuffer(t.px, np_type).reshape(t.h, t.w)
                last_y, last_x = (t.height - 1) // tile, (t.width - 1) // tile
                for ty in range(max((t.r0 - halo) // tile, 0), min((t.r0 + t.h - 1 + halo) // tile, last_y) + 1):
                    ra, rb = max(ty * tile - halo, t.r0), min((ty + 1) * tile + halo, t.r0 + t.h)
                    for tx in range(max((t.c0 - halo) // tile, 0), min((t.c0 + t.w - 1 + halo) // tile, last_x) + 1):
                        ca, cb = max(tx * tile - halo, t.c0), min((tx + 1) * tile + halo, t.c0 + t.w)
                        if ra < rb and ca < cb:
                            part = a[ra - t.r0:rb - t.r0, ca - t.c0:cb - t.c0]
                            rows.append((*(getattr(t, k) for k in keys), ty, tx, t.height, t.width, ra, ca,
                                         rb - ra, cb - ca, part.tobytes()))
            yield pd.DataFrame(rows, columns=cols)

    return map_slices(tiles.select(*keys, "r0", "c0", "h", "w", "height", "width", "px"),
        run, f"{fields}, ty int, tx int, height int, width int, pr int, pc int, ph int, pw int, px binary"
    )


def assemble(strips: list, ty: int, tx: int, tile: int, halo: int, height: int, width: int, dtype) -> tuple[np.ndarray, int, int]:
    """Paste strips (pr, pc, ph, pw, px) into one array; returns it with its origin.

    The array covers the tile plus halo, clipped at the frame's edge.
    """
    ra, ca = max(ty * tile - halo, 0), max(tx * tile - halo, 0)
    rb, cb = min((ty + 1) * tile + halo, height), min((tx + 1) * tile + halo, width)
    out = np.zeros((rb - ra, cb - ca), dtype)
    for s in strips:
        part = np.frombuffer(s["px"], dtype).reshape(s["ph"], s["pw"])
        out[s["pr"] - ra:s["pr"] - ra + s["ph"], s["pc"] - ca:s["pc"] - ca + s["pw"]] = part
    return out, ra, ca


def gather(tiles: DataFrame, tile: int, halo: int, dtype: str = "u1", keys: tuple[str, ...] = ("aoi", "frame")) -> DataFrame:
    """One row per target tile with its strips as an array (at most a tile's worth)."""
    p = pieces(tiles, tile, halo, dtype, keys)
    return p.groupBy(*keys, "ty", "tx", "height", "width").agg(
        F.collect_list(F.struct("pr", "pc", "ph", "pw", "px")).alias("strips")
    )


def map_halo(
    tiles: DataFrame, tile: int, halo: int, fn: Callable, dtype: str = "u1", out: str = "u1"
) -> DataFrame:
    """Apply ``fn(array, origin, frame_shape) -> array`` to tiles with a halo.

    ``fn`` gets the halo'd array and returns one of the same shape; only the
    tile's own part is kept.
    """
    src, dst = _DTYPES[dtype], _DTYPES[out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                a, ra, ca = assemble(t.strips, t.ty, t.tx, tile, halo, t.height, t.width, src)
                b = fn(a, (ra, ca), (t.height, t.width))
                r0, c0 = t.ty * tile, t.tx * tile
                own = np.ascontiguousarray(b[r0 - ra:r0 - ra + tile, c0 - ca:c0 - ca + tile], dtype=dst)
                rows.append((t.aoi, t.frame, t.ty, t.tx, r0, c0, *own.shape, t.height, t.width, own.tobytes()))
            yield pd.DataFrame(rows, columns=COLS)

    types = dict(tiles.dtypes)
    return map_slices(gather(tiles, tile, halo, dtype),
        run, schemas.TILE.replace("aoi STRING", f"aoi {types['aoi']}")
    )


def retile(tiles: DataFrame, tile: int, dtype: str = "u1") -> DataFrame:
    """Same pixels in tiles of another side."""
    return map_halo(tiles, tile, 0, lambda a, origin, shape: a, dtype, dtype)


# ---------------------------------------------------------------- temporal

def temporal_median(tiles: DataFrame, n: int, chunk: int = 64) -> DataFrame:
    """Median of the previous ``n`` registered tiles (float64; even n averages).

    Each tile position is one sequence, cut into time chunks with ``n`` rows of
    overlap; frames without ``n`` predecessors give no row. Only keys are ranked;
    the pixels join the chunks once.
    """
    place = ["aoi", "ty", "tx"]
    ranked = ordering.position(tiles.select(*place, "frame"), place, ["frame"], ordering.by_width("frame", 4096))
    span = max(chunk, n)
    ranked = ranked.withColumn("own", ordering.by_width("pos", span)).withColumn(
        "part", F.explode(F.array_distinct(F.array("own", ordering.by_width(F.col("pos") + n, span))))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, window = [], None
        for t in pdf.sort_values("pos").itertuples(index=False):
            if window is None:
                window = kernels.SlidingMedian(n, t.h * t.w)
            if t.own == t.part and t.pos >= n:
                rows.append((t.aoi, t.frame, t.ty, t.tx, t.r0, t.c0, t.h, t.w, t.height, t.width, window.value().tobytes()))
            window.push(np.frombuffer(t.px, np.uint8))
        return pd.DataFrame(rows, columns=COLS)

    types = dict(tiles.dtypes)
    return tiles.join(ranked, [*place, "frame"]).groupBy(*place, "part").applyInPandas(run, schemas.TILE.replace("aoi STRING", f"aoi {types['aoi']}"))


def frame_max_scaled(tiles: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Divide float32 tiles by their frame's maximum where that exceeds ``floor``.

    Only one number per tile is shuffled for the maximum.
    """
    @F.pandas_udf("float")
    def peak(px: pd.Series) -> pd.Series:
        return px.map(lambda b: float(np.frombuffer(b, np.float32).max()))

    @F.pandas_udf("binary")
    def scale(px: pd.Series, top: pd.Series) -> pd.Series:
        return pd.Series([
            (np.frombuffer(b, np.float32) / np.float32(m)).astype(np.float32).tobytes() if m > floor else bytes(b)
            for b, m in zip(px, top)
        ])

    top = tiles.groupBy("aoi", "frame").agg(F.max(peak("px")).alias("_top"))
    return tiles.join(top, ["aoi", "frame"]).withColumn("px", scale("px", "_top")).select(*COLS)


# ------------------------------------------------------------------ warping

def source_tiles_needed(inv: np.ndarray, ty: int, tx: int, tile: int, height: int, width: int) -> list[tuple[int, int]]:
    """Source tiles that hold a pixel around a sample of a target tile.

    The target tile is parted in four while the horizon (w = 0) crosses a part or
    its corners span more than two source tiles along an axis; parts of a few
    pixels are sampled. So only tiles that are hit are named, also at the horizon.
    """
    r1, c1 = min((ty + 1) * tile, height), min((tx + 1) * tile, width)
    stack, hit = [(ty * tile, tx * tile, r1, c1)], set()
    while stack:
        ra, ca, rb, cb = stack.pop()
        q = np.array([[ca, ra, 1], [cb - 1, ra, 1], [ca, rb - 1, 1], [cb - 1, rb - 1, 1]], np.float64) @ inv.T
        if (q[:, 2] > 1e-9).all() or (q[:, 2] < -1e-9).all():
            x, y = q[:, 0] / q[:, 2], q[:, 1] / q[:, 2]
            if y.max() < -1.5 or x.max() < -1.5 or y.min() > height or x.min() > width:
                continue
            rows = max(math.floor(y.min() - 1e-6), 0) // tile, min(math.floor(y.max() + 1e-6) + 1, height - 1) // tile
            cols = max(math.floor(x.min() - 1e-6), 0) // tile, min(math.floor(x.max() + 1e-6) + 1, width - 1) // tile
            if rows[1] - rows[0] < 2 and cols[1] - cols[0] < 2:
                hit.update((r, c) for r in range(rows[0], rows[1] + 1) for c in range(cols[0], cols[1] + 1))
                continue
        if (rb - ra) * (cb - ca) <= 1024:
            hit.update(map(tuple, kernels.tiles_hit(*kernels.warp_coords(inv, ra, ca, rb - ra, cb - ca), tile, height, width).tolist()))
            continue
        rm, cm = (ra + rb + 1) // 2, (ca + cb + 1) // 2
        stack += [(a, c, b, d) for a, b in ((ra, rm), (rm, rb)) for c, d in ((ca, cm), (cm, cb)) if a < b and c < d]
    return sorted(hit)


def warp(tiles: DataFrame, pairs: DataFrame, tile: int, fill: int = 255) -> DataFrame:
    """Registered templates: (aoi, dst_frame, slot, ty, tx, ..., px).

    ``pairs``: aoi, dst_frame, slot, src_frame, h (source -> target). A source
    tile meets one target tile at a time and gives the pixels it holds around that
    tile's samples; a target tile then gathers these, four for each of its pixels
    at most, however many source tiles they come from. Source and target frames
    share their size; ``tiles`` have side ``tile``.
    """
    aoi = dict(tiles.dtypes)["aoi"]
    shape = tiles.groupBy("aoi", "frame").agg(F.first("height").alias("height"), F.first("width").alias("width"))
    plan = pairs.join(shape.withColumnRenamed("frame", "src_frame"), ["aoi", "src_frame"])
    target = ["aoi", "dst_frame", "slot", "src_frame", "ty", "tx"]
    fields = f"aoi {aoi}, dst_frame int, slot int, src_frame int, ty int, tx int, h array<double>, height int, width int, "

    def needs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf.itertuples(index=False):
                inv = np.linalg.inv(np.array(p.h).reshape(3, 3))
                rows = []
                for ty in range((p.height - 1) // tile + 1):
                    for tx in range((p.width - 1) // tile + 1):
                        got = source_tiles_needed(inv, ty, tx, tile, p.height, p.width)
                        rows += [(p.aoi, p.dst_frame, p.slot, p.src_frame, ty, tx, p.h, p.height, p.width, y, x) for y, x in got or [(-1, -1)]]
                yield pd.DataFrame(rows, columns=[*target, "h", "height", "width", "sy", "sx"])

    def samples(t):
        inv = np.linalg.inv(np.array(t.h).reshape(3, 3))
        r0, c0 = t.ty * tile, t.tx * tile
        return r0, c0, *kernels.warp_coords(inv, r0, c0, min(tile, t.height - r0), min(tile, t.width - c0))

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            part = []
            for t in pdf.itertuples(index=False):
                if t.px is None:
                    part.append(None)
                    continue
                _, _, x, y = samples(t)
                r, c = kernels.corners_of(x, y)
                four = np.zeros(r.shape, np.uint8)
                ok = kernels.pick_corners({"pr": t.sy * tile, "pc": t.sx * tile, "ph": t.ph, "pw": t.pw, "px": t.px}, r, c, four)
                part.append({"which": np.packbits(ok).tobytes(), "v": four[ok].tobytes()})
            yield pdf.drop(columns=["sy", "sx", "ph", "pw", "px"]).assign(part=part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                r0, c0, x, y = samples(t)
                four = np.full((4, *x.shape), fill, np.uint8)
                for p in t.parts:
                    ok = np.unpackbits(np.frombuffer(p["which"], np.uint8), count=four.size).view(bool).reshape(four.shape)
                    four[ok] = np.frombuffer(p["v"], np.uint8)
                out = kernels.blend(four, x, y)
                rows.append((t.aoi, t.dst_frame, t.slot, t.src_frame, t.ty, t.tx, r0, c0, *x.shape, t.height, t.width, out.tobytes()))
            yield pd.DataFrame(rows, columns=["aoi", "dst_frame", "slot", "src_frame", *COLS[2:]])

    wanted = map_slices(plan.select("aoi", "dst_frame", "slot", "src_frame", "h", "height", "width"), needs, fields + "sy int, sx int")
    src = tiles.select("aoi", F.col("frame").alias("src_frame"), F.col("ty").alias("sy"), F.col("tx").alias("sx"),
                       F.col("h").alias("ph"), F.col("w").alias("pw"), "px")
    met = wanted.join(src, ["aoi", "src_frame", "sy", "sx"], "left").select(*target, "h", "height", "width", "sy", "sx", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ph", "pw")], "px")
    fed = map_slices(met, corners, fields + "part struct<which:binary,v:binary>").groupBy(*target).agg(
        F.first("h").alias("h"), F.first("height").alias("height"), F.first("width").alias("width"), F.collect_list("part").alias("parts"))
    return map_slices(fed, run, f"aoi {aoi}, dst_frame int, slot int, src_frame int, " + schemas.TILE.split(", ", 2)[2])


def crop(tiles: DataFrame, windows: DataFrame, tile: int) -> DataFrame:
    """Bilinear crops of tiled frames on geographic grids, nodata 0.

    ``windows``: src_aoi, frame, aoi, gt (source geotransform), out_gt,
    out_height, out_width. A crop is a warp whose matrix maps source pixels to
    output pixels, so the same fan-in applies.
    """
    aoi = dict(windows.dtypes)["aoi"]

    def matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for w in pdf.itertuples(index=False):
                src, dst = kernels.affine3(w.gt), kernels.affine3(w.out_gt)
                inv = np.linalg.inv(src) @ dst  # output pixel -> degrees -> source pixel
                for ty in range((w.out_height - 1) // tile + 1):
                    for tx in range((w.out_width - 1) // tile + 1):
                        r0, c0 = ty * tile, tx * tile
                        r1, c1 = min(r0 + tile, w.out_height), min(c0 + tile, w.out_width)
                        q = np.array([[c0, r0, 1], [c1, r0, 1], [c0, r1, 1], [c1, r1, 1]]) @ inv.T
                        rows.append((w.src_aoi, w.frame, w.aoi, ty, tx, inv.ravel(), w.out_height, w.out_width,
                                     float(q[:, 1].min() - 1), float(q[:, 1].max() + 1), float(q[:, 0].min() - 1), float(q[:, 0].max() + 1)))
            yield pd.DataFrame(rows, columns=["src_aoi", "frame", "aoi", "ty", "tx", "inv", "oh", "ow", "ra", "rb", "ca", "cb"])

    fields = f"src_aoi {dict(windows.dtypes)['src_aoi']}, frame int, aoi {aoi}, ty int, tx int, inv array<double>, oh int, ow int, ra double, rb double, ca double, cb double"
    need = map_slices(windows, matrix, fields)
    # tiles are addressed by their index, so the range join is an equi-join
    need = need.withColumn("sy", F.explode(F.sequence(F.greatest(F.floor(F.col("ra") / tile), F.lit(-1)).cast("int"), F.greatest(F.floor(F.col("rb") / tile), F.lit(-1)).cast("int"))))
    need = need.withColumn("sx", F.explode(F.sequence(F.greatest(F.floor(F.col("ca") / tile), F.lit(-1)).cast("int"), F.greatest(F.floor(F.col("cb") / tile), F.lit(-1)).cast("int"))))
    src = tiles.select(F.col("aoi").alias("src_aoi"), "frame", F.col("ty").alias("sy"), F.col("tx").alias("sx"), F.col("height").alias("sh"), F.col("width").alias("sw"),
                       F.struct(F.col("r0").alias("pr"), F.col("c0").alias("pc"), F.col("h").alias("ph"), F.col("w").alias("pw"), "px").alias("piece"))
    fed = need.join(src, ["src_aoi", "frame", "sy", "sx"], "left").groupBy("aoi", "frame", "ty", "tx", "inv", "oh", "ow").agg(
        F.collect_list("piece").alias("strips"), F.max("sh").alias("sh"), F.max("sw").alias("sw"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                r0, c0 = t.ty * tile, t.tx * tile
                hh, ww = min(tile, t.oh - r0), min(tile, t.ow - c0)
                if len(t.strips):
                    out = kernels.warp_tile(t.strips, np.array(t.inv).reshape(3, 3), r0, c0, hh, ww, int(t.sh), int(t.sw), 0, centre=0.5)
                else:
                    out = np.zeros((hh, ww), np.uint8)
                rows.append((t.aoi, t.frame, t.ty, t.tx, r0, c0, hh, ww, t.oh, t.ow, out.tobytes()))
            yield pd.DataFrame(rows, columns=COLS)

    return map_slices(fed, run, schemas.TILE.replace("aoi STRING", f"aoi {aoi}"))

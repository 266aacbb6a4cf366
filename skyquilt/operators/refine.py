"""From candidates to detections: patches, scoring, regions, windows, peaks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt import schemas
from skyquilt.functions import kernels
from skyquilt.functions.batches import ROWS, map_slices
from skyquilt.operators import background as bg, ordering, tiles as tl

CHANNELS = 4
SCREEN_HALF, WINDOW_HALF = 10, 22
ACCEPT_SCORE = 0.7
#: Maps whose peaks are found at once.
PEAK_MAPS = 64
PEAK_LIMIT = 0.17

#: Patches that leave a task together.
PATCHES = 256


# ------------------------------------------------------------------ patches

def screen_fits(r: str = "r", c: str = "c", height: str = "height", width: str = "width") -> Column:
    """A 21x21 patch lies inside the frame; row and column 0 are excluded."""
    r, c, h, w = F.col(r), F.col(c), F.col(height), F.col(width)
    return (r - 10 > 0) & (c - 10 > 0) & (r + 11 < h) & (c + 11 < w)


def window_fits(r: Column, c: Column, height: Column, width: Column) -> Column:
    """A 45x45 window round a fractional centre lies inside the frame."""
    def low(v):
        return (v - WINDOW_HALF).cast("int")

    def high(v):
        return (v + WINDOW_HALF).cast("int")

    return (low(r) > 0) & (low(c) > 0) & (high(r) < height) & (high(c) < width)


def channels(current: DataFrame, compensated: DataFrame, n: int) -> DataFrame:
    """Channel tiles (ch 0..3 = t, t-1, t-2, t-3) of frames that have templates.

    ``compensated``: aoi, frame, slot, tile columns; slot n - 1 is t - 1.
    """
    past = compensated.where(F.col("slot") >= n - 3).withColumn("ch", (F.lit(n) - F.col("slot")).cast("int"))
    ready = compensated.select("aoi", "frame").distinct()
    now = current.join(ready, ["aoi", "frame"], "left_semi").withColumn("ch", F.lit(0))
    cols = ["aoi", "frame", "ch", *tl.COLS[2:]]
    return now.select(*cols).unionByName(past.select(*cols))


def _patches(channel_tiles: DataFrame, points: DataFrame, tile: int, half: int) -> tuple[DataFrame, Callable, str]:
    """Tiles that have points, the task's function that cuts the patches, and the fields without ``px``."""
    side = 2 * half + 1
    aoi = dict(channel_tiles.dtypes)["aoi"]
    strips = tl.pieces(channel_tiles, tile, half, "u1", ("aoi", "frame", "ch"))
    at = points.groupBy(
        "aoi", "frame", F.floor(F.col("r") / tile).cast("int").alias("ty"), F.floor(F.col("c") / tile).cast("int").alias("tx")
    ).agg(F.collect_list(F.struct("pid", "r", "c", "info")).alias("points"))
    fed = strips.groupBy("aoi", "frame", "ty", "tx", "height", "width").agg(
        F.collect_list(F.struct("ch", "pr", "pc", "ph", "pw", "px")).alias("strips")
    ).join(at, ["aoi", "frame", "ty", "tx"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                layers = []
                for ch in range(CHANNELS):
                    part = [s for s in t.strips if s["ch"] == ch]
                    a, ra, ca = tl.assemble(part, t.ty, t.tx, tile, half, t.height, t.width, np.uint8)
                    layers.append(a)
                cube = np.stack(layers)
                for k in range(0, len(t.points), PATCHES):
                    rows = []
                    for p in t.points[k:k + PATCHES]:
                        r, c = p["r"] - half - ra, p["c"] - half - ca
                        patch = cube[:, r:r + side, c:c + side].astype(np.float32)
                        rows.append((t.aoi, t.frame, p["pid"], p["r"], p["c"], p["info"], patch.ravel()))
                    yield pd.DataFrame(rows, columns=["aoi", "frame", "pid", "r", "c", "info", "px"])

    return fed, run, f"aoi {aoi}, frame int, pid long, r int, c int, info array<bigint>"


def extract_patches(channel_tiles: DataFrame, points: DataFrame, tile: int, half: int) -> DataFrame:
    """Patches of side 2 * half + 1 round integer centres, flattened channel-first.

    ``points``: aoi, frame, pid, r, c, info (array<bigint>, carried along). Only
    tiles with points are unpacked; a tile's strips and points are bounded by
    its area.
    """
    fed, run, fields = _patches(channel_tiles, points, tile, half)
    return map_slices(fed, run, f"{fields}, px array<float>")


def score_patches(channel_tiles: DataFrame, points: DataFrame, tile: int, half: int, load: Callable, mean: np.ndarray | None = None) -> DataFrame:
    """``score`` of ``extract_patches``, in the task that cuts the patches: no patch leaves it."""
    fed, cut, fields = _patches(channel_tiles, points, tile, half)
    side = 2 * half + 1
    run = _scores(load, (CHANNELS, side, side), mean)
    return map_slices(fed, lambda batches: run(cut(batches)), f"{fields}, pred array<float>")


# ------------------------------------------------------------------ scoring

def onnx_model(path: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Loader of an ONNX file; each worker opens it once."""
    def load():
        import onnxruntime

        s = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = s.get_inputs()[0].name
        return lambda x: s.run(None, {name: x})[0]

    return load


def _scores(load: Callable, shape: tuple[int, ...], mean: np.ndarray | None, batch: int = 512, out: str = "pred", double: bool = False) -> Callable:
    """The task's function of ``score``."""
    kind = np.float64 if double else np.float32
    if mean is not None:
        mean = np.asarray(mean, kind)
        mean = mean.reshape(-1, *[1] * (len(shape) - 1)) if mean.size == shape[0] else mean.reshape(shape)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            if not len(pdf):
                continue
            model = model or load()
            preds = []
            for i in range(0, len(pdf), batch):
                x = np.stack(pdf.px.iloc[i:i + batch].to_numpy()).astype(kind).reshape(-1, *shape)
                if mean is not None:
                    x = x - mean
                preds.extend(np.asarray(model(x), kind).reshape(len(x), -1))
            yield pdf.drop(columns="px").assign(**{out: preds})

    return run


def score(
    df: DataFrame,
    load: Callable[[], Callable[[np.ndarray], np.ndarray]],
    shape: tuple[int, ...],
    mean: np.ndarray | None = None,
    batch: int = 512,
    out: str = "pred",
    double: bool = False,
) -> DataFrame:
    """Batched prediction on ``px``: replaces it by ``out`` (array<float>).

    ``load`` returns a batch function (n, *shape) -> (n, m) and is called once
    per task. ``mean`` (per channel or per element) is subtracted first; its
    size is fixed by the patch shape. With ``double`` the model gets and gives
    double precision (array<double>).
    """
    keep = [c for c in df.columns if c != "px"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return map_slices(df, _scores(load, shape, mean, batch, out, double), f"{fields}, {out} array<{'double' if double else 'float'}>")


def accept(scored: DataFrame, limit: float = ACCEPT_SCORE) -> DataFrame:
    """Class-0 probability strictly above the limit."""
    return scored.where(F.col("pred")[0] > F.lit(limit).cast("float"))


# ------------------------------------------------------------------ regions

def region_mask(centres: DataFrame, tile: int, half: int = 3) -> DataFrame:
    """Mask tiles of the union of 7x7 squares round accepted centres."""
    aoi = dict(centres.dtypes)["aoi"]
    lo_r, lo_c = F.greatest(F.col("r") - half, F.lit(0)), F.greatest(F.col("c") - half, F.lit(0))
    hi_r, hi_c = F.least(F.col("r") + half, F.col("height") - 1), F.least(F.col("c") + half, F.col("width") - 1)
    d = centres.select("aoi", "frame", "r", "c", "height", "width").distinct()
    d = d.withColumn("ty", F.explode(F.sequence(F.floor(lo_r / tile).cast("int"), F.floor(hi_r / tile).cast("int"))))
    d = d.withColumn("tx", F.explode(F.sequence(F.floor(lo_c / tile).cast("int"), F.floor(hi_c / tile).cast("int"))))
    d = d.groupBy("aoi", "frame", "ty", "tx", "height", "width").agg(F.collect_list(F.struct("r", "c")).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                r0, c0 = t.ty * tile, t.tx * tile
                m = np.zeros((min(tile, t.height - r0), min(tile, t.width - c0)), np.uint8)
                for p in t.at:
                    m[max(p["r"] - half - r0, 0):max(p["r"] + half + 1 - r0, 0), max(p["c"] - half - c0, 0):max(p["c"] + half + 1 - c0, 0)] = 1
                rows.append((t.aoi, t.frame, t.ty, t.tx, r0, c0, *m.shape, t.height, t.width, m.tobytes()))
            yield pd.DataFrame(rows, columns=tl.COLS)

    return map_slices(d, run, schemas.TILE.replace("aoi STRING", f"aoi {aoi}"))


def plan_windows(regions: DataFrame) -> DataFrame:
    """Regression windows of every region, with their upper-left pixel.

    A region of at most 22.5 on both sides has one window at its centroid; a
    larger one is covered by a grid of step 22. ``regions`` also carries height
    and width; windows that leave the frame are dropped.
    """
    small = (F.col("r1") - F.col("r0") <= 22.5) & (F.col("c1") - F.col("c0") <= 22.5)

    def axis(low, high, centre):
        start = F.least(F.col(low) + WINDOW_HALF / 2, F.col(centre))
        end = F.greatest(F.col(high).cast("double"), F.col(centre))
        steps = F.floor((end - start) / WINDOW_HALF).cast("int")
        return F.when(small, F.array(F.struct(F.lit(0).alias("k"), F.col(centre).alias("at")))).otherwise(
            F.transform(F.sequence(F.lit(0), steps), lambda k: F.struct(k.alias("k"), (start + k * WINDOW_HALF).alias("at")))
        )

    d = regions.withColumn("rr", F.explode(axis("r0", "r1", "centroid_r"))).withColumn("cc", F.explode(axis("c0", "c1", "centroid_c")))
    d = d.where(window_fits(F.col("rr.at"), F.col("cc.at"), F.col("height"), F.col("width")))
    return d.select(
        "aoi", "frame", "region_id", "r0", "c0", "r1", "c1", F.col("rr.k").alias("wi"), F.col("cc.k").alias("wj"),
        (F.col("rr.at") - WINDOW_HALF).cast("int").alias("min_r"), (F.col("cc.at") - WINDOW_HALF).cast("int").alias("min_c"),
    )


def window_points(windows: DataFrame) -> DataFrame:
    """Windows as patch points; ``info`` carries region, grid step, box and origin."""
    return windows.select(
        "aoi", "frame", F.col("region_id").cast("long").alias("pid"),
        (F.col("min_r") + WINDOW_HALF).alias("r"), (F.col("min_c") + WINDOW_HALF).alias("c"),
        F.array(*[F.col(c).cast("long") for c in ("region_id", "wi", "wj", "r0", "c0", "r1", "c1", "min_r", "min_c")]).alias("info"),
    )


# -------------------------------------------------------------------- peaks

def resize_heatmap(heat: Column, side: int = 45) -> Column:
    """15x15 response -> side x side by bilinear resize (array<float>)."""
    @F.pandas_udf("array<float>")
    def grow(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(v):
            n = int(round(len(v) ** 0.5))
            return kernels.bilinear(np.asarray(v, np.float32).reshape(n, n), side, side).astype(np.float32).ravel()

        for h in batches:
            for at in range(0, len(h), ROWS):
                yield h.iloc[at:at + ROWS].map(one)

    return grow(heat)


def peaks(responses: DataFrame, limit: float = PEAK_LIMIT, col: str = "pred", side: int = 45) -> DataFrame:
    """Peak pixels of each window: replaces the response by (k, pr, pc) rows."""
    keep = [c for c in responses.columns if c != col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            maps = []
            for v in pdf[col]:
                n = int(round(len(v) ** 0.5))
                heat = np.asarray(v, np.float32).reshape(n, n)
                maps.append(heat if n == side else kernels.bilinear(heat, side, side).astype(np.float32))
            cells = [c for at in range(0, len(maps), PEAK_MAPS) for c in kernels.heatmap_peaks(np.stack(maps[at:at + PEAK_MAPS]), limit)]
            yield pdf[keep].assign(found=[[{"k": i, "pr": r, "pc": c} for i, (r, c) in enumerate(found)] for found in cells])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in responses.select(*keep).schema)
    d = map_slices(responses, run, f"{fields}, found array<struct<k:int,pr:int,pc:int>>")
    return d.select(*keep, F.explode("found").alias("p")).select(*keep, "p.k", "p.pr", "p.pc")


def inside_box(peak_rows: DataFrame) -> DataFrame:
    """Strictly inside all four sides of the region's box."""
    r, c = F.col("r"), F.col("c")
    return peak_rows.where((r > F.col("r0")) & (r < F.col("r1")) & (c > F.col("c0")) & (c < F.col("c1")))


def window_detections(responses: DataFrame, limit: float = PEAK_LIMIT) -> DataFrame:
    """Peaks of all windows in frame coordinates, inside their region's box.

    ``seq`` is the place in the order of region, window and peak.
    """
    d = peaks(responses.select("aoi", "frame", "info", "pred"), limit)
    names = ["region_id", "wi", "wj", "r0", "c0", "r1", "c1", "min_r", "min_c"]
    d = d.select("aoi", "frame", "k", "pr", "pc", *[F.col("info")[i].alias(n) for i, n in enumerate(names)])
    d = ordering.position(d, ["aoi", "frame"], ["region_id", "wi", "wj", "k"], ordering.by_width("region_id", 1 << 20), "seq")
    d = d.select("aoi", "frame", "seq", (F.col("pr") + F.col("min_r")).cast("int").alias("r"),
                 (F.col("pc") + F.col("min_c")).cast("int").alias("c"), "r0", "c0", "r1", "c1")
    return inside_box(d).select("aoi", "frame", "seq", "r", "c")


def diagonal_coords(r: Column, c: Column) -> Column:
    """The eleven (r - 5 + i, c - 5 + i) points of a detection."""
    return F.transform(F.sequence(F.lit(-5), F.lit(5)), lambda i: F.struct((r + i).alias("r"), (c + i).alias("c")))


# -------------------------------------------------------------- scene prior

def prior_inputs(tiles: DataFrame, side: int = 256) -> DataFrame:
    """Frames reduced to side x side in [0, 1]; tiles send only the sampled pixels.

    Each tile adds its share of the four-pixel blends it takes part in, so the
    frame itself is never assembled.
    """
    aoi = dict(tiles.dtypes)["aoi"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def taps(n, lo, hi):
            x = (np.arange(side) + 0.5) * n / side - 0.5
            i = np.floor(x).astype(int)
            f = x - i
            idx = np.concatenate([np.clip(i, 0, n - 1), np.clip(i + 1, 0, n - 1)])
            wt, to = np.concatenate([1 - f, f]), np.concatenate([np.arange(side)] * 2)
            on = (idx >= lo) & (idx < hi)
            return to[on], idx[on] - lo, wt[on]

        for pdf in batches:
            parts = []
            for t in pdf.itertuples(index=False):
                a = np.frombuffer(t.px, np.uint8).reshape(t.h, t.w).astype(np.float64)
                ti, si, wi = taps(t.height, t.r0, t.r0 + t.h)
                tj, sj, wj = taps(t.width, t.c0, t.c0 + t.w)
                if not len(ti) or not len(tj):
                    continue
                part = a[np.ix_(si, sj)] * wi[:, None] * wj[None, :]
                cell = ti[:, None] * side + tj[None, :]
                flat = np.bincount(cell.ravel(), weights=part.ravel(), minlength=side * side)
                on = np.unique(cell)
                parts.append(pd.DataFrame({"aoi": t.aoi, "frame": t.frame, "height": t.height, "width": t.width, "cell": on, "v": flat[on]}))
            if parts:
                yield pd.concat(parts)

    d = map_slices(tiles.select("aoi", "frame", "r0", "c0", "h", "w", "height", "width", "px"),
        run, f"aoi {aoi}, frame int, height int, width int, cell int, v double"
    ).groupBy("aoi", "frame", "height", "width", "cell").agg(F.floor(F.sum("v") + 0.5).alias("v"))
    d = d.groupBy("aoi", "frame", "height", "width").agg(F.sort_array(F.collect_list(F.struct("cell", "v"))).alias("s"))
    return d.select("aoi", "frame", "height", "width", F.transform("s", lambda e: (e["v"] / 255.0).cast("float")).alias("px"))


def prior_cells(priors: DataFrame) -> DataFrame:
    """Priors (aoi, frame, height, width, pred) as a row for each cell: aoi, frame, cell, v."""
    return priors.select("aoi", "frame", F.posexplode("pred").alias("cell", "v")).withColumn("v", F.col("v").cast("double"))


def prior_values(points: DataFrame, priors: DataFrame, side: int) -> DataFrame:
    """Distinct points (aoi, frame, r, c) with ``prior``: the prior resized to the frame (bilinear) at that pixel.

    Each point meets four cells by an equi-join; the full-size map is not built
    and no row holds a whole prior. Points of frames without a prior are left out.
    """
    at = ["aoi", "frame", "r", "c"]
    p = points.select("aoi", "frame", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).distinct()
    p = p.join(priors.select("aoi", "frame", "height", "width"), ["aoi", "frame"])
    last = F.lit(side - 1)
    for v, n in (("r", "height"), ("c", "width")):
        x = (F.col(v) + 0.5) * side / F.col(n) - 0.5
        p = p.withColumns({f"_{v}": F.floor(x), f"_f{v}": x - F.floor(x)})
    cells = [F.least(F.greatest(F.col("_r") + i, F.lit(0)), last) * side + F.least(F.greatest(F.col("_c") + j, F.lit(0)), last) for i in (0, 1) for j in (0, 1)]
    taps = p.select(*at, "_fr", "_fc", F.posexplode(F.array(*cells)).alias("k", "cell")).join(
        prior_cells(priors), ["aoi", "frame", "cell"])
    four = taps.groupBy(*at).agg(F.first("_fr").alias("_fr"), F.first("_fc").alias("_fc"), *[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"_{k}") for k in range(4)])
    fr, fc, v = F.col("_fr"), F.col("_fc"), [F.col(f"_{k}") for k in range(4)]
    return four.select(*at, ((v[0] * (1 - fc) + v[1] * fc) * (1 - fr) + (v[2] * (1 - fc) + v[3] * fc) * fr).alias("prior"))


def scene_prior_filter(dets: DataFrame, priors: DataFrame, limit: float = 0.0, side: int = 256) -> DataFrame:
    """Keep detections whose prior is at least ``limit``; priors: aoi, frame, height, width, pred."""
    keep = prior_values(dets, priors, side).filter(F.col("prior") >= limit)
    keep = keep.select("aoi", "frame", F.col("r").alias("_r"), F.col("c").alias("_c"))
    named = dets.withColumns({"_r": F.col("r").cast("int"), "_c": F.col("c").cast("int")})
    return named.join(keep, ["aoi", "frame", "_r", "_c"], "left_semi").drop("_r", "_c")


def first_peaks(peak_rows: DataFrame, patch: list[str]) -> DataFrame:
    """Each position once per patch, with its first sequence number."""
    return peak_rows.groupBy(*patch, "r", "c").agg(F.min("seq").alias("seq"))

"""Background subtraction on tile stacks, plain and motion-aware."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt import schemas
from skyquilt.functions import kernels
from skyquilt.functions.batches import map_slices
from skyquilt.operators import components, tiles as tl

CURRENT, INVALID, MOTION = -1, -2, -3
BLUR_SIZE, BLUR_SIGMA = 21, 8.0
HALO = BLUR_SIZE // 2 + 2  # blur reach plus the opening's two pixels
STACK = ("aoi", "frame", "slot")


def identity_templates(tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Templates for frames that are registered already: a join on tile keys."""
    src = tiles.withColumnRenamed("frame", "src_frame")
    return pairs.select("aoi", "dst_frame", "slot", "src_frame").join(src, ["aoi", "src_frame"])


def stack(current: DataFrame, templates: DataFrame, tile: int, halo: int,
          invalid: DataFrame | None = None, motion: DataFrame | None = None) -> DataFrame:
    """One row per tile with the strips of all its layers (templates + 1, bounded)."""
    def layer(df, slot, dtype="u1"):
        return tl.pieces(df.withColumn("slot", F.lit(slot)), tile, halo, dtype, STACK)

    ready = templates.select("aoi", "dst_frame").distinct().withColumnRenamed("dst_frame", "frame")
    parts = [
        tl.pieces(templates.select("aoi", F.col("dst_frame").alias("frame"), "slot", *tl.COLS[2:]), tile, halo, "u1", STACK),
        layer(current.join(ready, ["aoi", "frame"], "left_semi"), CURRENT),
    ]
    if invalid is not None:
        parts.append(layer(invalid, INVALID))
    if motion is not None:
        parts.append(layer(motion, MOTION, "f4"))
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    d = d.groupBy("aoi", "frame", "ty", "tx", "height", "width").agg(
        F.collect_list(F.struct("slot", "pr", "pc", "ph", "pw", "px")).alias("strips")
    )
    return d.where(F.exists("strips", lambda s: s["slot"] == CURRENT) & F.exists("strips", lambda s: s["slot"] >= 0))


def compensate(template: np.ndarray, image: np.ndarray, origin, shape, mode: str) -> np.ndarray:
    """Template brightness moved to the image's local mean, as bytes."""
    diff = image.astype(np.float64) - template
    v = template + kernels.blur(diff, kernels.gaussian_weights(BLUR_SIZE, BLUR_SIGMA), origin, shape)
    if mode == "clip":
        return np.clip(v, 0, 255).astype(np.uint8)
    return (np.trunc(v).astype(np.int64) & 255).astype(np.uint8)


def _layers(strips, ty, tx, tile, halo, height, width) -> tuple[dict, tuple[int, int]]:
    by_slot: dict[int, list] = {}
    for s in strips:
        by_slot.setdefault(int(s["slot"]), []).append(s)
    out, origin = {}, (0, 0)
    for slot, part in by_slot.items():
        dtype = np.float32 if slot == MOTION else np.uint8
        a, r, c = tl.assemble(part, ty, tx, tile, halo, height, width, dtype)
        out[slot], origin = a, (r, c)
    return out, origin


def _subtract(layers: dict, origin, shape, *, threshold, brightness, motion_aware, alpha, tau) -> dict:
    image = layers[CURRENT]
    slots = sorted(s for s in layers if s >= 0)
    temps = [layers[s] for s in slots]
    if brightness:
        temps = [compensate(t, image, origin, shape, brightness) for t in temps]
    median = np.median(np.stack(temps), axis=0)
    if motion_aware:
        median = median.astype(np.uint8).astype(np.float64)
    diff = np.abs(image.astype(np.float64) - median)
    bad = layers.get(INVALID)
    bad = np.zeros(image.shape, bool) if bad is None else bad != 0
    value = diff
    if motion_aware:
        m = layers.get(MOTION)
        m = np.ones(image.shape, np.float32) if m is None else m
        lifted = diff.astype(np.float32) + np.float32(alpha) * (m - np.float32(tau))
        lifted[bad] = diff[bad]
        value = np.clip(lifted, 0, 255).astype(np.uint8)
    raw = ((value >= threshold) & ~bad).astype(np.uint8)
    return {
        "templates": temps, "median": median, "diff": diff, "enhanced": np.asarray(value, np.float64),
        "raw": raw, "opened": kernels.open_2x2(raw),
    }


STAGES = ("median", "diff", "enhanced", "raw", "opened")


def subtract(
    stacks: DataFrame,
    tile: int,
    threshold: float = 10,
    brightness: str | None = "clip",
    motion_aware: bool = False,
    alpha: float = 10.0,
    tau: float = 0.1,
    halo: int = HALO,
    keep: Sequence[str] = ("opened", "templates"),
) -> DataFrame:
    """Run the whole subtraction of a tile in one pass over its stack.

    Output: tile columns with ``px`` = the opened mask, and one more column per
    name in ``keep``: ``templates`` (array of bytes), ``median``, ``diff``,
    ``enhanced`` (float64 bytes), ``raw`` (bytes).
    """
    extra = [k for k in keep if k != "opened"]
    kinds = {"templates": "array<binary>"}
    fields = "".join(f", {k} {kinds.get(k, 'binary')}" for k in extra)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                shape = (t.height, t.width)
                layers, origin = _layers(t.strips, t.ty, t.tx, tile, halo, *shape)
                got = _subtract(layers, origin, shape, threshold=threshold, brightness=brightness,
                                motion_aware=motion_aware, alpha=alpha, tau=tau)
                r0, c0 = t.ty * tile, t.tx * tile

                def own(a, dtype):
                    part = a[r0 - origin[0]:r0 - origin[0] + tile, c0 - origin[1]:c0 - origin[1] + tile]
                    return np.ascontiguousarray(part, dtype=dtype)

                mask = own(got["opened"], np.uint8)
                more = []
                for k in extra:
                    if k == "templates":
                        more.append([own(a, np.uint8).tobytes() for a in got[k]])
                    else:
                        more.append(own(got[k], np.uint8 if k == "raw" else np.float64).tobytes())
                rows.append((t.aoi, t.frame, t.ty, t.tx, r0, c0, *mask.shape, *shape, mask.tobytes(), *more))
            yield pd.DataFrame(rows, columns=[*tl.COLS, *extra])

    aoi = dict(stacks.dtypes)["aoi"]
    return map_slices(stacks, run, schemas.TILE.replace("aoi STRING", f"aoi {aoi}") + fields)


# ------------------------------------------------------------- invalid area

def saturated(tiles: DataFrame) -> DataFrame:
    """Mask tiles of pixels that are 0 or 255."""
    @F.pandas_udf("binary")
    def blank(px: pd.Series) -> pd.Series:
        def one(b):
            a = np.frombuffer(b, np.uint8)
            return ((a == 0) | (a == 255)).astype(np.uint8).tobytes()

        return px.map(one)

    return tiles.withColumn("px", blank("px"))


def any_slot(masks: DataFrame) -> DataFrame:
    """OR of mask tiles over all layers of a frame; layers are few and fixed."""
    @F.pandas_udf("binary")
    def union(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in p]).tobytes())

    return masks.groupBy("aoi", "frame", "ty", "tx").agg(
        *[F.first(c).alias(c) for c in ("r0", "c0", "h", "w", "height", "width")], F.collect_list("px").alias("p")
    ).withColumn("px", union("p")).select(*tl.COLS)


def invalid_area(
    current: DataFrame, templates: DataFrame, tile: int, min_area: int = 10_000, grow: int = 30
) -> DataFrame:
    """Large blank components of the frame or any template, grown by a square.

    Returns mask tiles of frames that have such an area; others have none.
    """
    ready = templates.select("aoi", "dst_frame").distinct().withColumnRenamed("dst_frame", "frame")
    layers = templates.select("aoi", F.col("dst_frame").alias("frame"), "slot", *tl.COLS[2:]).unionByName(
        current.join(ready, ["aoi", "frame"], "left_semi").withColumn("slot", F.lit(CURRENT)).select("aoi", "frame", "slot", *tl.COLS[2:])
    )
    big = components.large_component_masks(saturated(layers), 8, min_area, STACK)
    low, high = -(grow // 2), grow - 1 - grow // 2
    return tl.map_halo(any_slot(big), tile, grow // 2, lambda a, o, s: kernels.rank_filter(a, low, high, True))


def open_mask(masks: DataFrame, tile: int) -> DataFrame:
    """2x2 opening of mask tiles."""
    return tl.map_halo(masks, tile, 2, lambda a, o, s: kernels.open_2x2(a))


def compensated(current: DataFrame, templates: DataFrame, tile: int, mode: str = "clip") -> DataFrame:
    """Brightness-compensated templates: aoi, frame, slot, tile columns."""
    d = subtract(stack(current, templates, tile, HALO), tile, brightness=mode, keep=("templates",))
    cols = [c for c in tl.COLS if c != "px"]
    return d.select(*cols, F.posexplode("templates").alias("slot", "px"))


# ---------------------------------------------------------------- candidates

def set_pixels(masks: DataFrame) -> DataFrame:
    """Sparse form of mask tiles: aoi, frame, r, c, height, width."""
    @F.pandas_udf("array<int>")
    def where(px: pd.Series) -> pd.Series:
        return px.map(lambda b: np.flatnonzero(np.frombuffer(b, np.uint8)).astype(np.int32))

    d = masks.select("aoi", "frame", "r0", "c0", "w", "height", "width", F.explode(where("px")).alias("i"))
    return d.select(
        "aoi", "frame", (F.col("r0") + F.floor(F.col("i") / F.col("w"))).cast("int").alias("r"),
        (F.col("c0") + F.col("i") % F.col("w")).cast("int").alias("c"), "height", "width",
    )


def _sampled_at(i: Column, n: Column, m: Column) -> Column:
    """Index j of the m-long nearest resize that reads source i, else null."""
    j = F.ceil(i * m / n)
    return F.when((F.floor(j * n / m) == i) & (j < m), j)


def candidates(pixels: DataFrame, motion_aware: bool = False) -> DataFrame:
    """Candidate centres: set pixels that a nearest resize to a third reads.

    ``seq`` is the row-major order of the reduced mask.
    """
    h3, w3 = F.floor(F.col("height") / 3), F.floor(F.col("width") / 3)
    d = pixels.withColumn("i", _sampled_at(F.col("r"), F.col("height"), h3)).withColumn(
        "j", _sampled_at(F.col("c"), F.col("width"), w3)
    ).where("i is not null and j is not null")
    at = (lambda v: 3 * v + 1) if motion_aware else (lambda v: 3 * (v - 1) + 2)
    d = d.select("aoi", "frame", (F.col("i") * w3 + F.col("j")).alias("seq"), at(F.col("i")).cast("int").alias("r"),
                 at(F.col("j")).cast("int").alias("c"), "height", "width")
    if motion_aware:
        d = d.where("r >= 0 and r < height and c >= 0 and c < width")
    return d

"""End-to-end detection: registered templates to refined detections."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.functions.geo import IDENTITY3
from skyquilt.operators import background as bg, components, motion as mo, refine, sequence as sq, tiles as tl


@dataclass
class Settings:
    """Parameters of a detection run; the defaults are those of the AOI run."""

    tile: int = 512
    templates: int = 5
    threshold: float = 6.0
    brightness: str | None = "clip"
    use_motion: bool = True
    motion_method: str = "block"
    motion_alpha: float = 10.0
    motion_tau: float = 0.1
    motion_sigma: float = 3.0
    motion_options: dict = field(default_factory=dict)
    use_prior: bool = False
    prior_limit: float = 0.0
    prior_side: int = 256
    blank_area: int = 10_000
    blank_grow: int = 30
    double_shift: bool = False


def background_stage(tiles: DataFrame, homographies: DataFrame | None, s: Settings, keep=("opened", "templates")) -> DataFrame:
    """Templates, invalid area, motion and subtraction. ``homographies`` =
    aoi, src_frame, dst_frame, h for template pairs, the identity where a pair has
    none; None for frames that are registered already."""
    pairs = sq.template_pairs(tiles.select("aoi", "frame").distinct(), s.templates, s.double_shift)
    if homographies is None:
        warped = bg.identity_templates(tiles, pairs)
    else:
        # a pair that could not be registered keeps its place
        known = pairs.join(homographies.select(*sq.PAIR, "h"), sq.PAIR, "left")
        known = known.withColumn("h", F.coalesce("h", F.array(*[F.lit(v) for v in IDENTITY3])))
        warped = tl.warp(tiles, known, s.tile)
    warped = session.cut(warped, "warped")
    bad = bg.invalid_area(tiles, warped, s.tile, s.blank_area, s.blank_grow)
    motion = None
    if s.use_motion:
        # positions count processed frames: those with a full template list
        pos = sq.frame_positions(tiles.select("aoi", "frame").distinct())
        pos = pos.withColumn("pos", F.col("pos") - s.templates).where("pos >= 0")
        field_ = mo.estimate(tiles, s.tile, s.motion_method, s.motion_sigma, **s.motion_options)
        motion = mo.warmed_tiles(field_, tiles, pos)
    stacks = bg.stack(tiles, warped, s.tile, bg.HALO, bad, motion)
    return bg.subtract(
        stacks, s.tile, s.threshold, s.brightness, s.use_motion, s.motion_alpha, s.motion_tau, keep=keep
    )


def refine_stage(
    tiles: DataFrame, subtracted: DataFrame, s: Settings, classifier, regressor,
    classifier_mean: np.ndarray | None = None, regressor_mean: np.ndarray | None = None,
) -> DataFrame:
    """Candidates -> screened centres -> regions -> windows -> detections (aoi, frame, seq, r, c)."""
    cols = [c for c in tl.COLS if c != "px"]
    comp = subtracted.select(*cols, F.posexplode("templates").alias("slot", "px"))
    chan = session.cut(refine.channels(tiles, comp, s.templates), "channels")
    cand = bg.candidates(bg.set_pixels(subtracted.select(*tl.COLS)), s.use_motion).where(refine.screen_fits())
    points = cand.select("aoi", "frame", F.col("seq").alias("pid"), "r", "c",
                         F.array(F.col("height").cast("long"), F.col("width").cast("long")).alias("info"))
    screened = refine.score_patches(chan, points, s.tile, refine.SCREEN_HALF, classifier, classifier_mean)
    centres = refine.accept(screened).select(
        "aoi", "frame", "r", "c", F.col("info")[0].cast("int").alias("height"), F.col("info")[1].cast("int").alias("width"))
    mask = session.cut(refine.region_mask(centres, s.tile), "regions")
    size = mask.groupBy("aoi", "frame").agg(F.first("height").alias("height"), F.first("width").alias("width"))
    regs = components.regions(mask, 4).join(size, ["aoi", "frame"])
    windows = refine.window_points(refine.plan_windows(regs))
    responses = refine.score_patches(chan, windows, s.tile, refine.WINDOW_HALF, regressor, regressor_mean)
    return refine.window_detections(responses)


def detect(
    tiles: DataFrame, homographies: DataFrame | None, s: Settings, classifier, regressor,
    classifier_mean=None, regressor_mean=None, prior_model=None,
) -> DataFrame:
    """Tiled frames -> detections in output pixels: aoi, frame, seq, x (column), y (row)."""
    tiles = session.cut(tiles, "tiles")  # read by every branch below
    sub = session.cut(background_stage(tiles, homographies, s), "subtracted")
    found = refine_stage(tiles, sub, s, classifier, regressor, classifier_mean, regressor_mean)
    if s.use_prior and prior_model is not None:
        side = s.prior_side
        priors = refine.score(refine.prior_inputs(tiles, side), prior_model, (1, side, side))
        found = refine.scene_prior_filter(found, priors, s.prior_limit, side)
    return to_output(found)


def to_output(found: DataFrame) -> DataFrame:
    """(row, col) detections -> integer (x, y)."""
    return found.select("aoi", "frame", "seq", F.col("c").cast("int").alias("x"), F.col("r").cast("int").alias("y"))


def stages(tiles: DataFrame, homographies: DataFrame | None, s: Settings) -> DataFrame:
    """Diagnostic form: one row per (frame, tile, stage) with its raw bytes."""
    d = background_stage(tiles, homographies, s, keep=("opened", "templates", *bg.STAGES[:-1]))
    cols = [c for c in tl.COLS if c != "px"]
    named = [F.struct(F.lit(n).alias("stage"), F.col("px" if n == "opened" else n).alias("px")) for n in bg.STAGES]
    long = d.select(*cols, F.explode(F.array(*named)).alias("e")).select(*cols, "e.stage", "e.px")
    temps = d.select(*cols, F.posexplode("templates").alias("i", "px"))
    return long.unionByName(temps.select(*cols, F.format_string("template%d", "i").alias("stage"), "px"))

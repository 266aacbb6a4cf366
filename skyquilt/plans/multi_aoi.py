"""One job from keypoints, tiles and tracks to the scores of all AOIs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.operators import sequence as sq
from skyquilt.plans import detection, evaluation


@dataclass
class Registration:
    """How frames are registered to each other.

    ``plan``: ``direct`` matches every template with its frame, ``seeded`` only
    neighbours and the first window, from which the other matrices follow.
    ``on_failure``: a pair with fewer than four good matches takes the identity
    (``identity``), or its frame gives no detections (``skip``); the frame is a
    template of later ones in both cases.
    """

    plan: str = "direct"
    block: int = 512
    max_dist: int = 50
    hypotheses: int = 2000
    reprojection: float = 3.0
    on_failure: str = "identity"


def matched_points(keypoints: DataFrame, pairs: DataFrame, s: Registration) -> DataFrame:
    """Good mutual matches with both positions: aoi, src_frame, dst_frame, match_id, x, y, u, v.

    ``keypoints``: aoi, frame, kp_id (counted within a frame), desc, x, y. A mutual
    match names a source keypoint once, so its id numbers the matches of a pair.
    """
    good = sq.good_matches(sq.mutual_matches(keypoints.select("aoi", "frame", "kp_id", "desc"), pairs, s.block), s.max_dist)

    def at(side: str, x: str, y: str) -> DataFrame:
        return keypoints.select("aoi", F.col("frame").alias(f"{side}_frame"), F.col("kp_id").alias(f"{side}_kp"),
                                F.col("x").cast("double").alias(x), F.col("y").cast("double").alias(y))

    d = good.join(at("src", "x", "y"), ["aoi", "src_frame", "src_kp"]).join(at("dst", "u", "v"), ["aoi", "dst_frame", "dst_kp"])
    return d.select(*sq.PAIR, F.col("src_kp").alias("match_id"), "x", "y", "u", "v")


def register(keypoints: DataFrame, frames: DataFrame, n: int, s: Registration) -> tuple[DataFrame, DataFrame]:
    """Matrices of all template pairs (aoi, src_frame, dst_frame, h) and the frames (aoi, frame) with a pair that failed.

    ``frames``: aoi, frame. A frame without keypoints fails like one without matches.
    """
    if s.plan not in ("direct", "seeded"):
        raise ValueError(f"a run needs every template pair: {s.plan}")
    pairs = session.cut(sq.registration_plan(frames, n, s.plan), "pairs")
    found = sq.estimate_homographies(matched_points(keypoints, pairs, s), pairs, s.hypotheses, s.reprojection)
    found = session.cut(found, "homographies")
    failed = found.where("n_matches < 4").select("aoi", F.col("dst_frame").alias("frame")).distinct()
    h = found.select(*sq.PAIR, "h")
    return (h if s.plan == "direct" else session.cut(sq.compose_scan(frames, h, n), "composed")), failed


def detections(
    tiles: DataFrame, keypoints: DataFrame, registration: Registration, settings: detection.Settings,
    classifier, regressor, classifier_mean=None, regressor_mean=None, prior_model=None,
) -> DataFrame:
    """Frames and their keypoints to detections in output pixels: aoi, frame, seq, x, y."""
    if registration.on_failure not in ("identity", "skip"):
        raise ValueError(f"unknown failure policy: {registration.on_failure}")
    tiles = session.cut(tiles, "frames")
    frames = session.cut(tiles.select("aoi", "frame").distinct(), "sequence")
    h, failed = register(keypoints, frames, settings.templates, registration)
    found = detection.detect(tiles, h, settings, classifier, regressor, classifier_mean, regressor_mean, prior_model)
    return found.join(failed, ["aoi", "frame"], "left_anti") if registration.on_failure == "skip" else found


def run(
    tiles: DataFrame, keypoints: DataFrame, truth: DataFrame, first: int, last: int, width: int, height: int,
    registration: Registration, settings: detection.Settings, classifier, regressor,
    classifier_mean=None, regressor_mean=None, prior_model=None, **report,
) -> DataFrame:
    """Register, subtract, refine, merge, match and score: one row per AOI and one ``overall``.

    ``tiles`` are crops of ``width`` x ``height`` that cover their AOI's box; only
    AOIs that have frames are scored. ``report`` goes to ``multi_aoi_report``.
    """
    tiles = tiles.where(F.col("frame").between(first, last))
    found = detections(tiles, keypoints.where(F.col("frame").between(first, last)), registration, settings,
                       classifier, regressor, classifier_mean, regressor_mean, prior_model)
    return evaluation.multi_aoi_report(
        truth, found, first, last, settings.templates, width=width, height=height,
        aois=tiles.select("aoi").distinct(), **report)

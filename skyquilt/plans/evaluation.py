"""End-to-end evaluation plans: offline metrics and the multi-AOI evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.functions.geo import geo_to_pixel, pixel_to_geo
from skyquilt.operators import matching, ordering, spatial, tracks


def inside_border(x, y, width, height, border: int) -> Column:
    """b <= x < w - b and b <= y < h - b."""
    x, y, width, height = (F.col(v) if isinstance(v, str) else (v if isinstance(v, Column) else F.lit(v))
                           for v in (x, y, width, height))
    return (x >= border) & (x < width - border) & (y >= border) & (y < height - border)


def offline_counts(
    truth: DataFrame, dets: DataFrame, first: int, last: int, min_move_m: float, radius: float
) -> DataFrame:
    """Per-frame tp/fp/fn of pixel detections against moving truth."""
    # read twice below (match and counts), so the ordered part runs once
    moving = session.cut(
        tracks.some_step_moves(tracks.frame_range(truth, first, last), min_move_m).select("frame_number", "id", "x", "y"),
        "moving",
    )
    gt = moving.select(
        F.col("frame_number").cast("int").alias("frame"), "x", "y",
        F.struct("id", "x", "y").alias("gt"),
    )
    seen = dets.where(F.col("frame").between(first, last)).select(F.col("frame").cast("int").alias("frame"), "x", "y")
    base = matching.spine(truth.sparkSession, first, last)
    n_gt = gt.groupBy("frame").agg(F.count(F.lit(1)).alias("n_gt"))
    matched = matching.nn_match(seen, gt, radius)
    counted = matching.counts_on_spine(base, ["frame"], (n_gt, ["n_gt"]), (matched, ["n_det", "tp"]))
    return matching.frame_counts(counted)


def offline_metrics(
    truth: DataFrame, dets: DataFrame, first: int, last: int, min_move_m: float = 1.2, radius: float = 10.0
) -> DataFrame:
    """Precision, recall and F1 over a frame range."""
    return matching.micro_scores(offline_counts(truth, dets, first, last, min_move_m, radius))


def aoi_geotransform(width: int, height: int) -> Column:
    """Geotransform of a crop that covers its AOI box (columns ulx, uly, lrx, lry)."""
    zero = F.lit(0.0)
    return F.array(
        F.col("ulx"), (F.col("lrx") - F.col("ulx")) / width, zero,
        F.col("uly"), zero, (F.col("lry") - F.col("uly")) / height,
    )


def with_geo(points: DataFrame, width: int, height: int) -> DataFrame:
    """Attach each AOI's geotransform; the AOI dimension has a fixed size."""
    dim = spatial.aoi_dim(points.sparkSession).select("aoi", aoi_geotransform(width, height).alias("gt6"))
    return points.join(F.broadcast(dim), "aoi")


def visible_truth(
    truth: DataFrame, first: int, last: int, min_move_m: float, width: int, height: int, border: int
) -> DataFrame:
    """Moving truth per AOI whose pixel lies inside the border."""
    moving = tracks.every_step_moves(tracks.frame_range(truth, first, last), min_move_m)
    per_aoi = with_geo(spatial.assign_aoi(moving), width, height)
    px = geo_to_pixel("gt6", "longitude", "latitude")
    return per_aoi.withColumn("px", px).where(
        inside_border(F.col("px.col"), F.col("px.row"), width, height, border)
    ).select("aoi", F.col("frame_number").cast("int").alias("frame"), "id",
             F.col("longitude").alias("lon"), F.col("latitude").alias("lat"),
             F.col("px.col").alias("col"), F.col("px.row").alias("row"))


def merged_detections(
    dets: DataFrame, width: int, height: int, border: int, merge_px: float
) -> DataFrame:
    """Integer pixels -> border filter -> merge -> degrees. ``dets``: aoi, frame, seq, x, y."""
    inside = dets.select("aoi", "frame", "seq", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    inside = inside.where(inside_border("x", "y", width, height, border))
    merged = matching.merge_close_points(inside, merge_px)
    geo = with_geo(merged, width, height).withColumn("g", pixel_to_geo("gt6", "x", "y"))
    return geo.select("aoi", "frame", "seq", "x", "y", F.col("g.lon").alias("lon"), F.col("g.lat").alias("lat"))


def multi_aoi_report(
    truth: DataFrame,
    dets: DataFrame,
    first: int,
    last: int,
    num_templates: int = 5,
    min_move_m: float = 0.8,
    width: int = 1000,
    height: int = 1000,
    border: int = 15,
    merge_px: float = 10.0,
    match_m: float = 5.0,
    aois: DataFrame | None = None,
) -> DataFrame:
    """All AOIs in one job: tracks and detections to per-AOI and overall scores.

    The first ``num_templates`` frames produce no output, as they only fill the
    background window. ``aois`` (aoi) limits the truth to the AOIs that were run.
    Truth points are numbered by id, so repeated rows count and match one by one.
    """
    start = first + num_templates
    seen = visible_truth(truth, first, last, min_move_m, width, height, border).where(F.col("frame") >= start)
    if aois is not None:
        seen = seen.join(aois, "aoi", "left_semi")
    seen = ordering.position(seen, ["aoi", "frame"], ["id", "lon", "lat"], ordering.by_width("id", 1 << 16), "gt")
    # both are read twice below (counts and matching), so they are written once
    gt = session.cut(seen, "truth")
    det = session.cut(
        merged_detections(dets.where(F.col("frame").between(start, last)), width, height, border, merge_px), "merged"
    )
    pairs = matching.greedy_geo_match(
        det.withColumnRenamed("seq", "det"), gt, match_m
    )
    keys = ["aoi", "frame"]

    def per_frame(d, name):
        return d.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    counted = (
        per_frame(gt, "n_gt").join(per_frame(det, "n_det"), keys, "full")
        .join(per_frame(pairs, "tp"), keys, "left").fillna(0, ["n_gt", "n_det", "tp"])
    )
    return matching.report(matching.frame_counts(counted))

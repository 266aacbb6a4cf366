"""Ground-truth track operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.geo import haversine_lonlat_m, haversine_m
from skyquilt.operators import ordering

FRAMES_PER_CHUNK = 512
_ORDER = ["frame_number", "x", "y"]


def frame_range(tracks: DataFrame, first: int, last: int) -> DataFrame:
    """Inclusive frame filter, to be applied before tracks are ordered."""
    return tracks.where(F.col("frame_number").between(first, last))


def _with_steps(tracks: DataFrame, distance) -> DataFrame:
    here = F.struct("latitude", "longitude")
    d = ordering.neighbours(
        tracks, ["id"], _ORDER, ordering.by_width("frame_number", FRAMES_PER_CHUNK), here,
        prev="_p", next="_n",
    )
    return d.withColumn("step_prev", distance("_p")).withColumn("step_next", distance("_n")).drop("_p", "_n")


def _atan2(side: str) -> Column:
    return haversine_m("latitude", "longitude", F.col(side)["latitude"], F.col(side)["longitude"])


def _asin(side: str) -> Column:
    return haversine_lonlat_m(
        "longitude", "latitude", F.col(side)["longitude"], F.col(side)["latitude"]
    )


def displacement(tracks: DataFrame) -> DataFrame:
    """Metres from each point to the next one of its track (null at the end)."""
    return _with_steps(tracks.where("id is not null"), _atan2).drop("step_prev").withColumnRenamed(
        "step_next", "step_m"
    )


def every_step_moves(tracks: DataFrame, min_move_m: float = 0.8) -> DataFrame:
    """Drop (frame, id) keys that are an end of a step shorter than the limit.

    Single-point tracks and rows without an id stay; a NaN step is not short.
    """
    def short(c):
        return F.coalesce((F.col(c) < min_move_m) & ~F.isnan(c), F.lit(False))

    steps = _with_steps(tracks.where("id is not null"), _atan2)
    static = steps.where(short("step_prev") | short("step_next")).select("frame_number", "id").distinct()
    return tracks.join(static, ["frame_number", "id"], "left_anti")


def some_step_moves(tracks: DataFrame, min_move_m: float = 0.8) -> DataFrame:
    """Keep rows that are an end of a step of at least the limit."""
    def moved(c):
        return F.coalesce((F.col(c) >= min_move_m) & ~F.isnan(c), F.lit(False))

    steps = _with_steps(tracks.where("id is not null"), _asin)
    return steps.where(moved("step_prev") | moved("step_next")).drop("step_prev", "step_next")

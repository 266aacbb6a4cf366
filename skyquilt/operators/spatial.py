"""Radius joins on a grid, and the AOI range assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.fixed import AOI_BOXES


def _cell(c: Column, side: Column) -> Column:
    return F.floor(c / side).cast("long")


def grid_cells(
    left: DataFrame,
    right: DataFrame,
    left_at: Sequence[Column],
    right_low: Sequence[Column],
    right_high: Sequence[Column],
    side: float,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the cells of ``side`` they meet in, and the names of the cell columns.

    A left point lies in one cell; a right box is copied to every cell it touches.
    """
    s = F.lit(float(side))
    names = [f"_g{i}" for i in range(len(left_at))]
    l = left.select("*", *[_cell(c, s).alias(n) for c, n in zip(left_at, names)])
    r = right
    for n, lo, hi in zip(names, right_low, right_high):
        r = r.withColumn(n, F.explode(F.sequence(_cell(lo, s), _cell(hi, s))))
    return l, r, names


def grid_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: Sequence[Column],
    right_low: Sequence[Column],
    right_high: Sequence[Column],
    side: float,
    how: str = "inner",
) -> tuple[DataFrame, list[str]]:
    """Join each left point to the right boxes that may contain it.

    Only rows of the same cell of ``grid_cells`` meet, and each (point, box) pair is
    produced once. The caller filters with the exact distance. Cells are small, and
    callers collapse exact copies first, so no key group is joined all-to-all.

    Also returns the cell column names: a later grouping of left points that
    includes ``keys`` and the cells needs no further shuffle.
    """
    l, r, names = grid_cells(left, right, left_at, right_low, right_high, side)
    return l.join(r, [*keys, *names], how), names


def _radius_boxes(right_at: Sequence[Column], radius: float) -> tuple[list[Column], list[Column], float]:
    slack = radius * (1 + 1e-6) + 1e-3
    return [c - slack for c in right_at], [c + slack for c in right_at], 2 * slack


def radius_cells(
    left: DataFrame, right: DataFrame, left_at: Sequence[Column], right_at: Sequence[Column], radius: float
) -> tuple[DataFrame, DataFrame, list[str]]:
    """``grid_cells`` of points and of the boxes that reach ``radius`` around the right points."""
    return grid_cells(left, right, left_at, *_radius_boxes(right_at, radius))


def radius_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: Sequence[Column],
    right_at: Sequence[Column],
    radius: float,
    how: str = "inner",
) -> tuple[DataFrame, list[str]]:
    """Candidate pairs within ``radius`` on every axis (a superset; filter after)."""
    return grid_pairs(left, right, keys, left_at, *_radius_boxes(right_at, radius), how)


def aoi_dim(spark) -> DataFrame:
    """The AOI dimension; its size is fixed by ``AOI_BOXES``."""
    return spark.createDataFrame(AOI_BOXES, "aoi STRING, ulx DOUBLE, uly DOUBLE, lrx DOUBLE, lry DOUBLE")


def aoi_array(boxes=AOI_BOXES) -> Column:
    """The AOI boxes as one literal array of (aoi, min/max lon/lat)."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("aoi"),
                F.lit(min(ulx, lrx)).alias("min_lon"),
                F.lit(max(ulx, lrx)).alias("max_lon"),
                F.lit(min(uly, lry)).alias("min_lat"),
                F.lit(max(uly, lry)).alias("max_lat"),
            )
            for name, ulx, uly, lrx, lry in boxes
        ]
    )


def within(box: Column, lon: Column, lat: Column) -> Column:
    return lon.between(box["min_lon"], box["max_lon"]) & lat.between(box["min_lat"], box["max_lat"])


def assign_aoi(points: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """One row per (point, AOI containing it); boxes overlap, so points may repeat.

    The boxes are a fixed literal, so this is a map-side explode: one scan for
    all AOIs and no join at all.
    """
    hits = F.filter(aoi_array(), lambda b: within(b, F.col(lon), F.col(lat)))
    return points.select("*", F.explode(F.transform(hits, lambda b: b["aoi"])).alias("aoi"))


def in_one_aoi(points: DataFrame, aoi: str, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Points inside a named AOI, borders included."""
    box = next(b for b in AOI_BOXES if b[0] == aoi)
    return points.where(within(aoi_array([box])[0], F.col(lon), F.col(lat)))


def requested_aois(requests: DataFrame, col: str = "aoi") -> DataFrame:
    """Requested AOI names with their box; unknown names keep ``known = false``."""
    dim = F.broadcast(aoi_dim(requests.sparkSession))
    return (
        requests.select(col)
        .distinct()
        .join(dim.withColumnRenamed("aoi", col), col, "left")
        .withColumn("known", F.col("ulx").isNotNull())
    )

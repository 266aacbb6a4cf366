"""The table behind a drawn frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _mark(points: DataFrame, kind: str, colour: str, radius: int) -> DataFrame:
    return points.withColumn("kind", F.lit(kind)).withColumn("colour", F.lit(colour)).withColumn("radius", F.lit(radius))


def overlay(dets: DataFrame, truth: DataFrame) -> DataFrame:
    """Detections and truth points with their marker attributes."""
    return _mark(dets, "detection", "red", 6).unionByName(_mark(truth, "truth", "yellow", 4))


def in_image(x, y, width, height, lower: str = "inclusive"):
    """Point inside the image; ``strict`` also leaves out row and column 0."""
    if lower == "strict":
        return (x > 0) & (x < width) & (y > 0) & (y < height)
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)

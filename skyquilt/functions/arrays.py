"""Small array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_unit(px: Column) -> Column:
    """Bytes to [0, 1]."""
    return F.transform(px, lambda v: v / F.lit(255.0))


def sixteen_to_eight(v: Column) -> Column:
    return F.shiftright(v.cast("int"), 8)


def nearest_source(i: Column, n: int, m: int) -> Column:
    """Source index of target i in an n -> m nearest resize."""
    return F.floor(i * n / F.lit(m)).cast("int")


def max_cells(values: Column, width: int) -> Column:
    """All cells equal to the maximum: array of (r, c, v), row-major."""
    top = F.array_max(values)
    cells = F.transform(values, lambda v, i: F.struct(
        F.floor(i / width).cast("int").alias("r"), (i % width).cast("int").alias("c"), v.alias("v")))
    return F.filter(cells, lambda s: s["v"] == top)

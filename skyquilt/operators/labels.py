"""Label masks: filled discs round truth points, directly at the reduced size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def disc_half_widths(radius: int) -> list[int]:
    """Half width of each row 0..radius of a filled midpoint circle."""
    half = [0] * (radius + 1)
    x = radius
    for y in range(radius + 1):
        if y > 0 and x * x + y * y > radius * radius:
            x -= 1
        if x < y:
            break
        half[y] = max(half[y], x)
        half[x] = max(half[x], y)
    return half


def _target_range(low: Column, high: Column, n: int, m: int) -> tuple[Column, Column]:
    first = F.ceil(F.greatest(low, F.lit(0)) * m / F.lit(n))
    last = F.ceil((F.least(high, F.lit(n - 1)) + 1) * m / F.lit(n)) - 1
    return first, last


def targets_of(low: Column, high: Column, n: int, m: int) -> Column:
    """Targets j of an n -> m nearest resize with low <= floor(j * n / m) <= high."""
    first, last = _target_range(low, high, n, m)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def usable_frames(frames: DataFrame, truth: DataFrame, key: str = "frame") -> DataFrame:
    """Frames that have both an image and truth."""
    return frames.select(key).distinct().join(truth.select(key).distinct(), key)


def disc_masks(truth: DataFrame, height: int, width: int, side: int = 256, radius: int = 30) -> DataFrame:
    """Set cells (frame, i, j) of the reduced label masks.

    ``truth``: frame, x (column), y (row). Only rows and columns that the
    reduction reads are produced, so the full-size mask never exists; points
    that round to the same pixel are collapsed first.
    """
    half = F.array(*[F.lit(v) for v in disc_half_widths(radius)])
    p = truth.select("frame", F.bround("y").cast("int").alias("r"), F.bround("x").cast("int").alias("c")).distinct()
    p = p.withColumn("i", F.explode(targets_of(F.col("r") - radius, F.col("r") + radius, height, side)))
    row = F.floor(F.col("i") * height / F.lit(side))
    p = p.withColumn("reach", F.element_at(half, (F.abs(row - F.col("r")) + 1).cast("int")))
    first, last = _target_range(F.col("c") - F.col("reach"), F.col("c") + F.col("reach"), width, side)
    p = p.select("frame", "i", first.cast("int").alias("a"), last.cast("int").alias("b")).where("a <= b")
    # a span is a few 64-bit words; OR-ing words combines before the shuffle
    p = p.withColumn("word", F.explode(F.sequence(F.floor(F.col("a") / 64).cast("int"), F.floor(F.col("b") / 64).cast("int"))))
    p = p.withColumn("lo", F.greatest(F.col("a") - F.col("word") * 64, F.lit(0))).withColumn("hi", F.least(F.col("b") - F.col("word") * 64, F.lit(63)))
    bits = F.expr("shiftleft(-1L, lo) & shiftrightunsigned(-1L, 63 - hi)")
    rows = p.groupBy("frame", "i", "word").agg(F.bit_or(bits).alias("bits"))
    on = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1)
    return rows.select("frame", F.col("i").cast("int").alias("i"), "word", F.explode(on).alias("k")).select(
        "frame", "i", (F.col("word") * 64 + F.col("k")).cast("int").alias("j")
    )

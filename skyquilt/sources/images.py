"""Grey frames from image files, and tiles from frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquilt import schemas
from skyquilt.fixed import GREY_FROM_BGR


@F.pandas_udf(T.BinaryType())
def to_grey(data: pd.Series, channels: pd.Series) -> pd.Series:
    """Row-major bytes of 1, 3 or 4 interleaved BGR(A) channels -> grey bytes."""
    def one(raw, n):
        if n == 1:
            return bytes(raw)
        a = np.frombuffer(raw, np.uint8).reshape(-1, n)[:, :3].astype(np.float64)
        b, g, r = GREY_FROM_BGR
        return np.floor(a[:, 0] * b + a[:, 1] * g + a[:, 2] * r + 0.5).astype(np.uint8).tobytes()

    return pd.Series([one(d, n) for d, n in zip(data, channels)])


def read_grey_frames(spark: SparkSession, path: str) -> DataFrame:
    """Decode image files to grey frames; unreadable files are left out."""
    img = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    name = F.element_at(F.split("origin", "/"), -1)
    return img.where("height > 0").select(
        F.col("origin").alias("path"),
        F.regexp_extract(name, r"\d+", 0).cast("int").alias("frame"),
        "height", "width", to_grey("data", "nChannels").alias("px"),
    )


def require_templates(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """Fail when a template frame was not decoded (a current frame is just skipped)."""
    have = frames.select("aoi", F.col("frame").alias("src_frame"), F.lit(True).alias("_ok"))
    d = pairs.join(have, ["aoi", "src_frame"], "left")
    error = F.raise_error(F.concat(F.lit("template frame not readable: "), F.col("src_frame").cast("string")))
    return d.where(F.when(F.col("_ok"), F.lit(True)).otherwise(error.cast("boolean"))).drop("_ok")


def to_tiles(frames: DataFrame, tile: int) -> DataFrame:
    """Cut grey frames (aoi, frame, height, width, px) into tiles."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf.itertuples(index=False):
                a = np.frombuffer(f.px, np.uint8).reshape(f.height, f.width)
                rows = [
                    (f.aoi, f.frame, r // tile, c // tile, r, c, *a[r:r + tile, c:c + tile].shape, f.height,
                     f.width, a[r:r + tile, c:c + tile].tobytes())
                    for r in range(0, f.height, tile) for c in range(0, f.width, tile)
                ]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schemas.TILE.split(", ")])

    return frames.select("aoi", "frame", "height", "width", "px").mapInPandas(run, schemas.TILE)


def region_of_interest(tiles: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Pixels [r0:r1, c0:c1] of each frame; tiles outside are never unpacked."""
    from skyquilt.functions.pixels import explode_pixels

    touched = tiles.where(
        (F.col("r0") < r1) & (F.col("r0") + F.col("h") > r0) & (F.col("c0") < c1) & (F.col("c0") + F.col("w") > c0)
    )
    px = explode_pixels(touched)
    return px.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))

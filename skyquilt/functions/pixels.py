"""Packing between pixel arrays and dense bytes (Arrow batches, numpy inside)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def pack_u8(px: pd.Series) -> pd.Series:
    return px.map(lambda a: np.asarray(a, dtype=np.uint8).tobytes())


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def unpack_u8(px: pd.Series) -> pd.Series:
    return px.map(lambda b: np.frombuffer(b, dtype=np.uint8).astype(np.int32))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unpack_f4(px: pd.Series) -> pd.Series:
    return px.map(lambda b: np.frombuffer(b, dtype=np.float32).astype(np.float64))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unpack_f8(px: pd.Series) -> pd.Series:
    return px.map(lambda b: np.frombuffer(b, dtype=np.float64))


@F.pandas_udf(T.BinaryType())
def u8_to_f4(px: pd.Series) -> pd.Series:
    return px.map(lambda b: np.frombuffer(b, dtype=np.uint8).astype(np.float32).tobytes())


def explode_pixels(tiles, unpack=unpack_u8, name: str = "v", keys=("aoi", "frame")):
    """Tile rows -> one row per pixel: the keys (aoi, frame), r, c, value."""
    d = tiles.select(*keys, "r0", "c0", "w", F.posexplode(unpack("px")).alias("_i", name))
    return d.select(
        *keys,
        (F.col("r0") + F.floor(F.col("_i") / F.col("w"))).cast("int").alias("r"),
        (F.col("c0") + F.col("_i") % F.col("w")).cast("int").alias("c"),
        name,
    )

"""Imagery-shaped views of the given tables, for Spark and as SQL text.

Both forms must give identical rows (FIXTURES.md).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.functions.pixels import pack_u8
from skyquilt.operators import ordering


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tracks(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    e = ordering.position(e, ["user_id"], ["ts", "event_id"], F.unix_date(F.col("ts").cast("date")), "n")
    k = F.floor("value").cast("long") % 100
    return e.select(
        F.col("user_id").alias("id"), F.col("n"), k.alias("k"), (100 + F.col("n")).alias("frame_number")
    ).select(
        "id", "frame_number",
        F.expr("39.7655d + (id % 37) * 1e-4 + n * 4e-6 + k * 2e-7").alias("latitude"),
        F.expr("-84.1256d + (id % 41) * 2e-4 + n * 3e-6").alias("longitude"),
        F.expr("cast(20 * (id % 41) + n as double)").alias("x"),
        F.expr("cast(17 * (id % 37) + k % 10 as double)").alias("y"),
        "k",
    )


def dets(spark, sf) -> DataFrame:
    """Detections with misses, false alarms and second hits, in pixels and degrees."""
    t = tracks(spark, sf)
    made = F.filter(F.array(
        F.when((F.col("id") + F.col("frame_number")) % 3 != 0, F.struct(
            F.lit(0).alias("o"), (F.col("x") + F.col("k") % 25 - 12).alias("dx"),
            (F.col("y") + F.col("k") % 7 - 3).alias("dy"),
            F.expr("longitude + (k % 25 - 12) * 3.1e-6").alias("lon"),
            F.expr("latitude + (k % 7 - 3) * 1.07e-5").alias("lat"))),
        F.when(F.col("k") % 10 == 0, F.struct(
            F.lit(1).alias("o"), (F.col("x") + F.col("k") % 5).alias("dx"), (F.col("y") + 1).alias("dy"),
            F.expr("longitude + (k % 5) * 1.3e-6").alias("lon"),
            F.expr("latitude + 2.3e-6").alias("lat"))),
    ), lambda d: d.isNotNull())
    return t.select(F.col("frame_number").alias("frame"), "id", "k", F.explode(made).alias("d")).select(
        "frame", ((F.col("id") * 1000 + F.col("frame")) * 2 + F.col("d.o")).alias("seq"),
        F.col("d.dx").alias("x"), F.col("d.dy").alias("y"),
        F.expr("(k + 1) / 101.0d").alias("score"), "d.lon", "d.lat",
    )


TRACKS = """tr as (
select id, 100+n as frame_number,
  39.7655e0+(id%37)*1e-4+n*4e-6+k*2e-7 as latitude,
  -84.1256e0+(id%41)*2e-4+n*3e-6 as longitude,
  cast(20*(id%41)+n as double) as x, cast(17*(id%37)+k%10 as double) as y, k
from (select user_id as id,
        row_number() over (partition by user_id order by ts, event_id)-1 as n,
        cast(floor(value) as bigint)%100 as k from events) e)"""

DETS = """dets as (
select frame_number as frame, (id*1000+frame_number)*2 as seq,
  x+k%25-12 as x, y+k%7-3 as y, (k+1)/101.0e0 as score,
  longitude+(k%25-12)*3.1e-6 as lon, latitude+(k%7-3)*1.07e-5 as lat
from tr where (id+frame_number)%3<>0
union all
select frame_number, (id*1000+frame_number)*2+1, x+k%5, y+1, (k+1)/101.0e0,
  longitude+(k%5)*1.3e-6, latitude+2.3e-6
from tr where k%10=0)"""


def frames(spark, sf) -> DataFrame:
    """8x8 frames in ten sequences, pixels as ARRAY<INT>."""
    e = table(spark, sf, "embeddings")
    e = ordering.position(e, ["label"], ["vec_id"], ordering.by_width("vec_id", 4096), "frame")
    px = F.transform("embedding", lambda v: F.floor((v.cast("double") + 0.6) * 200).cast("int"))
    return e.select(F.col("label").alias("aoi"), F.col("frame").cast("int").alias("frame"), px.alias("px"))


FRAMES = """fr as (
select label as aoi, cast(row_number() over (partition by label order by vec_id)-1 as int) as frame,
  list_transform(embedding, lambda v: cast(floor((cast(v as double)+0.6e0)*200) as int)) as px
from embeddings)"""

PIXELS = FRAMES + """, pix as (
select aoi, frame, cast(i//8 as int) as r, cast(i%8 as int) as c, px[i+1] as v
from fr, (select unnest(range(64)) as i) g)"""


def samples(spark, sf) -> DataFrame:
    """Patch samples: 4 channels x 16 pixels; every 17th has a broken payload."""
    return table(spark, sf, "embeddings").select(
        F.format_string("part%02d", F.col("label")).alias("file_id"),
        F.col("vec_id").alias("sample_idx"),
        (F.col("vec_id") % 3 % 2).cast("int").alias("cls"),
        F.when(F.col("vec_id") % 17 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("px"),
    )


SAMPLES = """smp as (
select printf('part%02d', label) as file_id, vec_id as sample_idx, cast(vec_id%3%2 as int) as cls,
  case when vec_id%17=0 then embedding[1:10] else embedding end as px
from embeddings)"""


def pairs_h(spark, sf) -> DataFrame:
    """One homography per consecutive frame pair: identity + 0.01 * first nine values."""
    e = table(spark, sf, "embeddings")
    e = ordering.position(e, ["label"], ["vec_id"], ordering.by_width("vec_id", 4096), "frame")
    h = F.array(*[
        F.col("embedding")[i].cast("double") * 0.01 + F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)
    ])
    return e.select(
        F.col("label").alias("aoi"), F.col("frame").cast("int").alias("src_frame"),
        (F.col("frame") + 1).cast("int").alias("dst_frame"), h.alias("h"),
    )


HOMS = """hom as (
select label as aoi, cast(n as int) as src_frame, cast(n+1 as int) as dst_frame,
  list_transform(range(1,10), lambda i: cast(embedding[i] as double)*0.01e0
    + case when (i-1)%4=0 then 1.0e0 else 0.0e0 end) as h
from (select *, row_number() over (partition by label order by vec_id)-1 as n from embeddings) z)"""

MOSAIC_SIDE = 6  # tiles of 8x8 per row and column: 48x48 frames


def mosaic(spark, sf) -> DataFrame:
    """48x48 frames in two sequences, as 8x8 tiles; each embedding is one tile.

    A frame that lacks tiles at the end of its sequence is padded with even ones.
    """
    n = MOSAIC_SIDE * MOSAIC_SIDE
    e = table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 2).cast("string").alias("aoi"),
        F.floor(F.col("vec_id") / 2).cast("int").alias("k"), "embedding",
    )
    e = e.withColumn("frame", F.floor(F.col("k") / n).cast("int")).withColumn("b", F.col("k") % n)
    grid = e.select("aoi", "frame").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    px = F.transform("embedding", lambda v: F.floor((v.cast("double") + 0.6) * 200).cast("int"))
    px = F.coalesce(px, F.array_repeat(F.lit(120), 64))
    return grid.join(e, ["aoi", "frame", "b"], "left").select(
        "aoi", "frame",
        F.floor(F.col("b") / MOSAIC_SIDE).cast("int").alias("ty"),
        (F.col("b") % MOSAIC_SIDE).cast("int").alias("tx"),
        px.alias("v"),
    ).select(
        "aoi", "frame", "ty", "tx", (F.col("ty") * 8).alias("r0"), (F.col("tx") * 8).alias("c0"),
        F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(48).alias("height"), F.lit(48).alias("width"),
        pack_u8("v").alias("px"),
    )


MOSAIC = """mt as (
select cast(vec_id%2 as varchar) as aoi, cast((vec_id//2)//36 as int) as frame, (vec_id//2)%36 as b,
  list_transform(embedding, lambda v: cast(floor((cast(v as double)+0.6e0)*200) as int)) as px
from embeddings),
mb as (select g.aoi, g.frame, g.b, coalesce(mt.px, list_transform(range(64), lambda i: 120)) as px
from (select aoi, frame, unnest(range(36)) as b from (select distinct aoi, frame from mt) f) g
left join mt on mt.aoi=g.aoi and mt.frame=g.frame and mt.b=g.b),
mos as materialized (
select aoi, frame, cast(b//6*8+i//8 as int) as r, cast(b%6*8+i%8 as int) as c, px[i+1] as v
from mb, (select unnest(range(64)) as i) g)"""


def with_(*views: str) -> str:
    return "with recursive " + ",\n".join(views) + "\n"


def scene(spark, sf, times: int = 3) -> DataFrame:
    """The mosaic with every pixel repeated: 144x144 frames in 24x24 tiles."""
    @F.pandas_udf("binary")
    def grow(px: pd.Series) -> pd.Series:
        one = np.ones((times, times), np.uint8)
        return px.map(lambda b: np.kron(np.frombuffer(b, np.uint8).reshape(8, 8), one).tobytes())

    m = mosaic(spark, sf).withColumn("px", grow("px"))
    for c in ("r0", "c0", "h", "w", "height", "width"):
        m = m.withColumn(c, F.col(c) * times)
    return m

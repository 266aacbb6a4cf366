"""Keypoints to report: frames of a trembling camera with known movers.

A picture of 160 x 160 pixels for each of two AOIs is averaged from all vectors;
frame f shows the 144 x 144 pixels at the offset (11 f mod 7, 7 f mod 5). Four
squares a frame move over it. So the matrices, the truth and the counts are known
in SQL without looking at a pixel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyquilt import fixed
from skyquilt.functions.pixels import pack_u8
from skyquilt.operators import sequence as sq
from skyquilt.plans import detection as de, multi_aoi
from skyquilt.workload import fixtures as fx
from skyquilt.workload.evaluation import _rounded
from skyquilt.workload.refinement import stand_in_classifier, stand_in_prior
from skyquilt.workload.registry import query

SIDE, TILE, N, PER_FRAME = 144, 48, 3, 64
AOIS = ("01", "03")  # their boxes do not meet
BASE = 20  # tiles of 8 x 8 a side

#: Offsets of a frame's view and the column of mover ``o``; the SQL twins use the same text.
DY, DX = "(frame * 11) % 7", "(frame * 7) % 5"
MOVER_ROW, MOVER_COL = "26 + 30 * o", "26 + (9 * frame + 37 * o + 5 * a) % 90"

MOVERS = f"""fs as (select distinct cast(vec_id%2 as int) as a, cast(vec_id//{PER_FRAME} as int) as frame from embeddings),
mv as (select a, frame, o, {MOVER_ROW} as r, {MOVER_COL} as c from fs, (select unnest(range(4)) as o) k)"""


def _frames(spark, sf):
    return fx.table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 2).cast("int").alias("a"), F.floor(F.col("vec_id") / PER_FRAME).cast("int").alias("frame")).distinct()


def _aoi():
    return F.array(*[F.lit(a) for a in AOIS])[F.col("a")]


def _cells(spark, sf):
    """Cells of 8 x 8 of each AOI's picture: a, b and the average of all vectors that fall on it."""
    e = fx.table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 2).cast("int").alias("a"), (F.floor(F.col("vec_id") / 2) % (BASE * BASE)).cast("int").alias("b"), F.posexplode("embedding").alias("i", "v"))
    return e.groupBy("a", "b", "i").agg(F.avg("v").alias("v"))


def views(spark, sf):
    """The frames, as tiles of 48 x 48."""
    grid = _frames(spark, sf).select("a").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(BASE * BASE - 1))))
    grid = grid.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    base = grid.join(_cells(spark, sf), ["a", "b", "i"], "left").select(
        "a", F.expr(f"cast(floor(b / {BASE}) * 8 + floor(i / 8) as int)").alias("y"), F.expr(f"b % {BASE} * 8 + i % 8").alias("x"),
        F.coalesce(F.floor((F.col("v") + 0.6) * 200), F.lit(120)).cast("int").alias("v"))
    p = base.join(_frames(spark, sf), "a").withColumn("r", F.expr(f"y - {DY}")).withColumn("c", F.expr(f"x - {DX}"))
    p = p.where(f"r between 0 and {SIDE - 1} and c between 0 and {SIDE - 1}")
    p = p.withColumn("o", F.expr("least(3, greatest(0, cast(floor((r - 11) / 30) as int)))"))
    mover = F.expr(f"abs(r - ({MOVER_ROW})) <= 3 and abs(c - ({MOVER_COL})) <= 3")
    p = p.select("a", "frame", F.floor(F.col("r") / TILE).cast("int").alias("ty"), F.floor(F.col("c") / TILE).cast("int").alias("tx"),
                 F.struct("r", "c", F.when(mover, 255).otherwise(F.col("v")).alias("v")).alias("p"))
    t = p.groupBy("a", "frame", "ty", "tx").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return t.select(
        _aoi().alias("aoi"), "frame", "ty", "tx", (F.col("ty") * TILE).alias("r0"), (F.col("tx") * TILE).alias("c0"),
        F.lit(TILE).alias("h"), F.lit(TILE).alias("w"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), pack_u8("p.v").alias("px"))


def keypoints(spark, sf):
    """One keypoint for each cell that has a vector; every seventh is found at a wrong place."""
    k = _cells(spark, sf).where("i = 0").join(_frames(spark, sf), "a")
    wrong = F.when(F.col("b") % 7 == 0, F.col("frame") % 4 * 20).otherwise(0)
    k = k.select(
        _aoi().alias("aoi"), "frame", F.col("b").cast("long").alias("kp_id"), F.array(*[F.xxhash64("a", "b", F.lit(w)) for w in range(4)]).alias("desc"),
        (F.expr(f"b % {BASE} * 8 + 3 - {DX}") + wrong).cast("double").alias("x"), F.expr(f"cast(floor(b / {BASE}) * 8 + 3 - {DY} as double)").alias("y"))
    return k


def truth(spark, sf):
    """Tracks of the movers, in degrees at the middle of their pixel."""
    d = _frames(spark, sf).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(3))))
    d = d.withColumn("r", F.expr(MOVER_ROW)).withColumn("c", F.expr(MOVER_COL))
    box = {b[0]: b[1:] for b in fixed.AOI_BOXES}
    ulx, uly, lrx, lry = (F.array(*[F.lit(box[a][i]) for a in AOIS])[F.col("a")] for i in range(4))
    return d.select(
        (F.col("a") * 4 + F.col("o")).cast("long").alias("id"), F.col("frame").alias("frame_number"),
        (uly + (F.col("r") + 0.5) * (lry - uly) / SIDE).alias("latitude"), (ulx + (F.col("c") + 0.5) * (lrx - ulx) / SIDE).alias("longitude"),
        F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))


def brighter_regressor():
    """Deterministic stand-in: 3x3 block means of what became brighter, in [0, 1]."""
    def run(x):
        d = np.clip(x[:, 0] - x[:, 1], 0, None).reshape(-1, 15, 3, 15, 3).mean(axis=(2, 4))
        return (d / 160).reshape(len(x), 225)

    return run


MATRICES = fx.with_(MOVERS) + f"""select case a when 0 then '{AOIS[0]}' else '{AOIS[1]}' end as aoi, src_frame, dst_frame,
 [1.0e0, 0.0e0, cast(sx-dx as double), 0.0e0, 1.0e0, cast(sy-dy as double), 0.0e0, 0.0e0, 1.0e0] as h
from (select d.a, s.frame as src_frame, d.frame as dst_frame, s.dx as sx, s.dy as sy, d.dx as dx, d.dy as dy
 from (select *, {DY} as dy, {DX} as dx from fs) d join (select *, {DY} as dy, {DX} as dx from fs) s
 on s.a=d.a and s.frame between d.frame-{N} and d.frame-1 where d.frame>={N}) q"""


def _matrices(spark, sf, plan):
    frames = _frames(spark, sf).select(_aoi().alias("aoi"), "frame")
    h, _ = multi_aoi.register(keypoints(spark, sf), frames, N, multi_aoi.Registration(plan=plan))
    return h.select(*sq.PAIR, F.transform("h", lambda v: F.round(v, 4) + F.lit(0.0)).alias("h"))


@query("register_direct", MATRICES)
def register_direct(spark, sf):
    """Keypoints to the matrices of all template pairs, each estimated."""
    return _matrices(spark, sf, "direct")


@query("register_seeded", MATRICES)
def register_seeded(spark, sf):
    """Keypoints to the matrices of all template pairs, most of them composed."""
    return _matrices(spark, sf, "seeded")


REPORT = fx.with_(MOVERS, f"""n as (select case a when 0 then '{AOIS[0]}' else '{AOIS[1]}' end as aoi, count(*) as n
from mv where frame>={N} and c between 15 and {SIDE - 16} and r between 15 and {SIDE - 16} group by 1),
al as (select aoi, n from n union all select 'overall', cast(sum(n) as bigint) from n)""") + """
select aoi, n as tp, cast(0 as bigint) as fp, cast(0 as bigint) as fn, n as n_gt, n as n_det, 1.0e0 as "precision", 1.0e0 as recall, 1.0e0 as f1 from al"""


@query("run_multi_aoi", REPORT)
def run_multi_aoi(spark, sf):
    """Keypoints, tiles and tracks to scores: every mover is found, and nothing else."""
    last = _frames(spark, sf).agg(F.max("frame")).first()[0]
    s = de.Settings(tile=TILE, templates=N, threshold=20, use_motion=False, blank_area=4000, use_prior=True, prior_limit=0.05, prior_side=16)
    d = multi_aoi.run(
        views(spark, sf), keypoints(spark, sf), truth(spark, sf), 0, last, SIDE, SIDE, multi_aoi.Registration(plan="seeded"), s,
        stand_in_classifier, brighter_regressor, prior_model=stand_in_prior, match_m=20.0)
    return _rounded(d)

"""Queries over patches, scores, regions, windows, peaks and scene priors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.functions import arrays, pixels as px
from skyquilt.operators import components, overlay, refine, tiles as tl
from skyquilt.plans import detection as de
from skyquilt.workload import fixtures as fx
from skyquilt.workload.raster import N, T, _templates, _tiles
from skyquilt.workload.registry import query


def stand_in_classifier():
    """Deterministic stand-in: how much the centre differs from the past."""
    def run(x):
        d = np.abs(x[:, 0, 9:12, 9:12] - x[:, 1, 9:12, 9:12]).mean(axis=(1, 2))
        p = 1 / (1 + np.exp(-(d - 25) / 4))
        return np.stack([p, 1 - p], axis=1)

    return run


def stand_in_regressor():
    """Deterministic stand-in: 3x3 block means of the change, in [0, 1]."""
    def run(x):
        d = np.abs(x[:, 0] - x[:, 1]).reshape(-1, 15, 3, 15, 3).mean(axis=(2, 4))
        return (d / 160).reshape(len(x), 225)

    return run


def stand_in_prior():
    def run(x):
        return x.reshape(len(x), -1)

    return run


def _channels(spark, sf):
    t = _tiles(spark, sf)
    return t, refine.channels(t, _templates(t).withColumnRenamed("dst_frame", "frame"), N)


def _points(spark, sf, low, half):
    t = _tiles(spark, sf)
    p = px.explode_pixels(t).where(F.col("v") >= low).withColumn("height", F.lit(48)).withColumn("width", F.lit(48))
    p = p.where(refine.screen_fits()) if half == 10 else p.where(refine.window_fits(F.col("r"), F.col("c"), F.lit(48), F.lit(48)))
    return p.select("aoi", "frame", (F.col("r") * 48 + F.col("c")).cast("long").alias("pid"), "r", "c",
                    F.array(F.lit(48).cast("long"), F.lit(48).cast("long")).alias("info"))


def _patch_sql(cond, half):
    side = 2 * half + 1
    return fx.with_(fx.MOSAIC, f"pts as (select aoi, frame, r, c from mos where frame>=3 and {cond})") + f"""
select p.aoi, p.frame, cast(p.r*48+p.c as bigint) as pid, cast(k.ch as int) as ch, sum(m.v)::bigint as s,
 sum(m.v*((m.r-p.r+{half})*{side}+(m.c-p.c+{half})))::bigint as w from pts p, (select unnest(range(4)) as ch) k, mos m
where m.aoi=p.aoi and m.frame=p.frame-k.ch and m.r between p.r-{half} and p.r+{half} and m.c between p.c-{half} and p.c+{half} group by all"""


def _patch_sums(p, side):
    area = side * side
    d = p.select("aoi", "frame", "pid", F.posexplode("px").alias("i", "v")).withColumn("ch", F.floor(F.col("i") / area).cast("int"))
    return d.groupBy("aoi", "frame", "pid", "ch").agg(
        F.sum("v").cast("bigint").alias("s"), F.sum(F.col("v") * (F.col("i") % area)).cast("bigint").alias("w"))


@query("i12_patches_21", _patch_sql("v>=165 and r-10>0 and c-10>0 and r+11<48 and c+11<48", 10))
def i12_patches_21(spark, sf):
    _, ch = _channels(spark, sf)
    return _patch_sums(refine.extract_patches(ch, _points(spark, sf, 165, 10), T, 10), 21)


@query("i12_patches_45", _patch_sql("v>=100 and r-22>0 and c-22>0 and r+22<48 and c+22<48", 22))
def i12_patches_45(spark, sf):
    _, ch = _channels(spark, sf)
    return _patch_sums(refine.extract_patches(ch, _points(spark, sf, 100, 22), T, 22), 45)


@query("c8_patch_fits", fx.with_(fx.TRACKS, fx.DETS) + """select seq, (y-10>0 and x-10>0 and y+11<600 and x+11<800) as fits21,
 (trunc(y+0.3e0-22)>0 and trunc(x+0.6e0-22)>0 and trunc(y+0.3e0+22)<600 and trunc(x+0.6e0+22)<800) as fits45 from dets""")
def c8_patch_fits(spark, sf):
    d = fx.dets(spark, sf).withColumn("height", F.lit(600)).withColumn("width", F.lit(800))
    return d.select("seq", refine.screen_fits("y", "x").alias("fits21"),
                    refine.window_fits(F.col("y") + 0.3, F.col("x") + 0.6, F.lit(600), F.lit(800)).alias("fits45"))


@query("j1_batched_scores", """select vec_id, [round((list_sum(embedding[1:16])+16*0.25e0)/16,3)+0.0e0, round(list_sum(embedding[17:64])/48,3)+0.0e0] as pred from embeddings""")
def j1_batched_scores(spark, sf):
    def load():
        return lambda x: np.stack([x[:, 0].mean(axis=(1, 2)) + 0.25, x[:, 1:].mean(axis=(1, 2, 3))], axis=1)

    e = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("px"))
    d = refine.score(e, load, (4, 4, 4), double=True)
    return d.select("vec_id", F.transform("pred", lambda v: F.round(v, 3) + 0.0).alias("pred"))


@query("d12_model_broadcast", """select vec_id, [round(list_sum(embedding[1:16])/16-0.5e0,3)+0.0e0, round(list_sum(embedding[49:64])/16+1,3)+0.0e0] as pred from embeddings""")
def d12_model_broadcast(spark, sf):
    def load():
        return lambda x: np.stack([x[:, 0].mean(axis=(1, 2)), x[:, 3].mean(axis=(1, 2))], axis=1)

    e = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("px"))
    d = refine.score(e, load, (4, 4, 4), mean=np.array([0.5, 0, 0, -1]), double=True)
    return d.select("vec_id", F.transform("pred", lambda v: F.round(v, 3) + 0.0).alias("pred"))


@query("c7_score_acceptance", fx.with_(fx.TRACKS, fx.DETS) + "select seq, x, y from dets where cast(score as float)>cast(0.7e0 as float)")
def c7_score_acceptance(spark, sf):
    d = fx.dets(spark, sf).withColumn("pred", F.array(F.col("score").cast("float"), (1 - F.col("score")).cast("float")))
    return refine.accept(d).select("seq", "x", "y")


@query("i13_candidate_regions", fx.with_(fx.MOSAIC, """px0 as materialized (select distinct aoi, frame, r+a as r, c+b as c from mos, (select unnest(range(-3,4)) as a) x, (select unnest(range(-3,4)) as b) y
 where v>=195 and r-10>0 and c-10>0 and r+11<48 and c+11<48)""", """lk as materialized (select a.aoi, a.frame, a.r*48+a.c as x, b.r*48+b.c as y from px0 a join px0 b on a.aoi=b.aoi and a.frame=b.frame and abs(a.r-b.r)+abs(a.c-b.c)=1)""",
    """re as (select aoi, frame, r*48+c as x, r*48+c as y from px0 union select re.aoi, re.frame, re.x, lk.y from re join lk on lk.aoi=re.aoi and lk.frame=re.frame and lk.x=re.y)""",
    "lb as (select aoi, frame, x, min(y) as label from re group by all)") + """select aoi, frame, cast(label as bigint) as region_id, cast(min(x//48) as int) as r0, cast(min(x%48) as int) as c0,
 cast(max(x//48)+1 as int) as r1, cast(max(x%48)+1 as int) as c1, count(*) as area from lb group by aoi, frame, label""")
def i13_candidate_regions(spark, sf):
    p = px.explode_pixels(fx.mosaic(spark, sf)).where("v >= 195").withColumn("height", F.lit(48)).withColumn("width", F.lit(48)).where(refine.screen_fits())
    return components.regions(refine.region_mask(p, T), 4).drop("centroid_r", "centroid_c")


REG = """rg as (select frame, seq as region_id, cast(y as int) as r0, cast(x as int) as c0, cast(y+5+seq%61 as int) as r1, cast(x+5+seq%47 as int) as c1,
 y+(5+seq%61)/2.0e0+0.25e0 as cr, x+(5+seq%47)/2.0e0+0.125e0 as cc from dets where y>=0 and x>=0)"""
AX = """{a}x as (select region_id, unnest(case when r1-r0<=22.5e0 and c1-c0<=22.5e0 then [0] else range(0, cast(floor((greatest({h},{m})-least({l}+11,{m}))/22) as int)+1) end) as k from rg)"""
I14 = fx.with_(fx.TRACKS, fx.DETS, REG, AX.format(a="r", h="r1", m="cr", l="r0"), AX.format(a="c", h="c1", m="cc", l="c0")) + """
select frame, region_id, cast(rk as int) as wi, cast(ck as int) as wj, cast(trunc(ra-22) as int) as min_r, cast(trunc(ca-22) as int) as min_c from (
select rg.*, rx.k as rk, cx.k as ck, case when r1-r0<=22.5e0 and c1-c0<=22.5e0 then cr else least(r0+11,cr)+22*rx.k end as ra,
 case when r1-r0<=22.5e0 and c1-c0<=22.5e0 then cc else least(c0+11,cc)+22*cx.k end as ca from rg join rx using (region_id) join cx using (region_id)) q
where trunc(ra-22)>0 and trunc(ca-22)>0 and trunc(ra+22)<600 and trunc(ca+22)<800"""


@query("i14_window_plan", I14)
def i14_window_plan(spark, sf):
    d = fx.dets(spark, sf).where("y >= 0 and x >= 0")
    h, w = F.col("seq") % 61 + 5, F.col("seq") % 47 + 5
    r = d.select(F.lit("a").alias("aoi"), "frame", F.col("seq").alias("region_id"), F.col("y").cast("int").alias("r0"), F.col("x").cast("int").alias("c0"),
                 (F.col("y") + h).cast("int").alias("r1"), (F.col("x") + w).cast("int").alias("c1"),
                 (F.col("y") + h / 2.0 + 0.25).alias("centroid_r"), (F.col("x") + w / 2.0 + 0.125).alias("centroid_c"),
                 F.lit(600).alias("height"), F.lit(800).alias("width"))
    return refine.plan_windows(r).select("frame", "region_id", "wi", "wj", "min_r", "min_c")


I15_SQL = f"""with recursive m as (select vec_id, i, cast(embedding[i+1] + cast(0.1 as float) as float) as v from embeddings, (select cast(unnest(range(64)) as int) as i) g),
top as (select vec_id, cast(max(v) as double) as t from m group by vec_id),
lv as (select vec_id, 0 as k, t-0.01e0 as lev from top where t >= {refine.PEAK_LIMIT!r}e0
 union all select vec_id, k+1, lev-0.01e0 from lv where lev > {refine.PEAK_LIMIT!r}e0),
le as (select vec_id, k, cast(greatest(lev, {refine.PEAK_LIMIT!r}e0) as float) as lev from lv),
met as materialized (select m.vec_id, m.i, any_value(m.v) as v, min(le.k) as k from m join le on le.vec_id=m.vec_id and m.v>=le.lev group by 1, 2),
nb as materialized (select a.vec_id, a.i, b.i as j, a.k as ki, b.k as kj from met a join met b on a.vec_id=b.vec_id
 and (b.i in (a.i-8, a.i+8) or (b.i=a.i-1 and a.i%8>0) or (b.i=a.i+1 and a.i%8<7))),
walk as (select vec_id, i, i as j from met union select w.vec_id, w.i, n.j from walk w join nb n on n.vec_id=w.vec_id and n.i=w.j and n.ki=n.kj),
zone as materialized (select vec_id, i, min(j) as z from walk group by 1, 2),
old as (select distinct n.vec_id, z.z from nb n join zone z on z.vec_id=n.vec_id and z.i=n.i where n.kj<n.ki),
born as (select m.vec_id, z.z, any_value(m.k) as k, arg_min(m.i, (-m.v, m.i)) as i from met m join zone z using (vec_id, i) anti join old using (vec_id, z) group by 1, 2),
cells as (select vec_id, 0 as phase, 0 as k, i as z, i from m join top using (vec_id) where v=t and t >= {refine.PEAK_LIMIT!r}e0
 union all select vec_id, 1, k, z, i from born),
once as (select vec_id, i, min((phase, k, z)) as o from cells group by 1, 2)
select vec_id, cast(row_number() over (partition by vec_id order by o)-1 as int) as k, cast(i//8 as int) as pr, cast(i%8 as int) as pc from once"""


@query("i15_heatmap_peaks", I15_SQL)
def i15_heatmap_peaks(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v + F.lit(0.1).cast("float")).alias("pred"))
    return refine.peaks(e, side=8)


@query("f5_max_cells", fx.with_(fx.PIXELS) + "select aoi, frame, r, c, v from pix qualify v=max(v) over (partition by aoi, frame)")
def f5_max_cells(spark, sf):
    f = fx.frames(spark, sf)
    return f.select("aoi", "frame", F.explode(arrays.max_cells(F.col("px"), 8)).alias("e")).select("aoi", "frame", "e.r", "e.c", "e.v")


@query("h2_peak_dedup", fx.with_(fx.TRACKS, fx.DETS) + "select frame, cast(floor(x/25) as bigint) as c, cast(floor(y/25) as bigint) as r, min(seq) as seq from dets group by 1,2,3")
def h2_peak_dedup(spark, sf):
    d = fx.dets(spark, sf).select("frame", F.floor(F.col("x") / 25).alias("c"), F.floor(F.col("y") / 25).alias("r"), "seq")
    return refine.first_peaks(d, ["frame"])


@query("c9_inside_bbox", fx.with_(fx.TRACKS, fx.DETS) + "select seq, x, y from dets where y>20+seq%50 and y<300+seq%70 and x>30 and x<500+seq%11")
def c9_inside_bbox(spark, sf):
    d = fx.dets(spark, sf)
    d = d.withColumn("r", F.col("y")).withColumn("c", F.col("x")).withColumn("r0", 20 + F.col("seq") % 50).withColumn("r1", 300 + F.col("seq") % 70)
    d = d.withColumn("c0", F.lit(30)).withColumn("c1", 500 + F.col("seq") % 11)
    return refine.inside_box(d).select("seq", "x", "y")


@query("c10_in_image", fx.with_(fx.TRACKS, fx.DETS) + "select seq, (x>=0 and x<700 and y>=0 and y<400) as kept, (x>0 and x<700 and y>0 and y<400) as drawn from dets")
def c10_in_image(spark, sf):
    x, y = F.col("x"), F.col("y")
    return fx.dets(spark, sf).select("seq", overlay.in_image(x, y, 700, 400).alias("kept"), overlay.in_image(x, y, 700, 400, "strict").alias("drawn"))


@query("b11_diagonal_coords", fx.with_(fx.TRACKS, fx.DETS) + "select seq, cast(y as int)+cast(i as int) as r, cast(x as int)+cast(i as int) as c from dets, (select unnest(range(-5,6)) as i) k")
def b11_diagonal_coords(spark, sf):
    d = fx.dets(spark, sf).select("seq", F.explode(refine.diagonal_coords(F.col("y").cast("int"), F.col("x").cast("int"))).alias("p"))
    return d.select("seq", "p.r", "p.c")


@query("b12_output_projection", fx.with_(fx.TRACKS, fx.DETS) + "select 0 as aoi, frame, seq, cast(trunc(x+0.7e0) as int) as x, cast(trunc(y+0.2e0) as int) as y from dets")
def b12_output_projection(spark, sf):
    d = fx.dets(spark, sf).select(F.lit(0).alias("aoi"), "frame", "seq", (F.col("y") + 0.2).alias("r"), (F.col("x") + 0.7).alias("c"))
    return de.to_output(d)


def resize_sql(n, m):
    def tap(i):
        x = f"(({i}+0.5e0)*{n}/{m}.0e0-0.5e0)"
        return (f"cast(greatest(0,least({n-1},floor({x}))) as int)", f"cast(greatest(0,least({n-1},floor({x})+1)) as int)", f"({x}-floor({x}))")
    r0, r1, fr = tap("i")
    c0, c1, fc = tap("j")

    def at(r, c):
        return f"px[{r}*{n}+{c}+1]"
    return f"(({at(r0,c0)}*(1-{fc})+{at(r0,c1)}*{fc})*(1-{fr})+({at(r1,c0)}*(1-{fc})+{at(r1,c1)}*{fc})*{fr})"


@query("b9_bilinear_resize", fx.with_(fx.FRAMES) + f"select aoi, frame, cast(i as int) as i, cast(j as int) as j, round({resize_sql(8,24)},2) as v from fr, (select unnest(range(24)) as i) a, (select unnest(range(24)) as j) b")
def b9_bilinear_resize(spark, sf):
    f = fx.frames(spark, sf).select("aoi", "frame", refine.resize_heatmap(F.transform("px", lambda v: v.cast("float")), 24).alias("h"))
    d = f.select("aoi", "frame", F.posexplode("h").alias("k", "v"))
    return d.select("aoi", "frame", F.floor(F.col("k") / 24).cast("int").alias("i"), (F.col("k") % 24).alias("j"), F.round(F.col("v").cast("double"), 2).alias("v"))


@query("b10_nearest_resize", fx.with_(fx.FRAMES) + "select aoi, frame, cast(i as int) as i, cast(j as int) as j, px[(i*8//5)*8+(j*8//5)+1] as v from fr, (select unnest(range(5)) as i) a, (select unnest(range(5)) as j) b")
def b10_nearest_resize(spark, sf):
    f = fx.frames(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
    at = arrays.nearest_source(F.col("i"), 8, 5) * 8 + arrays.nearest_source(F.col("j"), 8, 5)
    return f.select("aoi", "frame", "i", "j", F.col("px")[at].alias("v"))


PRIOR = resize_sql(8, 48).replace("px[", "p.px[")


@query("c6_scene_prior", fx.with_(fx.MOSAIC, "p as (select label as lb, frame, px from (select label, cast(row_number() over (partition by label order by vec_id)-1 as int) as frame, list_transform(embedding, lambda v: cast(floor((cast(v as double)+0.6e0)*200) as int)) as px from embeddings) z)")
       + f"select m.aoi, m.frame, m.r, m.c from (select aoi, frame, r, c, r as i, c as j from mos where v>=150) m join p on cast(p.lb as varchar)=m.aoi and p.frame=m.frame where {PRIOR}>=118.001e0")
def c6_scene_prior(spark, sf):
    pr = fx.frames(spark, sf).select(F.col("aoi").cast("string").alias("aoi"), "frame", F.lit(48).alias("height"), F.lit(48).alias("width"), F.col("px").alias("pred"))
    d = px.explode_pixels(fx.mosaic(spark, sf)).where("v >= 150").drop("v")
    return refine.scene_prior_filter(d, pr, 118.001, 8)


@query("d11_prior_lookup", fx.with_(fx.MOSAIC, "p as (select label as lb, frame, px from (select label, cast(row_number() over (partition by label order by vec_id)-1 as int) as frame, list_transform(embedding, lambda v: cast(floor((cast(v as double)+0.6e0)*200) as int)) as px from embeddings) z)")
       + f"select m.aoi, m.frame, m.r, m.c, round({PRIOR},6) as prior from (select aoi, frame, r, c, r as i, c as j from mos) m join p on cast(p.lb as varchar)=m.aoi and p.frame=m.frame")
def d11_prior_lookup(spark, sf):
    pr = fx.frames(spark, sf).select(F.col("aoi").cast("string").alias("aoi"), "frame", F.lit(48).alias("height"), F.lit(48).alias("width"), F.col("px").alias("pred"))
    return refine.prior_values(px.explode_pixels(fx.mosaic(spark, sf)), pr, 8).withColumn("prior", F.round("prior", 6))


@query("i23_scene_prior_map", fx.with_(fx.MOSAIC) + "select aoi, frame, cast(r//3 as int) as i, cast(c//3 as int) as j, round(v/255.0e0,5) as p from mos where r%3=1 and c%3=1")
def i23_scene_prior_map(spark, sf):
    d = refine.score(refine.prior_inputs(_tiles(spark, sf), 16), stand_in_prior, (1, 16, 16))
    d = d.select("aoi", "frame", F.posexplode("pred").alias("k", "p"))
    return d.select("aoi", "frame", F.floor(F.col("k") / 16).cast("int").alias("i"), (F.col("k") % 16).alias("j"), F.round(F.col("p").cast("double"), 5).alias("p"))


def _settings(**kw):
    return de.Settings(tile=48, templates=N, threshold=20, motion_method="frame_diff", blank_area=4000, **kw)


def _scene(spark, sf):
    return tl.retile(fx.scene(spark, sf), 48)


@query("i16_refinement")
def i16_refinement(spark, sf):
    t = _scene(spark, sf)
    s = _settings(use_motion=False)
    sub = session.cut(de.background_stage(t, None, s), "subtracted")
    return de.refine_stage(t, sub, s, stand_in_classifier, stand_in_regressor)


@query("detect_frames")
def detect_frames(spark, sf):
    """Registered frames to output pixels, with motion and scene prior."""
    s = _settings(use_prior=True, prior_limit=0.31, prior_side=16)
    return de.detect(_scene(spark, sf), None, s, stand_in_classifier, stand_in_regressor, prior_model=stand_in_prior)

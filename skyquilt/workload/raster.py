"""Queries over tiles: registration, background, candidates, components, motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquilt.functions import pixels as px
from skyquilt.operators import background as bg, components, motion as mo, sequence as sq, tiles as tl
from skyquilt.workload import fixtures as fx
from skyquilt.workload.registry import query

N = 3
T = 16  # tile side for the kernels; the frames are 48x48


def _tiles(spark, sf):
    return tl.retile(fx.mosaic(spark, sf), T)


def _templates(tiles, n=N):
    return bg.identity_templates(tiles, sq.template_pairs(tiles.select("aoi", "frame").distinct(), n))


MED = fx.MOSAIC + """, med as materialized (
select aoi, frame, r, c, v, list_median(w) as m from (
 select *, list(v) over (partition by aoi, r, c order by frame rows between 3 preceding and 1 preceding) as w from mos) q where len(w)=3)"""
MED = MED.replace("list_median(w)", "list_aggregate(w,'median')")


@query("e4_temporal_median", fx.with_(fx.PIXELS) + """select aoi, frame, r, c, list_aggregate(w,'median') as m from (
 select *, list(v) over (partition by aoi, r, c order by frame rows between 4 preceding and 1 preceding) as w from pix) q where len(w)=4""")
def e4_temporal_median(spark, sf):
    f = fx.frames(spark, sf)
    t = f.select("aoi", "frame", F.lit(0).alias("ty"), F.lit(0).alias("tx"), F.lit(0).alias("r0"), F.lit(0).alias("c0"),
                 F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(8).alias("height"), F.lit(8).alias("width"), px.pack_u8("px").alias("px"))
    return px.explode_pixels(tl.temporal_median(t, 4), px.unpack_f8, "m")


@query("b17_background_difference", fx.with_(MED) + "select aoi, frame, r, c, abs(v-m) as d from med")
def b17_background_difference(spark, sf):
    t = _tiles(spark, sf)
    d = bg.subtract(bg.stack(t, _templates(t), T, 2), T, brightness=None, halo=2, keep=("diff",))
    return px.explode_pixels(d.withColumn("px", F.col("diff")), px.unpack_f8, "d")


@query("c11_threshold", fx.with_(MED) + "select aoi, frame, r, c, cast(abs(v-m)>=30 as int) as b from med")
def c11_threshold(spark, sf):
    t = _tiles(spark, sf)
    d = bg.subtract(bg.stack(t, _templates(t), T, 2), T, 30, brightness=None, halo=2, keep=("raw",))
    return px.explode_pixels(d.withColumn("px", F.col("raw")), px.unpack_u8, "b")


OPEN = """bin as materialized (select aoi, frame, r, c from med where abs(v-m)>=15),
ero as materialized (select b.aoi, b.frame, b.r, b.c from bin b join bin o on o.aoi=b.aoi and o.frame=b.frame and b.r-o.r in (0,1) and b.c-o.c in (0,1)
 group by all having count(*)=(case when b.r>0 then 2 else 1 end)*(case when b.c>0 then 2 else 1 end)),
opn as materialized (select distinct aoi, frame, r+dr as r, c+dc as c from ero, (values (0,0),(0,1),(1,0),(1,1)) o(dr,dc) where r+dr<48 and c+dc<48)"""


def _opened(spark, sf, halo=2):
    t = _tiles(spark, sf)
    return bg.subtract(bg.stack(t, _templates(t), T, halo), T, 15, brightness=None, halo=halo, keep=())


@query("i8_opening", fx.with_(MED, OPEN) + "select aoi, frame, cast(r as int) as r, cast(c as int) as c from opn")
def i8_opening(spark, sf):
    return bg.set_pixels(_opened(spark, sf)).select("aoi", "frame", "r", "c")


I9 = """select mode, aoi, frame, cast(i*16+j as bigint) as seq, cast(case mode when 'base' then 3*(i-1)+2 else 3*i+1 end as int) as r,
 cast(case mode when 'base' then 3*(j-1)+2 else 3*j+1 end as int) as c
from (select *, r//3 as i, c//3 as j from opn where r%3=0 and c%3=0) q, (values ('base'),('motion')) m(mode)"""


@query("i9_candidate_centres", fx.with_(MED, OPEN) + I9)
def i9_candidate_centres(spark, sf):
    p = bg.set_pixels(_opened(spark, sf))
    both = [bg.candidates(p, m).withColumn("mode", F.lit(n)) for m, n in ((False, "base"), (True, "motion"))]
    return both[0].unionByName(both[1]).select("mode", "aoi", "frame", "seq", "r", "c")


@query("i6_brightness_compensation")
def i6_brightness_compensation(spark, sf):
    t = _tiles(spark, sf)
    return px.explode_pixels(bg.compensated(t, _templates(t), T), keys=("aoi", "frame", "slot"))


# ------------------------------------------------------------- components

CC_BASE = """on_ as materialized (select aoi, frame, r, c, r*48+c as id from mos where v>=160),
lk{k} as materialized (select a.aoi, a.frame, a.id as x, b.id as y from on_ a join on_ b on a.aoi=b.aoi and a.frame=b.frame
 and abs(a.r-b.r)<=1 and abs(a.c-b.c)<=1 {extra}),
re{k} as (select aoi, frame, id as x, id as y from on_ union select re.aoi, re.frame, re.x, lk.y from re{k} re join lk{k} lk on lk.aoi=re.aoi and lk.frame=re.frame and lk.x=re.y),
lb{k} as materialized (select aoi, frame, cast(x//48 as int) as r, cast(x%48 as int) as c, min(y) as label from re{k} group by aoi, frame, x)"""
CC4 = CC_BASE.format(k=4, extra="and abs(a.r-b.r)+abs(a.c-b.c)=1")
CC8 = CC_BASE.format(k=8, extra="")


def _bright(spark, sf, limit=160):
    @F.pandas_udf("binary")
    def over(b):
        import numpy as np
        return b.map(lambda x: (np.frombuffer(x, np.uint8) >= limit).astype(np.uint8).tobytes())

    return fx.mosaic(spark, sf).withColumn("px", over("px"))


@query("i11_components", fx.with_(fx.MOSAIC, CC4) + "select aoi, frame, r, c, cast(label as bigint) as label from lb4")
def i11_components(spark, sf):
    return components.pixel_labels(_bright(spark, sf), 4)


@query("i11_components_8", fx.with_(fx.MOSAIC, CC8) + "select aoi, frame, r, c, cast(label as bigint) as label from lb8")
def i11_components_8(spark, sf):
    return components.pixel_labels(_bright(spark, sf), 8)


@query("e12_region_properties", fx.with_(fx.MOSAIC, CC4) + """select aoi, frame, cast(label as bigint) as region_id, min(r) as r0, min(c) as c0,
 max(r)+1 as r1, max(c)+1 as c1, count(*) as area, round(avg(r),6) as centroid_r, round(avg(c),6) as centroid_c from lb4 group by aoi, frame, label""")
def e12_region_properties(spark, sf):
    d = components.regions(_bright(spark, sf), 4)
    return d.withColumn("centroid_r", F.round("centroid_r", 6)).withColumn("centroid_c", F.round("centroid_c", 6))


@query("f4_component_peak", fx.with_(fx.MOSAIC, CC4) + """select l.aoi, l.frame, cast(label as bigint) as label, l.r, l.c, v from lb4 l
 join mos m on m.aoi=l.aoi and m.frame=l.frame and m.r=l.r and m.c=l.c
 qualify row_number() over (partition by l.aoi, l.frame, label order by v desc, l.r, l.c)=1""")
def f4_component_peak(spark, sf):
    lab = components.pixel_labels(_bright(spark, sf), 4)
    v = px.explode_pixels(fx.mosaic(spark, sf)).where("v >= 160")
    best = lab.join(v, ["aoi", "frame", "r", "c"]).groupBy("aoi", "frame", "label").agg(
        F.max(F.struct("v", (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))).alias("b"))
    return best.select("aoi", "frame", "label", (-F.col("b.r")).alias("r"), (-F.col("b.c")).alias("c"), "b.v")


I7 = """lay as (select aoi, frame, r, c, v, -1 as slot from mos where frame>=3
 union all select m.aoi, m.frame+k.k, m.r, m.c, m.v, 3-k.k from mos m, (values (1),(2),(3)) k(k) where m.frame+k.k>=3 and m.frame+k.k<=(select max(frame) from mos x where x.aoi=m.aoi)),
on_ as materialized (select aoi, frame*10+slot+1 as fs, frame, r, c, r*48+c as id from lay where v<=80 or v>=160),
lk as materialized (select a.aoi, a.fs, a.id as x, b.id as y from on_ a join on_ b on a.aoi=b.aoi and a.fs=b.fs and abs(a.r-b.r)<=1 and abs(a.c-b.c)<=1),
re as (select aoi, fs, id as x, id as y from on_ union select re.aoi, re.fs, re.x, lk.y from re join lk on lk.aoi=re.aoi and lk.fs=re.fs and lk.x=re.y),
lb as materialized (select aoi, fs, x, min(y) as label from re group by aoi, fs, x),
bigl as (select aoi, fs, label from lb group by all having count(*)>3),
bad as materialized (select distinct aoi, fs//10 as frame, x//48 as r, x%48 as c from lb where (aoi,fs,label) in (select (aoi,fs,label) from bigl))"""


@query("i7_invalid_area", fx.with_(fx.MOSAIC, I7) + """select distinct aoi, cast(frame as int) as frame, cast(r+dr as int) as r, cast(c+dc as int) as c
from bad, (select unnest(range(-2,4)) as dr) a, (select unnest(range(-2,4)) as dc) b where r+dr between 0 and 47 and c+dc between 0 and 47""")
def i7_invalid_area(spark, sf):
    """Blank = outside (80, 160), components over 3 pixels, grown by 6x6."""
    @F.pandas_udf("binary")
    def blank(b):
        import numpy as np

        def one(x):
            a = np.frombuffer(x, np.uint8)
            return np.where(a <= 80, 0, np.where(a >= 160, 255, 1)).astype(np.uint8).tobytes()

        return b.map(one)

    t = _tiles(spark, sf).withColumn("px", blank("px"))
    m = bg.invalid_area(t, _templates(t), T, 3, 6)
    return bg.set_pixels(m).select("aoi", "frame", "r", "c")


@query("h3_invalid_union", fx.with_(fx.MOSAIC, I7) + "select aoi, cast(frame as int) as frame, cast(r as int) as r, cast(c as int) as c from bad")
def h3_invalid_union(spark, sf):
    @F.pandas_udf("binary")
    def blank(b):
        import numpy as np

        def one(x):
            a = np.frombuffer(x, np.uint8)
            return ((a <= 80) | (a >= 160)).astype(np.uint8).tobytes()

        return b.map(one)

    t = _tiles(spark, sf)
    temps = _templates(t).select("aoi", F.col("dst_frame").alias("frame"), "slot", *tl.COLS[2:])
    cur = t.join(temps.select("aoi", "frame").distinct(), ["aoi", "frame"], "left_semi").withColumn("slot", F.lit(-1))
    layers = temps.unionByName(cur.select("aoi", "frame", "slot", *tl.COLS[2:])).withColumn("px", blank("px"))
    big = components.large_component_masks(layers, 8, 3, bg.STACK)
    return bg.set_pixels(bg.any_slot(big)).select("aoi", "frame", "r", "c")


# ------------------------------------------------------------- registration

WARP_H = [1.02, 0.03, -1.5, -0.02, 0.98, 2.25, 0.0004, -0.0003, 1.0]
_W = "(iv[7]*c+iv[8]*r+iv[9])"


def _inv_literal():
    import numpy as np
    return "[" + ",".join(repr(float(v)) + "e0" if "e" not in repr(float(v)) else repr(float(v)) for v in np.linalg.inv(np.array(WARP_H).reshape(3, 3)).ravel()) + "]"


I3 = f"""iv as (select {_inv_literal()} as iv),
pt as materialized (select aoi, frame, r, c, round((iv[1]*c+iv[2]*r+iv[3])/{_W},9) as x, round((iv[4]*c+iv[5]*r+iv[6])/{_W},9) as y from mos, iv),
pc as materialized (select aoi, frame, r, c, cast(floor(x) as int) as xi, cast(floor(y) as int) as yi, x-floor(x) as fx, y-floor(y) as fy from pt),
tap as (select p.*, k, coalesce(m.v, 255) as v from (select *, unnest(range(4)) as k from pc) p
left join mos m on m.aoi=p.aoi and m.frame=p.frame and m.r=yi+k//2 and m.c=xi+k%2),
four as (select aoi, frame, r, c, any_value(fx) as fx, any_value(fy) as fy, max(v) filter (where k=0) as v0, max(v) filter (where k=1) as v1,
 max(v) filter (where k=2) as v2, max(v) filter (where k=3) as v3 from tap group by aoi, frame, r, c)
select aoi, cast(frame+1 as int) as frame, r, c, cast(floor((v0*(1-fx)+v1*fx)*(1-fy)+(v2*(1-fx)+v3*fx)*fy+0.5e0) as int) as v from four"""


@query("i3_perspective_warp", fx.with_(fx.MOSAIC) .rstrip() + ",\n" + I3)
def i3_perspective_warp(spark, sf):
    t = _tiles(spark, sf)
    pairs = t.select("aoi", F.col("frame").alias("src_frame")).distinct().select(
        "aoi", "src_frame", (F.col("src_frame") + 1).alias("dst_frame"), F.lit(0).alias("slot"),
        F.array(*[F.lit(v) for v in WARP_H]).alias("h"))
    w = tl.warp(t, pairs, T).withColumnRenamed("dst_frame", "frame")
    return px.explode_pixels(w)


@query("i2_aoi_crop", fx.with_(fx.MOSAIC).rstrip() + """,
ot as (select unnest(range(20)) as r), oc as (select unnest(range(26)) as c),
pt as (select f.aoi, f.frame, ot.r, oc.c, round((oc.c+0.5e0)*1.25e0+5.3e0-0.5e0,9) as x, round((ot.r+0.5e0)*1.1e0+7.7e0-0.5e0,9) as y from (select distinct aoi, frame from mos) f, ot, oc),
pc as (select *, floor(x) as xi, floor(y) as yi, x-floor(x) as fx, y-floor(y) as fy from pt)
select p.aoi, p.frame, cast(p.r as int) as r, cast(p.c as int) as c, cast(floor((coalesce(a.v,0)*(1-fx)+coalesce(b.v,0)*fx)*(1-fy)+(coalesce(d.v,0)*(1-fx)+coalesce(e.v,0)*fx)*fy+0.5e0) as int) as v
from pc p left join mos a on a.aoi=p.aoi and a.frame=p.frame and a.r=yi and a.c=xi left join mos b on b.aoi=p.aoi and b.frame=p.frame and b.r=yi and b.c=xi+1
left join mos d on d.aoi=p.aoi and d.frame=p.frame and d.r=yi+1 and d.c=xi left join mos e on e.aoi=p.aoi and e.frame=p.frame and e.r=yi+1 and e.c=xi+1""")
def i2_aoi_crop(spark, sf):
    t = _tiles(spark, sf)
    gt = [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    out = [5.3, 1.25, 0.0, 7.7, 0.0, 1.1]
    w = t.select(F.col("aoi").alias("src_aoi"), "frame").distinct().select(
        "src_aoi", "frame", F.col("src_aoi").alias("aoi"), F.array(*[F.lit(v) for v in gt]).alias("gt"),
        F.array(*[F.lit(v) for v in out]).alias("out_gt"), F.lit(20).alias("out_height"), F.lit(26).alias("out_width"))
    return px.explode_pixels(tl.crop(t, w, T))


# ------------------------------------------------------------------- motion

FD = """fd as materialized (select aoi, frame, r, c, v, lag(v) over (partition by aoi, r, c order by frame) as p from mos)"""


@query("i17_frame_difference", fx.with_(fx.MOSAIC, FD) + "select aoi, frame, r, c, round(sqrt(2*abs(v-p)*abs(v-p)),2) as m from fd where p is not null")
def i17_frame_difference(spark, sf):
    d = px.explode_pixels(mo.frame_difference(_tiles(spark, sf), T), px.unpack_f4, "m")
    return d.withColumn("m", F.round("m", 2))


@query("i18_motion_map", fx.with_(fx.MOSAIC, FD) + """select aoi, frame, r, c, round(abs(v-p)/cast(max(abs(v-p)) over (partition by aoi, frame) as double),4) as m
 from fd where p is not null""")
def i18_motion_map(spark, sf):
    d = mo.motion_map(mo.frame_difference(_tiles(spark, sf), T), T, sigma=0)
    return px.explode_pixels(d, px.unpack_f4, "m").withColumn("m", F.round("m", 4))


@query("i18_motion_map_blurred")
def i18_motion_map_blurred(spark, sf):
    d = mo.estimate(_tiles(spark, sf), T, "frame_diff", sigma=3.0)
    return px.explode_pixels(d, px.unpack_f4, "m").withColumn("m", F.round("m", 4))


@query("e11_frame_max_scaling", fx.with_(fx.MOSAIC) + "select aoi, frame, r, c, round(v/cast(max(v) over (partition by aoi, frame) as double),4) as m from mos")
def e11_frame_max_scaling(spark, sf):
    t = fx.mosaic(spark, sf).withColumn("px", px.u8_to_f4("px"))
    return px.explode_pixels(tl.frame_max_scaled(t), px.unpack_f4, "m").withColumn("m", F.round("m", 4))


@query("i20_block_motion", fx.with_(fx.MOSAIC, """sh as (select dr, dc from (select unnest(range(-2,3)) as dr) a, (select unnest(range(-2,3)) as dc) b)""", """sad as (select m.aoi, m.frame, m.r//8*8 as r, m.c//8*8 as c, dr, dc, sum(abs(m.v-p.v)) as sad, count(*) as n
from mos m, sh, mos p where p.aoi=m.aoi and p.frame=m.frame-1 and p.r=m.r-dr and p.c=m.c-dc group by all)""") + """select aoi, frame, cast(r as int) as r, cast(c as int) as c, cast(dr as int) as u, cast(dc as int) as v, cast(sad as bigint) as sad from sad where n=64
qualify row_number() over (partition by aoi, frame, r, c order by sad, dr*dr+dc*dc, dr, dc)=1""")
def i20_block_motion(spark, sf):
    return mo.block_motion(_tiles(spark, sf), T, 8, 2)


@query("i20_flow_table", fx.with_(fx.MOSAIC) + """select aoi, frame, r, c, round(m/max(m) over (partition by aoi, frame), 5) as m from (
 select aoi, frame, r, c, case when v%7=0 then 0.0e0 else sqrt((v%5)*(v%5)+(v%3+0.5e0)*(v%3+0.5e0)) end as m from mos where frame>0) q""")
def i20_flow_table(spark, sf):
    """A flow field from outside: a row for each moving pixel, none for a seventh of them."""
    t = _tiles(spark, sf)
    v = F.col("v")
    flow = px.explode_pixels(t).where("frame > 0 and v % 7 <> 0").select("aoi", "frame", "r", "c", (v % 5).cast("double").alias("u"), (v % 3 + 0.5).alias("v"))
    d = px.explode_pixels(mo.estimate(t, T, "table", sigma=0, flow=flow), px.unpack_f4, "m")
    return d.withColumn("m", F.round("m", 5))


@query("b15_flow_magnitude", fx.with_(fx.FRAMES) + "select aoi, frame, cast(i as int) as i, round(sqrt(px[2*i+1]*px[2*i+1]+px[2*i+2]*px[2*i+2]),6) as m from fr, (select unnest(range(32)) as i) g")
def b15_flow_magnitude(spark, sf):
    f = fx.frames(spark, sf).select("aoi", "frame", "px", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    return f.select("aoi", "frame", "i", F.round(F.hypot(F.col("px")[2 * F.col("i")], F.col("px")[2 * F.col("i") + 1]), 6).alias("m"))


@query("b16_motion_fusion", fx.with_(fx.PIXELS) + """select aoi, frame, r, c, cast(case when c=7 then v else
 floor(greatest(0,least(255,v+10.0e0*(((r*8+c)/64.0e0)-0.5e0)*40))) end as int) as e from pix""")
def b16_motion_fusion(spark, sf):
    p = fx.frames(spark, sf).select("aoi", "frame", F.posexplode("px").alias("i", "v"))
    p = p.withColumn("r", F.floor(F.col("i") / 8).cast("int")).withColumn("c", F.col("i") % 8)
    m = (F.col("r") * 8 + F.col("c")) / F.lit(64.0)
    return p.select("aoi", "frame", "r", "c", mo.fuse(F.col("v").cast("double"), (m - 0.5) * 40 + 0.0, F.col("c") == 7, 10.0, 0.0).alias("e"))


@query("i19_warm_up", fx.with_(fx.FRAMES) + "select aoi, frame, case when frame=0 then 1.0e0 when frame=1 then 0.0e0 else px[1]/255.0e0 end as m from fr")
def i19_warm_up(spark, sf):
    f = fx.frames(spark, sf)
    pos = sq.frame_positions(f)
    return f.join(pos, ["aoi", "frame"]).select("aoi", "frame", mo.warm_up(F.col("pos"), F.col("px")[0] / 255.0).alias("m"))


@query("i10_background_pipeline")
def i10_background_pipeline(spark, sf):
    from skyquilt.plans import detection as de
    s = de.Settings(tile=T, templates=N, threshold=20, motion_method="frame_diff", blank_area=400)
    return bg.set_pixels(de.background_stage(_tiles(spark, sf), None, s, keep=("opened",))).select("aoi", "frame", "r", "c")


@query("i24_stage_outputs")
def i24_stage_outputs(spark, sf):
    from skyquilt.plans import detection as de
    s = de.Settings(tile=T, templates=N, threshold=8, motion_method="frame_diff", motion_tau=0.5, blank_area=400)
    d = de.stages(_tiles(spark, sf), None, s)
    return d.select("aoi", "frame", "ty", "tx", "stage", F.octet_length("px").alias("bytes"), F.md5("px").alias("digest"))

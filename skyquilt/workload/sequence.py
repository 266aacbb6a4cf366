"""Queries over frame sequences, homographies and descriptor matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquilt.functions.geo import error_ellipse
from skyquilt.operators import ordering, sequence as sq
from skyquilt.workload import fixtures as fx
from skyquilt.workload.registry import query


def _with_gaps(frames):
    """Frame numbers with gaps, so that list order and number order differ."""
    return frames.withColumn("frame", (F.col("frame") + F.floor(F.col("frame") / 3) * 2).cast("int"))


@query("d5_template_pairs", fx.with_(fx.FRAMES, "p as (select aoi, frame, row_number() over (partition by aoi order by frame)-1 as pos from (select aoi, frame+frame//3*2 as frame from fr) g)") + """
select d.aoi, d.frame as dst_frame, cast(4-(d.pos-s.pos) as int) as slot, s.frame as src_frame
from p d join p s on s.aoi=d.aoi and s.pos between d.pos-4 and d.pos-1 where d.pos>=4""")
def d5_template_pairs(spark, sf):
    return sq.template_pairs(_with_gaps(fx.frames(spark, sf)), 4)


@query("d5_template_pairs_double", fx.with_(fx.FRAMES, "k as (select unnest(range(5)) as slot)") + """
select aoi, frame as dst_frame, cast(slot as int) as slot,
 cast(case when 2*(frame-5)+slot<5 then 2*(frame-5)+slot else (2*(frame-5)+slot-5)//2+5 end as int) as src_frame from fr, k where frame>=5""")
def d5_template_pairs_double(spark, sf):
    return sq.template_pairs(fx.frames(spark, sf), 5, double_shift=True)


@query("f3_sliding_window", fx.with_(fx.FRAMES) + """select aoi, frame, list_sum(w) as s, w[1] as oldest from (
select aoi, frame, list(px[1]) over (partition by aoi order by frame rows between 4 preceding and 1 preceding) as w from fr) q where len(w)=4""")
def f3_sliding_window(spark, sf):
    f = fx.frames(spark, sf).select("aoi", "frame", F.col("px")[0].alias("v"))
    d = ordering.sliding(f, ["aoi"], "frame", 4, F.col("v"), "w", chunk=32)
    s = F.aggregate("w", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return d.select("aoi", "frame", s.alias("s"), F.col("w")[0].alias("oldest"))


@query("d6_previous_frame", fx.with_(fx.FRAMES) + """select aoi, frame, lag(frame) over w as prev_frame,
 px[1]-lag(px) over w[1] as unused from fr window w as (partition by aoi order by frame)""".replace("px[1]-lag(px) over w[1] as unused", "px[1]-(lag(px) over w)[1] as diff"))
def d6_previous_frame(spark, sf):
    d = sq.previous_frame(fx.frames(spark, sf), F.struct("frame", "px"))
    return d.select("aoi", "frame", F.col("prev.frame").alias("prev_frame"), (F.col("px")[0] - F.col("prev.px")[0]).alias("diff"))


@query("d6_adjacent_frame", fx.with_(fx.FRAMES) + "select a.aoi, a.frame, a.px[1]-b.px[1] as diff from (select aoi, px, frame+frame//3*2 as frame from fr) a join (select aoi, px, frame+frame//3*2 as frame from fr) b on a.aoi=b.aoi and b.frame=a.frame-1")
def d6_adjacent_frame(spark, sf):
    d = sq.adjacent_frame(_with_gaps(fx.frames(spark, sf)), F.struct("px"))
    return d.select("aoi", "frame", (F.col("px")[0] - F.col("prev.px")[0]).alias("diff"))


@query("b5_projective_transform", fx.with_(fx.FRAMES, fx.HOMS) + """select aoi, src_frame, i,
 round((h[1]*i+h[2]*v+h[3])/(h[7]*i+h[8]*v+h[9]),6) as px, round((h[4]*i+h[5]*v+h[6])/(h[7]*i+h[8]*v+h[9]),6) as py
from (select f.aoi, f.frame as src_frame, cast(i as int) as i, px[i+1] as v, h from fr f join hom on hom.aoi=f.aoi and hom.src_frame=f.frame, (select unnest(range(64)) as i) g) q
where abs(h[7]*i+h[8]*v+h[9])>0.05e0""")
def b5_projective_transform(spark, sf):
    p = fx.frames(spark, sf).select("aoi", F.col("frame").alias("src_frame"), F.posexplode("px").alias("i", "v"))
    p = p.withColumn("x", F.col("i").cast("double")).withColumn("y", F.col("v").cast("double"))
    h = fx.pairs_h(spark, sf)
    d = p.join(h.select("aoi", "src_frame", F.col("h").alias("hh")), ["aoi", "src_frame"])
    keep = d.where("abs(hh[6]*x + hh[7]*y + hh[8]) > 0.05d").drop("hh")
    out = sq.transform_points(keep, h)
    return out.select("aoi", "src_frame", "i", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query("b6_error_ellipse", """with q as (select vec_id, 2+cast(embedding[1] as double) as a, cast(embedding[2] as double) as b, 2+cast(embedding[3] as double) as c from embeddings),
e as (select *, (a+c)/2-sqrt((a-c)/2*((a-c)/2)+b*b) as lo, (a+c)/2+sqrt((a-c)/2*((a-c)/2)+b*b) as hi from q)
select vec_id, round(sqrt(lo*5.991e0),6) as minor, round(sqrt(hi*5.991e0),6) as major,
 case when b<>0 or a<=c then 45.0e0 else 0.0e0 end as angle_deg from e""")
def b6_error_ellipse(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    v = [F.col("embedding")[i].cast("double") for i in range(3)]
    d = e.select("vec_id", error_ellipse(v[0] + 2, v[1], v[2] + 2).alias("e"))
    return d.select("vec_id", F.round("e.minor", 6).alias("minor"), F.round("e.major", 6).alias("major"), F.round("e.angle_deg", 6).alias("angle_deg"))


def _mm(a, b):
    return "[" + ",".join(
        "+".join(f"{a}[{3*i+k+1}]*{b}[{3*k+j+1}]" for k in range(3)) for i in range(3) for j in range(3)) + "]"


@query("e13_matrix_product", fx.with_(fx.HOMS, f"""ch as (
select aoi, src_frame, dst_frame, h, 1 as k from hom
union all
select ch.aoi, hom.src_frame, ch.dst_frame, {_mm('ch.h', 'hom.h')}, k+1 from ch join hom on hom.aoi=ch.aoi and hom.dst_frame=ch.src_frame where k<4)""")
       + "select aoi, src_frame, dst_frame, list_transform(h, lambda v: round(v,9)) as h from ch where dst_frame>=4")
def e13_matrix_product(spark, sf):
    d = sq.compose_chain(fx.pairs_h(spark, sf), 4)
    return d.withColumn("h", F.transform("h", lambda v: F.round(v, 9)))


@query("e13_seeded_products", fx.with_(fx.HOMS, f"""st as (select * from hom where dst_frame>=4),
seed as (select aoi, src_frame, cast(4 as int) as dst_frame, h from hom where src_frame<3 and aoi in (select aoi from hom where src_frame=4)),
ch as (
select aoi, src_frame, dst_frame, h from st
union all
select st.aoi, ch.src_frame, st.dst_frame, {_mm('st.h', 'ch.h')} from ch join st on st.aoi=ch.aoi and st.src_frame=ch.dst_frame and st.dst_frame-ch.src_frame<=4),
al as (select * from ch union all select * from seed union all
select s.aoi, s.src_frame, c.dst_frame, {_mm('c.h', 's.h')} from seed s join ch c on c.aoi=s.aoi and c.src_frame=4 and c.dst_frame-s.src_frame<=4)""")
       + "select aoi, src_frame, dst_frame, list_transform(h, lambda v: round(v,7)+0.0e0) as h from al where dst_frame in (select src_frame from hom h2 where h2.aoi=al.aoi)")
def e13_seeded_products(spark, sf):
    """Every template pair's matrix from one prefix product per frame."""
    f = fx.frames(spark, sf).select("aoi", "frame")
    h = fx.pairs_h(spark, sf)
    steps = h.where("dst_frame >= 4").join(f.select("aoi", F.col("frame").alias("dst_frame")), ["aoi", "dst_frame"])
    seeds = h.where("src_frame < 3").withColumn("dst_frame", F.lit(4)).join(f.where("frame = 4").select("aoi"), "aoi", "left_semi")
    d = sq.compose_scan(f, steps.select(*sq.PAIR, "h").unionByName(seeds.select(*sq.PAIR, "h")), 4)
    return d.withColumn("h", F.transform("h", lambda v: F.round(v, 7) + F.lit(0.0)))


@query("i5_registration_plan", fx.with_(fx.FRAMES) + """select d.aoi, 'direct' as mode, s.frame as src_frame, d.frame as dst_frame
from fr d join fr s on s.aoi=d.aoi and s.frame between d.frame-3 and d.frame-1 where d.frame>=3
union all select aoi, 'chained', frame-1, frame from fr where frame>=3
union all select aoi, 'seeded', frame-1, frame from fr where frame>=3
union all select aoi, 'seeded', cast(k as int), frame from fr, (select unnest(range(2)) as k) g where frame=3""")
def i5_registration_plan(spark, sf):
    f = fx.frames(spark, sf)
    parts = [sq.registration_plan(f, 3, m).withColumn("mode", F.lit(m)) for m in ("direct", "chained", "seeded")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("aoi", "mode", "src_frame", "dst_frame")


# Keypoints: four per frame, described by the sign bits of 16 values each.
KEYS = fx.FRAMES.replace("fr as", "fr0 as") + """, kp as (
select label as aoi, cast(n as int) as frame, cast(k as bigint) as kp_id,
  list_sum(list_transform(range(16), lambda i: case when embedding[16*k+i+1]>0 then 1::bigint<<i else 0::bigint end))::bigint as w
from (select *, row_number() over (partition by label order by vec_id)-1 as n from embeddings) z, (select unnest(range(4)) as k) g)"""
PAIR = """cd as (select a.aoi, a.frame as src_frame, b.frame as dst_frame, a.kp_id as src_kp, b.kp_id as dst_kp, cast(bit_count(xor(a.w,b.w)) as bigint) as dist
from kp a join kp b on a.aoi=b.aoi and b.frame=a.frame+1),
mm as (select * from cd qualify row_number() over (partition by aoi,src_frame,src_kp order by dist,dst_kp)=1
 and row_number() over (partition by aoi,src_frame,dst_kp order by dist,src_kp)=1)"""


def _keypoints(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    e = ordering.position(e, ["label"], ["vec_id"], ordering.by_width("vec_id", 4096), "n")
    d = e.select(F.col("label").alias("aoi"), F.col("n").cast("int").alias("frame"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    bits = F.transform(F.slice("embedding", F.col("k") * 16 + 1, 16), lambda v, i: F.when(v > 0, F.pow(F.lit(2.0), i)).otherwise(0.0))
    word = F.aggregate(bits, F.lit(0.0), lambda a, v: a + v).cast("bigint")
    return d.select("aoi", "frame", F.col("k").cast("bigint").alias("kp_id"), F.array(word).alias("desc"))


def _matches(spark, sf):
    kp = _keypoints(spark, sf)
    pairs = sq.registration_plan(kp.select("aoi", "frame").distinct(), 1)
    return sq.mutual_matches(kp, pairs), pairs


@query("d7_mutual_matches", fx.with_(KEYS, PAIR) + "select aoi, src_frame, dst_frame, src_kp, dst_kp, dist from mm")
def d7_mutual_matches(spark, sf):
    return _matches(spark, sf)[0]


@query("c12_good_matches", fx.with_(KEYS, PAIR) + """select p.aoi, p.src_frame, p.dst_frame, coalesce(n,0) as n_good, coalesce(n,0)>=4 as usable, coalesce(n,0)<=1000 as low_confidence
from (select distinct aoi, src_frame, dst_frame from cd) p left join (select aoi, src_frame, count(*) as n from mm where dist<=6 group by 1,2) g
on g.aoi=p.aoi and g.src_frame=p.src_frame""")
def c12_good_matches(spark, sf):
    m, pairs = _matches(spark, sf)
    return sq.match_quality(m, pairs, 6)


@query("g3_match_order", fx.with_(KEYS, PAIR) + """select aoi, src_frame, dst_frame, src_kp, dst_kp, dist,
 cast(row_number() over (partition by aoi, src_frame, dst_frame order by dist, src_kp, dst_kp) as int) as rank from mm qualify rank<=2""")
def g3_match_order(spark, sf):
    return sq.ranked_matches(_matches(spark, sf)[0], 2)


@query("i4_homography_estimate", fx.with_(fx.TRACKS) + """select a.frame_number as src_frame, count(*) as n_matches,
 count(*) filter (where a.k%4<>0) as n_inliers from tr a group by a.frame_number having count(*)>=40""")
def i4_homography_estimate(spark, sf):
    """Track points under a known shift and zoom; a quarter of the matches is moved far away."""
    t = fx.tracks(spark, sf)
    wrong = F.when(F.col("k") % 4 == 0, 1.0).otherwise(0.0)
    m = t.select(
        F.lit("all").alias("aoi"), F.col("frame_number").cast("int").alias("src_frame"), (F.col("frame_number") + 1).cast("int").alias("dst_frame"),
        F.col("id").alias("match_id"), "x", "y",
        (F.col("x") * 1.01 + 3 + wrong * (500 + F.col("id") % 13 * 17)).alias("u"),
        (F.col("y") * 0.99 - 2 - wrong * (400 + F.col("k") % 11 * 23)).alias("v"))
    pairs = m.select("aoi", "src_frame", "dst_frame").distinct()
    e = sq.estimate_homographies(m, pairs)
    return e.where("n_matches >= 40").select(F.col("src_frame").cast("bigint").alias("src_frame"), "n_matches", "n_inliers")

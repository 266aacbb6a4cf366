"""Queries over samples, labels, roads and model-quality aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.functions import arrays, sql as sqlf
from skyquilt.operators import evaluate as evl, labels, roads, samples as sm
from skyquilt.workload import fixtures as fx
from skyquilt.workload.evaluation import hav_sql
from skyquilt.workload.registry import query

MIXS = "((sample_idx::bigint*2654435761+{seed}*40503)%4294967296)"
OK = "sv as (select * from smp where len(px)=64)"


def _valid(spark, sf):
    return sm.valid_samples(fx.samples(spark, sf), 64)


# -------------------------------------------------------------- scalar forms

@query("b7_frame_key", fx.with_(fx.TRACKS) + "select id, frame_number, 'frame'||lpad(cast(frame_number as varchar),6,'0')||'.csv' as name from tr")
def b7_frame_key(spark, sf):
    from skyquilt.sources.catalogue import frame_key
    return fx.tracks(spark, sf).select("id", "frame_number", frame_key(F.col("frame_number"), "csv").alias("name"))


@query("b8_zero_centre", """with mch as (select list(m order by ch) as m from (select cast(i//16 as int) as ch, round(avg(cast(embedding[i+1] as double)),6) as m from embeddings, (select unnest(range(64)) as i) g group by 1) q)
select vec_id, i::int as i, round(cast(embedding[i+1] as double)-m[i//16+1],6) as by_channel, round(cast(embedding[i+1] as double)-i/64.0e0,6) as by_image from embeddings, mch, (select unnest(range(64)) as i) g""")
def b8_zero_centre(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("px"))
    ch = sm.element_sums(fx.table(spark, sf, "embeddings").select(F.col("embedding").alias("px")), 64)
    ch = ch.groupBy(F.floor(F.col("i") / 16).alias("ch")).agg(F.round(F.sum("s") / F.sum("n"), 6).alias("m"))
    mean = ch.agg(F.transform(F.sort_array(F.collect_list(F.struct("ch", "m"))), lambda s: s["m"]).alias("mean"))  # four values
    image = F.array(*[F.lit(i / 64.0) for i in range(64)])
    d = e.withColumn("mean", mean.scalar())
    d = d.select("vec_id", F.posexplode(F.arrays_zip(
        sm.zero_centre(F.col("px"), F.col("mean"), 64, 4).alias("a"), sm.zero_centre(F.col("px"), image, 64, 4).alias("b"))).alias("i", "z"))
    return d.select("vec_id", "i", F.round("z.a", 6).alias("by_channel"), F.round("z.b", 6).alias("by_image"))


@query("b13_sixteen_to_eight", "select event_id, cast(floor(cast(floor(value*100) as int)/256) as int) as v from events")
def b13_sixteen_to_eight(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", arrays.sixteen_to_eight(F.floor(F.col("value") * 100)).alias("v"))


@query("b14_unit_scale", fx.with_(fx.FRAMES) + "select aoi, frame, list_transform(px, lambda v: v/255.0e0) as u from fr")
def b14_unit_scale(spark, sf):
    return fx.frames(spark, sf).select("aoi", "frame", arrays.to_unit(F.col("px")).alias("u"))


@query("b18_one_hot", fx.with_(fx.SAMPLES) + "select file_id, sample_idx, case when cls=0 then [1,0] else [0,1] end as hot from smp")
def b18_one_hot(spark, sf):
    return fx.samples(spark, sf).select("file_id", "sample_idx", sm.one_hot(F.col("cls")).alias("hot"))


@query("b19_legacy_layout", fx.with_(fx.FRAMES) + """select aoi, frame, list_concat(list_concat(px[1:8],px[9:16]),list_concat(px[17:24],px[25:32])) as bin,
 list_concat(list_concat(px[1:8],px[17:24]),list_concat(px[25:32],px[33:40])) as reg from fr""")
def b19_legacy_layout(spark, sf):
    cols = F.array(*[F.slice("px", 8 * i + 1, 8) for i in range(5)])
    return fx.frames(spark, sf).select("aoi", "frame", sm.legacy_channels(cols, "binary").alias("bin"), sm.legacy_channels(cols, "regression").alias("reg"))


@query("j2_sql_functions", fx.with_(fx.TRACKS) + f"""select id, frame_number, round({hav_sql('latitude','longitude','39.77e0','-84.12e0')},6) as d1,
 round({hav_sql('latitude','longitude','39.77e0','-84.12e0','asin')},6) as d2, round(1+2*x,6) as gx, cast(trunc(x/3-1) as int) as pc,
 round((x+0.5e0*y)/(0.001e0*x+1),6) as hx, round(sqrt((2.5e0+sqrt(0.25e0+1))*5.991e0),6) as ax from tr""")
def j2_sql_functions(spark, sf):
    sqlf.register(spark)
    return fx.tracks(spark, sf).selectExpr(
        "id", "frame_number", "round(sky_haversine_m(latitude, longitude, 39.77D, -84.12D), 6) as d1",
        "round(sky_haversine_lonlat_m(longitude, latitude, -84.12D, 39.77D), 6) as d2",
        "round(sky_pixel_to_geo(array(1D, 2D, 0D, 0D, 0D, 1D), x, y).lon, 6) as gx",
        "sky_geo_to_pixel(array(3D, 3D, 0D, 0D, 0D, 1D), x, y).col as pc",
        "round(sky_project(array(1D, 0.5D, 0D, 0D, 1D, 0D, 0.001D, 0D, 1D), x, y).x, 6) as hx",
        "round(sky_ellipse_axis(3D, 1D, 2D, 1D), 6) as ax")


# ------------------------------------------------------------ means, quotas

@query("e5_channel_mean", fx.with_(fx.SAMPLES, OK) + "select cast(i//16 as int) as channel, round(avg(cast(px[i+1] as double)),5) as mean from sv, (select unnest(range(64)) as i) g group by 1")
def e5_channel_mean(spark, sf):
    return sm.channel_mean(_valid(spark, sf), 4, 16).withColumn("mean", F.round(F.col("mean").cast("double"), 5))


@query("e6_mean_image", fx.with_(fx.SAMPLES, OK) + "select cast(i as int) as i, round(avg(cast(px[i+1] as double)),9) as mean from sv, (select unnest(range(64)) as i) g group by 1")
def e6_mean_image(spark, sf):
    return sm.mean_image(_valid(spark, sf), 64).withColumn("mean", F.round("mean", 9))


@query("j3_array_aggregates", fx.with_(fx.SAMPLES, OK) + "select file_id, cast(i as int) as i, round(avg(cast(px[i+1] as double)),9) as mean, count(*) as n from sv, (select unnest(range(64)) as i) g group by 1,2")
def j3_array_aggregates(spark, sf):
    d = sm.element_sums(_valid(spark, sf), 64, ("file_id",))
    return d.select("file_id", "i", F.round(F.col("s") / F.col("n"), 9).alias("mean"), "n")


E7 = fx.with_(fx.SAMPLES, OK, "sz as (select file_id, count(*) as size from sv group by 1)",
              "tk as (select file_id, least(size, 150//(select count(*) from sz)+1) as take from sz)",
              "rs as (select *, sum(take) over (order by file_id) as loaded from tk)",
              f"rk as (select sv.*, take, row_number() over (partition by file_id order by {MIXS.format(seed=3)}, sample_idx)-1 as rank from sv join rs using (file_id) where loaded-take<150)")


@query("e7_sampled_mean_image", E7 + "select cast(i as int) as i, round(avg(cast(px[i+1] as double)),9) as mean from rk, (select unnest(range(64)) as i) g where rank<take group by 1")
def e7_sampled_mean_image(spark, sf):
    return sm.mean_image(sm.sampled_rows(_valid(spark, sf), 150, 3), 64).withColumn("mean", F.round("mean", 9))


E8 = """t as (select count(*) filter (where cls=0) as total_pos, count(*) filter (where cls=1) as total_neg from sv),
a as (select *, case when total_pos<{p} then total_pos else {p} end as pos, case when total_pos<{p} then least({n}, total_neg, total_pos*5) else {n} end as neg from t)
select {p} as want, total_pos, total_neg, case when total_neg<neg then least(pos, total_pos, total_neg//5) else pos end as pos, case when total_neg<neg then total_neg else neg end as neg,
 total_pos>=30 and total_neg>=50 as enough_validation from a"""


@query("e8_quota_adjustment", " union all ".join("(" + fx.with_(fx.SAMPLES, OK) .rstrip() + ",\n" + E8.format(p=p, n=n) + ")" for p, n in ((600000, 3000000), (40, 200), (60, 50000))))
def e8_quota_adjustment(spark, sf):
    t = sm.class_totals(_valid(spark, sf))
    out = None
    for p, n in ((600000, 3000000), (40, 200), (60, 50000)):
        d = sm.adjust_quotas(t, p, n, 30, 50).withColumn("want", F.lit(p))
        out = d if out is None else out.unionByName(d)
    return out


# --------------------------------------------------------- sampling, splits

@query("g4_balanced_sample", fx.with_(fx.SAMPLES, OK, "nf as (select count(distinct file_id) as n from sv)",
       f"rk as (select sv.*, row_number() over (partition by file_id, cls order by {MIXS.format(seed=12)}, sample_idx)-1 as rank from sv)")
       + "select file_id, sample_idx, cls, rank from rk, nf where rank < case when cls=0 then 60//n+1 else 120//n+1 end")
def g4_balanced_sample(spark, sf):
    return sm.balanced_sample(_valid(spark, sf), 60, 120, 11, epoch=1).select("file_id", "sample_idx", "cls", "rank")


@query("g5_epoch_batches", fx.with_(fx.SAMPLES, OK, f"p as (select file_id, sample_idx, row_number() over (order by {MIXS.format(seed=5)}, sample_idx)-1 as pos from sv)")
       + "select 'drop' as tail, file_id, sample_idx, pos//32 as batch_id from p where pos//32<(select count(*)//32 from p) union all select 'keep', file_id, sample_idx, pos//32 from p")
def g5_epoch_batches(spark, sf):
    v = _valid(spark, sf)
    parts = [sm.epoch_batches(v, 32, 5, drop_last=d).withColumn("tail", F.lit(n)) for d, n in ((True, "drop"), (False, "keep"))]
    return parts[0].unionByName(parts[1]).select("tail", "file_id", "sample_idx", "batch_id")


@query("g6_split_by_file", fx.with_(fx.SAMPLES, "f as (select file_id, row_number() over (order by file_id)-1 as pos, count(*) over () as n from (select distinct file_id from smp) z)")
       + "select file_id, sample_idx, case when pos<floor(n*(1-0.25e0)) then 'train' else 'validation' end as part from smp join f using (file_id)")
def g6_split_by_file(spark, sf):
    return sm.split_by_file(fx.samples(spark, sf), 0.25).select("file_id", "sample_idx", "part")


@query("g7_split_random", fx.with_(fx.SAMPLES, f"p as (select file_id, sample_idx, row_number() over (order by {MIXS.format(seed=42)}, sample_idx)-1 as pos, count(*) over () as n from smp)")
       + "select file_id, sample_idx, case when pos<ceil(n*0.2e0) then 'validation' else 'train' end as part from p")
def g7_split_random(spark, sf):
    return sm.split_random(fx.samples(spark, sf), 0.2, 42).select("file_id", "sample_idx", "part")


@query("g8_permutation_prefix", fx.with_(fx.SAMPLES, f"p as (select file_id, sample_idx, row_number() over (order by {MIXS.format(seed=9)}, sample_idx)-1 as pos from smp)")
       + "select file_id, sample_idx, pos, case when pos<300 then 'train' else 'validation' end as part from p where pos<300 or (pos>300 and pos<=400)")
def g8_permutation_prefix(spark, sf):
    return sm.split_permutation_prefix(fx.samples(spark, sf), 300, 100, 9).select("file_id", "sample_idx", "pos", "part")


@query("g9_few_samples", fx.with_(fx.SAMPLES) + f"select file_id, sample_idx from smp order by (('0x'||substr(md5(file_id),1,7))::bigint*2654435761+4*40503)%4294967296, file_id, {MIXS.format(seed=4)}, sample_idx limit 5")
def g9_few_samples(spark, sf):
    return sm.few_samples(fx.samples(spark, sf), 8, 4)


@query("d14_label_pairing", fx.with_(fx.SAMPLES) + "select s.file_id, s.sample_idx, s.px[1] as first_px, l.vec_id%7 as label from smp s join embeddings l on l.vec_id+l.vec_id%3%2=s.sample_idx and printf('part%02d', l.label)=s.file_id")
def d14_label_pairing(spark, sf):
    lab = fx.table(spark, sf, "embeddings").select(
        F.format_string("part%02d", "label").alias("file_id"), (F.col("vec_id") + F.col("vec_id") % 3 % 2).alias("sample_idx"), (F.col("vec_id") % 7).alias("label"))
    return sm.pair_labels(fx.samples(spark, sf), lab).select("file_id", "sample_idx", F.col("px")[0].alias("first_px"), "label")


# ---------------------------------------------------------------- quality

@query("e9_motion_statistics", fx.with_(fx.PIXELS, "m as (select aoi, frame, cast((v-14)/200.0e0 as float) as m from pix)") + """select aoi, frame, round(min(m)::double,6) as min, round(max(m)::double,6) as max, round(avg(m::double),6) as mean, round(stddev_pop(m::double),6) as std,
""" + ", ".join(f"round(quantile_cont(m::double,{q}/100.0e0),6) as p{q}" for q in evl.PERCENTS) + " from m group by 1,2")
def e9_motion_statistics(spark, sf):
    d = evl.motion_statistics(_motion(spark, sf))
    return d.select("aoi", "frame", *[F.round(c, 6).alias(c) for c in d.columns if c not in ("aoi", "frame")])


def _motion(spark, sf):
    p = fx.frames(spark, sf).select("aoi", "frame", F.explode("px").alias("v"))
    return p.select("aoi", "frame", ((F.col("v") - 14) / F.lit(200.0)).cast("float").alias("m"))


@query("e10_interval_shares", fx.with_(fx.PIXELS, "m as (select aoi, frame, cast((v-14)/200.0e0 as float) as m from pix)") + """select aoi, frame, cast(b as int) as bin,
 round(count(*) filter (where m>=cast(b/10.0e0 as float) and m<cast((b+1)/10.0e0 as float))*100.0e0/count(*),6) as share from m, (select unnest(range(10)) as b) k group by 1,2,3""")
def e10_interval_shares(spark, sf):
    return evl.interval_shares(_motion(spark, sf)).withColumn("share", F.round("share", 6))


@query("e15_accuracy", """select round(avg(case when round_even(0.5e0+(quality-0.5e0)*(doc_id%5)/8.0e0,0)=quality and round_even(1-(0.5e0+(quality-0.5e0)*(doc_id%5)/8.0e0),0)=1-quality then 1.0e0 else 0 end),9) as accuracy, count(*) as n from labels""")
def e15_accuracy(spark, sf):
    p = 0.5 + (F.col("quality") - 0.5) * (F.col("doc_id") % 5) / 8.0
    d = fx.table(spark, sf, "labels").select(F.array(p, 1 - p).alias("prob"), F.array("quality", 1 - F.col("quality")).alias("hot"))
    return evl.accuracy(d).withColumn("accuracy", F.round("accuracy", 9))


@query("e16_regression_error", """with q as (select list_sum(list_transform(range(1,65), lambda i: (cast(embedding[i] as double)-i/640.0e0)*(cast(embedding[i] as double)-i/640.0e0))) as s,
 list_sum(list_transform(range(1,65), lambda i: abs(cast(embedding[i] as double)-i/640.0e0))) as a from embeddings) select round(avg(s),6) as sum_squared, round(avg(a),6) as sum_absolute from q""")
def e16_regression_error(spark, sf):
    label = F.array(*[F.lit(i / 640.0) for i in range(1, 65)])
    d = fx.table(spark, sf, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("pred"), label.alias("label"))
    d = evl.regression_error(d)
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@query("e17_run_totals", """with q as (select event_type as aoi, count(*) as frames, sum(value) as total from events group by 1)
select aoi, frames, round(total,4) as total_s, round(total/frames,6) as mean_s from q union all select 'overall', sum(frames)::bigint, round(sum(total),4), round(sum(total)/sum(frames),6) from q""")
def e17_run_totals(spark, sf):
    d = evl.run_totals(fx.table(spark, sf, "events").select(F.col("event_type").alias("aoi"), F.col("value").alias("seconds")))
    return d.withColumn("total_s", F.round("total_s", 4)).withColumn("mean_s", F.round("mean_s", 6))


@query("e17_observed_totals", """with q as (select event_type as aoi, value as seconds from events)
select aoi, count(*) as frames, round(sum(seconds),4) as total_s from q group by 1 union all select 'overall', count(*), round(sum(seconds),4) from q""")
def e17_observed_totals(spark, sf):
    """Per-AOI totals from the table just written; the overall row was observed on the write."""
    t = fx.table(spark, sf, "events").select(F.col("event_type").alias("aoi"), F.col("value").alias("seconds"))
    written, run = evl.observed_totals(t, lambda d: session.cut(d, "timings"))
    per = written.groupBy("aoi").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("seconds"), 4).alias("total_s"))
    whole = per.limit(0).unionByName(spark.createDataFrame([("overall", run["frames"], round(run["total_s"], 4))], per.schema))
    return per.unionByName(whole)


@query("e19_mask_quality", fx.with_(fx.PIXELS) + """select round(tp/cast(tp+fp as double),9) as precision, round(tp/cast(tp+fn as double),9) as recall, round((tp+tn)/cast(tp+tn+fp+fn as double),9) as accuracy from (
select count(*) filter (where v/255.0e0>0.5e0 and v%3>0) as tp, count(*) filter (where v/255.0e0>0.5e0 and v%3=0) as fp, count(*) filter (where v/255.0e0<=0.5e0 and v%3>0) as fn,
 count(*) filter (where v/255.0e0<=0.5e0 and v%3=0) as tn from pix) q""")
def e19_mask_quality(spark, sf):
    p = fx.frames(spark, sf).select(F.explode("px").alias("v")).select((F.col("v") / 255.0).alias("pred"), (F.col("v") % 3 > 0).cast("int").alias("truth"))
    d = evl.mask_quality(p)
    return d.select(*[F.round(c, 9).alias(c) for c in d.columns])


# ------------------------------------------------------------- label masks

@query("c13_usable_frames", fx.with_(fx.TRACKS, fx.FRAMES) + "select distinct frame from (select frame+frame//3+100 as frame from fr) f where frame in (select 2*frame_number-100 from tr)")
def c13_usable_frames(spark, sf):
    """Image numbers with gaps against truth on every second number."""
    img = fx.frames(spark, sf).select((F.col("frame") + F.floor(F.col("frame") / 3) + 100).alias("frame"))
    return labels.usable_frames(img, fx.tracks(spark, sf).select((2 * F.col("frame_number") - 100).alias("frame")))


DISC = "disc as (select * from (values " + ",".join(f"({k},{w})" for k, w in enumerate(labels.disc_half_widths(30))) + ") v(k,w))"


@query("i21_label_masks", fx.with_(fx.TRACKS, DISC, "ij as (select i::int as i, i*600//256 as r, j::int as j, j*900//256 as c from (select unnest(range(256)) as i) a, (select unnest(range(256)) as j) b)",
       "pt as (select distinct frame_number as frame, cast(round_even(y,0) as int) as r, cast(round_even(x,0) as int) as c from tr)",
       "sp as (select distinct frame, r+s*k as r, c, w from pt, disc, (values (1),(-1)) z(s))")
       + "select frame, count(*) as cells, sum(i)::bigint as si, sum(j)::bigint as sj, sum(i*j)::bigint as sij from (select distinct frame, i, j from sp join (select distinct i, r from ij) ii using (r) join (select distinct j, c as cc from ij) jj on cc between sp.c-w and sp.c+w) q group by frame")
def i21_label_masks(spark, sf):
    t = fx.tracks(spark, sf).select(F.col("frame_number").alias("frame"), "x", "y")
    m = labels.disc_masks(t, 600, 900)
    return m.groupBy("frame").agg(F.count(F.lit(1)).alias("cells"), F.sum("i").alias("si"), F.sum("j").alias("sj"), F.sum(F.col("i") * F.col("j")).alias("sij"))


# ------------------------------------------------------------------- roads

CLASSES = ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "unclassified", "footway", None]
SEG = """sg as (select k as way_id, case k%10 when 0 then 'motorway' when 1 then 'trunk' when 2 then 'primary' when 3 then 'secondary' when 4 then 'tertiary' when 5 then 'residential'
 when 6 then 'service' when 7 then 'unclassified' when 8 then 'footway' end as highway,
 -84.1257e0+(k%83)*1.1e-4 as lon1, 39.7653e0+(k%71)*6e-5 as lat1, case when k%29=0 then null else -84.1257e0+(k%83)*1.1e-4+((k%13)-6)*1.7e-4 end as lon2, 39.7653e0+(k%71)*6e-5+((k%11)-5)*1.3e-4 as lat2
from (select s_suppkey as k from supplier union all select c_custkey+1000000 from customer) z),
rd as (select sg.*, b.m as buffer_m from sg join (values ('motorway',15),('trunk',12),('primary',10),('secondary',8),('tertiary',6),('residential',4),('service',3),('unclassified',3)) b(h,m) on h=highway where lon2 is not null)"""
_K = "(6371000e0*pi()/180)"


def seg_sql(lon, lat):
    kx = f"(cos(radians({lat}))*{_K})"
    return f"""(select sqrt(power(ax+t*dx,2)+power(ay+t*dy,2)) from (select *, case when dx*dx+dy*dy>0 then greatest(0,least(1,-(ax*dx+ay*dy)/(dx*dx+dy*dy))) else 0 end as t
 from (select (lon1-({lon}))*{kx} as ax, (lat1-({lat}))*{_K} as ay, (lon2-lon1)*{kx} as dx, (lat2-lat1)*{_K} as dy)))"""


def _segments(spark, sf):
    k = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).union(fx.table(spark, sf, "customer").select(F.col("c_custkey") + 1000000))
    name = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("k") % 10 + 1).cast("int"))
    return k.select(F.col("k").alias("way_id"), name.alias("highway"), F.expr("-84.1257d + (k % 83) * 1.1e-4").alias("lon1"), F.expr("39.7653d + (k % 71) * 6e-5").alias("lat1"),
                    F.expr("case when k % 29 = 0 then null else -84.1257d + (k % 83) * 1.1e-4 + ((k % 13) - 6) * 1.7e-4 end").alias("lon2"),
                    F.expr("39.7653d + (k % 71) * 6e-5 + ((k % 11) - 5) * 1.3e-4").alias("lat2"))


@query("c14_road_classes", fx.with_(SEG) + "select way_id, highway, buffer_m::double as buffer_m from rd")
def c14_road_classes(spark, sf):
    return roads.buffered_roads(_segments(spark, sf)).select("way_id", "highway", "buffer_m")


@query("d13_road_distance", fx.with_(fx.TRACKS, SEG) + f"""select id, frame_number, way_id, round(d,3) as dist_m from (select id, frame_number, way_id, buffer_m, {seg_sql('longitude','latitude')} as d
 from tr join rd on latitude between least(lat1,lat2)-2e-4 and greatest(lat1,lat2)+2e-4 and longitude between least(lon1,lon2)-3e-4 and greatest(lon1,lon2)+3e-4) q where d<=buffer_m""")
def d13_road_distance(spark, sf):
    p = fx.tracks(spark, sf).select("id", "frame_number", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    d = roads.road_pairs(p, roads.buffered_roads(_segments(spark, sf)), frame="frame_number")
    return d.select("id", "frame_number", "way_id", (F.floor(F.col("dist_m") * 1000 + 0.5) / 1000).alias("dist_m"))


@query("h4_on_any_road", fx.with_(fx.TRACKS, SEG) + f"""select distinct id, frame_number from (select id, frame_number, buffer_m, {seg_sql('longitude','latitude')} as d
 from tr join rd on latitude between least(lat1,lat2)-2e-4 and greatest(lat1,lat2)+2e-4 and longitude between least(lon1,lon2)-3e-4 and greatest(lon1,lon2)+3e-4) q where d<=buffer_m""")
def h4_on_any_road(spark, sf):
    t = fx.tracks(spark, sf)
    return roads.on_road(t, roads.buffered_roads(_segments(spark, sf)), ["id", "frame_number"], "longitude", "latitude")


MASK_GT = [-84.126, 0.0006 / 10, 0.0, 39.7705, 0.0, -0.0003 / 10]
ROADPX = SEG + f""", px as materialized (select r, c, {MASK_GT[0]!r}e0+(c+0.5e0)*{MASK_GT[1]!r} as lon, {MASK_GT[3]!r}e0+(r+0.5e0)*({MASK_GT[5]!r}) as lat
 from (select unnest(range(160))::int as r) a, (select unnest(range(150))::int as c) b),
mk as materialized (select distinct r, c from (select r, c, buffer_m, {seg_sql('lon','lat')} as d from px join rd on lat between least(lat1,lat2)-2e-4 and greatest(lat1,lat2)+2e-4
 and lon between least(lon1,lon2)-3e-4 and greatest(lon1,lon2)+3e-4) q where d<=buffer_m)"""


def _mask(spark, sf):
    return roads.road_mask(roads.buffered_roads(_segments(spark, sf)), MASK_GT, 160, 150)


@query("i22_road_mask", fx.with_(ROADPX) + "select 'full' as size, r, c from mk union all select 'half', i::int, j::int from (select unnest(range(80)) as i) a, (select unnest(range(60)) as j) b join mk on mk.r=i*160//80 and mk.c=j*150//60")
def i22_road_mask(spark, sf):
    m = _mask(spark, sf)
    half = roads.resized_mask(m, (160, 150), (80, 60)).select(F.lit("half").alias("size"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    return m.select(F.lit("full").alias("size"), F.col("r"), F.col("c")).unionByName(half)


@query("e14_mask_summary", fx.with_(ROADPX) + "select round(count(*)/24000.0e0,9) as share, cast(count(*)>0 as int) as max, case when count(*)=0 then [0] when count(*)=24000 then [1] else [0,1] end as distinct_values from mk")
def e14_mask_summary(spark, sf):
    return roads.mask_summary(_mask(spark, sf), 160, 150).withColumn("share", F.round("share", 9))

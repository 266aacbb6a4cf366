"""Queries over tracks, detections, matches and metrics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from skyquilt.functions import geo
from skyquilt.operators import matching, ordering, spatial, tracks as tk
from skyquilt.plans import evaluation as ev
from skyquilt.workload import fixtures as fx
from skyquilt.workload.registry import query

def hav_sql(lat1, lon1, lat2, lon2, form="atan2"):
    a = (f"(sin(radians({lat2}-({lat1}))/2)*sin(radians({lat2}-({lat1}))/2)"
         f"+cos(radians({lat1}))*cos(radians({lat2}))*sin(radians({lon2}-({lon1}))/2)*sin(radians({lon2}-({lon1}))/2))")
    return f"(2*6371000e0*atan2(sqrt({a}),sqrt(1-{a})))" if form == "atan2" else f"(2*6371000e0*asin(sqrt({a})))"


STEPS = f"""st as (
select *, {hav_sql('latitude', 'longitude', 'nlat', 'nlon')} as d_next,
  {hav_sql('latitude', 'longitude', 'plat', 'plon')} as d_prev from (
select *, lead(latitude) over w as nlat, lead(longitude) over w as nlon,
  lag(latitude) over w as plat, lag(longitude) over w as plon
from tr where frame_number between 105 and 160
window w as (partition by id order by frame_number, x, y)) q)"""
KEEP_ALL = """ka as (select * from st where not coalesce(d_next<1.2e0,false) and not coalesce(d_prev<1.2e0,false))"""
KEEP_ANY = """gt as (select frame_number as frame, id, x, y from st
where coalesce(d_next>=1.2e0,false) or coalesce(d_prev>=1.2e0,false))"""
NN = """cand as (
select d.frame, d.seq, g.id, sqrt((d.x-g.x)*(d.x-g.x)+(d.y-g.y)*(d.y-g.y)) as dist, g.x, g.y
from dets d join gt g on d.frame=g.frame where d.frame between 105 and 160),
nn as (select frame, seq, min({'dist':dist,'id':id,'x':x,'y':y}) as b from cand group by frame, seq),
hit as (select frame, count(*) as hits, count(distinct b.id) as tp from nn where b.dist<=10 group by frame)"""
COUNTS = """cnt as (
select s.frame, coalesce(hit.tp,0) as tp, coalesce(nd.n,0) as n_det, coalesce(ng.n,0) as n_gt,
  coalesce(nd.n,0)-coalesce(hit.tp,0) as fp, coalesce(ng.n,0)-coalesce(hit.tp,0) as fn
from (select cast(unnest(range(105,161)) as int) as frame) s
left join (select frame, count(*) n from dets group by frame) nd on nd.frame=s.frame
left join (select frame, count(*) n from gt group by frame) ng on ng.frame=s.frame
left join hit on hit.frame=s.frame)"""
OFFLINE = fx.with_(fx.TRACKS, fx.DETS, STEPS, KEEP_ANY, NN, COUNTS)
SCORES = """case when tp+fp>0 then tp/cast(tp+fp as double) else 0 end as precision,
 case when tp+fn>0 then tp/cast(tp+fn as double) else 0 end as recall"""
F1 = "case when precision+recall>0 then round(2*precision*recall/(precision+recall),9) else 0 end as f1"


def score_sql(source: str, cols: str = "") -> str:
    return (f"select {cols} tp, fp, fn, n_gt, n_det, round(precision,9) as precision, round(recall,9) as recall, {F1}"
            f" from (select *, {SCORES} from ({source}) s0) s1")


def _rounded(df):
    for c in ("precision", "recall", "f1"):
        df = df.withColumn(c, F.round(c, 9))
    return df


SUMS = "sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(n_gt)::bigint as n_gt, sum(n_det)::bigint as n_det"


def _counts(spark, sf):
    return ev.offline_counts(fx.tracks(spark, sf), fx.dets(spark, sf), 105, 160, 1.2, 10.0)


@query("offline_metrics", OFFLINE + score_sql(f"select {SUMS} from cnt"))
def offline_metrics(spark, sf):
    return _rounded(ev.offline_metrics(fx.tracks(spark, sf), fx.dets(spark, sf), 105, 160)).select(
        "tp", "fp", "fn", "n_gt", "n_det", "precision", "recall", "f1")


@query("d1_nn_match", OFFLINE + """select d.frame, count(*) as n_det, coalesce(any_value(hits),0)::bigint as hits, coalesce(any_value(tp),0) as tp
from dets d left join hit on hit.frame=d.frame where d.frame between 105 and 160 group by d.frame""")
def d1_nn_match(spark, sf):
    t = tk.some_step_moves(tk.frame_range(fx.tracks(spark, sf), 105, 160), 1.2)
    d = fx.dets(spark, sf).where("frame between 105 and 160")
    gt = t.select(F.col("frame_number").alias("frame"), "x", "y", F.struct("id", "x", "y").alias("gt"))
    return matching.nn_match(d, gt, 10.0)


@query("d4_frame_spine", OFFLINE + """select s.frame, coalesce(n,0) as n_det from
(select cast(unnest(range(90,181)) as int) as frame) s
left join (select frame, count(*) n from dets group by frame) nd on nd.frame=s.frame""")
def d4_frame_spine(spark, sf):
    n = fx.dets(spark, sf).groupBy("frame").agg(F.count(F.lit(1)).alias("n_det"))
    return matching.counts_on_spine(matching.spine(spark, 90, 180), ["frame"], (n, ["n_det"]))


@query("e1_frame_counts", OFFLINE + "select frame, tp, fp, fn, n_gt, n_det from cnt")
def e1_frame_counts(spark, sf):
    return _counts(spark, sf).select("frame", "tp", "fp", "fn", "n_gt", "n_det")


@query("e2_micro_scores", OFFLINE + score_sql(f"select frame%5 as grp, {SUMS} from cnt group by 1", "grp,"))
def e2_micro_scores(spark, sf):
    d = _counts(spark, sf).withColumn("grp", F.col("frame") % 5)
    return _rounded(matching.micro_scores(d, ["grp"]))


@query("e18_running_counts", OFFLINE + """select frame, n_gt, n_det,
sum(n_gt) over (order by frame)::bigint as run_gt, sum(n_det) over (order by frame)::bigint as run_det from cnt""")
def e18_running_counts(spark, sf):
    d = _counts(spark, sf).select("frame", "n_gt", "n_det")
    return ordering.running_sum(
        d, [], ["frame"], ordering.by_width("frame", 1024), {"run_gt": "n_gt", "run_det": "n_det"})


# ---------------------------------------------------------------- tracks

@query("c1_frame_range", fx.with_(fx.TRACKS) + "select id, frame_number, x, y from tr where frame_number between 105 and 130")
def c1_frame_range(spark, sf):
    return tk.frame_range(fx.tracks(spark, sf), 105, 130).select("id", "frame_number", "x", "y")


@query("f1_displacement", fx.with_(fx.TRACKS, STEPS) + "select id, frame_number, round(d_next,6) as step_m from st")
def f1_displacement(spark, sf):
    return tk.displacement(tk.frame_range(fx.tracks(spark, sf), 105, 160)).select(
        "id", "frame_number", F.round("step_m", 6).alias("step_m"))


@query("c2_every_step_moves", fx.with_(fx.TRACKS, STEPS, KEEP_ALL) + "select id, frame_number, x, y from ka")
def c2_every_step_moves(spark, sf):
    return tk.every_step_moves(tk.frame_range(fx.tracks(spark, sf), 105, 160), 1.2).select("id", "frame_number", "x", "y")


@query("c3_some_step_moves", fx.with_(fx.TRACKS, STEPS, KEEP_ANY) + "select id, frame as frame_number, x, y from gt")
def c3_some_step_moves(spark, sf):
    return tk.some_step_moves(tk.frame_range(fx.tracks(spark, sf), 105, 160), 1.2).select("id", "frame_number", "x", "y")


@query("d8_static_anti_join", fx.with_(fx.TRACKS, STEPS) + """select id, frame_number from tr
where frame_number between 105 and 160 and not exists (select 1 from st s where s.id=tr.id and s.frame_number=tr.frame_number
 and (coalesce(s.d_next<0.8e0,false) or coalesce(s.d_prev<0.8e0,false)))""")
def d8_static_anti_join(spark, sf):
    return tk.every_step_moves(tk.frame_range(fx.tracks(spark, sf), 105, 160)).select("id", "frame_number")


AOIS = "aoi_dim as (select * from (values ('01',-84.125664e0,39.771185e0,-84.119895e0,39.765354e0)," \
       "('02',-84.122165e0,39.786161e0,-84.116273e0,39.780145e0),('03',-84.101297e0,39.781737e0,-84.095836e0,39.775665e0)," \
       "('04',-84.122289e0,39.766089e0,-84.116211e0,39.760628e0),('34',-84.126152e0,39.783150e0,-84.114983e0,39.776215e0)," \
       "('40',-84.127380e0,39.772167e0,-84.118790e0,39.765719e0),('41',-84.121796e0,39.772351e0,-84.113391e0,39.764676e0)) v(aoi,ulx,uly,lrx,lry))"
IN_BOX = "longitude between least(ulx,lrx) and greatest(ulx,lrx) and latitude between least(uly,lry) and greatest(uly,lry)"


@query("c4_aoi_bounds", fx.with_(fx.TRACKS, STEPS, KEEP_ALL, AOIS)
       + f"select ka.id, frame_number from ka join aoi_dim on aoi='01' and {IN_BOX}")
def c4_aoi_bounds(spark, sf):
    moving = tk.every_step_moves(tk.frame_range(fx.tracks(spark, sf), 105, 160), 1.2)
    return spatial.in_one_aoi(moving, "01").select("id", "frame_number")


@query("d9_aoi_range_join", fx.with_(fx.TRACKS, AOIS) + f"select aoi, id, frame_number from tr join aoi_dim on {IN_BOX}")
def d9_aoi_range_join(spark, sf):
    return spatial.assign_aoi(fx.tracks(spark, sf)).select("aoi", "id", "frame_number")


@query("a7_aoi_dimension", fx.with_(AOIS) + """select r.aoi, ulx, uly, lrx, lry, ulx is not null as known
from (select distinct printf('%02d', label) as aoi from embeddings) r left join aoi_dim d on d.aoi=r.aoi""")
def a7_aoi_dimension(spark, sf):
    req = fx.table(spark, sf, "embeddings").select(F.format_string("%02d", "label").alias("aoi"))
    return spatial.requested_aois(req)


# --------------------------------------------------------- scalar geography

@query("b1_haversine_atan2", fx.with_(fx.TRACKS)
       + f"select id, frame_number, round({hav_sql('latitude','longitude','39.77e0','-84.12e0')},6) as d from tr")
def b1_haversine_atan2(spark, sf):
    d = geo.haversine_m("latitude", "longitude", F.lit(39.77), F.lit(-84.12))
    return fx.tracks(spark, sf).select("id", "frame_number", F.round(d, 6).alias("d"))


@query("b2_haversine_asin", fx.with_(fx.TRACKS)
       + f"select id, frame_number, round({hav_sql('latitude','longitude','39.77e0','-84.12e0','asin')},6) as d from tr")
def b2_haversine_asin(spark, sf):
    d = geo.haversine_lonlat_m("longitude", "latitude", F.lit(-84.12), F.lit(39.77))
    return fx.tracks(spark, sf).select("id", "frame_number", F.round(d, 6).alias("d"))


GT6 = "gt6 as (select aoi, ulx as g0, (lrx-ulx)/1000 as g1, uly as g3, (lry-uly)/1000 as g5 from aoi_dim)"


@query("b3_pixel_to_geo", fx.with_(fx.TRACKS, fx.DETS, AOIS, GT6)
       + "select seq, aoi, round(g0+x*g1+y*0.0e0,9) as lon, round(g3+x*0.0e0+y*g5,9) as lat from dets join gt6 on aoi in ('01','40')")
def b3_pixel_to_geo(spark, sf):
    d = fx.dets(spark, sf).withColumn("aoi", F.explode(F.array(F.lit("01"), F.lit("40"))))
    d = ev.with_geo(d, 1000, 1000).withColumn("g", geo.pixel_to_geo("gt6", "x", "y"))
    return d.select("seq", "aoi", F.round("g.lon", 9).alias("lon"), F.round("g.lat", 9).alias("lat"))


TOPIX = "cast(trunc(((g5*(longitude-g0)-0.0e0*(latitude-g3))/(g1*g5-0.0e0))) as int) as col, cast(trunc(((g1*(latitude-g3)-0.0e0*(longitude-g0))/(g1*g5-0.0e0))) as int) as \"row\""


@query("b4_geo_to_pixel", fx.with_(fx.TRACKS, AOIS, GT6) + f"select id, frame_number, aoi, {TOPIX} from tr join gt6 on true")
def b4_geo_to_pixel(spark, sf):
    names = F.transform(spatial.aoi_array(), lambda b: b["aoi"])
    t = ev.with_geo(fx.tracks(spark, sf).withColumn("aoi", F.explode(names)), 1000, 1000)
    return t.withColumn("p", geo.geo_to_pixel("gt6", "longitude", "latitude")).select(
        "id", "frame_number", "aoi", "p.col", "p.row")


VISIBLE = f"""vis as (
select aoi, frame, id, lon, lat, col, "row" from (
select g.aoi, cast(frame_number as int) as frame, id, longitude as lon, latitude as lat, {TOPIX}
from ka join aoi_dim a on {IN_BOX} join gt6 g on g.aoi=a.aoi) q
where col>=15 and col<985 and "row">=15 and "row"<985)"""


@query("d10_visible_truth", fx.with_(fx.TRACKS, STEPS, KEEP_ALL, AOIS, GT6, VISIBLE) + 'select aoi, frame, id, col, "row" from vis')
def d10_visible_truth(spark, sf):
    return ev.visible_truth(fx.tracks(spark, sf), 105, 160, 1.2, 1000, 1000, 15).select("aoi", "frame", "id", "col", "row")


@query("c5_border_filter", fx.with_(fx.TRACKS, fx.DETS) + "select seq, x, y from dets where x>=100 and x<700 and y>=100 and y<500")
def c5_border_filter(spark, sf):
    return fx.dets(spark, sf).where(ev.inside_border("x", "y", 800, 600, 100)).select("seq", "x", "y")


@query("h1_detection_union", fx.with_(fx.TRACKS, fx.DETS)
       + "select seq, 'direct' as origin, x, y from dets where score>0.7e0 union all select seq, 'regressed', x, y from dets where score<=0.7e0")
def h1_detection_union(spark, sf):
    d = fx.dets(spark, sf)
    one = d.where("score > 0.7d").select("seq", F.lit("direct").alias("origin"), "x", "y")
    two = d.where("score <= 0.7d").select("seq", F.lit("regressed").alias("origin"), "x", "y")
    return one.unionByName(two)


@query("d15_overlay_table", fx.with_(fx.TRACKS, fx.DETS) + """
select frame, 'detection' as kind, x, y, 'red' as colour, 6 as radius from dets
union all select frame_number, 'truth', x, y, 'yellow', 4 from tr""")
def d15_overlay_table(spark, sf):
    from skyquilt.operators.overlay import overlay
    d = fx.dets(spark, sf).select("frame", "x", "y")
    t = fx.tracks(spark, sf).select(F.col("frame_number").alias("frame"), "x", "y")
    return overlay(d, t)


# --------------------------------------------------- greedy match and merge

def _greedy_inputs(spark, sf):
    d = fx.dets(spark, sf).select("frame", F.col("seq").alias("det"), "lon", "lat")
    t = fx.tracks(spark, sf).select(
        F.col("frame_number").alias("frame"), F.col("id").alias("gt"),
        F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    return d, t


def greedy_views():
    """Views that walk the detections of ``edge`` (frame, seq, gt, dist) in order."""
    return (
        "step as materialized (select frame, seq, row_number() over (partition by frame order by seq) as i from (select distinct frame, seq from edge) z)",
        """walk as (
select frame, cast(0 as bigint) as i, cast([] as bigint[]) as used, cast([] as struct(det bigint, gt bigint)[]) as took from (select distinct frame from step) f
union all
select w.frame, w.i+1,
  case when p.gt is null then w.used else list_append(w.used, p.gt) end,
  case when p.gt is null then w.took else list_append(w.took, {'det': cast(s.seq as bigint), 'gt': cast(p.gt as bigint)}) end
from walk w join step s on s.frame=w.frame and s.i=w.i+1
left join lateral (select e.gt from edge e where e.frame=s.frame and e.seq=s.seq and not list_contains(w.used, e.gt)
  order by e.dist, e.gt limit 1) p on true)""",
    )


D2_SQL = fx.with_(
    fx.TRACKS, fx.DETS,
    f"""edge as materialized (select d.frame, d.seq, t.id as gt, {hav_sql('d.lat','d.lon','t.latitude','t.longitude')} as dist
from dets d join tr t on t.frame_number=d.frame
where abs(d.lat-t.latitude)<3e-4 and {hav_sql('d.lat','d.lon','t.latitude','t.longitude')}<=14)""",
    *greedy_views(),
) + "select frame, p.det, p.gt from (select frame, unnest(arg_max(took, i)) as p from walk group by frame) z"


@query("d2_greedy_geo_match", D2_SQL)
def d2_greedy_geo_match(spark, sf):
    d, t = _greedy_inputs(spark, sf)
    return matching.greedy_geo_match(d, t, 14.0, ["frame"]).select("frame", F.col("det").cast("long").alias("det"), F.col("gt").cast("long").alias("gt"))


def merge_views(source, distance):
    """Views that cluster the points of ``source`` (frame, seq, x, y) in order; ``fin`` holds the clusters of a frame."""
    return (
        f"step as materialized (select frame, seq, x, y, row_number() over (partition by frame order by seq) as i from {source})",
        f"""walk as (
select distinct frame, cast(0 as bigint) as i, cast([] as struct(sx double, sy double, n bigint)[]) as cl from step
union all
select frame, i+1, case when best is null then list_append(cl, {{'sx':x,'sy':y,'n':cast(1 as bigint)}})
  else list_transform(cl, lambda c, j: case when j=best then {{'sx':c.sx+x,'sy':c.sy+y,'n':c.n+1}} else c end) end
from (select w.frame, w.i, w.cl, s.x, s.y,
  list_min(list_filter(list_transform(w.cl, lambda c, j: {{'g': sqrt((s.x-c.sx/c.n)*(s.x-c.sx/c.n)+(s.y-c.sy/c.n)*(s.y-c.sy/c.n)), 'j': j}}), lambda e: e.g<{distance})).j as best
  from walk w join step s on s.frame=w.frame and s.i=w.i+1) q)""",
        "fin as (select frame, arg_max(cl, i) as cl from walk group by frame)",
    )


D3_SQL = fx.with_(
    fx.TRACKS, fx.DETS,
    *merge_views("dets", 18),
) + "select frame, round(c.sx/c.n,6) as x, round(c.sy/c.n,6) as y, c.n as n from (select frame, unnest(cl) as c from fin) z"


@query("d3_merge_close_points", D3_SQL)
def d3_merge_close_points(spark, sf):
    m = matching.merge_close_points(fx.dets(spark, sf), 18.0, ["frame"])
    return m.select("frame", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


def _aoi_dets(spark, sf):
    """Detections in AOI pixels: degrees through each AOI's geotransform."""
    d = fx.dets(spark, sf).where("frame between 105 and 160")
    d = ev.with_geo(spatial.assign_aoi(d, "lon", "lat"), 1000, 1000)
    return d.withColumn("p", geo.geo_to_pixel("gt6", "lon", "lat")).select(
        "aoi", F.col("frame").cast("int").alias("frame"), "seq", F.col("p.col").alias("x"), F.col("p.row").alias("y"))


def _prefixed(views, **names):
    """``views`` with other names, so that two walks fit in one query."""
    return [re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: names[m[1]], v) for v in views]


REPORT_SQL = fx.with_(
    fx.TRACKS, fx.DETS, STEPS, KEEP_ALL.replace("1.2e0", "0.8e0"), AOIS, GT6, VISIBLE,
    # the unit of both walks is an AOI's frame, called frame there
    """tg as materialized (select aoi || '-' || frame as frame, row_number() over (partition by aoi, frame order by id, lon, lat) as gt, lon, lat from vis where frame>=110)""",
    f"""ad as (select aoi || '-' || frame as frame, seq, cast(col as double) as x, cast("row" as double) as y from (
select a.aoi, cast(frame as int) as frame, seq, {TOPIX.replace("longitude", "lon").replace("latitude", "lat")}
from dets join aoi_dim a on {IN_BOX.replace("longitude", "lon").replace("latitude", "lat")} join gt6 g on g.aoi=a.aoi where frame between 110 and 160) q
where col>=15 and col<985 and "row">=15 and "row"<985)""",
    *_prefixed(merge_views("ad", 10), step="mstep", walk="mwalk"),
    """md as materialized (select frame, det as seq, g0+x*g1 as lon, g3+y*g5 as lat from (
select frame, split_part(frame, '-', 1) as aoi, det, c.sx/c.n as x, c.sy/c.n as y from (select frame, unnest(cl) as c, unnest(range(len(cl))) as det from fin) z) q join gt6 using (aoi))""",
    f"""edge as materialized (select d.frame, d.seq, t.gt, {hav_sql('d.lat','d.lon','t.lat','t.lon')} as dist from md d join tg t on t.frame=d.frame
where {hav_sql('d.lat','d.lon','t.lat','t.lon')}<=5)""",
    *greedy_views(),
    """cnt as (select split_part(frame, '-', 1) as aoi, sum(g) as n_gt, sum(d) as n_det, sum(m) as tp from (
select frame, 1 as g, 0 as d, 0 as m from tg union all select frame, 0, 1, 0 from md
union all select frame, 0, 0, len(arg_max(took, i)) from walk group by frame) z group by 1)""",
    "cn as (select *, n_det-tp as fp, n_gt-tp as fn from cnt)",
) + score_sql(f"select aoi, {SUMS} from cn group by 1 union all select 'overall', {SUMS} from cn", "aoi,")


@query("multi_aoi_report", REPORT_SQL)
def multi_aoi_report(spark, sf):
    return _rounded(ev.multi_aoi_report(fx.tracks(spark, sf), _aoi_dets(spark, sf), 105, 160))


E3_SQL = OFFLINE + score_sql(f"select frame%3 as k, {SUMS} from cnt group by 1", "cast(k as varchar) as aoi,") + \
    " union all " + score_sql(f"select {SUMS} from cnt", "'overall' as aoi,")


@query("e3_report", E3_SQL)
def e3_report(spark, sf):
    d = _counts(spark, sf).withColumn("aoi", (F.col("frame") % 3).cast("string"))
    return _rounded(matching.report(d))

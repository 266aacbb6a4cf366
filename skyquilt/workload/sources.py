"""Queries over sources, sinks and catalogues (round trips through the shared folder)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.functions.pixels import explode_pixels, unpack_u8
from skyquilt.operators import matching, samples as sm
from skyquilt.plans import evaluation as ev
from skyquilt.sources import catalogue, images, tables
from skyquilt.workload import fixtures as fx
from skyquilt.workload.evaluation import E3_SQL
from skyquilt.workload.registry import query

NAMES = """nm as (select regexp_replace(url,'[^a-zA-Z0-9]','_','g') || case page_id%4 when 0 then '.png' when 1 then '.JPG'
 when 2 then '.jpeg' else '.txt' end as name, page_id from pages)"""


def _names(spark, sf):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".png", ".JPG", ".jpeg", ".txt")]), (F.col("page_id") % 4 + 1).cast("int"))
    return fx.table(spark, sf, "pages").select(
        F.concat(F.regexp_replace("url", "[^a-zA-Z0-9]", "_"), ext).alias("name"), "page_id")


A1_SQL = """select name, page_id, case when regexp_extract(name,'\\d+',0)<>'' then cast(regexp_extract(name,'\\d+',0) as bigint)
 else row_number() over (order by name, page_id) end as frame, row_number() over (order by name, page_id)-1 as pos
from nm where regexp_matches(lower(name),'\\.(png|jpg|jpeg)$')"""


@query("a1_frame_catalogue", fx.with_(NAMES) + A1_SQL)
def a1_frame_catalogue(spark, sf):
    return catalogue.frame_catalogue(_names(spark, sf))


@query("f2_position_numbering", fx.with_(NAMES) + "select name, page_id, row_number() over (order by name, page_id) as position from nm")
def f2_position_numbering(spark, sf):
    from skyquilt.operators import ordering
    d = _names(spark, sf)
    d = ordering.position(d, [], ["name", "page_id"], ordering.sampled_chunk(d, ["name", "page_id"]))
    return d.select("name", "page_id", (F.col("pos") + 1).alias("position"))


@query("g1_catalogue_order", fx.with_(NAMES) + """select name, page_id, lag(name) over (order by name, page_id) as before,
 lead(name) over (order by name, page_id) as after from nm""")
def g1_catalogue_order(spark, sf):
    from skyquilt.operators import ordering
    d = _names(spark, sf)
    d = ordering.neighbours(d, [], ["name", "page_id"], ordering.sampled_chunk(d, ["name", "page_id"]), F.struct("name"), "p", "n")
    return d.select("name", "page_id", F.col("p.name").alias("before"), F.col("n.name").alias("after"))


FILES = """fl as (select '/data/' || case page_id%3 when 0 then 'TRAIN' when 1 then 'TEST' else 'VAL' end || '/' ||
 regexp_replace(url,'[^a-zA-Z0-9]','_','g') || page_id || case when page_id%5=0 then '.ntf' else '.ntf.r1' end as path from pages)"""


def _files(spark, sf):
    folder = F.element_at(F.array(F.lit("TRAIN"), F.lit("TEST"), F.lit("VAL")), (F.col("page_id") % 3 + 1).cast("int"))
    return fx.table(spark, sf, "pages").select(F.concat(
        F.lit("/data/"), folder, F.lit("/"), F.regexp_replace("url", "[^a-zA-Z0-9]", "_"), F.col("page_id").cast("string"),
        F.when(F.col("page_id") % 5 == 0, ".ntf").otherwise(".ntf.r1")).alias("path"))


@query("a8_aoi_frame_catalogue", fx.with_(FILES, "src as (select path, row_number() over (order by path)-1 as pos from fl where path like '%.r1')")
       + """select path, pos+100 as frame, aoi, 'AOI_'||aoi||'/frame'||lpad(cast(pos+100 as varchar),6,'0')||'.png' as crop
from src, (select unnest(['01','02','03','04','34','40','41']) as aoi) a""")
def a8_aoi_frame_catalogue(spark, sf):
    return catalogue.aoi_catalogue(catalogue.source_catalogue(_files(spark, sf), 100, None)).select("path", "frame", "aoi", "crop")


@query("g2_first_n", fx.with_(FILES, "src as (select path, row_number() over (order by path)-1 as pos from fl where path like '%.r1')")
       + "select path, pos+100 as frame from src where pos<24")
def g2_first_n(spark, sf):
    return catalogue.source_catalogue(_files(spark, sf), 100, 24).select("path", "frame")


@query("c15_file_position_filter", fx.with_(NAMES, "p as (select name, page_id, row_number() over (order by name, page_id) as position from nm)")
       + "select name, page_id, case when position<=30 then 'train' else 'test' end as part from p where position<>31")
def c15_file_position_filter(spark, sf):
    d = f2_position_numbering(spark, sf)
    return sm.file_position_split(d, "position", 30, 31).select("name", "page_id", "part")


@query("a2_grey_frames", fx.with_(fx.FRAMES) + """select aoi, frame, cast(i as int) as i,
 cast(floor(px[3*i+1]*0.114e0+px[3*i+2]*0.587e0+px[3*i+3]*0.299e0+0.5e0) as int) as v from fr, (select unnest(range(21)) as i) g""")
def a2_grey_frames(spark, sf):
    from skyquilt.functions.pixels import pack_u8
    f = fx.frames(spark, sf).select("aoi", "frame", pack_u8(F.slice("px", 1, 63)).alias("data"), F.lit(3).alias("n"))
    g = f.select("aoi", "frame", images.to_grey("data", "n").alias("px"))
    return g.select("aoi", "frame", F.posexplode(unpack_u8("px")).alias("i", "v"))


@query("a3_truth_csv", fx.with_(fx.TRACKS) + "select id, frame_number, x, y, latitude, longitude from tr")
def a3_truth_csv(spark, sf):
    path = session.scratch(spark, "truth")
    tables.write_truth_csv(fx.tracks(spark, sf).withColumn("frame_number", F.col("frame_number").cast("int")), path)
    return tables.read_truth_csv(spark, path)


@query("a4_detection_csv", fx.with_(fx.TRACKS, fx.DETS) + """select s.frame, coalesce(n,0) as n_det from
(select cast(unnest(range(95,171)) as int) as frame) s left join (select frame, count(*) n from dets group by frame) d on d.frame=s.frame""")
def a4_detection_csv(spark, sf):
    path = session.scratch(spark, "dets")
    tables.write_detections(fx.dets(spark, sf), path, ["frame"])
    return tables.detections_per_frame(spark, path, 95, 170)


@query("a5_detection_sink", fx.with_(fx.TRACKS, fx.DETS) + "select frame, printf('%.1f',x) || ',' || printf('%.1f',y) as line from dets")
def a5_detection_sink(spark, sf):
    path = session.scratch(spark, "dets")
    tables.write_detections(fx.dets(spark, sf), path, ["frame"])
    return spark.read.schema("value STRING, frame BIGINT").text(path).select("frame", F.col("value").alias("line"))


@query("a6_geo_sink", fx.with_(fx.TRACKS, fx.DETS) + """select s.frame, n_det, printf('%.6f',lon) as lon, printf('%.6f',lat) as lat
from (select frame, count(*)::bigint as n_det from dets group by frame) s join dets d on d.frame=s.frame
union all select frame, 0, null, null from (select cast(unnest(range(95,100)) as bigint) as frame) e""")
def a6_geo_sink(spark, sf):
    path = session.scratch(spark, "geo")
    d = fx.dets(spark, sf)
    spine = matching.spine(spark, 95, 99).select(F.col("frame").cast("bigint").alias("frame")).union(d.select("frame"))
    tables.write_geo_detections(d, spine, path, ["frame"])
    rows = spark.read.schema("lon STRING, lat STRING, frame BIGINT").option("header", True).csv(f"{path}/rows")
    return tables.read_geo_manifest(spark, path).join(rows, "frame", "left").select("frame", "n_det", "lon", "lat")


@query("a9_homography_source", fx.with_(fx.HOMS) + "select aoi, src_frame, dst_frame, h from hom")
def a9_homography_source(spark, sf):
    path = session.scratch(spark, "hom")
    fx.pairs_h(spark, sf).withColumn("aoi", F.col("aoi").cast("string")).write.parquet(path)
    return tables.read_homographies(spark, path).withColumn("aoi", F.col("aoi").cast("int"))


@query("a10_patch_samples", fx.with_(fx.SAMPLES) + "select file_id, cls, count(*) as n from smp where len(px)=64 group by 1,2")
def a10_patch_samples(spark, sf):
    path = session.scratch(spark, "samples")
    fx.samples(spark, sf).write.parquet(path)
    return sm.file_class_counts(sm.valid_samples(spark.read.parquet(path), 64))


@query("a11_prior_samples", fx.with_(fx.PIXELS) + "select aoi, frame, r, c, v/255.0e0 as v, v>120 as m from pix")
def a11_prior_samples(spark, sf):
    path = session.scratch(spark, "prior")
    f = fx.frames(spark, sf)
    sm.write_prior_samples(f.select("aoi", "frame", F.col("px").alias("image"), F.transform("px", lambda v: v > 120).alias("mask")), path)
    d = sm.read_prior_samples(spark, path)
    d = d.select("aoi", "frame", F.posexplode(F.arrays_zip("image", "mask")).alias("i", "z"))
    return d.select("aoi", "frame", F.floor(F.col("i") / 8).cast("int").alias("r"), (F.col("i") % 8).alias("c"),
                    F.col("z.image").alias("v"), F.col("z.mask").alias("m"))


@query("a12_metrics_sink", E3_SQL)
def a12_metrics_sink(spark, sf):
    path = session.scratch(spark, "metrics")
    d = ev.offline_counts(fx.tracks(spark, sf), fx.dets(spark, sf), 105, 160, 1.2, 10.0)
    d = session.cut(d.withColumn("aoi", (F.col("frame") % 3).cast("string")), "counts")
    tables.write_metrics(matching.micro_scores(d, ["aoi"]), matching.micro_scores(d), path)
    out = tables.read_metrics(spark, path)
    for c in ("precision", "recall", "f1"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@query("a13_norm_params", """with p as (select label, avg(cast(embedding[1] as double)) as a, avg(cast(embedding[2] as double)) as b from embeddings group by label)
select label, [round(a,9), round(b,9)] as norm from p""")
def a13_norm_params(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    p = e.groupBy("label").agg(F.avg(F.col("embedding")[0].cast("double")).alias("a"), F.avg(F.col("embedding")[1].cast("double")).alias("b"))
    arr = F.array(F.round("a", 9), F.round("b", 9))
    path = session.scratch(spark, "norm")
    p.select("label", F.when(F.col("label") % 3 == 0, arr).alias("mean_img"), F.when(F.col("label") % 3 == 1, arr).alias("mean"),
             F.when(F.col("label") % 3 == 2, arr).alias("mu")).write.parquet(path)
    return tables.norm_mean(spark.read.parquet(path))


@query("a14_region_of_interest", fx.with_(fx.MOSAIC) + "select aoi, frame, r, c, v from mos where r>=5 and r<29 and c>=11 and c<40")
def a14_region_of_interest(spark, sf):
    return images.region_of_interest(fx.mosaic(spark, sf), 5, 29, 11, 40)


@query("i1_tiling", fx.with_(fx.MOSAIC) + "select aoi, frame, r, c, v from mos")
def i1_tiling(spark, sf):
    """Re-tile 8x8 tiles to 16x16 through the halo exchange and unpack."""
    from skyquilt.operators import tiles
    return explode_pixels(tiles.retile(fx.mosaic(spark, sf), 16))

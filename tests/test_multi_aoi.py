"""Registration wired to detection and detection to scores."""

import pytest
from pyspark.sql import functions as F

from skyquilt.operators import sequence as sq
from skyquilt.plans import detection as de, evaluation, multi_aoi
from skyquilt.workload import end_to_end as e2e
from skyquilt.workload.refinement import stand_in_classifier

SF = "/root/testdata/sf0.001"
SETTINGS = de.Settings(tile=e2e.TILE, templates=e2e.N, threshold=20, use_motion=False, blank_area=4000)


def _found(spark, tiles, keys, **kw):
    d = multi_aoi.detections(tiles, keys, multi_aoi.Registration(**kw), SETTINGS, stand_in_classifier, e2e.brighter_regressor)
    return d.groupBy("frame").count().rdd.collectAsMap()


def test_a_frame_that_cannot_be_registered_is_skipped_or_taken_as_it_is(spark):
    tiles = e2e.views(spark, SF).where("aoi = '01' and frame < 5")
    keys = e2e.keypoints(spark, SF).where("aoi = '01' and (frame <> 4 or kp_id < 3)")
    skipped = _found(spark, tiles, keys, on_failure="skip")
    assert set(skipped) == {3}
    kept = _found(spark, tiles, keys)
    assert kept[3] == skipped[3]
    # frame 4 is compared with templates that are out of place, so more than its movers stand out
    assert kept[4] > skipped[3]


def test_wrong_settings_are_refused(spark):
    empty = spark.createDataFrame([], "aoi string, frame int")
    with pytest.raises(ValueError):
        multi_aoi.register(empty, empty, 3, multi_aoi.Registration(plan="chained"))
    with pytest.raises(ValueError):
        multi_aoi.detections(empty, empty, multi_aoi.Registration(on_failure="drop"), SETTINGS, None, None)


def test_matched_points_keep_their_positions(spark):
    rows = [("a", 1, 0, [5, 5], 1.0, 2.0), ("a", 1, 1, [-1, -1], 3.0, 4.0), ("a", 2, 7, [-1, -1], 5.0, 6.0), ("a", 2, 8, [5, 5], 7.0, 8.0)]
    keys = spark.createDataFrame(rows, "aoi string, frame int, kp_id long, desc array<long>, x double, y double")
    pairs = spark.createDataFrame([("a", 1, 2)], "aoi string, src_frame int, dst_frame int")
    d = multi_aoi.matched_points(keys, pairs, multi_aoi.Registration())
    assert sorted(map(tuple, d.select("match_id", "x", "y", "u", "v").collect())) == [(0, 1.0, 2.0, 7.0, 8.0), (1, 3.0, 4.0, 5.0, 6.0)]
    assert sq.PAIR == d.columns[:3]


def test_repeated_truth_counts_and_matches_one_by_one(spark):
    t = e2e.truth(spark, SF).where("id = 0")
    twice = t.unionByName(t.withColumn("id", F.lit(99).cast("long")))
    last = t.agg(F.max("frame_number")).first()[0]
    at = t.select(F.lit("01").alias("aoi"), F.col("frame_number").cast("int").alias("frame"), F.col("x").alias("x"), F.col("y").alias("y"))
    dets = at.withColumn("seq", F.lit(0)).unionByName(at.withColumn("seq", F.lit(1)))
    run = dict(num_templates=e2e.N, width=e2e.SIDE, height=e2e.SIDE, match_m=20.0, aois=at.select("aoi").distinct())
    rows = {r.aoi: r for r in evaluation.multi_aoi_report(twice, dets, 0, last, **run, merge_px=0.5).collect()}
    frames = t.where(f"frame_number >= {e2e.N}").count()
    assert set(rows) == {"01", "overall"}
    # equal points merge into one detection, which takes one of the two
    assert (rows["01"].n_gt, rows["01"].n_det, rows["01"].tp) == (2 * frames, frames, frames)

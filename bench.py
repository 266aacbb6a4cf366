"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_REPS choose the tables, the local cores and
the measured runs per query (after one warm-up run; the median is reported).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from skyquilt import session
from skyquilt.workload import catalog

HEADLINE = (
    "offline_metrics", "c2_every_step_moves", "c3_some_step_moves", "d1_nn_match", "d9_aoi_range_join",
    "d2_greedy_geo_match", "d3_merge_close_points", "d13_road_distance", "d5_template_pairs", "d7_mutual_matches",
    "e4_temporal_median", "e9_motion_statistics", "i8_opening", "e12_region_properties", "i3_perspective_warp",
    "i20_block_motion", "i12_patches_21", "g4_balanced_sample", "i21_label_masks", "detect_frames", "i15_heatmap_peaks", "i16_refinement",
    "i10_background_pipeline", "i4_homography_estimate", "i11_components", "multi_aoi_report", "g5_epoch_batches", "k1_template_window",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    reps = int(os.environ.get("BENCH_REPS", "1"))
    spark = session.build("bench", f"local[{cpus}]", max(cpus, 8))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(reps + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")),
    }))
    session.clear(spark)
    spark.stop()


if __name__ == "__main__":
    main()

"""Faults that show on larger or odd tables, on small hand-made ones."""

import math

import duckdb
import numpy as np
import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skyquilt.operators import matching, roads
from skyquilt.workload import catalog


def _embeddings(folder, vectors, labels=None, ids=None):
    n = len(vectors)
    pq.write_table(pa.table({
        "vec_id": pa.array(range(n) if ids is None else ids, pa.int64()),
        "embedding": pa.array([v.tolist() for v in vectors], pa.list_(pa.float32())),
        "label": pa.array([0] * n if labels is None else labels, pa.int32()),
    }), f"{folder}/embeddings.parquet")


@pytest.mark.parametrize("name", ["d12_model_broadcast", "j1_batched_scores"])
def test_scores_beside_a_rounding_edge(spark, tmp_path, name):
    edge = ((np.arange(200) + 0.5) / 1000).astype(np.float32)
    sides = np.concatenate([np.nextafter(edge, np.float32(0)), np.nextafter(edge, np.float32(1))])
    _embeddings(tmp_path, np.repeat(sides[:, None], 64, axis=1))
    error = oracle.compare(spark, str(tmp_path), catalog.QUERIES[name], catalog.ORACLES[name], oracle.connect(str(tmp_path)))[2]
    assert error is None, error


@pytest.mark.parametrize("name", ["k1_template_window", "k3_failed_frames"])
def test_streams_of_files_written_out_of_order(spark, tmp_path, name):
    rng = np.random.default_rng(3)
    vectors = rng.uniform(-0.3, 0.3, (120, 64)).astype(np.float32)
    folder = tmp_path / "embeddings.parquet"
    folder.mkdir()
    for i, part in enumerate((2, 0, 1)):
        at = tmp_path / f"{i}"
        at.mkdir()
        ids = np.arange(part * 40, part * 40 + 40)
        _embeddings(at, vectors[ids], ids % 2, ids)
        (at / "embeddings.parquet").rename(folder / f"part-{i}.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/*.parquet'")
    error = oracle.compare(spark, str(tmp_path), catalog.QUERIES[name], catalog.ORACLES[name], con)[2]
    assert error is None, error


def test_files_land_in_order(spark, tmp_path):
    from skyquilt.streaming import templates

    d = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    templates.land(d, str(tmp_path / "landing"), "k", 100)
    files = sorted((tmp_path / "landing").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == 10
    assert [v for f in files for v in pq.read_table(f)["k"].to_pylist()] == list(range(1000))


def test_a_point_on_many_roads_is_never_paired(spark):
    rng = np.random.default_rng(7)
    line = "lon1 double, lat1 double, lon2 double, lat2 double"
    rows = [(i, "motorway" if i % 3 else "service", *(float(v) for v in rng.uniform(0, 2e-3, 4))) for i in range(60)]
    r = roads.buffered_roads(spark.createDataFrame(rows + [(100 + w, "trunk", *v) for w, _, *v in rows], f"way_id long, highway string, {line}"))
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1e-4, 2.1e-3, (400, 2)))], "id long, lon double, lat double")
    got = roads.on_road(p, r, ["id"])
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(x.id for x in roads.road_pairs(p, r).select("id").distinct().collect())
    assert sorted(x.id for x in got.collect()) == want and 0 < len(want) < 400


def test_roads_meet_points_without_a_broadcast(spark):
    rng = np.random.default_rng(13)
    line = "lon1 double, lat1 double, lon2 double, lat2 double"
    rows = [(i, ("motorway", "service")[i % 2], *(float(v) for v in rng.uniform(-1e-3, 2e-3, 4))) for i in range(60)]
    rows += [(100, "trunk", 0.0, 0.0, 0.0, 2e-3), (101, "trunk", 2e-3, 1e-3, -1e-3, 1e-3), (102, "trunk", 6e-4, 6e-4, 6e-4, 6e-4), rows[0]]  # straight, a point, a copy
    r = roads.buffered_roads(spark.createDataFrame(rows, f"way_id long, highway string, {line}"))
    cells = roads._cells(r.where("way_id > 0"))
    assert "Exchange" not in cells._jdf.queryExecution().executedPlan().toString()
    side = F.lit(roads.CELL_DEG)
    boxes = roads._pieces(r.where("way_id > 0"), side).select("way_id", *[F.floor(F.col(c) / side).alias(c) for c in ("west", "east", "south", "north")]).collect()
    want = {(b.way_id, x, y) for b in boxes for x in range(b.west, b.east + 1) for y in range(b.south, b.north + 1)}
    assert sorted((c.way_id, c.gx, c.gy) for c in cells.collect()) == sorted(want) and len(boxes) < len(want)

    at = rng.uniform(-1e-3, 2e-3, (300, 2))
    got = roads.road_pairs(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, lon double, lat double"), r)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    width = dict(roads.ROAD_BUFFER_M)
    near = []
    for i, (x, y) in enumerate(at):
        k = np.array([np.cos(np.radians(y)) * roads.M_PER_DEG, roads.M_PER_DEG])
        for way, name, *ends in rows:
            a, v = (np.array(ends[:2]) - (x, y)) * k, (np.array(ends[2:]) - ends[:2]) * k
            t = np.clip(-(a @ v) / (v @ v), 0, 1) if v @ v else 0
            if np.linalg.norm(a + t * v) <= width[name]:
                near.append((i, way))
    assert sorted((p.id, p.way_id) for p in got.collect()) == sorted(near) and len(set(near)) < len(near)


def test_pairs_of_a_road_and_a_track_stand_together(spark):
    rng = np.random.default_rng(17)
    line = "lon1 double, lat1 double, lon2 double, lat2 double"
    ways = [(i, ("motorway", "tertiary")[i % 2], *(float(v) for v in rng.uniform(-2e-4, 1e-3, 4))) for i in range(40)]
    at = rng.uniform(0, 8e-4, (6, 2))
    rows = [(k, f, float(x + f * 5e-7), float(y)) for k, (x, y) in enumerate(at) for f in range(600)]
    rows += [rows[0], (None, 7, *rows[0][2:]), (1, 9, None, 0.0), (1, 9, 0.0, None), (2, None, *rows[0][2:]), (9, 0, float("nan"), 0.0), (9, 1, 0.0, float("nan"))]
    p = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "id long, frame int, lon double, lat double").repartition(3)
    got = roads.road_pairs(p, roads.buffered_roads(spark.createDataFrame(ways, f"way_id long, highway string, {line}")), frame="frame")
    assert got.columns == ["id", "frame", "lon", "lat", "way_id", "highway", "buffer_m", "dist_m"]

    width, want = dict(roads.ROAD_BUFFER_M), []
    for key, frame, x, y in rows:
        if x is None or y is None:
            continue
        k = np.array([np.cos(np.radians(y)) * roads.M_PER_DEG, roads.M_PER_DEG])
        for way, name, *ends in ways:
            a, v = (np.array(ends[:2]) - (x, y)) * k, (np.array(ends[2:]) - ends[:2]) * k
            if np.linalg.norm(a + np.clip(-(a @ v) / (v @ v), 0, 1) * v) <= width[name]:
                want.append((key, frame, way))
    found = [(r.id, r.frame, r.way_id) for r in got.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, want)) and len(set(want)) < len(want)

    cell = [(r.id, r.way_id, math.floor(r.lon / roads.CELL_DEG), math.floor(r.lat / roads.CELL_DEG), r.frame and r.frame // roads.TRACK_FRAMES) for r in got.collect()]
    runs = 1 + sum(a != b for a, b in zip(cell, cell[1:]))
    assert runs == len(set(cell)) and 10 * runs < len(cell)
    assert all(a[1] <= b[1] for a, b, c, d in zip(found, found[1:], cell, cell[1:]) if c == d and a[1] is not None)


def test_geo_match_makes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows, want = {"det": [], "gt": []}, set()
    for frame in range(3):
        side = 4e-4 if frame else 2e-5  # a crowded place, and two spread frames

        def points(n, numbers):
            at = np.round(rng.uniform(0, side, (n, 2)), 6)
            return [(frame, int(k), float(x) - 84.1, float(y) + 39.7) for k, (x, y) in zip(rng.integers(0, numbers, n), at)]

        d, t = points(150, 130), points(120, 110)  # some numbers have two places
        rows["det"] += d
        rows["gt"] += t
        taken = set()
        for k in sorted({r[1] for r in d}):
            near = [(matching._arc_m(a[3], a[2], b[3], b[2]), b[1]) for a in d if a[1] == k for b in t if b[1] not in taken]
            near = [v for v in near if v[0] <= 9]
            if near:
                taken.add(min(near)[1])
                want.add((frame, k, min(near)[1]))
    df = {k: spark.createDataFrame(v + [(0, 999, None, 39.7), (0, 998, float("nan"), 39.7)], f"frame int, {k} long, lon double, lat double").repartition(4) for k, v in rows.items()}
    pairs = matching.greedy_pairs(matching.geo_edges(df["det"], df["gt"], 9.0, ["frame"]), ["frame"])
    assert {(r.frame, r.det, r.gt) for r in pairs.collect()} == want
    for made in ("geo_edges", "greedy_pairs"):
        monkeypatch.setattr(matching, made, None)
    got = matching.greedy_geo_match(df["det"], df["gt"], 9.0, ["frame"]).collect()
    assert {(r.frame, r.det, r.gt) for r in got} == want and len(got) == len(want)
    assert matching.greedy_geo_match(df["det"].limit(0), df["gt"], 9.0, ["frame"]).collect() == []


def _joined(plan) -> list[int]:
    """Rows that each join of a plan gave when it ran."""
    while plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.finalPhysicalPlan()
    if plan.nodeName().endswith("QueryStage"):
        return _joined(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else []
    below = plan.children()
    return own + [n for i in range(below.size()) for n in _joined(below.apply(i))]


def test_nearest_truth_of_a_crowded_cell_makes_no_pairs(spark):
    rng = np.random.default_rng(5)
    # halves of a metre in one place, so many are equally near; a frame without truth, and a place far from all
    at = {k: np.unique(rng.integers(0, 50, (2000, 2)), axis=0)[:n] / 2 for k, n in (("det", 700), ("gt", 600))}
    t = [(0, float(x), float(y), int(g)) for (x, y), g in zip(at["gt"], rng.permutation(600))]
    d = [(0, float(x), float(y)) for x, y in at["det"]] + [(1, 3.0, 3.0), (0, 900.0, 900.0), (0, None, 1.0)]
    got = matching.nearest_truth(spark.createDataFrame(d, "frame int, x double, y double"), spark.createDataFrame(t, "frame int, x double, y double, gt int"), 6.0)
    rows = {(r.frame, r.x, r.y): r.best and tuple(r.best) for r in got.collect()}
    want = {}
    for f, x, y in d:
        near = [] if x is None else [(float(np.hypot(x - a, y - b)), g) for e, a, b, g in t if e == f]
        want[f, x, y] = min((v for v in near if v[0] <= 6), default=None)
    assert {k: v and v[1] for k, v in rows.items()} == {k: v and v[1] for k, v in want.items()}
    assert all(v is None or abs(v[0] - want[k][0]) < 1e-9 for k, v in rows.items())
    # a position meets blocks of its own cell, not its truth one by one
    joined = _joined(got._jdf.queryExecution().executedPlan())
    assert joined and max(joined) <= len(d) * -(-len(t) // matching.BLOCK)


def test_tasks_hold_a_slice_of_a_batch(spark):
    from skyquilt.functions.batches import ROWS, map_slices

    def size(batches):
        for pdf in batches:
            yield pdf[["id"]].assign(n=len(pdf), last=[list(v)[-1] for v in pdf["v"]])

    d = spark.range(0, 1000, 1, 1).select("id", F.array(F.lit(0), F.col("id")).alias("v"))
    got = map_slices(d, size, "id long, n int, last long").collect()
    assert sorted(r.id for r in got) == list(range(1000)) and all(r.last == r.id for r in got)
    assert max(r.n for r in got) == ROWS


@pytest.mark.parametrize("half", [10, 22])
def test_patches_are_scored_where_they_are_cut(spark, half):
    from skyquilt.operators import refine

    rng = np.random.default_rng(half)
    px = "aoi int, frame int, ch int, ty int, tx int, r0 int, c0 int, h int, w int, height int, width int, px binary"
    tiles = spark.createDataFrame([(0, 0, ch, ty, tx, ty * 48, tx * 48, 48, 48, 96, 96, bytearray(rng.integers(0, 256, 2304, np.uint8).tobytes()))
                                   for ch in range(4) for ty in range(2) for tx in range(2)], px)
    points = spark.createDataFrame([(0, 0, i, int(r), int(c), [i]) for i, (r, c) in enumerate(rng.integers(23, 73, (700, 2)))],
                                   "aoi int, frame int, pid long, r int, c int, info array<bigint>")

    def load():
        return lambda x: np.stack([x.mean(axis=(1, 2, 3)), x[:, 3, 0, 1], x[:, 0, -1, -2]], axis=1)

    mean, side = np.arange(4.0), 2 * half + 1
    want = refine.score(refine.extract_patches(tiles, points, 48, half), load, (4, side, side), mean)
    got = refine.score_patches(tiles, points, 48, half, load, mean)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.select("pid", "r", "c", "info", "pred").collect())) == sorted(map(tuple, want.select("pid", "r", "c", "info", "pred").collect()))
    assert got.count() == 700
    assert str(got._jdf.queryExecution().optimizedPlan().toString()).count("MapInArrow") == 2  # strips, then patches with scores

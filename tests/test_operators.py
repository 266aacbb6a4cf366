"""Edge cases and properties on small hand-made inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt import schemas
from skyquilt.functions import geo, kernels, pixels as px
from skyquilt.operators import background as bg, components, graph, matching, motion, ordering, refine, roads, sequence as sq, tiles as tl, tracks
from skyquilt.plans import detection
from skyquilt.sources import images, tables

TRACK = "id long, frame_number int, x double, y double, latitude double, longitude double"
M = 1 / 111194.92664455873  # degrees of latitude per metre


def _track(spark, rows):
    return spark.createDataFrame([(i, f, 0.0, 0.0, lat, 0.0) for i, f, lat in rows], TRACK)


def _kept(df):
    return sorted((r.id if r.id is not None else -1, r.frame_number) for r in df.collect())


def test_motion_filters_on_edge_cases(spark):
    t = _track(spark, [
        (1, 1, 0.0), (1, 2, 2 * M), (1, 3, 2.1 * M),      # moves, then stands
        (2, 1, 0.0),                                       # single point
        (None, 1, 0.0), (None, 2, 0.0),                    # no id
        (3, 1, float("nan")), (3, 2, 5 * M),               # unknown position
    ])
    assert _kept(tracks.every_step_moves(t, 1.0)) == [(-1, 1), (-1, 2), (1, 1), (2, 1), (3, 1), (3, 2)]
    assert _kept(tracks.some_step_moves(t, 1.0)) == [(1, 1), (1, 2)]


def test_track_steps_cross_chunks(spark):
    rows = [(1, f, f * 2 * M) for f in (1, 500, 511, 512, 513, 1030, 5000)]
    d = tracks.displacement(_track(spark, rows)).orderBy("frame_number").collect()
    got = [r.step_m for r in d]
    assert got[-1] is None
    assert [round(v) for v in got[:-1]] == [998, 22, 2, 2, 1034, 7940]


def test_position_and_running_sum_do_not_depend_on_chunks(spark):
    d = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 200).alias("o"))
    want = sorted(tuple(r) for r in ordering.position(d, ["k"], ["o"], F.lit(0)).collect())
    for width in (1, 7, 64):
        got = ordering.position(d, ["k"], ["o"], ordering.by_width("o", width))
        assert sorted(tuple(r) for r in got.collect()) == want
    s = ordering.running_sum(d, ["k"], ["o"], ordering.by_width("o", 9), {"run": "o"}).where("k = 1").orderBy("o").collect()
    assert [r.run for r in s] == list(np.cumsum([r.o for r in s]))


def test_sliding_is_the_same_for_any_chunk(spark):
    d = spark.range(50).select(F.lit(0).alias("k"), F.col("id").alias("p"))
    for chunk in (4, 5, 50):
        rows = ordering.sliding(d, ["k"], "p", 4, F.col("p"), "w", chunk).collect()
        assert sorted((r.p, tuple(r.w)) for r in rows) == [(i, tuple(range(i - 4, i))) for i in range(4, 50)]


def test_nearest_match_never_takes_the_second_nearest(spark):
    truth = spark.createDataFrame([(1, 0.0, 0.0, 1), (1, 8.0, 0.0, 2)], "frame int, x double, y double, gt int")
    dets = spark.createDataFrame([(1, 1.0, 0.0), (1, 2.0, 0.0), (1, 2.0, 0.0), (1, 50.0, 0.0), (2, 0.0, 0.0)], "frame int, x double, y double")
    got = {r.frame: (r.n_det, r.hits, r.tp) for r in matching.nn_match(dets, truth, 10.0).collect()}
    assert got == {1: (4, 3, 1), 2: (1, 0, 0)}
    at_limit = spark.createDataFrame([(1, 18.0, 0.0)], "frame int, x double, y double")
    assert matching.nn_match(at_limit, truth, 10.0).first().tp == 1


def _greedy(edges):
    used, pairs = set(), []
    for d in sorted({e[0] for e in edges}):
        free = sorted((dist, g) for dd, g, dist in edges if dd == d and g not in used)
        if free:
            used.add(free[0][1])
            pairs.append((d, free[0][1]))
    return sorted(pairs)


@pytest.mark.parametrize("dense", [False, True])
def test_greedy_parts_equal_a_direct_loop(spark, dense):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for frame in range(6):
        e = [(d, g, float(rng.integers(0, 9))) for d in range(60) for g in range(50) if (True if dense and frame == 0 else rng.random() < 0.02)]
        want[frame] = _greedy(e)
        rows += [(frame, *x) for x in e]
    edges = spark.createDataFrame(rows, "frame int, det int, gt int, dist double").repartition(5)
    got = {}
    for r in matching.greedy_pairs(edges, ["frame"]).collect():
        got.setdefault(r.frame, []).append((r.det, r.gt))
    assert {k: sorted(v) for k, v in got.items()} == want
    parts = matching._claims(edges, ["frame"]).select("frame", "part").distinct().groupBy("frame").count().collect()
    assert all((r["count"] == 1) == (dense and r.frame == 0) for r in parts)
    assert matching.greedy_pairs(edges.limit(0), ["frame"]).collect() == []


@pytest.mark.parametrize("step", [1_000_000, 60])
def test_graph_components_of_any_shape(spark, step):
    rng = np.random.default_rng(step)
    links = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 600)] + [(999 - i, 999) for i in range(60)] + [(7, 7), (7, 7)]
    links += [(int(a), int(b)) for a, b in rng.integers(2_000, 2_200, (90, 2))]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    order = rng.permutation(len(links))
    df = spark.createDataFrame([links[i] for i in order], "a long, b long").repartition(6)
    got = graph.components(df, step).collect()
    assert sorted(map(tuple, got)) == sorted((i, find(i)) for i in list(parent))
    text = graph.components(df.selectExpr("lpad(a, 6, '0') as a", "lpad(b, 6, '0') as b"), step).collect()
    assert sorted((int(a), int(b)) for a, b in text) == sorted(map(tuple, got))
    assert graph.components(df.limit(0), step).collect() == []


def test_merge_uses_the_running_mean_and_ignores_row_order(spark):
    pts = [(0, "a", 0, 0.0, 0.0), (0, "a", 1, 4.0, 0.0), (0, "a", 2, 7.0, 0.0), (0, "a", 3, 90.0, 0.0)]
    d = spark.createDataFrame(pts[::-1], "frame int, aoi string, seq long, x double, y double")
    got = sorted((r.seq, round(r.x, 3), r.n) for r in matching.merge_close_points(d, 6.0).collect())
    assert got == [(0, 3.667, 3), (3, 90.0, 1)]


def test_merge_cuts_blocks_until_stable_and_equals_all_clusters(spark):
    """A dense block, and two ends of a bar that only a second cut along x parts; equal gaps go to the older cluster."""
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 60, (900, 2)).tolist()
    bar = [(200 + 3 * i, 0) for i in range(30)] + [(200 + 2 * i, 50) for i in range(5)] + [(280 + 2 * i, 50) for i in range(5)]
    pts = [(0, "a", i, float(x), float(y)) for i, (x, y) in enumerate(dense + bar)]
    d = spark.createDataFrame(pts, "frame int, aoi string, seq long, x double, y double").repartition(4)
    got = sorted((r.seq, round(r.x, 6), round(r.y, 6), r.n) for r in matching.merge_close_points(d, 7.0).collect())
    cl = []
    for _, _, i, x, y in pts:
        gaps = [float(np.hypot(x - c[1] / c[3], y - c[2] / c[3])) for c in cl]
        k = int(np.argmin(gaps)) if gaps else -1
        if k >= 0 and gaps[k] < 7.0:
            cl[k][1:] = [cl[k][1] + x, cl[k][2] + y, cl[k][3] + 1]
        else:
            cl.append([i, x, y, 1])
    assert got == sorted((i, round(a / n, 6), round(b / n, 6), n) for i, a, b, n in cl)
    blocks = matching._blocks(d, ["aoi", "frame"], 7.0)
    assert blocks.select("_part").distinct().count() == 4


def test_merge_matches_a_direct_loop(spark):
    rng = np.random.default_rng(9)
    pts = [(f, "a", i, float(x), float(y)) for f in range(3) for i, (x, y) in enumerate(rng.integers(0, 120, (150, 2)))]
    d = spark.createDataFrame(pts, "frame int, aoi string, seq long, x double, y double")
    got = sorted((r.frame, r.seq, round(r.x, 6), round(r.y, 6), r.n) for r in matching.merge_close_points(d, 7.0).collect())
    want = []
    for f in range(3):
        cl = []
        for _, _, i, x, y in [p for p in pts if p[0] == f]:
            near = [(math.hypot(x - c[1] / c[3], y - c[2] / c[3]), j) for j, c in enumerate(cl)]
            if near and min(near)[0] < 7.0:
                c = cl[min(near)[1]]
                c[1], c[2], c[3] = c[1] + x, c[2] + y, c[3] + 1
            else:
                cl.append([i, x, y, 1])
        want += [(f, c[0], round(c[1] / c[3], 6), round(c[2] / c[3], 6), c[3]) for c in cl]
    assert got == sorted(want)


def test_scores_of_empty_counts_are_zero(spark):
    d = spark.createDataFrame([("a", 0, 0, 0, 0, 0)], "aoi string, tp long, fp long, fn long, n_gt long, n_det long")
    r = matching.micro_scores(d).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


# ------------------------------------------------------------------- raster

def _frames(spark, arrays, aoi="a"):
    h, w = arrays[0].shape
    return spark.createDataFrame(
        [(aoi, i, h, w, bytearray(a.astype(np.uint8).tobytes())) for i, a in enumerate(arrays)],
        "aoi string, frame int, height int, width int, px binary",
    )


def _dense(df, shape, col="v", dtype=float):
    out = {}
    for r in df.collect():
        out.setdefault(r.frame, np.zeros(shape, dtype))[r.r, r.c] = r[col]
    return out


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(1)
    return [rng.integers(0, 256, (37, 41)) for _ in range(5)]


def test_tiles_of_any_size_hold_the_same_frame(spark, noise):
    f = _frames(spark, noise)
    for tile in (8, 16, 64):
        t = images.to_tiles(f, tile)
        got = _dense(px.explode_pixels(tl.retile(t, 11)), (37, 41))
        assert all((got[i] == a).all() for i, a in enumerate(noise))


def test_subtraction_does_not_depend_on_tiles(spark, noise):
    f = _frames(spark, noise)
    results = []
    for tile in (13, 64):
        t = images.to_tiles(f, tile)
        temps = bg.identity_templates(t, sq.template_pairs(t.select("aoi", "frame").distinct(), 3))
        d = bg.subtract(bg.stack(t, temps, tile, bg.HALO), tile, 30, keep=("templates",))
        results.append(sorted((r.frame, r.r, r.c) for r in bg.set_pixels(d.select(*tl.COLS)).collect()))
    assert results[0] == results[1] and results[0]


def test_base_and_motion_medians_round_differently(spark):
    a = [np.full((4, 4), v) for v in (10, 11, 20)]
    t = images.to_tiles(_frames(spark, a), 4)
    temps = bg.identity_templates(t, sq.template_pairs(t.select("aoi", "frame").distinct(), 2))
    stacks = bg.stack(t, temps, 4, 2)
    for aware, want in ((False, 9.5), (True, 10.0)):
        d = bg.subtract(stacks, 4, 5, None, aware, halo=2, keep=("diff",))
        assert np.frombuffer(d.first()["diff"], np.float64).tolist() == [want] * 16


def test_component_across_four_tiles_and_diagonals(spark):
    m = np.zeros((8, 8), int)
    m[2:6, 3:5] = 1
    m[6, 5] = 1
    t = images.to_tiles(_frames(spark, [m]), 4)
    for fan in (2, 4):
        four = sorted((r.region_id, r.area, r.r0, r.c0, r.r1, r.c1) for r in components.regions(t, 4, fan=fan).collect())
        eight = [(r.region_id, r.area) for r in components.regions(t, 8, fan=fan).collect()]
        assert four == [(19, 8, 2, 3, 6, 5), (53, 1, 6, 5, 7, 6)]
        assert eight == [(19, 9)]


@pytest.mark.parametrize("connectivity", [4, 8])
def test_component_levels_equal_one_label_of_the_frame(spark, connectivity):
    rng = np.random.default_rng(4)
    snake = np.zeros((61, 45), int)  # one component through every tile of the frame
    snake[::4] = 1
    snake[np.isin(np.arange(61) % 8, (1, 2, 3)), -1] = 1
    snake[np.arange(61) % 8 > 4, 0] = 1
    masks = [(rng.random((61, 45)) > p).astype(int) for p in (0.3, 0.42, 0.6, 0.97)] + [snake, np.zeros((61, 45), int), np.ones((61, 45), int)]
    t = images.to_tiles(_frames(spark, masks), 5)
    for fan in (2, 3, 16):
        got = {}
        for r in components.pixel_labels(t, connectivity, fan=fan).collect():
            got[r.frame, r.r, r.c] = r.label
        for f, m in enumerate(masks):
            lab = kernels.label(m != 0, connectivity)
            first = {k: int(np.flatnonzero(lab.ravel() == k)[0]) for k in range(1, lab.max() + 1)}
            assert {(r, c): v for (g, r, c), v in got.items() if g == f} == {(r, c): first[lab[r, c]] for r, c in zip(*np.nonzero(m))}
    assert kernels.label(snake != 0, 4).max() == 1


def test_blank_frame_is_invalid_everywhere(spark):
    a = [np.full((24, 24), 90), np.full((24, 24), 91), np.full((24, 24), 255)]
    t = images.to_tiles(_frames(spark, a), 10)
    temps = bg.identity_templates(t, sq.template_pairs(t.select("aoi", "frame").distinct(), 2))
    assert bg.set_pixels(bg.invalid_area(t, temps, 10, 100, 6)).count() == 24 * 24


def test_identity_warp_returns_the_frame(spark, noise):
    t = images.to_tiles(_frames(spark, noise), 16)
    pairs = t.select("aoi", F.col("frame").alias("src_frame")).distinct().select(
        "aoi", "src_frame", F.col("src_frame").alias("dst_frame"), F.lit(0).alias("slot"),
        F.array(*[F.lit(v) for v in geo.IDENTITY3]).alias("h"))
    got = _dense(px.explode_pixels(tl.warp(t, pairs, 16).withColumnRenamed("dst_frame", "frame")), (37, 41))
    assert all((got[i] == a).all() for i, a in enumerate(noise))


@pytest.mark.parametrize("h", [
    [1.0, 0.1, 3.0, 0.05, 1.1, -2.0, 0.02, 0.03, 1.0], [0.05, 0.0, 1.0, 0.0, 0.05, 1.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.05, -0.05, 0.4]])
def test_warp_at_the_horizon_equals_one_warp_of_the_frame(spark, noise, h):
    """Strong perspective, a source 20 times as wide as the target, and a horizon through the middle of tiles."""
    t = images.to_tiles(_frames(spark, noise[:1]), 16)
    pairs = t.select("aoi", F.col("frame").alias("src_frame")).distinct().select(
        "aoi", "src_frame", F.lit(9).alias("dst_frame"), F.lit(0).alias("slot"), F.array(*[F.lit(v) for v in h]).alias("h"))
    got = _dense(px.explode_pixels(tl.warp(t, pairs, 16).withColumnRenamed("dst_frame", "frame")), (37, 41))[9]
    inv = np.linalg.inv(np.array(h).reshape(3, 3))
    whole = {"pr": 0, "pc": 0, "ph": 37, "pw": 41, "px": noise[0].astype(np.uint8).tobytes()}
    assert (got == kernels.warp_tile([whole], inv, 0, 0, 37, 41, 37, 41, 255)).all()
    for ty in range(3):
        for tx in range(3):
            x, y = kernels.warp_coords(inv, 16 * ty, 16 * tx, min(16, 37 - 16 * ty), min(16, 41 - 16 * tx))
            assert set(map(tuple, kernels.tiles_hit(x, y, 16, 37, 41).tolist())) <= set(tl.source_tiles_needed(inv, ty, tx, 16, 37, 41))


def test_homography_is_recovered_from_noisy_matches(spark):
    rng = np.random.default_rng(2)
    h = np.array([[1.01, 0.02, 3], [-0.01, 0.99, -2], [1e-5, 2e-5, 1]])
    rows = []
    for i, (x, y) in enumerate(rng.random((3000, 2)) * 800):
        q = h @ (x, y, 1)
        u, v = q[:2] / q[2]
        if i % 3 == 0:
            u, v = rng.random(2) * 800
        rows.append(("a", 0, 1, i, float(x), float(y), float(u), float(v)))
    m = spark.createDataFrame(rows, "aoi string, src_frame int, dst_frame int, match_id long, x double, y double, u double, v double")
    pairs = spark.createDataFrame([("a", 0, 1), ("a", 1, 2)], "aoi string, src_frame int, dst_frame int")
    got = {r.src_frame: r for r in sq.estimate_homographies(m, pairs).collect()}
    assert np.allclose(np.array(got[0].h).reshape(3, 3), h, atol=1e-4)
    assert 0.66 <= got[0].inlier_ratio < 0.69
    assert got[1].h == geo.IDENTITY3 and got[1].inlier_ratio == 0.0


def test_homography_draws_until_the_inliers_are_met(spark):
    """Pairs of 75 % outliers, and pairs of few matches."""
    rng = np.random.default_rng(11)
    h = np.array([[1.01, 0.02, 3], [-0.01, 0.99, -2], [1e-5, 2e-5, 1]])
    rows, pairs = [], [("a", k, k + 1) for k in range(12)]
    for k in range(12):
        n, good = (400, 100) if k < 8 else (8, 6) if k < 11 else (3, 3)
        inliers = set(rng.permutation(n)[:good].tolist())
        for i, (x, y) in enumerate(rng.random((n, 2)) * 800):
            u, v = (h @ (x, y, 1))[:2] / (h @ (x, y, 1))[2]
            if i not in inliers:
                u, v = rng.random(2) * 800
            rows.append(("a", k, k + 1, i, float(x), float(y), float(u), float(v)))
    m = spark.createDataFrame(rows, "aoi string, src_frame int, dst_frame int, match_id long, x double, y double, u double, v double")
    got = {r.src_frame: r for r in sq.estimate_homographies(m, spark.createDataFrame(pairs, "aoi string, src_frame int, dst_frame int")).collect()}
    for k in range(11):
        assert np.allclose(np.array(got[k].h).reshape(3, 3), h, atol=1e-3) and got[k].n_inliers >= (100 if k < 8 else 6)
    assert len(got) == 12 and got[11].h == geo.IDENTITY3 and got[11].n_matches == 3


def test_seeded_chain_gives_every_template_pair(spark, noise):
    n = 3
    frames = [("a", 2 * f + 1) for f in range(2 * n + 2)] + [("b", f) for f in range(n + 1)] + [("c", f) for f in range(n)]
    frames = spark.createDataFrame(frames, "aoi string, frame int")
    plan = sq.registration_plan(frames, n, "seeded")
    assert {(r.aoi, r.src_frame, r.dst_frame) for r in plan.where("aoi = 'b'").collect()} == {("b", k, n) for k in range(n)}
    shift = lambda a, b: [1.0, 0.0, float(b * b - a * a), 0.0, 1.0, float(b - a), 0.0, 0.0, 1.0]
    made = spark.createDataFrame([(*r, shift(r[1], r[2])) for r in plan.collect()], "aoi string, src_frame int, dst_frame int, h array<double>")
    got = {(r.aoi, r.src_frame, r.dst_frame): r.h for r in sq.compose_seeded(frames, made, n).collect()}
    want = {tuple(r) for r in sq.registration_plan(frames, n, "direct").collect()}
    assert set(got) == want and all(got[k] == shift(k[1], k[2]) for k in want)
    assert sq.compose_seeded(frames, made, n).count() == len(want)
    scan = {(r.aoi, r.src_frame, r.dst_frame): r.h for r in sq.compose_scan(frames, made, n).collect()}
    assert set(scan) == want and all(np.allclose(scan[k], shift(k[1], k[2])) for k in want)

    t = images.to_tiles(_frames(spark, noise[:n + 1]), 16)  # one frame is processed
    own = t.select("aoi", "frame").distinct()
    one, every = (sq.registration_plan(own, n, m).withColumn("h", F.array(*[F.lit(v) for v in (1.0, 0.0, 2.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0)])) for m in ("seeded", "direct"))
    s = detection.Settings(tile=16, templates=n, use_motion=False)
    rows = [sorted((r.frame, r.ty, r.tx, [bytes(x) for x in r.templates]) for r in detection.background_stage(t, h, s).collect())
            for h in (sq.compose_seeded(own, one, n), every)]
    assert rows[0] == rows[1] and {r[0] for r in rows[0]} == {n}


def test_prefix_products_cross_chunks_and_stop_at_missing_steps(spark):
    rng = np.random.default_rng(6)
    mats = {k: np.eye(3) + rng.normal(0, 0.05, (3, 3)) for k in range(1, 40) if k not in (7, 8, 21)}
    frames = spark.createDataFrame([("a", 3 * k) for k in range(40)], "aoi string, frame int")
    steps = spark.createDataFrame([("a", 3 * k - 3, 3 * k, m.ravel().tolist()) for k, m in mats.items()], "aoi string, src_frame int, dst_frame int, h array<double>")
    pairs = [(s, t) for t in range(40) for s in range(max(0, t - 8), t)]
    want = {}
    for s, t in pairs:
        if all(k in mats for k in range(s + 1, t + 1)):
            m = np.eye(3)
            for k in range(s + 1, t + 1):
                m = mats[k] @ m
            want[3 * s, 3 * t] = m
    asked = spark.createDataFrame([("a", 3 * s, 3 * t) for s, t in pairs], "aoi string, src_frame int, dst_frame int")
    for chunk in (8, 11, 64):
        got = {(r.src_frame, r.dst_frame): np.array(r.h).reshape(3, 3) for r in sq.between(sq.prefix_products(frames, steps, chunk), asked).collect()}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_moving_square_is_found(spark):
    """A bright square on a textured background: one region at its place."""
    rng = np.random.default_rng(7)
    ground = rng.integers(60, 90, (60, 60))
    frames = []
    for i in range(5):
        a = ground.copy()
        a[20:26, 5 + 9 * i:11 + 9 * i] = 220
        frames.append(a)
    t = images.to_tiles(_frames(spark, frames), 20)
    temps = bg.identity_templates(t, sq.template_pairs(t.select("aoi", "frame").distinct(), 3))
    d = bg.subtract(bg.stack(t, temps, 20, bg.HALO), 20, 60, keep=())
    found = {r.frame: (r.r0, r.c0, r.area) for r in components.regions(d, 4).collect()}
    assert found == {3: (21, 33, 36), 4: (21, 42, 36)}


def test_pair_without_homography_keeps_its_template(spark, noise):
    t = images.to_tiles(_frames(spark, noise), 16)
    pairs = sq.template_pairs(t.select("aoi", "frame").distinct(), 3)
    eye = pairs.select(*sq.PAIR, F.array(*[F.lit(v) for v in geo.IDENTITY3]).alias("h"))
    s = detection.Settings(tile=16, templates=3, use_motion=False)
    whole, some = (sorted((r.frame, r.ty, r.tx, [bytes(x) for x in r.templates])
                          for r in detection.background_stage(t, h, s).collect())
                   for h in (eye, eye.where("src_frame <> 1")))
    assert whole == some and all(len(r[3]) == 3 for r in some) and some


def test_brightness_query_returns_every_template(spark):
    from skyquilt.workload import catalog

    got = catalog.QUERIES["i6_brightness_compensation"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["aoi", "frame", "slot", "r", "c", "v"]
    per_frame = {tuple(r) for r in got.groupBy("aoi", "frame").agg(F.sort_array(F.collect_set("slot")).alias("s"), F.count(F.lit(1)).alias("n")).select(F.array_join("s", ","), "n").collect()}
    assert per_frame == {("0,1,2", 3 * 48 * 48)}


def test_block_motion_equals_a_direct_search(spark, noise):
    size, reach, block = (37, 41), 2, 8
    t = images.to_tiles(_frames(spark, noise[:2]), 16)
    got = {(r.r, r.c): (r.u, r.v, r.sad) for r in motion.block_motion(t, 16, block, reach).where("frame = 1").collect()}
    steps = sorted(((a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)), key=lambda d: (d[0] ** 2 + d[1] ** 2, d))
    want = {}
    for r in range(0, size[0], block):
        for c in range(0, size[1], block):
            r1, c1 = min(r + block, size[0]), min(c + block, size[1])
            tried = [(int(np.abs(noise[1][r:r1, c:c1] - noise[0][r - u:r1 - u, c - v:c1 - v]).sum()), k, u, v)
                     for k, (u, v) in enumerate(steps) if r >= u and c >= v and r1 - u <= size[0] and c1 - v <= size[1]]
            sad, _, u, v = min(tried)
            want[r, c] = (u, v, sad)
    assert got == want


def test_patch_on_row_zero_is_refused(spark):
    d = spark.createDataFrame([(10, 30), (11, 30), (30, 10)], "r int, c int").withColumn("height", F.lit(60)).withColumn("width", F.lit(60))
    assert [r.r for r in d.where(refine.screen_fits()).collect()] == [11]


def test_road_distance_matches_the_plane(spark):
    seg = spark.createDataFrame([(1, "trunk", 0.0, 0.0, 0.01, 0.005), (2, "path", 0.0, 0.0, 1.0, 0.0)],
                                "way_id long, highway string, lon1 double, lat1 double, lon2 double, lat2 double")
    pts = spark.createDataFrame([(1, 0.005, 0.0025), (2, 0.005, 0.00262), (3, -0.00005, 0.0), (4, 0.02, 0.0)], "id int, lon double, lat double")
    got = {r.id: r.dist_m for r in roads.road_pairs(pts, roads.buffered_roads(seg)).collect()}
    assert set(got) == {1, 2, 3} and got[1] < 1e-6 and abs(got[3] - 5.56) < 0.01


# ------------------------------------------------------------------ sources

def test_norm_mean_needs_a_known_key(spark):
    ok = spark.createDataFrame([([1.0],)], "mu array<double>")
    assert tables.norm_mean(ok).first().norm == [1.0]
    bad = spark.createDataFrame([(None,)], "mean array<double>")
    with pytest.raises(Exception, match="mean_img"):
        tables.norm_mean(bad).collect()


def test_malformed_truth_fails(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,frame_number,x,y,latitude,longitude\n1,2,a,4,5,6\n")
    with pytest.raises(Exception):
        tables.read_truth_csv(spark, str(tmp_path)).collect()


def test_empty_detection_file_counts_nothing(spark, tmp_path):
    (tmp_path / "frame000003.csv").write_text("")
    (tmp_path / "frame000004.csv").write_text("1.0,2.0\n3.5,4.0\n")
    got = {r.frame: r.n_det for r in tables.detections_per_frame(spark, str(tmp_path), 3, 5).collect()}
    assert got == {3: 0, 4: 2, 5: 0}


def test_grey_png_is_decoded(spark, tmp_path):
    import struct
    import zlib

    a = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    raw = b"".join(b"\x00" + r.tobytes() for r in a)

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "frame000007.png").write_bytes(png)
    (tmp_path / "frame000008.png").write_bytes(b"not an image")
    rows = images.read_grey_frames(spark, str(tmp_path)).collect()
    assert [(r.frame, r.height, r.width) for r in rows] == [(7, 3, 4)]
    assert bytes(rows[0].px) == a.tobytes()


def test_missing_template_raises(spark, noise):
    f = _frames(spark, noise).where("frame <> 1")
    pairs = spark.createDataFrame([("a", 1, 2)], "aoi string, src_frame int, dst_frame int")
    with pytest.raises(Exception, match="not readable"):
        images.require_templates(pairs, f).collect()


def test_tile_schema_has_the_declared_columns():
    assert tl.COLS == ["aoi", "frame", "ty", "tx", "r0", "c0", "h", "w", "height", "width", "px"]
    assert schemas.TILE.startswith("aoi STRING")


def test_positions_and_sums_keep_rows_without_key_or_order(spark):
    from skyquilt.operators import ordering

    df = spark.createDataFrame([("a", 1), ("a", None), (None, 2), (None, None), ("b", 3)], "k string, v int").withColumn("one", F.lit(1))
    chunk = F.floor(F.col("v") / 2)
    got = {(r.k, r.v): r.pos for r in ordering.position(df, ["k"], ["v"], chunk).collect()}
    assert got == {("a", None): 0, ("a", 1): 1, (None, None): 0, (None, 2): 1, ("b", 3): 0}
    sums = {(r.k, r.v): r.n for r in ordering.running_sum(df, ["k"], ["v"], chunk, {"n": "one"}).collect()}
    assert sums == {k: p + 1 for k, p in got.items()}


def test_quantiles_leave_nulls_out(spark):
    from skyquilt.operators import evaluate

    rows = [("a", x / 10) for x in range(1, 6)] + [("a", None)] * 5 + [(None, 1.0), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.p50 for r in evaluate.quantiles(df, ["k"], "v", (50,), F.floor(F.col("v") * 4)).collect()}
    assert got == {"a": 0.3, None: 1.0}

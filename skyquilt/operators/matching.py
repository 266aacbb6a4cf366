"""Detection-to-truth matching, point merging and the metric roll-ups."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.fixed import EARTH_RADIUS_M
from skyquilt.functions.geo import haversine_m, sphere_xyz
from skyquilt.operators.graph import components
from skyquilt.operators.spatial import radius_cells, radius_pairs


# ------------------------------------------------------------ nearest match

#: Truth positions of a cell that one row holds.
BLOCK = 256


def nearest_truth(
    dets: DataFrame, truth: DataFrame, radius: float, keys: Sequence[str] = ("frame",)
) -> DataFrame:
    """Nearest truth point within ``radius`` of every distinct detection position.

    Returns ``keys, x, y, n`` (copies of that position) and ``best`` =
    struct(dist, gt), null when none is near. Copies are collapsed on both
    sides before the join. A cell's truth lies in blocks, and a position meets
    each block as one row, so pairs are looked at but never made or sorted; the
    minimum over blocks is taken where the join left the rows, without another
    shuffle.
    """
    d = dets.select(*keys, F.col("x").cast("float").cast("double").alias("x"),
                    F.col("y").cast("float").cast("double").alias("y"))
    d = d.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    t = truth.select(*keys, F.col("x").alias("gx"), F.col("y").alias("gy"), "gt")
    t = t.groupBy(*keys, "gx", "gy").agg(F.min("gt").alias("gt"))
    d, t, cells = radius_cells(d, t, [F.col("x"), F.col("y")], [F.col("gx"), F.col("gy")], radius)
    place = [*keys, *cells]
    nth = F.row_number().over(Window.partitionBy(*place).orderBy("gx", "gy"))
    t = t.withColumn("_block", F.floor((nth - 1) / BLOCK)).groupBy(*place, "_block").agg(
        F.collect_list(F.struct("gx", "gy", "gt")).alias("_near")
    )

    def reach(g):
        dx, dy = F.col("x") - g["gx"], F.col("y") - g["gy"]
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("dist"), g["gt"].alias("gt"))

    best = F.array_min(F.filter(F.transform("_near", reach), lambda b: b["dist"] <= radius))
    near = d.join(t, place, "left").select(*place, "x", "y", "n", best.alias("best"))
    return near.groupBy(*place, "x", "y", "n").agg(F.min("best").alias("best")).drop(*cells)


def nn_match(
    dets: DataFrame, truth: DataFrame, radius: float = 10.0, keys: Sequence[str] = ("frame",)
) -> DataFrame:
    """Per key: n_det, hits (detections with a near truth), tp (distinct truth hit)."""
    near = nearest_truth(dets, truth, radius, keys)
    per_truth = near.groupBy(*keys, F.col("best.gt").alias("gt")).agg(F.sum("n").alias("n"))
    return per_truth.groupBy(*keys).agg(
        F.sum("n").alias("n_det"),
        F.coalesce(F.sum(F.when(F.col("gt").isNotNull(), F.col("n"))), F.lit(0)).alias("hits"),
        F.count("gt").alias("tp"),
    )


# ------------------------------------------------------------- greedy match

def _in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Groups one after another, rows of a group in ``order``."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _runs(pdf: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows of equal keys."""
    k = pdf[list(keys)]
    cut = np.flatnonzero((k.ne(k.shift())).any(axis=1).to_numpy())
    for a, b in zip(cut, [*cut[1:], len(pdf)]):
        yield tuple(k.iloc[a]), pdf.iloc[a:b]


def _claims(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``edges`` with ``part``: pairs of two parts share no detection and no truth, so neither can take from the other.

    Nodes are 64-bit hashes; two that agree by chance only make two parts one.
    """
    named = edges.withColumns({"_d": F.xxhash64(*keys, F.lit("det"), "det"), "_g": F.xxhash64(*keys, F.lit("gt"), "gt")})
    parts = components(named.select(F.col("_d").alias("a"), F.col("_g").alias("b")))
    return named.join(parts.select(F.col("node").alias("_d"), F.col("root").alias("part")), "_d").drop("_d", "_g")


def greedy_pairs(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detections in ``det`` order take their nearest open truth.

    ``edges`` holds ``keys, det, gt, dist`` for pairs within reach. The unit of
    work is a connected part of the graph of these pairs: one ordered pass over it,
    with the part's taken truth in memory.
    """
    keys = list(keys)
    unit = [*keys, "part"]
    edges = _claims(session.cut(edges, "edges"), keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used, done = None, set(), None
        for pdf in batches:
            took = []
            change = pdf[unit].ne(pdf[unit].shift()).any(axis=1).to_numpy()
            for i, (new, det, gt) in enumerate(zip(change.tolist(), pdf["det"].tolist(), pdf["gt"].tolist())):
                if new:
                    key = tuple(pdf[unit].iloc[i])
                    if key != group:
                        group, used, done = key, set(), None
                if det != done and gt not in used:
                    used.add(gt)
                    done = det
                    took.append(i)
            yield pdf.iloc[took]

    return _in_order(edges, unit, ["det", "dist", "gt"]).mapInPandas(run, edges.schema).drop("part")


def geo_edges(
    dets: DataFrame, truth: DataFrame, radius_m: float, keys: Sequence[str] = ("aoi", "frame")
) -> DataFrame:
    """Pairs within ``radius_m`` on the sphere.

    ``dets``: keys, det, lon, lat. ``truth``: keys, gt, lon, lat.
    """
    t = truth.select(*keys, "gt", F.col("lon").alias("glon"), F.col("lat").alias("glat"))
    d = dets.select(*keys, "det", "lon", "lat")
    near, _ = radius_pairs(
        d, t, keys, sphere_xyz("lat", "lon"), sphere_xyz("glat", "glon"), radius_m
    )
    near = near.withColumn("dist", haversine_m("lat", "lon", "glat", "glon"))
    return near.where(F.col("dist") <= radius_m).select(*keys, "det", "gt", "dist")


def _reach(dets: DataFrame, truth: DataFrame, keys: Sequence[str], side: float) -> tuple[DataFrame, DataFrame]:
    """Detections and truth that may have a partner, with ``part``.

    Points lie in cells of ``side``. Cells of detections are linked with the cells of
    truth around them, and the cells of one number with each other; parts are the
    components of these links. So two parts share no partner and no number, and no
    pair of points is made. Cells are 64-bit hashes; two that agree by chance only
    make two parts one.
    """
    at = ["_x", "_y", "_z"]

    def celled(df):
        ok = F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")
        d = df.where(ok).withColumns({c: F.col(c).cast("double") for c in ("lon", "lat")})
        d = d.withColumns({a: F.floor(v / F.lit(side)).cast("long") for a, v in zip(at, sphere_xyz("lat", "lon"))})
        for k in keys:
            d = d.where(F.col(k).isNotNull())
        return d.withColumn("_cell", F.xxhash64(*keys, *at))

    d, t = celled(dets), celled(truth)
    around = F.explode(F.array(*[F.lit(v).cast("long") for v in (-1, 0, 1)]))
    near = d.select(*keys, *at, F.col("_cell").alias("a")).distinct()
    for a in at:
        near = near.withColumn("_s", around).withColumn(a, F.col(a) + F.col("_s")).drop("_s")
    links = near.join(t.select(*keys, *at, F.col("_cell").alias("b")).distinct(), [*keys, *at]).select("a", "b")
    for df, name in ((d, "det"), (t, "gt")):
        same = df.groupBy(*keys, name).agg(F.collect_set("_cell").alias("c")).where(F.size("c") > 1)
        links = links.unionByName(same.select(F.col("c")[0].alias("a"), F.explode("c").alias("b")))
    parts = components(links).select(F.col("node").alias("_cell"), F.col("root").alias("part"))
    return tuple(df.join(parts, "_cell").drop("_cell", *at) for df in (d, t))


class _OpenTruth:
    """Truth of one part that is not taken yet, found by cells of the reach.

    A detection looks at the cells around it; chords find the nearest truth, and
    what lies within ``NEAR`` of that, or of the radius, is compared by its arc.
    """

    NEAR = 1e-5

    def __init__(self, rows: list[tuple], radius: float):
        self.rows, self.radius, self.side = rows, radius, radius * (1 + 1e-6) + 1e-3
        self.at = _xyz(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        self.open = np.ones(len(rows), bool)
        self.of: dict = {}
        cells: dict[tuple, list[int]] = {}
        for i, c in enumerate(map(tuple, np.floor(self.at / self.side).astype(np.int64).tolist())):
            cells.setdefault(c, []).append(i)
        for i, r in enumerate(rows):
            self.of.setdefault(r[0], []).append(i)
        self.cells = {c: np.array(v) for c, v in cells.items()}
        self.near: dict[tuple, np.ndarray] = {}

    def _around(self, cell: tuple) -> np.ndarray:
        got = self.near.get(cell)
        if got is None:
            x, y, z = cell
            got = [self.cells[c] for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (c := (x + i, y + j, z + k)) in self.cells]
            got = np.concatenate(got) if got else np.empty(0, np.int64)
        got = self.near[cell] = got[self.open[got]]
        return got

    def take(self, places: list[tuple]) -> tuple | None:
        """(distance, number, place, truth row) of the nearest open truth of a detection's places."""
        best = None
        for lon, lat, at in places:
            got = self._around(tuple(np.floor(at / self.side).astype(np.int64).tolist()))
            if not len(got):
                continue
            chord = np.sqrt(((self.at[got] - at) ** 2).sum(axis=1))
            for i in got[chord <= min(chord.min(), self.radius) + self.NEAR].tolist():
                gt, glon, glat = self.rows[i]
                dist = _arc_m(lat, lon, glat, glon)
                if dist <= self.radius and (best is None or (dist, gt) < best[:2]):
                    best = dist, gt, (lon, lat), (glon, glat)
        if best:
            self.open[self.of[best[1]]] = False
        return best


def _xyz(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lam, phi = np.radians(lon), np.radians(lat)
    return EARTH_RADIUS_M * np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)], axis=1)


def _arc_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """``haversine_m`` of two points."""
    s1, s2 = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    a = s1 * s1 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * s2 * s2
    return 2 * EARTH_RADIUS_M * math.atan2(math.sqrt(a), math.sqrt(1 - a))


#: Matches that leave a task together.
MATCHES = 10_000


def greedy_geo_match(
    dets: DataFrame,
    truth: DataFrame,
    radius_m: float = 5.0,
    keys: Sequence[str] = ("aoi", "frame"),
) -> DataFrame:
    """Order-dependent one-to-one match within ``radius_m``: keys, det, gt, dist.

    The same as ``greedy_pairs`` of ``geo_edges``, but the pairs are never made:
    their number grows with the square of a crowded place. The unit of work is a part
    that no pair leaves; its truth is held in a grid, and its detections pass in order.
    """
    keys = list(keys)
    unit = [*keys, "part"]
    d, t = _reach(dets.select(*keys, "det", "lon", "lat"), truth.select(*keys, "gt", "lon", "lat"), keys, 2 * (radius_m * (1 + 1e-6) + 1e-3))
    kinds = dict(d.dtypes)["det"], dict(t.dtypes)["gt"]
    rows = t.select(*unit, F.lit(0).alias("_k"), F.lit(None).cast(kinds[0]).alias("det"), "gt", "lon", "lat").unionByName(
        d.select(*unit, F.lit(1).alias("_k"), "det", F.lit(None).cast(kinds[1]).alias("gt"), "lon", "lat"))
    fields = ", ".join(f"`{k}` {kind}" for k, kind in d.select(*keys).dtypes)
    names = [*keys, "det", "gt", "lon", "lat", "glon", "glat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        group, held, free, det, places, out = None, [], None, None, [], []

        def settle():
            if places:
                got = free.take(places)
                if got:
                    out.append((*group[:-1], det, got[1], *got[2], *got[3]))

        for batch in batches:
            if types is None:
                types = [batch.schema.field(n).type for n in names[:len(keys) + 2]] + [pa.float64()] * 4
            lon, lat = (batch.column(n).to_numpy() for n in ("lon", "lat"))
            xyz = _xyz(lon, lat)
            cols = [batch.column(n).to_pylist() for n in (*unit, "_k", "det", "gt")]
            for i, (*key, kind, a, gt) in enumerate(zip(*cols)):
                if key != group:
                    settle()
                    group, held, free, det, places = key, [], None, None, []
                if kind == 0:
                    held.append((gt, float(lon[i]), float(lat[i])))
                    continue
                if free is None:
                    free = _OpenTruth(held, radius_m) if held else False
                if free is False:
                    continue
                if places and a != det:
                    settle()
                    places = []
                det = a
                places.append((float(lon[i]), float(lat[i]), xyz[i]))
                if len(out) >= MATCHES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names)
                    out.clear()
        settle()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names)

    found = _in_order(rows, unit, ["_k", "det", "gt"]).mapInArrow(
        run, f"{fields}, det {kinds[0]}, gt {kinds[1]}, lon double, lat double, glon double, glat double")
    return found.select(*keys, "det", "gt", haversine_m("lat", "lon", "glat", "glon").alias("dist"))


# ------------------------------------------------------------- point merge

def _cut(cells: DataFrame, block: Sequence[str], axis: str, d: float) -> DataFrame:
    """``block`` numbered anew, so that an empty gap >= d along an axis parts it."""
    bin_, w = f"_b{axis}", Window.partitionBy(*block).orderBy(f"_b{axis}")
    bins = cells.groupBy(*block, bin_).agg(F.min(f"_lo{axis}").alias("_lo"), F.max(f"_hi{axis}").alias("_hi"))
    new = F.coalesce(F.col("_lo") - F.lag("_hi").over(w) > d * (1 + 1e-9), F.lit(True))
    bins = bins.withColumn("_new", new.cast("int")).withColumn("_n", F.sum("_new").over(w)).select(*block, bin_, "_n")
    return cells.join(bins, [*block, bin_]).withColumn("_part", F.xxhash64("_part", "_n", F.lit(axis))).drop("_n")


def _blocks(points: DataFrame, keys: Sequence[str], d: float) -> DataFrame:
    """``points`` with ``_part``: points of different parts can never share a cluster.

    A cluster mean stays inside the span of its own points, so points on two
    sides of an empty gap >= d never meet. Occupied cells of width d, which the
    frame's size bounds, are cut along both axes in turn until nothing changes.
    Parts are 64-bit hashes; two that agree by chance are one part.
    """
    cell = {f"_b{a}": F.floor(F.col(a) / F.lit(float(d))).cast("long") for a in ("x", "y")}
    p = points.withColumns(cell)
    cells = p.groupBy(*keys, "_bx", "_by").agg(*[f(a).alias(f"_{n}{a}") for a in ("x", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    cells = cells.withColumn("_part", F.lit(0).cast("long"))
    block, before = [*keys, "_part"], 0
    while True:
        cells = session.cut(_cut(_cut(cells, block, "x", d), block, "y", d), "cells")
        parts = cells.select(*block).distinct().count()
        if parts == before:
            return p.join(cells.select(*keys, "_bx", "_by", "_part"), [*keys, "_bx", "_by"]).drop("_bx", "_by")
        before = parts


class _Clusters:
    """Running sums of one block's clusters, found by the cell of their mean.

    A cell is as wide as the distance, so the clusters within reach of a point lie
    in the nine cells around it; a cluster changes its cell when its mean does.
    """

    def __init__(self, distance: float):
        self.distance, self.sums, self.first, self.last = distance, [], [], None
        self.cells: dict[tuple[int, int], list[int]] = {}

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return math.floor(x / self.distance), math.floor(y / self.distance)

    def add(self, x: float, y: float, seq: int) -> None:
        if self.last is not None and seq < self.last:
            raise RuntimeError("points arrived out of order")
        self.last = seq
        r, c = self._cell(x, y)
        best = (self.distance, -1)
        for i in (r - 1, r, r + 1):
            for j in (c - 1, c, c + 1):
                for k in self.cells.get((i, j), ()):
                    a, b, n = self.sums[k]
                    gap = float(np.hypot(x - a / n, y - b / n))
                    if gap < self.distance and (best[1] < 0 or (gap, k) < best):
                        best = gap, k
        k = best[1]
        if k < 0:
            self.cells.setdefault((r, c), []).append(len(self.sums))
            self.sums.append((x, y, 1.0))
            self.first.append(seq)
            return
        a, b, n = self.sums[k]
        old, new = self._cell(a / n, b / n), self._cell((a + x) / (n + 1), (b + y) / (n + 1))
        self.sums[k] = a + x, b + y, n + 1
        if old != new:
            self.cells[old].remove(k)
            self.cells.setdefault(new, []).append(k)

    def rows(self, key: tuple) -> list[tuple]:
        return [(*key, s, a / n, b / n, int(n)) for s, (a, b, n) in zip(self.first, self.sums)]


def _merge_pass(distance: float, keys: Sequence[str]):
    """One ordered pass over blocks; only the clusters of one are in memory."""
    names = [*keys, "seq", "x", "y", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, clusters = None, None
        for pdf in batches:
            out = []
            for key, part in _runs(pdf, keys):
                if key != block:
                    if clusters:
                        out += clusters.rows(block)
                    block, clusters = key, _Clusters(distance)
                for x, y, seq in zip(part.x.tolist(), part.y.tolist(), part.seq.tolist()):
                    clusters.add(x, y, seq)
            yield pd.DataFrame(out, columns=names)
        if clusters:
            yield pd.DataFrame(clusters.rows(block), columns=names)

    return run


def merge_close_points(points: DataFrame, distance: float, keys: Sequence[str] = ("aoi", "frame")) -> DataFrame:
    """Leader clustering in ``seq`` order by running mean; returns cluster means.

    Each step depends on the means before it, so points that may interact have
    to be visited in order. Each key group is first cut at empty gaps along both
    axes into blocks that cannot interact, which spreads a large frame over many
    tasks; a block is then streamed in order, and a point meets only the clusters
    around it. Points without a coordinate are left out.
    """
    keys = list(keys)
    p = points.select(*keys, F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"),
                      F.col("y").cast("double").alias("y")).filter("x is not null and y is not null")
    block = [*keys, "_part"]
    p = _blocks(p, keys, distance).select(*block, "seq", "x", "y")
    fields = ", ".join(f"{k} {t}" for k, t in p.select(*block).dtypes)
    out = _in_order(p, block, ["seq"]).mapInPandas(
        _merge_pass(distance, block), f"{fields}, seq long, x double, y double, n long"
    )
    return out.drop("_part")


# ----------------------------------------------------------------- metrics

def spine(spark, first: int, last: int, name: str = "frame") -> DataFrame:
    """Every frame of an inclusive range."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def counts_on_spine(base: DataFrame, keys: Sequence[str], *parts: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Left join count tables onto a spine; what is missing counts 0."""
    out, names = base, []
    for df, cols in parts:
        out = out.join(df.select(*keys, *cols), list(keys), "left")
        names += cols
    return out.fillna(0, names)


def frame_counts(counts: DataFrame) -> DataFrame:
    """tp, n_det, n_gt -> fp, fn. Empty sides fall out of the arithmetic."""
    return counts.withColumn("fp", F.col("n_det") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def with_scores(sums: DataFrame) -> DataFrame:
    """precision, recall and F1 of summed counts; 0.0 where a denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    d = sums.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return d.withColumn("f1", _ratio(2 * p * r, p + r))


def micro_scores(per_frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    names = ["tp", "fp", "fn", "n_gt", "n_det"]
    return with_scores(per_frame.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names]))


def report(per_frame: DataFrame) -> DataFrame:
    """One row per AOI and one ``overall`` row from the summed counts."""
    names = ["tp", "fp", "fn", "n_gt", "n_det"]
    per_aoi = per_frame.groupBy("aoi").agg(*[F.sum(n).alias(n) for n in names])
    rolled = per_aoi.rollup("aoi").agg(F.grouping("aoi").alias("_g"), *[F.sum(n).alias(n) for n in names])
    rolled = rolled.withColumn("aoi", F.when(F.col("_g") == 1, "overall").otherwise(F.col("aoi"))).drop("_g")
    return with_scores(rolled)

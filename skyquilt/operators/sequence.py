"""Frame sequences, templates, homographies and descriptor matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquilt import session
from skyquilt.functions.batches import map_slices
from skyquilt.functions.geo import IDENTITY3, bound, inverse3, matmul3, project
from skyquilt.operators import ordering

FRAME_CHUNK = 4096


def frame_positions(frames: DataFrame, keys=("aoi",)) -> DataFrame:
    """Position of each frame in its sequence; only keys are shuffled."""
    return ordering.position(
        frames.select(*keys, "frame"), list(keys), ["frame"], ordering.by_width("frame", FRAME_CHUNK)
    )


def template_pairs(frames: DataFrame, n: int, double_shift: bool = False) -> DataFrame:
    """(aoi, dst_frame, slot, src_frame): the ``n`` list predecessors of each frame.

    Slot 0 is the oldest. Frames with fewer than ``n`` predecessors get none.
    ``double_shift`` gives the list that results when each processed frame is
    appended twice.
    """
    p = frame_positions(frames)
    dst = p.where(F.col("pos") >= n).select("aoi", F.col("frame").alias("dst_frame"), "pos")
    dst = dst.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if double_shift:
        at = 2 * (F.col("pos") - n) + F.col("slot")
        src = F.when(at < n, at).otherwise(F.floor((at - n) / 2) + n)
    else:
        src = F.col("pos") - n + F.col("slot")
    dst = dst.withColumn("pos", src.cast("long"))
    return dst.join(p.withColumnRenamed("frame", "src_frame"), ["aoi", "pos"]).select(
        "aoi", "dst_frame", "slot", "src_frame"
    )


def previous_frame(frames: DataFrame, value: Column, keys=("aoi",), out: str = "prev") -> DataFrame:
    """Attach the previous frame of the sequence (null for the first)."""
    return ordering.neighbours(frames, list(keys), ["frame"], ordering.by_width("frame", 64), value, prev=out)


def adjacent_frame(frames: DataFrame, value: Column, keys=("aoi",), out: str = "prev") -> DataFrame:
    """Attach the row of frame - 1 where it exists (number, not list order)."""
    before = frames.select(*keys, (F.col("frame") + 1).alias("frame"), value.alias(out))
    return frames.join(before, [*keys, "frame"])


# ------------------------------------------------------------- homographies

def compose_chain(steps: DataFrame, n: int, full_only: bool = True) -> DataFrame:
    """H(t-k -> t) for k = 1..n from one-step matrices ``(aoi, src_frame, dst_frame, h)``.

    ``steps`` must be consecutive in list order. Only positions travel in the
    window; the fold multiplies newest first. Frames with fewer than ``n`` steps
    get none, or with ``full_only`` off those that their steps allow.
    """
    p = ordering.position(steps, ["aoi"], ["dst_frame"], ordering.by_width("dst_frame", FRAME_CHUNK))
    w = ordering.sliding(
        p, ["aoi"], "pos", n, F.struct("src_frame", "h"), "chain", include_current=True, full_only=full_only
    )
    def product(k: Column) -> Column:
        return F.aggregate(
            F.slice(F.reverse("chain"), 1, k), F.array(*[F.lit(v) for v in IDENTITY3]),
            lambda acc, s: matmul3(acc, s["h"]),
        )

    d = w.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("chain"))))
    return d.select(
        "aoi", F.element_at("chain", -F.col("k"))["src_frame"].alias("src_frame"),
        "dst_frame", product(F.col("k")).alias("h"),
    )


def prefix_products(frames: DataFrame, steps: DataFrame, chunk: int) -> DataFrame:
    """One matrix per frame: the product of the steps of its chunk up to it.

    Returns aoi, frame, pos, chunk, run, h. ``steps`` (aoi, src_frame, dst_frame, h)
    join list neighbours. A chunk is ``chunk`` frames; a frame without a step from
    its predecessor begins the next run of the chunk with the identity (run 0 are
    the frames that are linked to the chunk before).
    """
    p = frame_positions(frames)
    before = p.select("aoi", (F.col("pos") + 1).alias("pos"), F.col("frame").alias("src_frame"))
    linked = p.join(before, ["aoi", "pos"], "left").join(
        steps.select("aoi", "src_frame", F.col("dst_frame").alias("frame"), "h"), ["aoi", "src_frame", "frame"], "left")
    rows = linked.groupBy("aoi", ordering.by_width("pos", chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "frame", "h"))).alias("s"))
    eye = F.array(*[F.lit(v) for v in IDENTITY3])

    def onward(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.when(s["h"].isNull(), F.struct((last["run"] + 1).alias("run"), eye.alias("h"))).otherwise(
            F.struct(last["run"].alias("run"), matmul3(s["h"], last["h"]).alias("h")))
        return F.concat(acc, F.array(new))

    start = F.array(F.struct(F.lit(0).alias("run"), eye.alias("h")))
    made = rows.withColumn("p", F.slice(F.aggregate("s", start, onward), F.lit(2), F.size("s")))
    return made.select("aoi", "chunk", F.explode(F.arrays_zip("s", "p")).alias("e")).select(
        "aoi", F.col("e.s.frame").alias("frame"), F.col("e.s.pos").alias("pos"), "chunk", F.col("e.p.run").alias("run"), F.col("e.p.h").alias("h"))


def between(prefixes: DataFrame, pairs: DataFrame) -> DataFrame:
    """H(src -> dst) of ``pairs`` (aoi, src_frame, dst_frame) whose frames lie in one chunk or in two neighbouring ones.

    Two matrices and, across a border, the earlier chunk's last one give it;
    nothing is folded. Pairs that a missing step parts give no row.
    """
    side = lambda name: prefixes.select("aoi", *[F.col(c).alias(f"{name}_{c}") for c in ("frame", "pos", "chunk", "run", "h")])
    ends = prefixes.groupBy("aoi", F.col("chunk").alias("src_chunk")).agg(F.max_by(F.struct("run", "h"), "pos").alias("end"))
    d = pairs.select("aoi", "src_frame", "dst_frame").join(side("src"), ["aoi", "src_frame"]).join(side("dst"), ["aoi", "dst_frame"]).join(ends, ["aoi", "src_chunk"])
    back = inverse3(F.col("src_h"))
    same = (F.col("src_chunk") == F.col("dst_chunk")) & (F.col("src_run") == F.col("dst_run"))
    next_ = (F.col("src_chunk") + 1 == F.col("dst_chunk")) & (F.col("src_run") == F.col("end.run")) & (F.col("dst_run") == 0)
    h = F.when(same, bound(matmul3, F.col("dst_h"), back)).when(next_, bound(matmul3, F.col("dst_h"), bound(matmul3, F.col("end.h"), back)))
    return d.withColumn("h", h).where("h is not null and src_pos < dst_pos").select(*PAIR, "h")


def compose_scan(frames: DataFrame, homographies: DataFrame, n: int) -> DataFrame:
    """Matrices of all template pairs from those of the ``seeded`` plan, by prefix products.

    A template older than the first step is taken through the first processed
    frame, to which it was registered.
    """
    p = frame_positions(frames)
    src = p.select("aoi", F.col("frame").alias("src_frame"), F.col("pos").alias("src_pos"))
    dst = p.select("aoi", F.col("frame").alias("dst_frame"), F.col("pos").alias("dst_pos"))
    known = session.cut(homographies.select(*PAIR, "h").join(src, ["aoi", "src_frame"]).join(dst, ["aoi", "dst_frame"]).where(F.col("dst_pos") >= n), "registered")
    prefixes = session.cut(prefix_products(frames, known.where("dst_pos = src_pos + 1"), max(n, 32)), "prefixes")
    wanted = template_pairs(frames, n).join(src, ["aoi", "src_frame"])
    late = between(prefixes, wanted.where(F.col("src_pos") >= n - 1))
    seeds = known.where((F.col("dst_pos") == n) & (F.col("src_pos") < n - 1)).select(
        "aoi", F.col("src_frame").alias("seed"), F.col("dst_frame").alias("via"), F.col("h").alias("h0"))
    early = wanted.where(F.col("src_pos") < n - 1).select("aoi", F.col("src_frame").alias("seed"), "dst_frame").join(seeds, ["aoi", "seed"])
    first = early.where("dst_frame = via").select("aoi", F.col("seed").alias("src_frame"), "dst_frame", F.col("h0").alias("h"))
    legs = early.where("dst_frame <> via").select("aoi", F.col("via").alias("src_frame"), "dst_frame").distinct()
    onward = between(prefixes, legs).withColumnRenamed("src_frame", "via").join(early, ["aoi", "via", "dst_frame"])
    onward = onward.select("aoi", F.col("seed").alias("src_frame"), "dst_frame", bound(matmul3, F.col("h"), F.col("h0")).alias("h"))
    return late.unionByName(first).unionByName(onward)


def compose_seeded(frames: DataFrame, homographies: DataFrame, n: int) -> DataFrame:
    """Matrices of all template pairs from those of the ``seeded`` plan.

    Steps chain as in ``compose_chain``. A template older than the first step is
    taken through the first processed frame, to which it was registered.
    """
    p = frame_positions(frames)
    src = p.select("aoi", F.col("frame").alias("src_frame"), F.col("pos").alias("src_pos"))
    dst = p.select("aoi", F.col("frame").alias("dst_frame"), F.col("pos").alias("dst_pos"))
    known = homographies.select(*PAIR, "h").join(src, ["aoi", "src_frame"]).join(dst, ["aoi", "dst_frame"])
    known = session.cut(known.where(F.col("dst_pos") >= n), "registered")
    chained = compose_chain(known.where("dst_pos = src_pos + 1").select(*PAIR, "h"), n, full_only=False)
    seeds = known.where((F.col("dst_pos") == n) & (F.col("src_pos") < n - 1))
    via = seeds.select("aoi", F.col("src_frame").alias("seed"), "src_pos", F.col("dst_frame").alias("src_frame"), F.col("h").alias("h0"))
    onward = chained.join(via, ["aoi", "src_frame"]).join(dst, ["aoi", "dst_frame"]).where(F.col("dst_pos") - F.col("src_pos") <= n)
    onward = onward.select("aoi", F.col("seed").alias("src_frame"), "dst_frame", matmul3(F.col("h"), F.col("h0")).alias("h"))
    return chained.unionByName(seeds.select(*PAIR, "h")).unionByName(onward)


def registration_plan(frames: DataFrame, n: int, mode: str = "direct") -> DataFrame:
    """Frame pairs whose homography must be estimated.

    ``direct``: every template to the current frame. ``chained``: only the newest
    template; the others follow by ``compose_chain`` once ``n`` steps are there.
    ``seeded``: the chained pairs and every template of each sequence's first
    processed frame, from which ``compose_seeded`` gives all template pairs.
    """
    pairs = template_pairs(frames, n)
    if mode == "direct":
        return pairs.select("aoi", "src_frame", "dst_frame")
    if mode == "chained":
        return pairs.where(F.col("slot") == n - 1).select("aoi", "src_frame", "dst_frame")
    if mode == "seeded":
        first = frame_positions(frames).where(F.col("pos") == n).select("aoi", F.col("frame").alias("dst_frame"), F.lit(True).alias("first"))
        pairs = pairs.join(first, ["aoi", "dst_frame"], "left")
        return pairs.where((F.col("slot") == n - 1) | F.col("first")).select("aoi", "src_frame", "dst_frame")
    raise ValueError(f"unknown registration mode: {mode}")


def transform_points(points: DataFrame, homographies: DataFrame) -> DataFrame:
    """Points (aoi, src_frame, x, y) under every homography of their frame."""
    d = points.join(homographies, ["aoi", "src_frame"]).withColumn("p", project("h", "x", "y"))
    return d.withColumn("px", F.col("p.x")).withColumn("py", F.col("p.y")).drop("p", "h")


# -------------------------------------------------------- descriptor matches

def mutual_matches(keypoints: DataFrame, pairs: DataFrame, block: int = 512) -> DataFrame:
    """Cross-checked nearest descriptors per frame pair.

    The match is a nearest-neighbour search by Hamming distance; descriptors are
    arrays of 64-bit words. A frame's keypoints are spread over blocks of about
    ``block`` by a hash of ``kp_id``, so that one task of the search holds two
    blocks and emits one row per keypoint, never the pairs themselves. A
    block's descriptors travel as one binary value.
    """
    sizes = keypoints.groupBy("aoi", "frame").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    kp = keypoints.join(sizes, ["aoi", "frame"]).withColumn("blk", F.pmod(F.xxhash64("kp_id"), F.col("blocks")))
    words = F.transform("kps", lambda k: F.array_join(F.transform(k["desc"], lambda w: F.lpad(F.hex(w), 16, "0")), ""))
    packed = kp.groupBy("aoi", "frame", "blk").agg(
        F.sort_array(F.collect_list(F.struct("kp_id", "desc"))).alias("kps")
    ).withColumn("kps", F.struct(F.col("kps.kp_id").alias("ids"), F.unhex(F.array_join(words, "")).alias("bits")))
    src = packed.select("aoi", F.col("frame").alias("src_frame"), F.col("kps.ids").alias("s_ids"), F.col("kps.bits").alias("s"))
    dst = packed.select("aoi", F.col("frame").alias("dst_frame"), F.col("kps.ids").alias("d_ids"), F.col("kps.bits").alias("d"))
    both = pairs.select("aoi", "src_frame", "dst_frame").join(src, ["aoi", "src_frame"]).join(dst, ["aoi", "dst_frame"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ia, ib = np.asarray(row.s_ids, np.int64), np.asarray(row.d_ids, np.int64)
                a = np.frombuffer(row.s, np.uint64).reshape(len(ia), -1)
                b = np.frombuffer(row.d, np.uint64).reshape(len(ib), -1)
                dist = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
                fwd, bwd = dist.argmin(axis=1), dist.argmin(axis=0)
                yield pd.DataFrame({
                    "aoi": row.aoi, "src_frame": row.src_frame, "dst_frame": row.dst_frame,
                    "side": [0] * len(ia) + [1] * len(ib),
                    "kp": np.concatenate([ia, ib]),
                    "other": np.concatenate([ib[fwd], ia[bwd]]),
                    "dist": np.concatenate([dist.min(axis=1), dist.min(axis=0)]),
                })

    aoi = dict(pairs.dtypes)["aoi"]
    found = map_slices(
        both, search, f"aoi {aoi}, src_frame int, dst_frame int, side int, kp long, other long, dist long"
    )
    key = ["aoi", "src_frame", "dst_frame"]
    best = found.groupBy(*key, "side", "kp").agg(F.min(F.struct("dist", "other")).alias("b"))
    fwd = F.col("side") == 0
    found = best.select(
        *key, F.when(fwd, F.col("kp")).otherwise(F.col("b.other")).alias("src_kp"),
        F.when(fwd, F.col("b.other")).otherwise(F.col("kp")).alias("dst_kp"), F.col("b.dist").alias("dist"),
    )
    # a pair is mutual when both sides name it
    both = found.groupBy(*key, "src_kp", "dst_kp").agg(F.count(F.lit(1)).alias("_n"), F.min("dist").alias("dist"))
    return both.where("_n = 2").drop("_n")


def good_matches(matches: DataFrame, max_dist: int = 50) -> DataFrame:
    return matches.where(F.col("dist") <= max_dist)


def match_quality(matches: DataFrame, pairs: DataFrame, max_dist: int = 50, few: int = 1000) -> DataFrame:
    """Good matches per frame pair and what they allow.

    ``usable`` needs four matches (otherwise the identity is used, ratio 0);
    ``low_confidence`` flags at most ``few``.
    """
    key = ["aoi", "src_frame", "dst_frame"]
    n = good_matches(matches, max_dist).groupBy(*key).agg(F.count(F.lit(1)).alias("n_good"))
    d = pairs.select(*key).join(n, key, "left").fillna(0, ["n_good"])
    return d.withColumn("usable", F.col("n_good") >= 4).withColumn("low_confidence", F.col("n_good") <= few)


def ranked_matches(matches: DataFrame, top: int) -> DataFrame:
    """The ``top`` closest matches of every pair, ordered by distance then ids."""
    w = Window.partitionBy("aoi", "src_frame", "dst_frame").orderBy("dist", "src_kp", "dst_kp")
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# -------------------------------------------------------- robust estimation

def _normalise(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = p.mean(axis=0)
    s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(axis=1)).mean(), 1e-12)
    t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1.0]])
    return (p - c) * s, t


def solve_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Least-squares homography of >= 4 point pairs, scaled to h33 = 1."""
    (a, ta), (b, tb) = _normalise(src), _normalise(dst)
    x, y, u, v = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
    o, z = np.ones_like(x), np.zeros_like(x)
    m = np.concatenate([
        np.stack([x, y, o, z, z, z, -u * x, -u * y, -u], 1),
        np.stack([z, z, z, x, y, o, -v * x, -v * y, -v], 1),
    ])
    h = np.linalg.svd(m, full_matrices=True)[2][-1].reshape(3, 3)
    h = np.linalg.inv(tb) @ h @ ta
    if not np.isfinite(h).all() or abs(h[2, 2]) < 1e-12 or abs(np.linalg.det(h)) < 1e-12:
        return None
    return h / h[2, 2]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve4(pts: pd.Series) -> pd.Series:
    def one(p):
        a = np.array([[q["x"], q["y"], q["u"], q["v"]] for q in p], dtype=np.float64)
        h = solve_homography(a[:, :2], a[:, 2:])
        return None if h is None else h.ravel()

    return pts.map(one)


PAIR = ["aoi", "src_frame", "dst_frame"]
MATCHES_PER_BLOCK = 1024
#: Hypotheses drawn for a pair after each round, as long as its inliers ask for more.
ROUNDS = (64, 256, 640, 1280)
_MOMENTS = [(i, j) for i in range(9) for j in range(i, 9)]


def _points(block) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([m["match_id"] for m in block], dtype=np.int64)
    return ids, np.array([[m["x"], m["y"], m["u"], m["v"]] for m in block], dtype=np.float64)


def _errors(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Reprojection errors, (matrices, points)."""
    h = h.reshape(-1, 3, 3)
    q = np.einsum("kij,nj->kin", h, np.column_stack([p[:, :2], np.ones(len(p))]))
    with np.errstate(divide="ignore", invalid="ignore"):
        e = np.hypot(q[:, 0] / q[:, 2] - p[:, 2], q[:, 1] / q[:, 2] - p[:, 3])
    return np.where(np.isfinite(e), e, np.inf)


def _scramble(ids: np.ndarray, low: int, high: int, seed: int) -> np.ndarray:
    """Seeded order of matches per hypothesis from ``low`` on, (high - low, ids)."""
    k = np.arange(low, high, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    z = ids.astype(np.uint64)[None, :] * np.uint64(2654435761) ^ k
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((z ^ (z >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def _per_block(df: DataFrame, fn, fields: str) -> DataFrame:
    """Run ``fn(row) -> list of tuples`` on rows that hold one block of matches."""
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in PAIR) + ", " + fields
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*(getattr(t, k) for k in PAIR), *r) for t in pdf.itertuples(index=False) for r in fn(t)]
            yield pd.DataFrame(rows, columns=names)

    return map_slices(df, run, schema)


def estimate_homographies(
    matches: DataFrame, pairs: DataFrame, hypotheses: int = 2000, threshold: float = 3.0, seed: int = 7, confidence: float = 0.995
) -> DataFrame:
    """Seeded sample-consensus homography per frame pair.

    ``matches``: aoi, src_frame, dst_frame, match_id, x, y (source), u, v (target);
    ``match_id`` counts the matches of a pair. Each hypothesis takes the four
    matches of smallest scrambled id; its matrix is scored against all matches,
    and the winner is refitted on its inliers. A pair draws in rounds until, at
    the winner's share of inliers, a sample without outliers has been among them
    with ``confidence``, or until it has had ``hypotheses``. Pairs with fewer than four
    matches get the identity with ratio 0.

    A pair's matches live in blocks of bounded size. Every step returns a few
    rows per block (best four, votes, sums of products) that are then added up,
    so a pair with any number of matches is spread over tasks.
    """
    blocks = session.cut(
        matches.groupBy(*PAIR, F.floor(F.col("match_id") / MATCHES_PER_BLOCK).alias("block")).agg(
            F.collect_list(F.struct("match_id", "x", "y", "u", "v")).alias("m"),
            F.count(F.lit(1)).alias("n"),
            *[F.sum(c).alias(f"s{c}") for c in "xyuv"],
        ),
        "matches",
    )
    totals = blocks.groupBy(*PAIR).agg(
        F.sum("n").alias("n_matches"), F.array(*[F.sum(f"s{c}") / F.sum("n") for c in "xyuv"]).alias("mid")
    )

    def best_four(low, high):
        def run(t):
            ids, p = _points(t.m)
            order = _scramble(ids, low, high, seed)
            rows = []
            for k in range(high - low):
                for i in np.argsort(order[k], kind="stable")[:4]:
                    rows.append((low + k, int(order[k, i]), *map(float, p[i])))
            return rows

        return run

    def votes(t):
        h = np.array([list(k["h"]) for k in t.hs])
        n = (_errors(h, _points(t.m)[1]) <= threshold).sum(axis=1)
        return [(int(k["hyp"]), int(v)) for k, v in zip(t.hs, n)]

    def winners(live: DataFrame, low: int, high: int) -> DataFrame:
        """Votes, number and matrix of the best of hypotheses low to high - 1 for each pair of ``live``."""
        drawn = _per_block(live, best_four(low, high), "hyp int, o long, x double, y double, u double, v double")
        first4 = Window.partitionBy(*PAIR, "hyp").orderBy("o", "x", "y", "u", "v")
        hyps = (
            drawn.withColumn("_k", F.row_number().over(first4)).where("_k <= 4")
            .groupBy(*PAIR, "hyp").agg(F.collect_list(F.struct("x", "y", "u", "v")).alias("pts"))
            .where(F.size("pts") == 4).select(*PAIR, "hyp", _solve4("pts").alias("h")).where("h is not null")
        )
        hyps = session.cut(hyps.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("hyp", "h"))).alias("hs")), "hyps")
        polled = _per_block(live.join(hyps, PAIR).select(*PAIR, "m", "hs"), votes, "hyp int, votes long")
        polled = polled.groupBy(*PAIR, "hyp").agg(F.sum("votes").alias("votes"))
        top = polled.groupBy(*PAIR).agg(F.max(F.struct("votes", (-F.col("hyp")).alias("neg"))).alias("b"))
        h = F.filter("hs", lambda k: k["hyp"] == -F.col("b.neg"))[0]["h"]
        return top.join(hyps, PAIR).select(*PAIR, F.struct("b.votes", "b.neg", h.alias("h0")).alias("b"))

    # a sample is without outliers with the fourth power of the share of inliers
    missed = F.pow(1.0 - F.pow(F.col("b.votes") / F.col("n_matches"), F.lit(4.0)), F.col("drawn").cast("double"))
    best, low, live = None, 0, blocks.join(totals.where("n_matches >= 4").select(*PAIR), PAIR)
    for high in [*[k for k in ROUNDS if k < hypotheses], hypotheses]:
        now = winners(live, low, high)
        if best is not None:
            now = best.unionByName(now).groupBy(*PAIR).agg(F.max("b").alias("b"))
        best = session.cut(now, "best")
        enough = best.join(totals, PAIR).withColumn("drawn", F.lit(high)).where(missed <= 1.0 - confidence)
        open_ = session.cut(totals.where("n_matches >= 4").join(enough, PAIR, "left_anti").select(*PAIR), "open")
        low, live = high, blocks.join(open_, PAIR)
        if open_.isEmpty():
            break
    best = best.select(*PAIR, F.col("b.h0").alias("h0"))

    def moments(t):
        p = _points(t.m)[1]
        p = p[_errors(np.array(t.h0), p)[0] <= threshold]
        q = (p - np.array(t.mid)) / 256.0
        x, y, u, v = q.T
        o, z = np.ones_like(x), np.zeros_like(x)
        a = np.concatenate([np.stack([x, y, o, z, z, z, -u * x, -u * y, -u], 1),
                            np.stack([z, z, z, x, y, o, -v * x, -v * y, -v], 1)])
        g = a.T @ a
        return [(len(p), [float(g[i, j]) for i, j in _MOMENTS])]

    parts = _per_block(
        blocks.join(best, PAIR).join(totals, PAIR).select(*PAIR, "m", "h0", "mid"), moments, "n long, g array<double>"
    )
    sums = parts.select(*PAIR, "n", F.posexplode("g").alias("i", "g")).groupBy(*PAIR, "i").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    sums = sums.groupBy(*PAIR).agg(
        F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "g"))), lambda e: e["g"]).alias("g")
    )

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(g: pd.Series, mid: pd.Series) -> pd.Series:
        def one(m, c):
            a = np.zeros((9, 9))
            for (i, j), val in zip(_MOMENTS, m):
                a[i, j] = a[j, i] = val
            h = np.linalg.eigh(a)[1][:, 0].reshape(3, 3)
            ta = np.array([[1 / 256, 0, -c[0] / 256], [0, 1 / 256, -c[1] / 256], [0, 0, 1]])
            tb = np.array([[256, 0, c[2]], [0, 256, c[3]], [0, 0, 1]])
            h = tb @ h @ ta
            return (h / h[2, 2]).ravel()

        return pd.Series([one(m, c) for m, c in zip(g, mid)])

    fit = sums.join(totals, PAIR).select(*PAIR, "n", solve("g", "mid").alias("h"))
    out = pairs.select(*PAIR).join(totals, PAIR, "left").join(fit, PAIR, "left")
    ident = F.array(*[F.lit(v) for v in IDENTITY3])
    return out.select(
        *PAIR, F.coalesce("h", ident).alias("h"),
        F.coalesce(F.col("n") / F.col("n_matches"), F.lit(0.0)).alias("inlier_ratio"),
        F.coalesce("n", F.lit(0)).alias("n_inliers"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
    )

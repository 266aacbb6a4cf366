"""Statistics and model-quality aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skyquilt.operators import ordering

PERCENTS = (10, 25, 50, 75, 90, 95, 99)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int], chunk: Column
) -> DataFrame:
    """Exact linear-interpolated percentiles ``p<q>`` per key.

    Nulls are left out; a key without values has no row. Values are counted first; running counts over value chunks give the ranks.
    No task ever holds all values of a key. ``chunk`` must be a non-decreasing
    function of the value.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = ordering.running_sum(counts, keys, [value], chunk, {"_upto": "_c"})
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    d = ordering._join_equal(upto, total, keys) if keys else upto.withColumn("_n", total.scalar())
    picks = []
    for q in percents:
        at = (F.col("_n") - 1) * (q / 100)
        picks.append(F.min(F.when(F.col("_upto") > F.floor(at), F.col(value))).alias(f"_lo{q}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value))).alias(f"_hi{q}"))
    d = d.groupBy(*keys, "_n").agg(*picks)
    out = []
    for q in percents:
        at = (F.col("_n") - 1) * (q / 100)
        lo, hi = F.col(f"_lo{q}").cast("double"), F.col(f"_hi{q}").cast("double")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(f"p{q}"))
    return d.select(*keys, *out)


def motion_statistics(motion: DataFrame, keys: Sequence[str] = ("aoi", "frame"), value: str = "m") -> DataFrame:
    """min, max, mean, population std, median and percentiles of a map in [0, 1]."""
    v = F.col(value).cast("double")
    basic = motion.groupBy(*keys).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")
    )
    return basic.join(quantiles(motion, keys, value, PERCENTS, ordering.by_width(F.col(value) * 4096, 1)), list(keys))


def interval_shares(motion: DataFrame, keys: Sequence[str] = ("aoi", "frame"), value: str = "m", bins: int = 10) -> DataFrame:
    """Per cent of values in each [lo, hi) of ten; the value 1.0 is in none."""
    edges = [i / bins for i in range(bins + 1)]
    v = F.col(value)
    counts = [
        F.count_if((v >= F.lit(lo).cast("float")) & (v < F.lit(hi).cast("float"))).alias(f"b{i}")
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ]
    d = motion.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *counts)
    return d.select(*keys, "n", F.posexplode(F.array(*[f"b{i}" for i in range(bins)])).alias("bin", "count")).select(
        *keys, "bin", (F.col("count") / F.col("n") * 100).alias("share")
    )


def accuracy(preds: DataFrame, prob: str = "prob", hot: str = "hot") -> DataFrame:
    """Share of rows whose rounded probabilities equal the one-hot on both entries."""
    ok = (F.bround(F.col(prob)[0]) == F.col(hot)[0]) & (F.bround(F.col(prob)[1]) == F.col(hot)[1])
    return preds.agg(F.avg(ok.cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def regression_error(preds: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Mean over samples of the summed squared and absolute errors."""
    def total(f):
        return F.aggregate(F.zip_with(pred, label, f), F.lit(0.0), lambda a, v: a + v)

    return preds.agg(
        F.avg(total(lambda p, t: (p - t) * (p - t))).alias("sum_squared"),
        F.avg(total(lambda p, t: F.abs(p - t))).alias("sum_absolute"),
    )


def mask_quality(cells: DataFrame, pred: str = "pred", truth: str = "truth", limit: float = 0.5) -> DataFrame:
    """Precision, recall and accuracy of a predicted mask, per pixel."""
    p, t = F.col(pred) > limit, F.col(truth) > limit
    d = cells.agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn")
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return d.select(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def run_totals(timings: DataFrame) -> DataFrame:
    """Frames, total and mean seconds per AOI and overall (from the sums)."""
    per = timings.groupBy("aoi").agg(F.count(F.lit(1)).alias("frames"), F.sum("seconds").alias("total_s"))
    d = per.rollup("aoi").agg(F.grouping("aoi").alias("_g"), F.sum("frames").alias("frames"), F.sum("total_s").alias("total_s"))
    d = d.withColumn("aoi", F.when(F.col("_g") == 1, "overall").otherwise(F.col("aoi"))).drop("_g")
    return d.withColumn("mean_s", F.when(F.col("frames") > 0, F.col("total_s") / F.col("frames")).otherwise(0.0))


def observed_totals(timings: DataFrame, write) -> tuple[DataFrame, dict]:
    """``timings`` written by ``write(df)``, and the run's totals counted while it is written.

    The counts are an observation on the writing plan, so the overall figures need
    no second scan: frames, total_s, mean_s (0 for no frame).
    """
    seen = Observation("run")
    kept = timings.observe(seen, F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_s"))
    out = write(kept)
    got = seen.get
    return out, {**got, "mean_s": got["total_s"] / got["frames"] if got["frames"] else 0.0}

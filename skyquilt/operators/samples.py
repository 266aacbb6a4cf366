"""Patch samples: counting, quotas, seeded sampling, splits and batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.operators import ordering


def valid_samples(samples: DataFrame, size: int) -> DataFrame:
    """Skip samples whose payload is missing, empty or of a wrong size."""
    return samples.where(F.coalesce(F.size("px") == size, F.lit(False)))


def file_class_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("file_id", "cls").agg(F.count(F.lit(1)).alias("n"))


def class_totals(samples: DataFrame) -> DataFrame:
    """One row: total_pos (class 0), total_neg (class 1)."""
    return samples.agg(
        F.count_if(F.col("cls") == 0).alias("total_pos"), F.count_if(F.col("cls") == 1).alias("total_neg")
    )


def adjust_quotas(totals: DataFrame, pos: int, neg: int, val_pos: int, val_neg: int) -> DataFrame:
    """Wanted class sizes cut to what exists, at five negatives per positive."""
    tp, tn = F.col("total_pos"), F.col("total_neg")
    d = totals.withColumn("pos", F.when(tp < pos, tp).otherwise(F.lit(pos).cast("long")))
    d = d.withColumn("neg", F.when(tp < pos, F.least(F.lit(neg).cast("long"), tn, F.col("pos") * 5)).otherwise(F.lit(neg).cast("long")))
    short = tn < F.col("neg")
    d = d.withColumn("pos", F.when(short, F.least("pos", tp, F.floor(tn / 5))).otherwise(F.col("pos")))
    d = d.withColumn("neg", F.when(short, tn).otherwise(F.col("neg")))
    return d.withColumn("enough_validation", (tp >= val_pos) & (tn >= val_neg))


# ------------------------------------------------------------------- means

def _sum_partials(cols: list[str], key_types: str, keys: list[str], size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for k, g in groups:
                a = np.stack(g["px"].to_numpy()).astype(np.float64)
                s = sums.setdefault(k, [np.zeros(size), 0])
                s[0] += a.sum(axis=0)
                s[1] += len(a)
        if sums:
            yield pd.DataFrame([
                (*(k if isinstance(k, tuple) else (k,)), i, float(v), s[1])
                for k, s in sums.items() for i, v in enumerate(s[0])
            ], columns=[*keys, "i", "s", "n"])

    return run


def element_sums(samples: DataFrame, size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Element-wise sums: one partial array per task, then a small final sum."""
    fields = "".join(f"{n} {t}, " for n, t in samples.select(*keys).dtypes)
    part = samples.select(*keys, "px").mapInPandas(
        _sum_partials(["px"], fields, list(keys), size), f"{fields}i int, s double, n long"
    )
    return part.groupBy(*keys, "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def mean_image(samples: DataFrame, size: int) -> DataFrame:
    """Element-wise mean: rows (i, mean)."""
    return element_sums(samples, size).select("i", (F.col("s") / F.col("n")).alias("mean"))


def channel_mean(samples: DataFrame, channels: int, pixels: int) -> DataFrame:
    """Mean per channel over samples and pixels: rows (channel, mean float)."""
    d = element_sums(samples, channels * pixels).withColumn("channel", F.floor(F.col("i") / pixels).cast("int"))
    return d.groupBy("channel").agg((F.sum("s") / F.sum("n")).cast("float").alias("mean"))


def sampled_rows(samples: DataFrame, max_samples: int, seed: int) -> DataFrame:
    """Seeded rows for the sampled mean image.

    Each file gives ``min(size, max // files + 1)`` rows; files are read in
    order until at least ``max`` rows are loaded. Kept: rows of the files read.
    """
    sizes = samples.groupBy("file_id").agg(F.count(F.lit(1)).alias("size"))
    files = sizes.agg(F.count(F.lit(1))).scalar()
    sizes = sizes.withColumn("take", F.least(F.col("size"), F.floor(F.lit(max_samples) / files) + 1))
    sizes = ordering.running_sum(sizes, [], ["file_id"], ordering.sampled_chunk(sizes, ["file_id"]), {"loaded": "take"})
    sizes = sizes.where(F.col("loaded") - F.col("take") < max_samples).select("file_id", "take")
    return take_per_group(samples, sizes, ["file_id"], seed)


def take_per_group(samples: DataFrame, quotas: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """The ``take`` rows of smallest ``mix`` order of every group, without replacement.

    Positions come from hash-range chunks, so a group of any size is spread out.
    Payload columns stay out of the ranking; they are joined back by key.
    """
    order = ordering.mix(seed, "sample_idx")
    light = samples.select(*keys, "sample_idx", order.alias("_o"))
    ranked = ordering.position(light, keys, ["_o", "sample_idx"], ordering.mix_chunk(F.col("_o")), "rank")
    chosen = ranked.join(quotas, keys).where(F.col("rank") < F.col("take")).select(*keys, "sample_idx", "rank")
    return samples.join(chosen, [*keys, "sample_idx"])


def balanced_sample(samples: DataFrame, target_pos: int, target_neg: int, seed: int, epoch: int = 0) -> DataFrame:
    """Per file and class: ``target // files + 1`` seeded rows, capped by its size."""
    files = samples.agg(F.count_distinct("file_id")).scalar()
    groups = samples.select("file_id", "cls").distinct()
    target = F.when(F.col("cls") == 0, F.lit(target_pos)).otherwise(F.lit(target_neg))
    quotas = groups.select("file_id", "cls", (F.floor(target / files) + 1).alias("take"))
    return take_per_group(samples, quotas, ["file_id", "cls"], seed + epoch)


def subtract_channel_mean(px: Column, mean: Column, pixels: int) -> Column:
    return F.transform(px, lambda v, i: v - F.element_at(mean, (F.floor(i / pixels) + 1).cast("int")))


def subtract_image_mean(px: Column, mean: Column) -> Column:
    return F.zip_with(px, mean, lambda v, m: v - m)


def zero_centre(px: Column, mean: Column, size: int, channels: int) -> Column:
    """Subtract a per-channel or a per-element mean, by the length of ``mean``."""
    n = F.size(mean)
    error = F.raise_error(F.lit("mean has neither channel nor image shape")).cast("array<double>")
    return (
        F.when(n == size, subtract_image_mean(px, mean))
        .when(n == channels, subtract_channel_mean(px, mean, size // channels))
        .otherwise(error)
    )


# --------------------------------------------------------- splits, batches

def permuted(samples: DataFrame, seed: int, keys: list[str] = (), out: str = "pos") -> DataFrame:
    """Position in a seeded permutation."""
    d = samples.withColumn("_o", ordering.mix(seed, "sample_idx"))
    return ordering.position(d, list(keys), ["_o", "sample_idx"], ordering.mix_chunk(F.col("_o")), out).drop("_o")


def epoch_batches(samples: DataFrame, batch: int, seed: int, epoch: int = 0, drop_last: bool = True) -> DataFrame:
    """Shuffle and number batches of a fixed size; the tail is dropped or kept."""
    d = permuted(samples, seed + epoch).withColumn("batch_id", F.floor(F.col("pos") / batch))
    if drop_last:
        d = d.where(F.col("batch_id") < F.floor(samples.agg(F.count(F.lit(1))).scalar() / batch))
    return d


def split_by_file(samples: DataFrame, val_share: float) -> DataFrame:
    """Leading files (by name) train, the rest validation; no file in both."""
    files = samples.select("file_id").distinct()
    files = ordering.position(files, [], ["file_id"], ordering.sampled_chunk(files, ["file_id"]))
    n = samples.agg(F.count_distinct("file_id")).scalar()
    files = files.withColumn("part", F.when(F.col("pos") < F.floor(n * (1 - val_share)), "train").otherwise("validation"))
    return samples.join(files.select("file_id", "part"), "file_id")


def split_random(samples: DataFrame, val_share: float, seed: int) -> DataFrame:
    """Exact-size seeded split; validation takes ceil(n * share) rows."""
    n = samples.agg(F.count(F.lit(1))).scalar()
    d = permuted(samples, seed)
    return d.withColumn("part", F.when(F.col("pos") < F.ceil(n * val_share), "validation").otherwise("train"))


def split_permutation_prefix(samples: DataFrame, n_train: int, n_val: int, seed: int) -> DataFrame:
    """First ``n_train`` of a permutation train; validation starts one after, so
    that the element in between stays unused."""
    p = F.col("pos")
    part = F.when(p < n_train, "train").when((p > n_train) & (p <= n_train + n_val), "validation")
    return permuted(samples, seed).withColumn("part", part).where("part is not null")


def file_position_split(files: DataFrame, position: str, last_train: int, unused: int) -> DataFrame:
    """Files up to ``last_train`` train, those after ``unused`` test."""
    p = F.col(position)
    return files.withColumn("part", F.when(p <= last_train, "train").when(p > unused, "test")).where("part is not null")


def few_samples(samples: DataFrame, k: int, seed: int, limit: int = 5) -> DataFrame:
    """Up to min(k, 5) rows, taken across seeded-shuffled files in order."""
    want = min(k, limit)
    fkey = F.conv(F.substring(F.md5("file_id"), 1, 7), 16, 10).cast("long")
    d = samples.select("file_id", "sample_idx", ordering.mix(seed, fkey).alias("_f"), ordering.mix(seed, "sample_idx").alias("_o"))
    return d.orderBy("_f", "file_id", "_o", "sample_idx").limit(want).select("file_id", "sample_idx")


# ------------------------------------------------------------ small layouts

def one_hot(cls: Column) -> Column:
    """Class 0 = vehicle, 1 = background."""
    return F.array((cls == 0).cast("int"), (cls == 1).cast("int"))


def legacy_channels(columns: Column, kind: str) -> Column:
    """Array of per-frame pixel columns -> flattened channel-first patch.

    The binary layout uses columns 0, 1, 2, 3; the regression layout 0, 2, 3, 4.
    """
    order = {"binary": (0, 1, 2, 3), "regression": (0, 2, 3, 4)}[kind]
    return F.flatten(F.array(*[columns[i] for i in order]))


def pair_labels(samples: DataFrame, labels: DataFrame) -> DataFrame:
    return samples.join(labels, ["file_id", "sample_idx"])


def write_prior_samples(samples: DataFrame, path: str) -> None:
    samples.write.parquet(path)


def read_prior_samples(spark: SparkSession, path: str) -> DataFrame:
    """Image scaled to [0, 1]; mask as stored."""
    d = spark.read.parquet(path)
    return d.withColumn("image", F.transform("image", lambda v: v / F.lit(255.0)))

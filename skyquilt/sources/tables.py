"""Readers and writers of the tabular inputs and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt import schemas
from skyquilt.functions.text import fixed_text
from skyquilt.operators import matching


def read_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """Truth tracks from CSV with a header; a malformed row fails the read."""
    return spark.read.schema(schemas.TRUTH).option("header", True).option("mode", "FAILFAST").csv(path)


def write_truth_csv(truth: DataFrame, path: str) -> None:
    cols = [c.split()[0] for c in schemas.TRUTH.split(", ")]
    truth.select(*cols).write.option("header", True).csv(path)


def write_detections(dets: DataFrame, path: str, keys=("aoi", "frame")) -> None:
    """Pixel form: ``x,y`` with one decimal, no header, a folder per frame.

    Rows are range-partitioned, so a very full frame is written by many tasks.
    """
    rows = dets.select(*keys, "seq", fixed_text("x", 1).alias("x"), fixed_text("y", 1).alias("y"))
    rows = rows.repartitionByRange(*keys, "seq").sortWithinPartitions(*keys, "seq").drop("seq")
    rows.write.partitionBy(*keys).csv(path)


def write_geo_detections(dets: DataFrame, frames: DataFrame, path: str, keys=("aoi", "frame")) -> None:
    """Geo form: ``lon,lat`` with six decimals and a header, plus a manifest.

    Spark writes no empty folders, so frames without detections are kept as
    rows of ``manifest`` with ``n_det = 0``.
    """
    rows = dets.select(*keys, "seq", fixed_text("lon", 6).alias("lon"), fixed_text("lat", 6).alias("lat"))
    rows = rows.repartitionByRange(*keys, "seq").sortWithinPartitions(*keys, "seq").drop("seq")
    rows.write.partitionBy(*keys).option("header", True).csv(f"{path}/rows")
    n = dets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_det"))
    matching.counts_on_spine(frames.select(*keys).distinct(), list(keys), (n, ["n_det"])).write.parquet(f"{path}/manifest")


def read_geo_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def read_geo_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("lon DOUBLE, lat DOUBLE, aoi STRING, frame INT").option("header", True).csv(f"{path}/rows")


def read_detection_csv(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Detections of an inclusive frame range, frame number from the path.

    Both ``frame000123.csv`` files and ``frame=123/`` folders are understood.
    Empty files give no rows.
    """
    raw = (
        spark.read.schema(schemas.DETECTION_CSV).option("recursiveFileLookup", "true").csv(path)
        .select("x", "y", F.regexp_extract(F.col("_metadata.file_path"), r"frame=?(\d+)", 1).cast("int").alias("frame"))
    )
    return raw.where(F.col("frame").between(first, last))


def detections_per_frame(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Counts over the whole range; a missing file counts 0."""
    n = read_detection_csv(spark, path, first, last).groupBy("frame").agg(F.count(F.lit(1)).alias("n_det"))
    return matching.counts_on_spine(matching.spine(spark, first, last), ["frame"], (n, ["n_det"]))


def read_homographies(spark: SparkSession, path: str) -> DataFrame:
    """Precomputed matrices; rows without nine values are refused."""
    h = spark.read.schema(schemas.HOMOGRAPHY).parquet(path)
    ok = F.when(F.size("h") == 9, F.col("h")).otherwise(F.raise_error(F.lit("homography needs nine values")))
    return h.withColumn("h", ok)


def write_metrics(per_aoi: DataFrame, overall: DataFrame, path: str) -> None:
    cols = [c.split()[0] for c in schemas.METRICS.split(", ")]
    per_aoi.select(*cols).unionByName(overall.withColumn("aoi", F.lit("overall")).select(*cols)).write.parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRICS).parquet(path)


def norm_mean(params: DataFrame) -> DataFrame:
    """Mean under the first present key of mean_img, mean, mu; an error if none."""
    keys = [k for k in ("mean_img", "mean", "mu") if k in params.columns]
    error = F.raise_error(F.lit("no mean_img, mean or mu in the parameters")).cast("array<double>")
    return params.withColumn("norm", F.coalesce(*[F.col(k) for k in keys], error)).drop(*keys)

"""File catalogues: which frames exist, in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.fixed import AOI_BOXES
from skyquilt.operators import ordering

IMAGE_NAME = r"(?i)\.(png|jpg|jpeg)$"


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Paths below a folder; only the listing is read, not the content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")


def frame_catalogue(files: DataFrame, name: str = "name") -> DataFrame:
    """Image names in name order; frame = first digit run, else 1-based position."""
    images = files.where(F.col(name).rlike(IMAGE_NAME))
    order = [name] + [c for c in files.columns if c != name]
    images = ordering.position(images, [], order, ordering.sampled_chunk(images, order))
    digits = F.regexp_extract(name, r"\d+", 0)
    frame = F.when(digits != "", digits.cast("bigint")).otherwise(F.col("pos") + 1)
    return images.withColumn("frame", frame)


def source_catalogue(files: DataFrame, first_frame: int, num_frames: int | None, path: str = "path") -> DataFrame:
    """``.r1`` files in full-path order, the first ``num_frames`` of them, numbered."""
    raw = files.where(F.col(path).endswith(".r1"))
    raw = ordering.position(raw, [], [path], ordering.sampled_chunk(raw, [path]))
    if num_frames is not None:
        raw = raw.where(F.col("pos") < num_frames)
    return raw.withColumn("frame", F.col("pos") + first_frame)


def aoi_catalogue(sources: DataFrame, aois: list[str] | None = None) -> DataFrame:
    """Each source frame with every wanted AOI and its crop path.

    The AOI list is a fixed literal, so this is a row-local explode.
    """
    names = [b[0] for b in AOI_BOXES if aois is None or b[0] in aois]
    d = sources.withColumn("aoi", F.explode(F.array(*[F.lit(n) for n in names])))
    return d.withColumn("crop", F.format_string("AOI_%s/frame%06d.png", "aoi", "frame"))


def first_frame_file(files: DataFrame, folders: list[str], path: str = "path") -> DataFrame:
    """First file, by path, of the first listed folder that has any."""
    rank = F.coalesce(*[F.when(F.col(path).contains(f"/{f}/"), F.lit(i)) for i, f in enumerate(folders)])
    return (
        files.where(F.col(path).endswith(".r1")).withColumn("folder_rank", rank)
        .where("folder_rank is not null").orderBy("folder_rank", path).limit(1)
    )


def frame_key(frame, suffix: str):
    """``frame%06d.<suffix>``."""
    return F.format_string(f"frame%06d.{suffix}", frame)

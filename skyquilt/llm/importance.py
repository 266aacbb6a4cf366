"""Target-distribution importance resampling on hashed word n-grams.

A document's weight is the mean log ratio of its features' shares in the target
and in the corpus; Gumbel noise from a hash of the id turns the highest scores
into a draw without replacement. Features are runs of one and two words, hashed
by CRC-32 (``crc``: table positions counted from the end, folded by XOR).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.llm.crc import word_features
from skyquilt.llm.memory import bound_batches, give_back
from skyquilt.llm.queries import query, table
from skyquilt.llm.raw import Words, steps

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25


def _buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each feature, number of features before each text's own, and its number of words."""
    words = Words(texts)
    one, two = word_features(words)
    last = np.zeros(len(one), bool)
    last[(words.of[1:] - 1)[words.counts > 0]] = True
    # a word's feature and the pair it begins stand side by side, so a text's features are contiguous
    both = np.empty((len(one), 2), np.int32)
    both[:, 0], both[:, 1] = one % BUCKETS, two % BUCKETS
    real = np.ones((len(one), 2), bool)
    real[:, 1] = ~last
    counts = np.maximum(0, 2 * words.counts - 1)
    return both[real], np.concatenate([[0], np.cumsum(counts)]), words.counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, texts in steps(batch):
            total += np.bincount(_buckets(texts)[0], minlength=BUCKETS)
    give_back()
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Features of all texts in each bucket. A task adds up its own; BUCKETS numbers reach the driver, whatever the corpus."""
    rows = docs.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's smoothed shares in thousandths, rounded down."""
    all_s, all_t = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def features(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_features, n_words, total)`` for each row: its features, words, and sum of gains."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in steps(batch):
                bucket, before, words = _buckets(texts)
                sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.diff(before)), pa.array(words.astype(np.int64)), pa.array(np.diff(sums[before]))],
                    ["doc_id", "n_features", "n_words", "total"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_features long, n_words long, total long")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3, ...) in the given order.

    Rows are sorted by range and written with their place in their partition;
    only the partitions' sizes are added up, so no task holds all rows.
    """
    placed = session.cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = sizes.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_at") - F.shiftleft(part, 33)
    return placed.join(F.broadcast(sizes), part == F.col("_part")).withColumn("rank", F.col("_before") + inside + 1).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for each row of ``docs``.

    ``rank`` numbers the drawn rows: the ``percent`` of those with ``least_words``
    words or more that score highest, ties to the smaller id; null elsewhere. A
    null or empty text has no features and weight 0. A null id hashes as an empty
    one and ranks behind equal scores with an id; rows that agree in id and score
    rank by their features. An empty target weighs by rarity alone. No rows: no
    rows. Columns besides ``doc_id`` and ``text`` are not read.
    """
    bound_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = session.cut(features(docs, gain).withColumn("weight", weight).withColumn("score", F.col("weight") + noise)
                         .select("doc_id", "n_features", "n_words", "weight", "score"), "scored")
    fit = F.col("n_words") >= least_words
    drawn = percent * (scored.filter(fit).count()) // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")]
    some = ranked(scored.filter(fit), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~fit).withColumn("rank", F.lit(None).cast("long"))
    return some.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws; ids must be unique and not null."""
    ids = resample(docs, target, **settings).filter("rank is not null").select("doc_id")
    return docs.join(ids, "doc_id", "left_semi")


@query("op11_importance_resampling")
def op11_importance_resampling(spark, sf):
    return resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))

"""Quality by hierarchical empirical Bayes.

A document classifier gives evidence; hosts and paths give priors. A host's
share of good documents is shrunk towards the share of all, a path's towards its
host's, each by a strength that the spread of the groups sets. The posterior of
a document adds its evidence to its path's prior, in log odds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.llm import linear
from skyquilt.llm.queries import query, table
from skyquilt.llm.text import words
from skyquilt.llm.toxicity import SHAPE, shape

#: Labelled documents that the classifier is fitted on, at most: those with the least hash of their id.
SAMPLE = 10_000
KEEP = 0.5
LOW, HIGH = 1.0, 1e6


def measures(text: str | None) -> list[float]:
    """Shape of a text and of its words: repeats in a row, words without a letter or digit, capitals only, the commonest word's share."""
    ws = words(text)
    n = max(1, len(ws))
    seen: dict[bytes, int] = {}
    for w in ws:
        seen[w] = seen.get(w, 0) + 1
    again = sum(a == b for a, b in zip(ws, ws[1:], strict=False))
    signs = sum(c for w, c in seen.items() if not any(x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 for x in w))
    return [*shape(text, len(seen), len(ws)), again / n, signs / n, max(seen.values(), default=0) / n, float(not ws)]


WIDTH = SHAPE + 4


def _classifier(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, float]:
    """Weights over the measures, their squares and roots, and the log odds of a good document in the sample."""
    chosen = (labels.dropna(subset=["doc_id", "quality"]).groupBy(F.col("doc_id").alias("labelled"))
              .agg(F.min(F.col("quality").cast("double")).alias("good"))
              .orderBy(F.xxhash64("labelled"), "labelled").limit(sample))

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(measures)

    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("labelled"))
    got = rows.select("id", measured("text").alias("x"), "good").limit(2 * sample).toPandas().sort_values("id")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), WIDTH)
    y = got["good"].to_numpy(np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    return linear.fit(_expanded(x), y, penalty=0.1), float(np.log(share / (1 - share)))


def _expanded(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x ** 2, np.sqrt(np.maximum(x, 0))], 1)


def _odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.ln(q / (1 - q))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-documents of the prior by the method of moments over ``groups(n, good)``, each against ``mean``."""
    rows = groups.select("n", (F.col("good") / F.col("n")).alias("share"), mean.alias("mean"))
    s = rows.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("share") - F.col("mean"), 2)).alias("spread"),
        F.sum(F.col("n") * F.col("mean") * (1 - F.col("mean"))).alias("chance"), F.count(F.lit(1)).alias("groups"),
        F.sum(F.pow("n", F.lit(2.0))).alias("square")).first()
    if not s.n or not s.chance:
        return HIGH
    typical = s.chance / s.n
    # expected spread is groups * typical by chance, plus the groups' own variance times their size
    own = (s.spread - s.groups * typical) / max(1e-9, s.n - s.square / s.n if s.groups > 1 else s.n)
    return float(min(HIGH, max(LOW, typical / own - 1))) if own > 0 else HIGH


def assess(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, host, path, p_document, host_posterior, path_posterior, score, keep)`` for each row.

    A group's posterior counts the classifier's probabilities of all its
    documents; the document's own is left out of the prior that it meets. Null
    hosts and paths are groups of their own. A null text is an empty one.
    Repeated rows count as documents. Without labels the classifier gives even
    odds and all documents are kept. No rows: no rows.
    """
    weights, base = _classifier(docs, labels, sample)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        x = np.array([measures(t) for t in texts], np.float64).reshape(len(texts), WIDTH)
        return pd.Series(linear.predict(_expanded(x), weights))

    rows = session.cut(docs.select(F.col("doc_id").alias("doc_id"), host.alias("host"), path.alias("path"),
                                   probability(F.col("text").cast("string")).alias("p")), "evidence")
    paths = session.cut(rows.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    every = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    mean = F.lit(every.good / every.n if every.n else 0.5)
    strong = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good")), mean)
    host_mean = (F.col("host_good") + strong * mean) / (F.col("host_n") + strong)
    groups = paths.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).drop("of")
    inner = _strength(groups, host_mean)
    groups = groups.select(F.col("host").alias("g_host"), F.col("path").alias("g_path"), "n", "good", host_mean.alias("host_posterior"))
    joined = rows.join(groups, F.col("host").eqNullSafe(F.col("g_host")) & F.col("path").eqNullSafe(F.col("g_path")))
    path_mean = (F.col("good") + inner * F.col("host_posterior")) / (F.col("n") + inner)
    prior = (F.col("good") - F.col("p") + inner * F.col("host_posterior")) / (F.col("n") - 1 + inner)
    total = _odds(F.col("p")) - F.lit(base) + _odds(prior)
    score = 1 / (1 + F.exp(-total))
    return joined.select("doc_id", "host", "path", F.col("p").alias("p_document"), "host_posterior", path_mean.alias("path_posterior"),
                         score.alias("score"), (score >= keep).alias("keep"))


@query("op3_site_posteriors")
def op3_site_posteriors(spark, sf):
    # documents name a source; its languages are the sections below it
    return assess(table(spark, sf, "documents"), table(spark, sf, "labels"), F.col("source"), F.col("lang"))

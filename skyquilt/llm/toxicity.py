"""Toxicity by a classifier chain.

The categories are predicted one after the other; each linear model sees the
text's features and the probabilities of the categories before it. In training
those are predictions of models that did not see the document (out of fold).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.llm import linear
from skyquilt.llm.memory import bound_batches, give_back
from skyquilt.llm.queries import query, table
from skyquilt.llm.text import folded

#: Labelled documents that the chain is fitted on, at most: those with the least hash of their id.
SAMPLE = 10_000
#: Words and stems per category whose presence is a feature, and documents that must hold each.
TERMS, MIN_DOCS = 128, 5
#: Bytes of a stem.
STEMS = (4, 5, 6)
FOLDS = 5
THRESHOLD = 0.5
SHAPE = 7
#: Texts whose features are in memory at once.
STEP = 512
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PLAIN = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum() or chr(c).isspace())


def shape(text: str | None, distinct: int, n_words: int) -> list[float]:
    """Length, share of capitals, digits, symbols and distinct words, words per line, word length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n, w = max(1, len(raw)), max(1, n_words)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    return [np.log1p(len(raw)) / 10, count(_UPPER) / n, count(_DIGIT) / n, len(raw.translate(None, _PLAIN)) / n,
            distinct / w, min(1.0, w / (1 + raw.count(b"\n")) / 100), min(1.0, len(raw) / w / 20)]


def stems(seen: set[bytes]) -> set[bytes]:
    """The words, and the first bytes of longer ones (marked ^), which stand for their inflected forms."""
    return seen.union(*({b"^" + w[:n] for w in seen if len(w) > n} for n in STEMS))


def features(texts, terms: dict[bytes, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(terms) + SHAPE), np.float64)
    for i, text in enumerate(texts):
        ws = folded(text).split()
        seen = set(ws)
        for t in terms.keys() & stems(seen):
            x[i, terms[t]] = 1.0
        x[i, len(terms):] = shape(text, len(seen), len(ws))
    return x


@dataclass
class Chain:
    """A fitted chain: its size is bounded by the number of categories and terms."""

    names: list[str]
    terms: dict[bytes, int]
    weights: list[np.ndarray]

    def probabilities(self, texts) -> np.ndarray:
        texts, out = list(texts), [np.zeros((0, len(self.weights)))]
        for k in range(0, len(texts), STEP):
            x = features(texts[k:k + STEP], self.terms)
            for w in self.weights:
                x = np.concatenate([x, linear.predict(x, w)[:, None]], 1)
            out.append(x[:, len(self.terms) + SHAPE:])
        return np.concatenate(out)


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> list[np.ndarray]:
    """One weight vector per column of y; columns of earlier categories' out-of-fold probabilities are added to x."""
    weights = []
    for k in range(y.shape[1]):
        out = np.zeros(len(y))
        for f in range(folds):
            inside = fold == f
            if inside.any():
                out[inside] = linear.predict(x[inside], linear.fit(x[~inside], y[~inside, k]))
        weights.append(linear.fit(x, y[:, k]))
        x = np.concatenate([x, out[:, None]], 1)
    return weights


def _choose_terms(sample: DataFrame, names: list[str]) -> dict[bytes, int]:
    """For each category the words whose presence tells most about it, by the likelihood ratio statistic."""
    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Documents that hold each term, all and by category, summed over STEP documents at a time."""
        for part in parts:
            for k in range(0, len(part), STEP):
                rows, seen = part.iloc[k:k + STEP], {}
                for text, flags in zip(rows["text"], rows[names].to_numpy(np.float64), strict=True):
                    held = np.concatenate([[1.0], flags])
                    for t in stems(set(folded(text).split())):
                        seen[t] = seen[t] + held if t in seen else held
                sums = np.array(list(seen.values())).reshape(len(seen), len(names) + 1)
                yield pd.DataFrame({"term": list(seen)} | {c: sums[:, i] for i, c in enumerate(["n", *names])})
        give_back()

    n = sample.count()
    positives = sample.agg(*[F.sum(c).alias(c) for c in names]).first()
    rows = (sample.select("text", *names).mapInPandas(counted, ", ".join(["term binary", "n double", *[f"{c} double" for c in names]]))
            .groupBy("term").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).filter(F.col("n") >= MIN_DOCS))

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    chosen: dict[bytes, int] = {}
    for c in names:
        share = (positives[c] or 0) / max(1, n)
        if not 0 < share < 1:
            continue
        gain = (term(F.col(c), F.col("n") * share) + term(F.col("n") - F.col(c), F.col("n") * (1 - share))
                + term(F.lit(positives[c]) - F.col(c), (F.lit(n) - F.col("n")) * share)
                + term(F.lit(n - positives[c]) - F.col("n") + F.col(c), (F.lit(n) - F.col("n")) * (1 - share)))
        for r in rows.select("term", gain.alias("gain")).orderBy(F.desc("gain"), "term").limit(TERMS).collect():
            chosen.setdefault(bytes(r.term), len(chosen))
    return chosen


def train(docs: DataFrame, labels: DataFrame, names: list[str], sample_size: int = SAMPLE) -> Chain:
    """Fit the chain over the 0/1 columns ``names`` of ``labels(doc_id, ...)``, in that order.

    It learns from at most ``sample_size`` labelled documents. Labels with a null
    in these columns or in doc_id are left out; of several labels of one id the
    largest counts. Without labels, or with one class only, a category gets its
    smoothed share.
    """
    bound_batches(docs.sparkSession)
    chosen = (labels.dropna(subset=["doc_id", *names]).groupBy(F.col("doc_id").alias("labelled"))
              .agg(*[F.max(F.col(c).cast("double")).alias(f"label_{k}") for k, c in enumerate(names)])
              .orderBy(F.xxhash64("labelled"), "labelled").limit(sample_size))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    flags = [f"label_{k}" for k in range(len(names))]
    # at most sample_size rows of a few numbers
    sample = session.cut(rows.join(F.broadcast(chosen), F.col("id") == F.col("labelled")).select("id", "text", *flags), "labelled")
    terms = _choose_terms(sample, flags)
    width = len(terms) + SHAPE

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([r.astype("<f4").tobytes() for r in features(texts, terms)])

    got = sample.select("id", packed("text").alias("x"), *flags).orderBy("id", "x").limit(2 * sample_size).toPandas()
    x = np.frombuffer(b"".join(got["x"]), "<f4").reshape(len(got), width).astype(np.float64)
    fold = np.arange(len(got)) % FOLDS
    return Chain(names, terms, fit_chain(x, got[flags].to_numpy(np.float64).reshape(len(got), len(names)), fold))


def score(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with ``p_<category>`` for each category of the chain and ``toxic`` (its probability reaches the threshold).

    Input columns of these names are replaced. A null text is an empty one;
    texts that are equal get equal scores. No rows: no rows.
    """
    bound_batches(docs.sparkSession)
    names = [f"p_{c}" for c in chain.names]
    docs = docs.drop(*names, "toxic")

    @F.pandas_udf(", ".join(f"{c} double" for c in names))
    def chained(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame(chain.probabilities(texts), columns=names)
        give_back()

    rows = docs.select(F.struct(*docs.columns).alias("row"), chained(F.col("text").cast("string")).alias("p"))
    return rows.select("row.*", "p.*", (F.col(f"p.p_{category}") >= threshold).alias("toxic"))


CATEGORIES = ["low_quality", "toxic", "abusive_spam"]


def categories(labels: DataFrame) -> DataFrame:
    """The chain's categories from the labels: poor text, toxic text, and text that is both."""
    poor, toxic = 1 - F.col("quality"), F.col("toxic")
    return labels.select("doc_id", poor.alias("low_quality"), toxic.alias("toxic"), (poor * toxic).alias("abusive_spam"))


def scored(spark, docs: DataFrame, sf: str) -> DataFrame:
    return score(docs, train(docs, categories(table(spark, sf, "labels")), CATEGORIES))


@query("op8_classifier_chain")
def op8_classifier_chain(spark, sf):
    return scored(spark, table(spark, sf, "documents"), sf).select("doc_id", *[f"p_{c}" for c in CATEGORIES], "toxic")

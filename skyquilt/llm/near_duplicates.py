"""N-gram Jaccard join with Bayesian candidate pruning.

Texts that agree in all MinHash values of a band are candidates. Candidates are
compared by further MinHash values, a few at a time, and dropped as soon as the
posterior probability that they reach the threshold falls below a tolerance; the
rest are verified exactly on their shingle sets. Equal texts are one node. No
pair leaves a task: each block of a bucket gives its nodes' numbers of links and
a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.llm import shingles
from skyquilt.llm.memory import bound_batches, tidy
from skyquilt.llm.perfect_hash import mix
from skyquilt.llm.queries import query, table
from skyquilt.operators.graph import components

#: Similarity as a fraction, so that it is compared in whole numbers.
THRESHOLD = (4, 5)
#: Chance of sharing no band at the threshold: (1 - 0.8 ** 4) ** 27, below 1e-6.
BANDS, ROWS = 27, 4
STEPS = (16, 32, 48)
TOLERANCE = 1e-7
#: Nodes of one side of a block; larger buckets are cut into pairs of blocks.
BLOCK = 512
STEP_BYTES = 1 << 20


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches of n MinHash values at which P(similarity >= threshold) reaches the tolerance (uniform prior)."""
    x = (np.arange(20_000) + 0.5) / 20_000
    for m in range(n + 1):
        density = m * np.log(x) + (n - m) * np.log1p(-x)
        density = np.exp(density - density.max())
        if density[x >= threshold].sum() >= tolerance * density.sum():
            return m
    return n


def _batches(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Slices of a batch of about STEP_BYTES of text."""
    size = part["text"].str.len().to_numpy().cumsum() // STEP_BYTES
    for _, rows in part.groupby(size, sort=False):
        yield rows


def _encoded(rows: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in rows["text"]]


def _signatures(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = shingles.Hasher()
    a, b = shingles.coefficients(BANDS * ROWS + STEPS[-1], 21)
    salt = mix(np.arange(BANDS, dtype=np.uint64), 31)
    for part in parts:
        for rows in _batches(part):
            bands, marks = [], []
            for s in hasher.sets(_encoded(rows)):
                if not len(s):
                    bands.append(None)
                    marks.append(None)
                    continue
                least = shingles.minhash(s, a, b)
                key = salt
                for k in range(ROWS):
                    key = mix(key + least[k:BANDS * ROWS:ROWS].astype(np.uint64), 32)
                bands.append(key.view(np.int64))
                marks.append(least[BANDS * ROWS:].tobytes())
            yield pd.DataFrame({"doc_id": rows["doc_id"], "digest": rows["digest"], "bands": bands, "marks": marks})


def _sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = shingles.Hasher()
    for part in parts:
        for rows in _batches(part):
            yield rows.drop(columns="text").assign(shingles=[s.tobytes() for s in hasher.sets(_encoded(rows))])


def common(sets: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Number of shared elements of all pairs of sets."""
    sizes = [len(s) for s in sets]
    every, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    row, use = np.repeat(np.arange(len(sets)), sizes), shared[inverse]
    row, col = row[use], column[inverse[use]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(shared.sum()), step):
        i, j = np.searchsorted(col, [lo, lo + step])
        part = np.zeros((len(sets), step), np.float32)
        part[row[i:j], col[i:j] - lo] = 1.0
        out += part @ part.T
    return out.astype(np.int64)


def linked(marks: np.ndarray, sets: list[np.ndarray], pairs: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """Of the pairs (rows of two indices) those that reach the threshold."""
    done, matches = 0, np.zeros(len(pairs), np.int64)
    for n in STEPS:
        matches = matches + (marks[pairs[:, 0], done:n] == marks[pairs[:, 1], done:n]).sum(1)
        alive = matches >= need[n]
        pairs, matches, done = pairs[alive], matches[alive], n
    if not len(pairs):
        return pairs
    sizes = np.array([len(s) for s in sets])
    rows, local = np.unique(pairs, return_inverse=True)
    local = local.reshape(pairs.shape)
    if len(pairs) > 2 * len(rows):
        both = common([sets[r] for r in rows])[local[:, 0], local[:, 1]]
    else:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs])
    top, bottom = THRESHOLD
    return pairs[both * bottom >= (sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - both) * top]


def _owned(rows: list, key: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs of left and right whose least common bucket is this one."""
    smaller = [[k for k in r.keys if k < key] for r in rows]
    names = {k: i for i, k in enumerate(sorted({k for s in smaller for k in s}))}
    inside = np.zeros((len(rows), max(1, len(names))), np.float32)
    for i, s in enumerate(smaller):
        inside[i, [names[k] for k in s]] = 1.0
    free = (inside[left] @ inside[right].T) == 0
    i, j = np.nonzero(free)
    pairs = np.stack([left[i], right[j]], 1)
    return pairs[pairs[:, 0] < pairs[:, 1]] if left is right else pairs


def _forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """A root for each of n nodes by the links, found by halving label paths."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, pairs[:, 0], label[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], label[pairs[:, 0]])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _verify_blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    need = {n: least_matches(n, THRESHOLD[0] / THRESHOLD[1], TOLERANCE) for n in STEPS}

    def block(name: tuple, rows: list) -> pd.DataFrame | None:
        key, i, j = name
        if len(rows) < 2:
            return None
        side = np.array([r.block for r in rows])
        left = np.flatnonzero(side == i)
        pairs = _owned(rows, key, left, left if i == j else np.flatnonzero(side == j))
        marks = np.stack([np.frombuffer(r.marks, np.uint32) for r in rows])
        pairs = linked(marks, [np.frombuffer(r.shingles, np.uint64) for r in rows], pairs, need)
        if not len(pairs):
            return None
        links = np.bincount(pairs.ravel(), minlength=len(rows))
        root = _forest(len(rows), pairs)
        use = np.flatnonzero(links)
        return pd.DataFrame({"a": [rows[k].digest for k in use], "b": [rows[root[k]].digest for k in use], "links": links[use]})

    name, rows = None, []
    for part in parts:
        for r in part.itertuples(index=False):
            if (r.key, r.i, r.j) != name:
                if rows and (out := block(name, rows)) is not None:
                    yield out
                name, rows = (r.key, r.i, r.j), []
            rows.append(r)
    if rows and (out := block(name, rows)) is not None:
        yield out


def _buckets(nodes: DataFrame) -> DataFrame:
    """``(key, n, digest)``: members of buckets with two nodes or more; of buckets with equal members one stays."""
    rows = nodes.select("digest", F.explode("bands").alias("key"))
    sets = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "digest")).alias("y"),
    ).filter("n > 1")
    return rows.join(sets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "key")


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(doc_id, digest)`` of the documents and ``nodes(digest, class_id, keeper, n_links)`` of their distinct texts.

    Two texts are linked if their sets of five-word shingles have a Jaccard
    similarity of 0.8 or more; fewer words make one shingle. Words are runs
    without ASCII white space, A-Z in lower case. A class is a connected set of
    texts; its id is the least doc_id of its rows (null if they have none), its
    ``keeper`` the digest of a text that has this id. ``n_links`` counts other
    texts, not their copies. Null texts and texts without words are alike (empty)
    but are no copies of each other: they are in ``rows`` with a null digest.
    Repeated rows are copies. No rows: no rows.
    """
    bound_batches(docs.sparkSession)
    digest = F.when(F.trim(F.translate("text", "\t\n\u000b\u000c\r", "     ")) != "", F.md5("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    full = rows.withColumn("digest", digest).filter("digest is not null")
    made = session.cut(full.mapInPandas(tidy(_signatures), "doc_id long, digest string, bands array<long>, marks binary"), "signatures")
    texts = made.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    nodes = session.cut(texts, "nodes")
    members = session.cut(_buckets(nodes), "members")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    keys = members.groupBy("digest").agg(F.collect_list(F.struct("key", "n")).alias("in"))
    # one text per digest: copies meet in the map-side aggregation, so no group of copies is hot
    whole = full.groupBy("digest").agg(F.first("text").alias("text"))
    use = whole.join(keys, "digest").join(nodes.select("digest", "marks"), "digest")
    sets = session.cut(use.mapInPandas(tidy(_sets), "digest string, in array<struct<key: long, n: long>>, marks binary, shingles binary"), "shingles")
    spread = sets.select("digest", "marks", "shingles", F.col("in.key").alias("keys"), F.explode("in").alias("at")).select(
        "digest", "marks", "shingles", "keys", "at.key", F.ceil(F.col("at.n") / BLOCK).cast("int").alias("blocks"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "digest", "marks", "shingles", "keys", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = session.cut(spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                        .mapInPandas(tidy(_verify_blocks), "a string, b string, links long"), "links")
    roots = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("n_links"))
    members = nodes.select("digest", "rep").join(roots, F.col("digest") == F.col("node"), "left").select(
        "digest", "rep", F.coalesce("root", "digest").alias("root"))
    classes = members.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "digest")).alias("least"))
    named = members.join(classes, "root").join(links, "digest", "left").select(
        "digest", F.col("least.rep").alias("class_id"), F.col("least.digest").alias("keeper"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.select("doc_id", digest.alias("digest")), session.cut(named, "classes")


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, class_id, n_links)``: one row per document. A document without words is a class of its own."""
    rows, named = join(docs)
    return rows.join(named, "digest", "left").select(
        "doc_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class in all columns: the one whose id names it. Documents without words all stay.

    Where a class's first document is repeated as a row, one of its rows stays.
    """
    rows, named = join(docs)
    first = session.cut(named.filter("digest = keeper").select("keeper", "class_id"), "keepers")
    again = rows.filter("digest is not null").groupBy("doc_id", "digest").count().filter("count > 1").limit(1).count()
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"),
                         F.when(F.trim(F.translate("text", "\t\n\u000b\u000c\r", "     ")) != "", F.md5("text")).alias("digest"))
    same = (F.col("digest") == F.col("keeper")) & F.col("id").eqNullSafe(F.col("class_id"))
    kept = packed.join(first, same, "left_semi")
    if again:
        kept = kept.groupBy("digest", "id").agg(F.first("row").alias("row"))
    return kept.select("row.*").unionByName(packed.filter("digest is null").select("row.*"))


@query("op10_bayesian_jaccard")
def op10_bayesian_jaccard(spark, sf):
    return classes(table(spark, sf, "documents"))

"""Largest inner products by vantage-point trees, one per shard.

A vector is extended by one coordinate to a common length, which turns the
largest inner product into the least Euclidean distance. Each shard is one tree.
A subtree is skipped when the triangle inequality's lower bound on its distances,
times a factor, reaches the distance of the query's k-th candidate: factor 1 is
exact search, a larger one skips more.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.llm.queries import query, table

K = 20
SHARD = 16_384
LEAF = 256
#: Share of the squared lengths by which distances may be wrong: rows that near the k-th are compared by their exact scores.
SLACK = 1e-12
FACTOR = 2.0
BLOCK = 256
#: Pairs scored at once.
STEP = 8_192
QUERIES_PER_TASK = 8_192


class Tree:
    """A vantage-point tree over the rows of x; each child keeps its range of distances from the parent's vantage point."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.order = x, np.arange(len(x))
        self.nodes: list[tuple] = []
        self._build(0, len(x), leaf)

    def _build(self, lo: int, hi: int, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append((lo, hi))
        if hi - lo <= leaf:
            return at
        rows = self.order[lo:hi]
        # the row farthest from the first lies at the edge, where spheres cut best
        far = rows[np.linalg.norm(self.x[rows] - self.x[rows[0]], axis=1).argmax()]
        d = np.linalg.norm(self.x[rows] - self.x[far], axis=1)
        middle = (hi - lo) // 2
        by = np.argsort(d, kind="stable")
        self.order[lo:hi], d = rows[by], d[by]
        left = self._build(lo, lo + middle, leaf)
        right = self._build(lo + middle, hi, leaf)
        self.nodes[at] = (lo, hi, far, left, d[0], d[middle - 1], right, d[middle], d[-1])
        return at

    def finish(self, vectors: np.ndarray, least_id: np.ndarray, square: float) -> None:
        """Rows in the tree's order, so that a leaf is one slice, with their vectors and least ids."""
        self.sorted = self.x[self.order]
        self.square = (self.sorted ** 2).sum(1)
        self.vectors, self.least_id, self.longest = vectors[self.order], least_id[self.order], square

    def search(self, q: np.ndarray, k: int, factor: float) -> np.ndarray:
        """Rows of the k best found for each query (-1 where there are fewer): highest score first, ties to the smaller id."""
        self.raw, self.factor = q, factor
        self.q = np.concatenate([q, np.zeros((len(q), 1))], 1)
        self.q_square = (q ** 2).sum(1)
        self.slack = SLACK * (self.q_square + self.longest)
        self.best = np.full((len(q), k), -np.inf)
        self.names = np.full((len(q), k), np.iinfo(np.int64).max)
        self.found = np.full((len(q), k), -1, np.int64)
        self.reach2 = np.full(len(q), np.inf)  # squared distance of the k-th, with its slack
        self.reach = np.full(len(q), np.inf)
        self.seen = 0
        self._visit(0, np.arange(len(q)))
        return self.found

    def _leaf(self, lo: int, hi: int, who: np.ndarray) -> None:
        k = self.best.shape[1]
        self.seen += len(who) * (hi - lo)
        d = self.q_square[who, None] + self.square[None, lo:hi] - 2 * (self.q[who] @ self.sorted[lo:hi].T)
        row, col = np.nonzero(d <= self.reach2[who, None])
        if not len(row):
            return
        # rows within reach are scored exactly and join the candidates; each query keeps its k best
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        shape = len(who), int(rank.max()) + 1
        score, name, at = np.full(shape, -np.inf), np.full(shape, np.iinfo(np.int64).max), np.full(shape, -1, np.int64)
        for i in range(0, len(row), STEP):
            r, c, n = row[i:i + STEP], lo + col[i:i + STEP], rank[i:i + STEP]
            score[r, n] = (self.raw[who[r]] * self.vectors[c]).sum(1)
            name[r, n], at[r, n] = self.least_id[c], self.order[c]
        use = np.unique(row)
        mine = who[use]
        score, name, at = (np.concatenate([old[mine], new[use]], 1) for old, new in ((self.best, score), (self.names, name), (self.found, at)))
        pick = np.lexsort((name, -score), axis=1)[:, :k]
        self.best[mine], self.names[mine], self.found[mine] = (np.take_along_axis(x, pick, 1) for x in (score, name, at))
        self.reach2[mine] = np.maximum(self.q_square[mine] + self.longest - 2 * self.best[mine, -1], 0) + self.slack[mine]
        self.reach[mine] = np.sqrt(self.reach2[mine])

    def _visit(self, at: int, who: np.ndarray) -> None:
        node = self.nodes[at]
        if len(node) == 2:
            self._leaf(*node, who)
            return
        _, _, far, *children = node
        d = np.linalg.norm(self.q[who] - self.x[far], axis=1)
        inner = d < (children[2] + children[4]) / 2
        sides = (children[:3], children[3:])
        for first in (True, False):  # the nearer child of each query, then the other one if it may hold nearer rows
            for side, mine in ((sides[0], inner), (sides[1], ~inner)):
                go = mine if first else ~mine
                child, low, high = side
                bound = np.maximum(np.maximum(low - d, d - high), 0)
                use = who[go & (bound * self.factor <= self.reach[who])]
                if len(use):
                    self._visit(child, use)


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, all components finite."""
    finite = F.forall(vector, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _extended(x: np.ndarray, square: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(square - (x ** 2).sum(1), 0))[:, None]], 1)


def _grow(part: pd.DataFrame) -> pd.DataFrame:
    x, square = np.array(part["v"].tolist(), np.float64), float(part["square"].iloc[0])
    names = [np.sort(np.array(i, np.int64)) for i in part["ids"]]
    tree = Tree(_extended(x, square))
    tree.finish(x, np.array([n[0] for n in names], np.int64), square)
    return pd.DataFrame({"shard": part["shard"].iloc[:1], "tree": [pickle.dumps((tree, x, names), 5)]})


def _search(k: int, factor: float):
    def answers(state, ids: list[int], vectors: list) -> pd.DataFrame:
        tree, x, names = state
        q = np.array(vectors, np.float64)
        found = tree.search(q, k + 1, factor)  # one may be the query's own
        out = []
        for i, me in enumerate(ids):
            rows = found[i][found[i] >= 0]
            score = (q[i][None, :] * x[rows]).sum(1)
            hits = [(s, n) for s, r in zip(score, rows, strict=True) for n in names[r] if n != me]
            hits.sort(key=lambda h: (-h[0], h[1]))
            out += [(me, n, s) for s, n in hits[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, ids, vectors = None, [], []
        for part in parts:
            for r in part.itertuples(index=False):
                if r.tree is not None:
                    if ids:
                        yield answers(state, ids, vectors)
                    state, ids, vectors = pickle.loads(r.tree), [], []
                    continue
                ids.append(r.query_id)
                vectors.append(r.v)
                if len(ids) == BLOCK:
                    yield answers(state, ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield answers(state, ids, vectors)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest inner products found for each query among all other ids.

    ``vectors`` and ``queries`` hold ``vec_id, embedding``. Ranks start at 1, ties
    go to the smaller vec_id; a query with fewer candidates has fewer rows.
    Vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do ids that are null. Vectors of different lengths are searched
    apart. Equal vectors are searched as one. Repeated ids are answered and found once per distinct
    vector. Empty tables give no rows.
    """
    schema = "query_id long, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("query_id").isNotNull())
    asked = asked.dropDuplicates(["query_id", "v"])
    spark = vectors.sparkSession
    # a query needs k other ids at most, so of equal vectors the k + 1 least ids stand for all; salted, as one vector may be very common
    ids = rows.select("id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")).distinct()
    for salt in (F.pmod(F.xxhash64("id"), F.lit(64)), F.lit(0)):
        least = Window.partitionBy("h", "g", salt).orderBy("id")
        ids = ids.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1).drop("n")
    groups = ids.groupBy("h", "g").agg(F.collect_list("id").alias("ids"), F.min("id").alias("id"))
    distinct = groups.join(rows.dropDuplicates(["id", "v"]), "id").filter((F.xxhash64("v") == F.col("h")) & (F.xxhash64(F.lit(1), "v") == F.col("g")))
    kept = session.cut(distinct.select("ids", "v", "h"), "vectors")
    # a row for each length that occurs: its longest vector, and the numbers of its shards
    length = F.aggregate("v", F.lit(0.0), lambda s, a: s + a * a)
    before = Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)
    dims = kept.groupBy(F.size("v").alias("dim")).agg(F.max(length).alias("square"), F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dims = session.cut(dims.withColumn("first", F.coalesce(F.sum("shards").over(before), F.lit(0)).cast("int")), "lengths")
    if dims.limit(1).count() == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed = kept.join(dims, F.size("v") == F.col("dim")).withColumn("shard", (F.col("first") + F.pmod("h", F.col("shards"))).cast("int"))
    trees = session.cut(placed.select("shard", "square", "ids", "v").groupBy("shard").applyInPandas(_grow, "shard int, tree binary"), "trees")
    blocks = max(1, -(-asked.count() // QUERIES_PER_TASK))
    asked = asked.join(dims, F.size("v") == F.col("dim"))
    every = F.explode(F.sequence("first", F.col("first") + F.col("shards") - 1)).alias("shard")
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    # each block of queries meets each shard's tree once; within a task the tree comes first
    work = trees.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "tree",
                        F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("v")).unionByName(
        asked.select(every, part.alias("block"), F.lit(None).cast("binary").alias("tree"), "query_id", "v"))
    work = work.repartition("shard", "block").sortWithinPartitions("shard", "block", F.col("query_id").asc_nulls_first())
    found = work.select("tree", "query_id", "v").mapInPandas(_search(k, factor), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op5_vantage_trees")
def op5_vantage_trees(spark, sf):
    rows = table(spark, sf, "embeddings")
    return nearest(rows, rows.filter("vec_id % 20 = 0"))

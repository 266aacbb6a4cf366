"""Ranked lexical search by an FP-tree of documents.

Documents are restricted to the terms of the queries. A shard's term vectors, in
order of falling document frequency, form a trie whose nodes stand for documents
that share a beginning. A node keeps its documents' largest frequency of each term
and their least length norm; both bound any score below it. The trie is walked
depth first, for all items at once, and a node is left out for the items whose
tenth score so far it cannot reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.llm.memory import bound_batches, give_back
from skyquilt.llm.queries import query, table
from skyquilt.llm.raw import FOLD, spread, steps
from skyquilt.llm.shingles import Hasher

TOP = 10
#: Characters of queries that are searched at once; what a block sends to the tasks is of this order.
BLOCK_CHARS = 4_000_000
#: Documents and entries of one tree, and documents below which a node is not parted further.
SHARD, SHARD_ENTRIES, LEAF = 8_192, 4_000_000, 64
#: Nodes on a path; what branches below is one leaf.
LEVELS = 200
VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"


def item_terms(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").translate(FOLD).split())


def item_blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """Items with their terms, in blocks of about ``size`` characters; rows of one id are one item."""
    chars = F.coalesce(F.length("text"), F.lit(0)) + 16
    total = items.agg(F.sum(chars)).first()[0] or 0
    blocks = -(-total // size)
    for b in range(blocks):
        rows = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        found: dict[int | None, set[bytes]] = {}
        for item, text in rows.select("item_id", "text").toLocalIterator():
            found.setdefault(item, set()).update(item_terms(text))
        yield list(found.items())


class Vocabulary:
    """Terms of a block of items by their 64-bit hashes."""

    def __init__(self, terms: list[bytes]):
        hashed, _ = Hasher().words(terms)
        order = np.argsort(hashed)
        self.hashes, self.ids = hashed[order], order.astype(np.int32)
        if len(np.unique(self.hashes)) < len(terms):
            raise ValueError("two terms have one hash")
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places that hold a term, and its number."""
        at = np.flatnonzero(self.bits[(hashed >> np.uint64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, hashed[at]), len(self.hashes) - 1)
        same = self.hashes[k] == hashed[at]
        return at[same], self.ids[k[same]]


def vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``(doc_id, n, terms, tfs)``: number of all terms, and frequency of each that the items hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = Vocabulary(terms), Hasher()
        for batch in batches:
            for rows, texts in steps(batch):
                value, counts = hasher.words([t.translate(FOLD) for t in texts])
                at, term = known.find(value) if len(terms) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
                doc = np.searchsorted(np.cumsum(counts), at, side="right")
                key, tf = np.unique(doc * max(1, len(terms)) + term, return_counts=True)
                doc, term = np.divmod(key, max(1, len(terms)))
                edges = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(counts.astype(np.int64)),
                     pa.ListArray.from_arrays(edges, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(edges, pa.array(tf.astype(np.int32)))],
                    ["doc_id", "n", "terms", "tfs"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, VECTORS)


@dataclass(frozen=True)
class Queries:
    """Items as postings: the items of term t are ``items[starts[t]:starts[t + 1]]``; ``weight`` and ``rank`` by term."""

    count: int
    items: np.ndarray
    starts: np.ndarray
    weight: np.ndarray
    rank: np.ndarray

    @staticmethod
    def of(found: list[set[bytes]], number: dict[bytes, int], df: np.ndarray, n_docs: int) -> Queries:
        pairs = sorted((number[t], i) for i, terms in enumerate(found) for t in terms)
        term = np.array([p[0] for p in pairs], np.int64)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
        return Queries(len(found), np.array([p[1] for p in pairs], np.int64), np.searchsorted(term, np.arange(len(df) + 1)), weight, rank)


def saturated(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Node:
    """Documents ``lo`` to ``hi`` of the sorted shard, with their largest frequencies and least norm."""

    lo: int
    hi: int
    children: list[Node]
    terms: np.ndarray
    tf_max: np.ndarray
    m_min: int


def _grouped(cuts: list[int]) -> Iterator[tuple[int, int, bool]]:
    """Branches between the cuts, and whether each is one alone: neighbours of LEAF documents at most together share a leaf."""
    begin, branches = cuts[0], 0
    for here, end in zip(cuts[:-1], cuts[1:]):
        if branches and end - begin > LEAF:
            yield begin, here, branches == 1
            begin, branches = here, 0
        branches += 1
    yield begin, cuts[-1], branches == 1


class Tree:
    """The FP-tree of one shard, and the best documents found in it for each item."""

    def __init__(self, doc: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, queries: Queries, top: int):
        self.queries, self.top = queries, top
        rank = queries.rank[terms]
        owner = np.repeat(np.arange(len(doc)), sizes)
        inside = np.lexsort((rank, owner))
        rank, terms, tfs = rank[inside], terms[inside], tfs[inside]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        coded = rank.astype(">u4")
        paths = [coded[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        order = np.array(sorted(range(len(doc)), key=paths.__getitem__), np.int64)
        self.doc, self.m, sizes = doc[order], m[order], sizes[order]
        moved = spread(edges[:-1][order], sizes)
        self.rank, self.terms, self.tfs = rank[moved], terms[moved], tfs[moved]
        self.edges = np.concatenate([[0], np.cumsum(sizes)])
        self.most = np.zeros(len(queries.weight), np.int64)
        self.item = np.zeros(0, np.int64)
        self.found = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.least = np.ones(queries.count, np.int64)  # a score must be above 0
        self.visited = 0
        self.root = self._node(0, len(doc), 0)

    def _node(self, lo: int, hi: int, depth: int, level: int = 0) -> Node:
        """Node of documents that share ``depth`` terms; it is a leaf if they are few, equal, or LEVELS nodes down."""
        a, b = self.edges[lo], self.edges[hi]
        np.maximum.at(self.most, self.terms[a:b], self.tfs[a:b])
        terms = np.unique(self.terms[a:b])
        node = Node(lo, hi, [], terms, self.most[terms], int(self.m[lo:hi].min()))
        self.most[terms] = 0
        while hi - lo > LEAF and level < LEVELS:
            at = self.edges[lo:hi] + depth
            inside = at < self.edges[lo + 1:hi + 1]
            step = np.where(inside, self.rank[np.minimum(at, len(self.rank) - 1)], -1)
            cuts = [lo, *(np.flatnonzero(step[1:] != step[:-1]) + 1 + lo).tolist(), hi]
            if len(cuts) > 2:
                node.children = [self._node(c, d, depth + 1 if one else depth, level + 1 if one else LEVELS) for c, d, one in _grouped(cuts)]
                break
            if not inside[0]:
                break  # equal vectors
            depth += 1  # a term that all share makes the path longer, not the tree deeper
        return node

    def _sums(self, terms: np.ndarray, value: np.ndarray, row: np.ndarray | None = None, rows: int = 1, keep: np.ndarray | None = None) -> np.ndarray:
        """Sum of ``value`` over the items of ``terms``, for each row and item: whole numbers below 2 ** 53."""
        q = self.queries
        count = q.starts[terms + 1] - q.starts[terms]
        item = q.items[spread(q.starts[terms], count)]
        value = np.repeat(value, count)
        at = item if row is None else np.repeat(row, count) * q.count + item
        if keep is not None:
            use = keep[item]
            at, value = at[use], value[use]
        return np.bincount(at, weights=value, minlength=rows * q.count).astype(np.int64).reshape(rows, q.count)

    def _bound(self, node: Node) -> np.ndarray:
        return self._sums(node.terms, self.queries.weight[node.terms] * saturated(node.tf_max, node.m_min))[0]

    def search(self) -> None:
        stack = [(self.root, self._bound(self.root))]
        while stack:
            node, bound = stack.pop()
            active = bound >= self.least
            if not active.any():
                continue
            self.visited += 1
            if not node.children:
                self._leaf(node, active)
                continue
            below = [(child, self._bound(child)) for child in node.children]
            stack.extend(sorted(below, key=lambda x: int(x[1][active].sum())))  # the best child is taken next

    def _leaf(self, node: Node, active: np.ndarray) -> None:
        for lo in range(node.lo, node.hi, 4 * LEAF):
            hi = min(node.hi, lo + 4 * LEAF)
            a, b = self.edges[lo], self.edges[hi]
            row = np.repeat(np.arange(hi - lo), np.diff(self.edges[lo:hi + 1]))
            terms = self.terms[a:b]
            value = self.queries.weight[terms] * saturated(self.tfs[a:b], self.m[lo:hi][row])
            scores = self._sums(terms, value, row, hi - lo, active)
            doc, item = np.nonzero((scores >= self.least) & active)
            if doc.size:
                self._add(item, self.doc[lo:hi][doc], scores[doc, item])

    def _add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Keep the best ``top`` of each item, ties to the smaller id."""
        item, doc, score = np.concatenate([self.item, item]), np.concatenate([self.found, doc]), np.concatenate([self.score, score])
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.top
        full = place == self.top - 1
        self.least[item[full]] = np.maximum(1, score[full])
        self.item, self.found, self.score = item[keep], doc[keep], score[keep]


NO_ID = np.iinfo(np.int64).max


def best_of_shards(rows: DataFrame, queries: Queries, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """``(item, doc_id, score)``: the best ``top`` of each shard of the rows of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        docs = entries = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            doc = t.column("doc_id").fill_null(NO_ID).to_numpy()
            n = t.column("n").to_numpy()
            lists, tfs = (t.column(c).combine_chunks() for c in ("terms", "tfs"))
            sizes = lists.value_lengths().to_numpy()
            tree = Tree(doc, 10 + (90 * n * n_docs) // n_terms, sizes, lists.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64), queries, top)
            tree.search()
            ids = pa.array(tree.found, mask=tree.found == NO_ID)
            return pa.RecordBatch.from_arrays([pa.array(tree.item.astype(np.int32)), ids, pa.array(tree.score)], ["item", "doc_id", "score"])

        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                more = len(part.column("terms").flatten())
                if held and (docs + part.num_rows > SHARD or entries + more > SHARD_ENTRIES):
                    yield flush()
                    held, docs, entries = [], 0, 0
                held.append(part)
                docs, entries = docs + part.num_rows, entries + more
        if held:
            yield flush()
        give_back()

    return rows.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item with a score above 0.

    Equal scores go by ascending id. A null or empty text has no term; an item
    without a term that a document holds has no row. Rows of ``items`` with one id
    are one item (null is an id). Repeated rows of ``docs`` are documents of their
    own, and one with a null id stands behind equal scores. No rows on either
    side: no rows. Columns besides the ids and texts are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    out = []
    for found in item_blocks(items, block_chars):
        terms = sorted(set().union(*(t for _, t in found)))
        number = {t: k for k, t in enumerate(terms)}
        rows = session.cut(vectors(docs, terms), "vectors")
        n_docs, n_terms = rows.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        rows = rows.filter(F.size("terms") > 0)
        df = np.zeros(len(terms), np.int64)
        for term, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
            df[term] = n
        queries = Queries.of([t for _, t in found], number, df, n_docs)
        best = best_of_shards(rows, queries, n_docs, max(1, n_terms), top)
        ids = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(found)], "item int, item_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        out.append(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))  # a block's items
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
SQL = f"""
with t as (select doc_id, unnest(regexp_extract_all(text, '{WORD}')) as w from documents),
l as (select doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from t),
f as (select doc_id, w, count(*) as tf from l group by all),
d as (select doc_id, sum(tf)::bigint as n from f group by all),
c as (select count(*)::bigint as nd, sum(n)::bigint as nl from d),
q as (select distinct item_id, translate(unnest(regexp_extract_all(text, '{WORD}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from benchmark),
v as (select w, floor(1000 * ln((2 * max(nd) + 2)::double / (2 * count(*) + 1)))::bigint as weight from f, c group by w),
s as (select q.item_id, f.doc_id, sum(v.weight * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * d.n * c.nd) // c.nl))))::bigint as score
      from q join f using (w) join v using (w) join d using (doc_id), c group by all),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0)
select * from r where rank <= {TOP}
"""


@query("op13_document_tree", SQL)
def op13_document_tree(spark, sf):
    return search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))

"""Ranked search by an FP-tree against a direct score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.llm import ranked_search
from skyquilt.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [w.translate(UPPER) for w in TERM.findall(text or "")]


def direct(docs, items, top=10):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, all_terms = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    out = []
    for item, q in queries.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in q}
        scored = []
        for i, c, n in found:
            m = 10 + 90 * n * n_docs // all_terms
            s = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s > 0:
                scored.append((-s, math.inf if i is None else i, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:top])]
    return sorted(out, key=str)


def test_query_equals_direct_scores(spark):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*c).collect()]
    got = QUERIES["op13_document_tree"](spark, SF)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == direct(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))


def test_odd_rows(spark):
    docs = [(None, None), (1, ""), (2, " .,"), (3, " ".join(f"w{i} Red" for i in range(40_000))), (4, "red Blue é"), (4, "red Blue é"), (None, "red Blue é"),
            (5, "RED|blue|É"), *((i, "red blue") for i in range(6, 400)), *((i, f"red x{i % 7} blue y{i % 3}") for i in range(400, 700))]
    items = [(1, "red blue"), (2, None), (3, ""), (None, "é x3"), (4, "no such"), (1, "y1 red"), (5, "É")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("mine"), "score": F.lit(None), "terms": F.lit(1)})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit("mine"), "rank": F.lit(0)})
    for size in (ranked_search.BLOCK_CHARS, 30):
        assert sorted((tuple(r) for r in ranked_search.search(df, q, block_chars=size).collect()), key=str) == direct(docs, items)
    assert ranked_search.search(df.limit(0), q).collect() == [] == ranked_search.search(df, q.limit(0)).collect()


@pytest.mark.parametrize("seed", range(4))
def test_tree_prunes_and_stays_exact(seed):
    rng = np.random.default_rng(seed)
    n, v, top = 3_000, 60, 5
    weights = 1 / np.arange(1, v + 1)
    rows = [np.unique(rng.choice(v, rng.integers(1, 12), p=weights / weights.sum())) for _ in range(n)]
    if seed == 3:  # every document begins like the one before, so each level parts one from the rest
        rows, v = [np.arange(min(k + 1, 900)) for k in range(1_500)], 900
        n = len(rows)
    sizes, term = np.array([len(r) for r in rows]), np.concatenate(rows)
    tf = rng.integers(1, 6, len(term)).astype(np.int64)
    doc, m = rng.permutation(n).astype(np.int64), rng.integers(10, 400, n)
    found = [{int(t) for t in rng.choice(v, 4, replace=False)} for _ in range(20)]
    df = np.bincount(term, minlength=v)
    q = ranked_search.Queries.of(found, {t: t for t in range(v)}, df, n)
    tree = ranked_search.Tree(doc, m, sizes, term, tf, q, top)
    tree.search()
    got = sorted(zip(tree.item.tolist(), (-tree.score).tolist(), tree.found.tolist()))
    owner, want = np.repeat(np.arange(n), sizes), []
    for k, terms_ in enumerate(found):
        value = np.where(np.isin(term, list(terms_)), q.weight[term] * ranked_search.saturated(tf, m[owner]), 0)
        s = np.bincount(owner, weights=value, minlength=n).astype(int)
        want += sorted((k, -int(s[i]), int(doc[i])) for i in range(n) if s[i] > 0)[:top]
    assert got == want
    nodes, stack = 0, [tree.root]
    while stack:
        node = stack.pop()
        nodes += 1
        stack += node.children
    assert nodes > 5 and tree.visited < nodes

"""Importance resampling against a direct computation, and CRC-32 of spans against the library's."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.llm import crc, importance
from skyquilt.llm.queries import QUERIES
from skyquilt.llm.raw import Words

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def direct(docs, target, percent=25, least=20):
    """The contract's rows, one document after the other."""
    def features(text):
        w = WORD.findall((text or "").translate(UPPER))
        return w, [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    found = [(i, *features(t)) for i, t in docs]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, _, fs in found:
        np.add.at(s, fs, 1)
    for text in target:
        np.add.at(t, features(text)[1], 1)
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (S + 10_000) / ((int(s[b]) + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for i, w, fs in found:
        weight = sum(gain[b] for b in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], -r[1], -r[2]))
    drawn = percent * len(fit) // 100
    place = {id(r): k + 1 for k, r in enumerate(fit[:drawn])}
    return sorted(((*r[:4], place.get(id(r))) for r in rows), key=str)


def test_query_equals_a_direct_computation(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op11_importance_resampling"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and set(t for _, t in got.dtypes) == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == direct(docs, target)


def test_odd_rows(spark):
    long = " ".join(f"w{i} " + "é" * (i % 90) for i in range(60_000))
    rows = [(None, None), (1, ""), (2, " \n\t"), (3, long), (4, "a b " * 15), (4, "a b " * 15), (None, "x\x00y Ab9 " * 20), (7, "Z" * 300 + " " + "q" * 70_000)]
    rows += [(i, f"one two three {i} " * 8) for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rank": F.lit("mine"), "total": F.lit(1), "score": F.lit(None)})
    target = spark.createDataFrame([("one two",), (None,), ("",)], "text string")
    got = importance.resample(df, target)
    assert sorted((tuple(r) for r in got.collect()), key=str) == direct(rows, ["one two", None, ""])
    assert importance.drawn_documents(df.filter("doc_id >= 10"), target).count() == 7
    assert importance.resample(df.limit(0), target.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_crc_of_spans_of_any_length(seed):
    rng = random.Random(seed)
    sizes = [0, 1, 31, 63, 64, 65, 127, 128, 129, 1000, 70_001]
    texts = [" ".join("".join(rng.choice("abXY09éñ") for _ in range(rng.choice(sizes[:9]))) for _ in range(rng.choice([0, 1, 2, 30]))).encode() for _ in range(200)]
    w = Words(texts)
    one, two = crc.word_features(w)
    k = 0
    for i, text in enumerate(texts):
        ws = [x.encode() for x in WORD.findall(text.decode().translate(UPPER))]
        assert w.counts[i] == len(ws)
        for j, x in enumerate(ws):
            assert one[k] == zlib.crc32(x)
            assert j + 1 == len(ws) or two[k] == zlib.crc32(x + b" " + ws[j + 1])
            k += 1
    buf = np.frombuffer(rng.randbytes(80_000), np.uint8)
    first = np.array([rng.randrange(9_000) for _ in sizes])
    assert crc.spans(buf, first, np.array(sizes)).tolist() == [zlib.crc32(buf[f:f + n].tobytes()) for f, n in zip(first, sizes)]


def test_ranks_cross_partitions(spark):
    rows = spark.range(5_000).withColumn("v", F.expr("id * 7919 % 1000"))
    got = importance.ranked(rows.repartition(16), [F.desc("v"), F.asc("id")]).select("id", "rank").collect()
    want = sorted(range(5_000), key=lambda i: (-(i * 7919 % 1000), i))
    assert [i for i, _ in sorted(got, key=lambda r: r.rank)] == want

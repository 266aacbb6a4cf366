"""Removal of repeated strings against a direct search, and the index's parts."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.llm import repeats, run_index
from skyquilt.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def direct(docs, length=50):
    """Spans and kept bytes of each row, by a table of all strings of ``length`` bytes."""
    key = lambda i: float("inf") if i is None else i
    least = {}
    for i, t in sorted(docs, key=lambda r: key(r[0])):
        t = (t or "").encode()
        for p in range(len(t) - length + 1):
            least.setdefault(t[p:p + length], key(i))
    out = []
    for i, t in docs:
        t = (t or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if least[t[p:p + length]] < key(i):
                gone[p:p + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        out.append((i, len(t), [(int(a), int(b)) for a, b in zip(edge[0::2], edge[1::2])], bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=str)


def test_query_equals_a_direct_search(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_run_index"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    want = [(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in direct(docs)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 100_000


def texts(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    pool = [" ".join(word() for _ in range(rng.choice([5, 12, 40, 200]))) for _ in range(8)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            t += rng.choice([p, p[a:a + 49], p[a:a + 50], p[a:a + 51], "=" * rng.choice([40, 60, 300]), "ab" * 80, "\x00" * 70, word() + " "])
        out.append(t)
    return out


@pytest.mark.parametrize("seed,hot,bucket", [(0, 4_096, 4 << 20), (1, 0, 2_000), (2, 1, 500), (3, 2, 4 << 20)])
def test_any_texts(spark, seed, hot, bucket):
    rng = random.Random(seed)
    docs = [(rng.randrange(200), t) for t in texts(seed)]
    docs += [(None, None), (None, docs[3][1]), (5, ""), (None, "x" * 120), (-7, "x" * 90 + "y" * 60), (500, docs[9][1] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumns({"home": F.lit("mine"), "data": F.lit(1), "kept": F.lit(None)})
    assert rows_of(repeats.remove_repeats(df, hot=hot, bucket_bytes=bucket)) == direct(docs)


def test_empty_table_and_another_length(spark):
    docs = list(enumerate(texts(9, 40)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert repeats.remove_repeats(df.limit(0)).collect() == []
    assert rows_of(repeats.remove_repeats(df, length=33)) == direct(docs, 33)


def test_equal_windows_have_equal_anchors():
    s = run_index.Segments([t.encode() for t in texts(4)], 50)
    seen = defaultdict(set)
    raw = s.buf.tobytes()
    for a, n, b, h in zip(s.start.tolist(), s.count.tolist(), s.before.tolist(), s.anchor.tolist()):
        assert 0 <= b - n + 1 and b <= 34
        for w in range(n):
            seen[raw[a + w:a + w + 50]].add((h, b - w))
    assert all(len(v) == 1 for v in seen.values())
    assert sum(s.count) == sum(max(0, len(t.encode()) - 49) for t in texts(4))


def test_runs_are_fewer_than_rows_where_texts_repeat():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3_000))
    docs = [base[:1_000 + 17 * k] + str(k) + base[1_000 + 17 * k:] for k in range(60)]
    s = run_index.Segments([t.encode() for t in docs], 50)
    index = run_index.RunIndex(s.buf, s.start, s.count, s.before, s.text_of(s.start), 50)
    mask = index.repeated()
    assert index.n_runs * 10 < index.n_rows
    assert [int(m).bit_count() for m in mask[s.start < len(docs[0])]] == [0] * int((s.start < len(docs[0])).sum())


def test_arrays_survive_packing():
    arrays = [np.arange(9, dtype=np.uint64), np.zeros(0, np.int64), np.frombuffer(b"abc", np.uint8), np.array([-1, 5], np.int32)]
    for a, b in zip(arrays, repeats.load(repeats.dump(*arrays))):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()

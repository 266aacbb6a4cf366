"""Suffix-array dedup: bytes covered by strings that begin in an earlier document too.

Texts are packed once into batches. Batches send the hashes of their anchors
(``run_index``) to buckets, which answer with those that another document has; only
segments around these are sent, once for each batch and content, and indexed by
bucket. The answers go back to the batches as bit masks. So no table of all
positions is made, and a copy that half of the documents hold costs one row for
each batch.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.llm.memory import bound_batches, give_back
from skyquilt.llm.queries import query, table
from skyquilt.llm.raw import spread, texts_of
from skyquilt.llm.run_index import RunIndex, Segments, matrix, row_hash

LENGTH = 50
#: Bytes of texts in a batch (a longer text is a batch of its own) and in a bucket's share.
HOME_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
#: Batches that may hold an anchor before its windows are dealt out one by one.
HOT = 4_096
NO_ID = np.iinfo(np.int64).max
ROUTED = "bucket long, home long, data binary"
RESULT = "doc_id long, n_bytes long, spans array<struct<first:long,end:long>>, kept binary"


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, planes of equal bytes together."""
    out = io.BytesIO()
    press = zstandard.ZstdCompressor(level=3)
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else a
        data = press.compress(planes.tobytes())
        out.write(struct.pack("<4sQQ", a.dtype.str.encode().ljust(4), len(a), len(data)) + data)
    return out.getvalue()


def load(data: bytes) -> list[np.ndarray]:
    out, at, free = [], 0, zstandard.ZstdDecompressor()
    while at < len(data):
        kind, n, size = struct.unpack_from("<4sQQ", data, at)
        at += 20
        dtype = np.dtype(kind.decode().strip())
        planes = np.frombuffer(free.decompress(data[at:at + size], max_output_size=max(1, n * dtype.itemsize)), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).ravel() if n else np.zeros(0, dtype))
        at += size
    return out


def rows(bucket: list, home: list, data: list) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int64()), "home": pa.array(home, pa.int64()), "data": pa.array(data, pa.binary())})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts, numbered by their task; ``cut`` writes them, so the numbers stay."""
    task, number = TaskContext.get().partitionId(), 0
    ids, texts, held = [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal number
        number += 1
        data = dump(np.array(ids, np.int64), np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | number]), pa.array([held]), pa.array([data], pa.binary())], ["home", "size", "data"])

    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            if texts and held + len(t) > HOME_BYTES:
                yield flush()
                ids, texts, held = [], [], 0
            ids.append(NO_ID if i is None else i)
            texts.append(t)
            held += len(t)
    if texts:
        yield flush()
    give_back()


def _open(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    ids, sizes, raw = load(data)
    raw, ends = raw.tobytes(), np.cumsum(sizes)
    return ids, [raw[e - n:e] for n, e in zip(sizes.tolist(), ends.tolist())]


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def _anchors(buckets: int, length: int):
    """Each anchor of a batch, twice its hash and one more if two of its texts have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, data in zip(batch.column("home").to_pylist(), batch.column("data").to_pylist()):
                _, texts = _open(data)
                s = Segments(texts, length)
                owner = s.text_of(s.start)
                order = np.argsort(s.anchor, kind="stable")
                anchor, owner = s.anchor[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
                last = np.append(first[1:], len(anchor)) - 1
                anchor, several = anchor[first], owner[first] != owner[last]
                out = [], []
                for bucket, at in _dealt((anchor % np.uint64(buckets)).astype(np.int64)):
                    value = anchor[at] * np.uint64(2) + several[at]
                    out[0].append(bucket)
                    out[1].append(dump(np.diff(value, prepend=np.uint64(0))))
                yield from rows(out[0], [home] * len(out[0]), out[1]).to_batches()
        give_back()

    return run


def _shared(hot: int):
    """For each batch its anchors that another document has, with a bit for those of more than ``hot`` batches."""
    def run(group: pa.Table) -> pa.Table:
        homes = group.column("home").to_pylist()
        value = [np.cumsum(load(d)[0]) for d in group.column("data").to_pylist()]
        owner = np.repeat(np.arange(len(homes)), [len(v) for v in value])
        value = np.concatenate(value)
        order = np.argsort(value >> np.uint64(1), kind="stable")
        anchor, several, owner = value[order] >> np.uint64(1), value[order] & np.uint64(1), owner[order]
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(first, len(anchor)))
        keep = np.repeat((count > 1) | (np.maximum.reduceat(several, first) > 0), count)
        answer = (anchor * np.uint64(2) + np.repeat(count > hot, count))[keep]
        out = [], []
        for k, at in _dealt(owner[keep]):
            out[0].append(homes[k])
            out[1].append(dump(np.diff(answer[at], prepend=np.uint64(0))))
        return rows([0] * len(out[0]), *out)

    return run


def _segments(buckets: int, length: int):
    """The segments of a batch around shared anchors, by bucket, and what the batch itself decides (bucket below 0)."""
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        if not packs.num_rows or not answers.num_rows:
            return rows([], [], [])
        home = packs.column("home")[0].as_py()
        ids, texts = _open(packs.column("data")[0].as_py())
        s = Segments(texts, length)
        known = np.sort(np.concatenate([np.cumsum(load(d)[0]) for d in answers.column("data").to_pylist()]))
        k = np.minimum(np.searchsorted(known, s.anchor * np.uint64(2)), len(known) - 1)
        shared = known[k] >> np.uint64(1) == s.anchor
        hot = shared & (known[k] & np.uint64(1) > 0)
        calm = np.flatnonzero(shared & ~hot)
        out: tuple[list, list] = ([], [])

        def ship(start, count, before, route, step=1 << 17):
            """One row for each content, sent by its least document; copies in this batch refer to it."""
            width = -(-(2 * length) // 8) * 8
            value = np.concatenate([row_hash(matrix(s.buf, start[i:i + step], count[i:i + step] + length - 1, width)) for i in range(0, len(start), step)])
            value = (value * np.uint64(2 * length) + count.astype(np.uint64)) * np.uint64(2 * length) + before.astype(np.uint64)
            doc = ids[s.text_of(start)]
            order = np.lexsort((start, doc, value))
            group = value[order]
            new = np.concatenate([[True], group[1:] != group[:-1]])
            rep = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            # equal hashes are checked byte by byte; what differs is sent for itself
            copy = np.flatnonzero(~new)
            good = np.zeros(len(copy), bool)
            for i in range(0, len(copy), step):
                a, b = order[copy[i:i + step]], rep[copy[i:i + step]]
                size = np.where((count[a] == count[b]) & (before[a] == before[b]), count[a] + length - 1, 0)
                good[i:i + step] = (size > 0) & (matrix(s.buf, start[a], size, width) == matrix(s.buf, start[b], size, width)).all(1)
            a, b = order[copy[good]], rep[copy[good]]
            later = doc[b] < doc[a]
            full = (np.uint64(1) << count[a[later]].astype(np.uint64)) - np.uint64(1)
            out[0].append(-1 - home)
            out[1].append(dump(start[a[later]].astype(np.uint32), full, start[a[~later]].astype(np.uint32), start[b[~later]].astype(np.uint32)))
            sent = np.sort(np.concatenate([order[new], order[copy[~good]]]))
            if route is None:
                to = np.concatenate([row_hash(matrix(s.buf, start[sent[i:i + step]], np.full(len(sent[i:i + step]), length), width)) for i in range(0, len(sent), step)])
            else:
                to = route[sent]
            for bucket, at in _dealt((to % np.uint64(buckets)).astype(np.int64)):
                i = sent[at]
                out[0].append(bucket)
                out[1].append(dump(start[i].astype(np.uint32), doc[i], count[i].astype(np.uint8), before[i].astype(np.uint8), s.buf[spread(start[i], count[i] + length - 1)]))

        if len(calm):
            ship(s.start[calm], s.count[calm], s.before[calm], s.anchor[calm])
        warm = np.flatnonzero(hot)
        if len(warm):  # windows of their own, dealt by all their bytes
            start = spread(s.start[warm], s.count[warm])
            before = np.repeat(s.start[warm] + s.before[warm], s.count[warm]) - start
            ship(start, np.ones(len(start), np.int64), before, None)
        return rows(out[0], [home] * len(out[0]), out[1])

    return run


def _marks(length: int):
    """For each batch the places and masks of its segments with repeated windows, by one bucket's index."""
    def run(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            return group
        homes = group.column("home").to_pylist()
        parts = [load(d) for d in group.column("data").to_pylist()]
        owner = np.repeat(np.arange(len(homes)), [len(p[0]) for p in parts])
        place, doc, count, before, content = (np.concatenate([p[k] for p in parts]) for k in range(5))
        del parts
        count, before = count.astype(np.int64), before.astype(np.int64)
        size = count + length - 1
        mask = RunIndex(content, np.cumsum(size) - size, count, before, doc, length).repeated()
        hit = np.flatnonzero(mask)
        out = [], []
        for k, at in _dealt(owner[hit]):
            i = hit[at]
            out[0].append(homes[k])
            out[1].append(dump(place[i], mask[i], np.zeros(0, np.uint32), np.zeros(0, np.uint32)))
        return rows([0] * len(out[0]), *out)

    return run


def _removed(length: int):
    """Spans and remaining bytes of each text of a batch."""
    def run(packs: pa.Table, marks: pa.Table) -> pa.Table:
        ids, texts = _open(packs.column("data")[0].as_py())
        ends = np.cumsum([len(t) for t in texts])
        begin = ends - [len(t) for t in texts]
        window = np.zeros(int(ends[-1]) + 1, np.int8)
        found = [load(d) for d in marks.column("data").to_pylist()]
        for place, mask, _, _ in found:
            _set(window, place.astype(np.int64), mask)
        later = [(a, b) for _, _, a, b in found if len(a)]
        if later:  # copies inside a document take the mask of the one that was sent
            place, mask = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            order = np.argsort(place, kind="stable")
            place, mask = place[order], mask[order]
            a, b = np.concatenate([x for x, _ in later]), np.concatenate([x for _, x in later])
            k = np.minimum(np.searchsorted(place, b), max(0, len(place) - 1))
            same = place[k] == b if len(place) else np.zeros(len(b), bool)
            _set(window, a[same].astype(np.int64), mask[k[same]])
        total = np.cumsum(window[:-1], dtype=np.int32)
        total[length:] -= total[:-length].copy()
        gone = total > 0
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]).astype(np.int8))
        # a span ends with its text
        inner = begin[(begin > 0) & (begin < len(gone))]
        split = np.unique(inner[gone[inner] & gone[inner - 1]]) if len(inner) else inner
        first = np.sort(np.concatenate([np.flatnonzero(edge == 1), split]))
        last = np.sort(np.concatenate([np.flatnonzero(edge == -1), split]))
        owner = np.searchsorted(ends, first, side="right")
        at = begin[owner]
        cuts = pa.StructArray.from_arrays([pa.array(first - at), pa.array(last - at)], ["first", "end"])
        offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
        buf = np.frombuffer(b"".join(texts), np.uint8)
        kept = [(buf[a:b][~gone[a:b]]).tobytes() for a, b in zip(begin.tolist(), ends.tolist())]
        return pa.table({"doc_id": pa.array(ids, mask=ids == NO_ID), "n_bytes": pa.array(ends - begin), "spans": pa.ListArray.from_arrays(offsets, cuts),
                         "kept": pa.array(kept, pa.binary())})

    return run


def _set(window: np.ndarray, place: np.ndarray, mask: np.ndarray) -> None:
    for bit in range(64):
        some = (mask >> np.uint64(bit) & np.uint64(1)).astype(bool)
        if some.any():
            window[place[some] + bit] = 1


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for each row of ``docs``.

    ``spans`` are the maximal runs of bytes covered by strings of ``length`` bytes
    (32 to 78) that also begin in a document with a smaller id, ``kept`` the bytes
    outside them. A null text is empty. A null id is larger than every other, and
    rows with one id do not repeat each other. No rows: no rows. Columns besides
    ``doc_id`` and ``text`` are not read.
    """
    bound_batches(docs.sparkSession)
    packs = session.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack, "home long, size long, data binary"), "packs")
    total = packs.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    batches = packs.select("home", "data")
    anchors = batches.mapInArrow(_anchors(buckets, length), ROUTED)
    answers = anchors.groupBy("bucket").applyInArrow(_shared(hot), ROUTED)
    sent = batches.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(_segments(buckets, length), ROUTED)
    marks = sent.groupBy("bucket").applyInArrow(_marks(length), ROUTED)
    return batches.groupBy("home").cogroup(marks.groupBy("home")).applyInArrow(_removed(length), RESULT)


@query("op12_run_index")
def op12_run_index(spark, sf):
    found = remove_repeats(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

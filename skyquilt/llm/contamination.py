"""Benchmark decontamination by the q-gram lemma.

A window of ``length`` bytes and a region at most ``edits`` edits away share at
least ``length - q + 1 - q * edits`` q-grams, on diagonals that lie within
``edits`` of each other. So q-grams shared with benchmark windows are counted in
overlapping bands of diagonals, bands that meet the bound are kept, and each is
verified by banded alignment. Items too short for edits are searched as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.llm.memory import bound_batches, tidy
from skyquilt.llm.queries import query, table
from skyquilt.llm.text import folded

SCHEMA = "doc_id long, text string, item_id long, first long, last long, windows int, edits int"
#: A benchmark is searched in blocks of so many characters; each block is one broadcast.
BLOCK_CHARS = 4_000_000
#: Bytes of text that one step in a task works on (a longer text is a step of its own).
STEP_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Windows of ``length`` bytes every ``stride`` (a shorter item is one window, one below ``shortest`` an exact one)."""

    length: int = 80
    stride: int = 40
    edits: int = 5
    q: int = 10
    shortest: int = 40

    def budget(self, n: int) -> int:
        """Edits allowed in a window of n bytes, in proportion."""
        return self.edits * n // self.length

    def bound(self, n: int) -> int:
        """q-grams that a window of n bytes shares with any region within its budget."""
        return n - self.q + 1 - self.q * self.budget(n)


def windows(text: bytes, s: Settings) -> list[bytes]:
    """Windows of a folded benchmark text; one below ``shortest`` bytes has none, as it is searched whole."""
    if len(text) < s.shortest:
        return []
    starts = list(range(0, max(1, len(text) - s.length + 1), s.stride))
    if starts[-1] + s.length < len(text):
        starts.append(len(text) - s.length)
    return [text[i:i + s.length] for i in starts]


def _grams(buf: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes at each place (8 <= q <= 16)."""
    n = len(buf) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eight[q - 8:q - 8 + n]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """Which leading 20 bits any of the hashes has."""
    bits = np.zeros(1 << 20, bool)
    bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return bits


class Index:
    """q-grams of the windows of one block of a benchmark."""

    def __init__(self, items: list[tuple[int, str | None]], s: Settings):
        self.settings, self.items, self.texts = s, [], []
        whole = []
        for item, text in items:
            text = folded(text)
            if 0 < len(text) < s.shortest:
                whole.append((item, text))
            for w in windows(text, s):
                self.items.append(item)
                self.texts.append(np.frombuffer(w, np.uint8))
        self.short = self._short(whole)
        self.short_bits = _bitmap(np.concatenate([first for *_, first in self.short])) if self.short else None
        grams = [_grams(np.array(w), s.q) for w in self.texts]
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.window = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.offset = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.zeros(0, np.int64)
        self.hashes, self.starts, self.counts = np.unique(hashes[order], return_index=True, return_counts=True)
        self.bits = _bitmap(self.hashes)
        self.bounds = np.array([s.bound(len(w)) for w in self.texts], np.int64)

    def _short(self, whole: list[tuple[int, bytes]]) -> list[tuple[int, np.ndarray, list[list[int]], np.ndarray]]:
        """Length, texts in order, windows of each text and first q-grams of the items below ``shortest`` bytes, by length."""
        by_length: dict[int, dict[bytes, list[int]]] = {}
        for item, text in whole:
            by_length.setdefault(len(text), {}).setdefault(text, []).append(len(self.items))
            self.items.append(item)
        out = []
        for n, found in sorted(by_length.items()):
            texts = sorted(found)
            first = [_grams(np.frombuffer(t[:self.settings.q], np.uint8), self.settings.q) for t in texts]
            out.append((n, np.array(texts, f"S{n}"), [found[t] for t in texts], np.unique(np.concatenate(first))))
        return out

    def _exact(self, buf: np.ndarray, begin: np.ndarray, grams: np.ndarray) -> list:
        """First to last exact copy of each short item in each text: any bytes from q on, whole words below that."""
        found = []
        gap = (buf == 32) | (buf == 10)
        starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        likely = np.flatnonzero(self.short_bits[(grams >> np.uint64(44)).astype(np.int64)])
        for n, texts, at, first in self.short:
            if n >= self.settings.q:
                place = likely[np.isin(grams[likely], first)]
                place = place[place + n <= len(buf)]
            else:
                place = starts[gap[starts + n]]  # q separators follow the last text
            if not len(place):
                continue
            bytes_at = np.ndarray((len(buf) - n + 1,), f"S{n}", buf, 0, (1,))[place]
            k = np.minimum(np.searchsorted(texts, bytes_at), len(texts) - 1)
            same = texts[k] == bytes_at
            place, k = place[same], k[same]
            doc = np.searchsorted(begin, place, "right") - 1
            key, low = np.unique(doc * len(texts) + k, return_index=True)
            high = np.zeros(len(key), np.int64)
            np.maximum.at(high, np.searchsorted(key, doc * len(texts) + k), place)
            for pair, a, b in zip(key.tolist(), place[low].tolist(), high.tolist(), strict=True):
                d, t = divmod(pair, len(texts))
                found += [(d, w, int(a - begin[d]), int(b - begin[d]) + n, 0) for w in at[t]]
        return found

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """``(text, window, first byte, last byte, edits)`` of the regions found."""
        s, q = self.settings, self.settings.q
        if not len(self.hashes) and not self.short:
            return []
        buf = np.frombuffer((b"\n" * q).join(texts) + b"\n" * q, np.uint8)
        begin = np.cumsum([0] + [len(t) + q for t in texts])
        grams = _grams(buf, q)
        found = self._exact(buf, begin, grams) if self.short else []
        return sorted(found + self._near(buf, begin, grams)) if len(self.hashes) else sorted(found)

    def _near(self, buf: np.ndarray, begin: np.ndarray, grams: np.ndarray) -> list:
        s, q = self.settings, self.settings.q
        place = np.flatnonzero(self.bits[(grams >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.hashes, grams[place])
        at[at == len(self.hashes)] = 0
        same = self.hashes[at] == grams[place]
        place, at = place[same], at[same]
        # a region holds the least bound of q-grams within the longest window and its edits
        reach, least = s.length + s.edits - q, int(self.bounds.min())
        if not len(place):
            return []
        dense = np.searchsorted(place, place + reach, "right") - np.arange(len(place)) >= least
        cover = np.zeros(len(place) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(dense), 1)
        np.add.at(cover, np.searchsorted(place, place[dense] + reach, "right"), -1)
        keep = np.cumsum(cover[:-1]) > 0
        place, at = place[keep], at[keep]
        return self._bands(buf, begin, place, at)

    def _bands(self, buf, begin, place, at) -> list:
        s, found = self.settings, []
        step = s.edits + 1
        for lo in range(0, len(place), 50_000):  # postings of so many places at a time, with the overlap of a region
            hi = np.searchsorted(place, place[min(lo + 50_000, len(place)) - 1] + 2 * (s.length + 2 * step), "right")
            p, a = place[lo:hi], at[lo:hi]
            n = self.counts[a]
            post = np.repeat(self.starts[a] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            w, o = self.window[post], self.offset[post]
            diagonal = np.repeat(p, n) - o + s.length  # above 0
            for shift in (0, 1):  # band k holds diagonals k * step to (k + 2) * step - 1, so any span of `edits` is in one
                band = diagonal // step - shift
                key = np.unique(np.stack([w, band, o], 1), axis=0) if len(w) < 64 else _distinct(w, band, o)
                if shift == 0:
                    rows = key
                else:
                    rows = _distinct(*np.concatenate([rows, key]).T)
            if not len(rows):
                continue
            new = np.flatnonzero((np.diff(rows[:, 0], prepend=-1) != 0) | (np.diff(rows[:, 1], prepend=-1) != 0))
            size = np.diff(np.append(new, len(rows)))
            good = size >= self.bounds[rows[new, 0]]
            found += self._verify(buf, begin, rows[new[good], 0], rows[new[good], 1] * step - s.length)
        return sorted(set(found))

    def _verify(self, buf, begin, w, low) -> list:
        """Align window w along the diagonals from ``low``, as many windows at once as have one length."""
        s, found = self.settings, []
        lengths = np.array([len(self.texts[i]) for i in w], np.int64)
        for length in np.unique(lengths):
            edits = s.budget(int(length))
            for part in np.array_split(np.flatnonzero(lengths == length), max(1, (lengths == length).sum() // 2048)):
                if not len(part):
                    continue
                width = 2 * (s.edits + 1) + 2 * edits
                start = low[part] - edits
                cost, first, end = align(buf, np.stack([self.texts[i] for i in w[part]]), start, width)
                for i in np.flatnonzero(cost <= edits):
                    # each separator byte in a region is an edit, so they are at its ends and its middle is text
                    doc = int(np.searchsorted(begin, (first[i] + end[i]) // 2, "right")) - 1
                    size = int(begin[doc + 1] - begin[doc]) - s.q
                    found.append((doc, int(w[part[i]]), max(0, int(first[i] - begin[doc])), min(size, int(end[i] - begin[doc])), int(cost[i])))
        return found


def _distinct(w, band, o) -> np.ndarray:
    """Distinct rows in order."""
    w, band, o = (np.asarray(x, np.int64) for x in (w, band, o))
    order = np.lexsort((o, band, w))
    rows = np.stack([w[order], band[order], o[order]], 1)
    return rows[np.concatenate(([True], (np.diff(rows, axis=0) != 0).any(1)))] if len(rows) else rows


def align(buf: np.ndarray, patterns: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits that turn a pattern into a region on diagonals start to start + width - 1, and that region.

    One row per pattern; column b of the state is diagonal ``start + b``. Where
    several regions need as few edits the one that ends first is returned.
    """
    n, length = patterns.shape
    padded = np.concatenate([np.full(length + width, 10, np.uint8), buf, np.full(length + width, 10, np.uint8)])
    base = start[:, None] + np.arange(width)[None, :]
    cost = np.zeros((n, width), np.int32)
    first = base.copy()
    slope = np.arange(width, dtype=np.int32)
    for i in range(length):
        text = padded[np.clip(base + i + length + width, 0, len(padded) - 1)]
        best, origin = cost + (text != patterns[:, i:i + 1]), first
        down = np.concatenate([cost[:, 1:] + 1, np.full((n, 1), 1 << 20, np.int32)], 1)
        up = down < best
        best = np.where(up, down, best)
        origin = np.where(up, np.concatenate([first[:, 1:], first[:, -1:]], 1), origin)
        level = best - slope
        least = np.minimum.accumulate(level, 1)
        source = np.maximum.accumulate(np.where(level == least, slope, 0), 1)
        cost, first = least + slope, np.take_along_axis(origin, source, 1)
    b = cost.argmin(1)
    row = np.arange(n)
    return cost[row, b], first[row, b], base[row, b] + length


def _searcher(share, s: Settings):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = share.value
        for part in parts:
            batch, size = [], 0
            for row in zip(part["n"], part["text"], strict=True):
                if size and size + len(row[1] or "") > STEP_BYTES:
                    yield matched(index, batch)
                    batch, size = [], 0
                batch.append(row)
                size += len(row[1] or "")
            if batch:
                yield matched(index, batch)

    return run


def matched(index: Index, batch: list[tuple[int, str | None]]) -> pd.DataFrame:
    """One row for each document of the batch and benchmark item found in it."""
    best: dict = {}
    texts = [folded(t) for _, t in batch]
    for doc, window, first, end, edits in index.search(texts):
        key = (doc, index.items[window])
        old = best.setdefault(key, [first, end, set(), edits])
        old[:2] = [min(old[0], first), max(old[1], end)]
        old[2].add(window)
        old[3] = min(old[3], edits)
    rows = [(batch[d][0], batch[d][1], item, v[0], v[1], len(v[2]), v[3]) for (d, item), v in best.items()]
    return pd.DataFrame(rows, columns=["doc_id", "text", "item_id", "first", "last", "windows", "edits"])


def matches(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(doc_id, text, item_id, first, last, windows, edits)``: benchmark items found in documents.

    One row per document row and item: the span (bytes of the folded text) of
    the regions found, how many windows of the item were found, and the least
    edits. Null or empty texts match nothing. Items that fold to less than
    ``shortest`` bytes are found as exact copies, those below ``q`` bytes as whole
    words; only an item that folds to nothing is not searched. Repeated
    documents give repeated rows; a null id stays null. Repeated items are
    searched once per row. Empty tables give no rows. Ties in a region go to the
    one that ends first.
    """
    if s.bound(s.length) < 1 or min(s.bound(n) for n in range(s.shortest, s.length + 1)) < 1 or not 8 <= s.q <= 16:
        raise ValueError("the q-gram bound of these settings is below 1, or q is not between 8 and 16")
    spark = docs.sparkSession
    bound_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = -(-int(total) // BLOCK_CHARS)
    rows = docs.select(F.col("doc_id").cast("long").alias("n"), F.col("text").cast("string").alias("text"))
    if not blocks:
        return spark.createDataFrame([], SCHEMA)
    # a benchmark above the bound is a stated query set, searched block by block over all documents
    found = []
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        part = [tuple(r) for r in items.filter(block == k).collect()]
        found.append(rows.mapInPandas(tidy(_searcher(spark.sparkContext.broadcast(Index(part, s)), s)), SCHEMA))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents in which no benchmark item was found, in all their columns.

    A document goes if its id and text were matched, so of rows that share an id
    only those with a matched text go.
    """
    bad = session.cut(matches(docs, benchmark, s).select(F.col("doc_id").alias("bad_id"), F.md5("text").alias("bad_text")).distinct(), "leaks")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("n"), F.col("text").alias("whole"))
    same = F.col("n").eqNullSafe(F.col("bad_id")) & (F.md5("whole") == F.col("bad_text"))
    return rows.join(bad, same, "left_anti").select("row.*")


@query("op6_qgram_decontamination")
def op6_qgram_decontamination(spark, sf):
    return matches(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("text")

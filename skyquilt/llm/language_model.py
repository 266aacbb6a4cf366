"""A hierarchical Pitman-Yor language model with a restaurant for every observed context.

The context of a token is the word before it; the first token of a text follows
the end of a text. Each context is a restaurant over words; all share one parent
restaurant, whose base is uniform over the vocabulary and one unknown word. A
Gibbs sweep takes the customers of each pair of context and word out of the
restaurant and seats them anew, one by one, given the tables of all other words
there; the new tables are the parent's customers, and are seated in the same way.
Predictive probabilities are averaged over the sweeps after the first.

Texts become blocks of tokens with a vocabulary of their own. Pairs go to buckets
by context (a frequent context is dealt out by word too), words go to buckets by
hash; a sweep exchanges, for the words of a bucket of pairs, sums of tables for
totals. A pair met once has one table whatever is sampled, so only the others are
kept. The random numbers of a pair follow from the pair and the sweep, so a block
needs its pairs' counts and its words' totals of each sweep to find the tables
again. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.llm.memory import tidy
from skyquilt.llm.queries import query, table
from skyquilt.llm.text import words

#: A token that no text holds as a word: the end of a text, and the context of its first token.
END = b"\n"
SWEEPS, BURN_IN = 3, 1
STRENGTH = 1.0
#: Customers beyond this many are seated in groups of 1/64 of those seated.
SINGLY = 64
#: Frequent words that all tasks know, at most: 12 bytes each, sent as two bytes instead of eight.
FREQUENT = 65_536
BLOCK_TOKENS = 2_000_000
#: Tokens, and words of blocks, for each bucket of pairs and of words.
BUCKET_TOKENS, BUCKET_WORDS = 1_500_000, 1_000_000
LEAST_BUCKETS = 48
#: A frequent context's pairs are dealt to a bucket for each so many tokens.
PART_TOKENS = 250_000

BLOCK, TABLE, ONCE, SUMS, STATE, ANSWER, PAIRS, WORDS = range(8)
SCHEMA = "key long, kind int, src long, a binary, b binary, c binary, d binary, e binary, sums array<double>"
COLUMNS = ["key", "kind", "src", "a", "b", "c", "d", "e", "sums"]


def number(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that follow from key and step."""
    x = _mix(key + np.uint64(step * 0x9E3779B97F4A7C15 % 2 ** 64))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(_mix(u) + w)


def _put(values: np.ndarray, kind: str) -> bytes:
    """Numbers, packed: first bytes come first, then second bytes and so on, as most numbers are small."""
    raw = np.ascontiguousarray(values, kind).ravel()
    planes = raw.view("u1").reshape(len(raw), raw.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _get(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).ravel().view(kind)


def _row(key: int, kind: int, src: int, *parts: bytes, sums: list[float] | None = None) -> tuple:
    return (key, kind, src, *parts, *[None] * (5 - len(parts)), sums)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS)


class Frequent:
    """The most frequent words in order of their hashes, and how often they occur."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, part: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.part = hashes[order], counts[order], part

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h

    def parts(self, h: np.ndarray) -> np.ndarray:
        """Buckets over which each context's pairs are dealt."""
        at, hit = self.find(h)
        out = np.ones(len(h), np.uint64)
        out[hit] += (self.counts[at[hit]] // self.part).astype(np.uint64)
        return out

    def put(self, h: np.ndarray) -> bytes:
        """Hashes, packed: two bytes for each frequent word; differences of the others, which are small where they are sorted."""
        at, hit = self.find(h)
        parts = [np.packbits(hit).tobytes(), _put(at[hit], "<u2"), _put(np.diff(h[~hit], prepend=np.uint64(0)), "<u8")]
        return np.array([len(h), *map(len, parts)], "<u8").tobytes() + b"".join(parts)

    def get(self, data: bytes) -> np.ndarray:
        n, *sizes = np.frombuffer(data[:32], "<u8").tolist()
        bits, ranks, others = (data[j - i:j] for i, j in zip(sizes, (32 + np.cumsum(sizes)).tolist(), strict=True))
        hit = np.unpackbits(np.frombuffer(bits, "u1"), count=n).astype(bool)
        out = np.empty(n, np.uint64)
        if hit.any():
            out[hit] = self.hashes[_get(ranks, "<u2")]
        out[~hit] = np.cumsum(_get(others, "<u8"), dtype=np.uint64)
        return out


def _binomial(n: np.ndarray, p: np.ndarray, key: np.ndarray, step: int) -> np.ndarray:
    """Binomial numbers by inversion; rounded normal ones where the variance is above 50."""
    u = _uniform(key, step)
    out = (u < p).astype(np.int64)
    spread = n * p * (1 - p)
    wide = np.flatnonzero((n > 1) & (spread > 50))
    if len(wide):
        z = np.sqrt(-2 * np.log(u[wide])) * np.cos(2 * np.pi * _uniform(key[wide], ~step & 0xFFFFFF))
        out[wide] = np.clip(np.rint(n[wide] * p[wide] + z * np.sqrt(spread[wide])), 0, n[wide]).astype(np.int64)
    few = np.flatnonzero((n > 1) & (spread <= 50))
    if len(few):
        flip = p[few] > 0.5
        size, q, left = n[few].astype(np.float64), np.where(flip, 1 - p[few], p[few]), u[few]
        x, live, at = np.zeros(len(few)), np.arange(len(few)), 0
        most, odds, mass = size, q / (1 - q), np.exp(size * np.log1p(-q))
        while True:
            on = np.flatnonzero((left > mass) & (most > at))
            if not len(on):
                break
            live, most, odds, left, mass = live[on], most[on], odds[on], left[on] - mass[on], mass[on]
            mass = mass * ((most - at) / (at + 1)) * odds
            at += 1
            x[live] = at
        out[few] = np.where(flip, size - x, x).astype(np.int64)
    return out


def seat(count: np.ndarray, tables_of_others: np.ndarray, discount: float, parent: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tables after seating ``count`` customers of a word, each at a new table or one of the word's by the restaurant's rule."""
    out = np.ones(len(count), np.int64)
    order = np.argsort(-count, kind="stable")[:np.count_nonzero(count > 1)]
    # the words that still have customers to seat are the first ones, and all have seated as many
    upwards, count, key = count[order][::-1], count[order], key[order]
    fixed, each = (STRENGTH + discount * tables_of_others[order]) * parent[order], discount * parent[order]
    tables, seated, turn, live = np.ones(len(order)), 1, 0, len(order)
    while live:
        turn += 1
        now = tables[:live]
        new = fixed[:live] + each[:live] * now
        whole = new + (seated - discount * now)
        step = max(1, seated // SINGLY)
        now += _uniform(key[:live], turn) * whole < new if step == 1 else _binomial(np.minimum(step, count[:live] - seated), new / whole, key[:live], turn)
        seated += step
        live = len(upwards) - int(np.searchsorted(upwards, seated, side="right"))
    out[order] = tables.astype(np.int64)
    return out


class Totals:
    """Numbers that hold for the whole corpus; their size does not depend on it."""

    def __init__(self, vocabulary: int, tokens: int, discount: float):
        self.vocabulary, self.tokens, self.discount = vocabulary, tokens, discount
        self.parent_discount = 0.5
        self.customers: list[float] = []
        self.tables: list[float] = []

    def parent(self, sweep: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probability, after a sweep, of words with so many customers and tables (0 and 0: unknown)."""
        fresh = (STRENGTH + self.parent_discount * self.tables[sweep]) / (self.vocabulary + 1)
        return (customers - self.parent_discount * tables + fresh) / (STRENGTH + self.customers[sweep])

    def reseat(self, sweep: int, count, tables, all_tables, customers, parent_tables, key) -> np.ndarray:
        """Tables of pairs in a sweep, from those of the sweep before and its totals of context and word."""
        p = self.parent(sweep - 1, customers, parent_tables)
        return seat(count, all_tables - tables, self.discount, p, key + np.uint64(sweep))

    def chance(self, count, of_context, tables: list, all_tables, customers, parent_tables) -> np.ndarray:
        """Probability of words in contexts, averaged over the kept sweeps; the last three hold a row for each sweep from 0."""
        out = 0.0
        for k in range(BURN_IN + 1, SWEEPS + 1):
            back_off = STRENGTH + self.discount * all_tables[k]
            out = out + count - self.discount * tables[k] + back_off * self.parent(k, customers[k], parent_tables[k])
        return out / ((STRENGTH + of_context) * (SWEEPS - BURN_IN))

    def replay(self, count, all_tables, customers, parent_tables, key) -> list:
        """Tables of pairs after each sweep from 0."""
        tables = [np.minimum(count, 1)]
        many = np.flatnonzero(count > 1)
        few = (count[many], key[many])
        for k in range(1, SWEEPS + 1):
            now = tables[0].copy()
            now[many] = self.reseat(k, few[0], tables[-1][many], all_tables[k - 1][many], customers[k - 1][many], parent_tables[k - 1][many], few[1])
            tables.append(now)
        return tables


# ---- blocks of texts

class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def _blocks(most: int):
    def block(at: int, numbers: _Numbers, ids: list, docs: list, flags: list) -> pd.DataFrame:
        hashes = np.fromiter(map(number, numbers), np.uint64, len(numbers))
        tokens = np.concatenate(ids)
        return _frame([_row(
            at, BLOCK, -1, _put(docs, "<i8"), _put(flags, "u1"), _put([len(x) for x in ids], "<u4"), _put(tokens, "<u4"),
            hashes.tobytes(), sums=[float(len(tokens)), float(len(numbers))])])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 32
        numbers, ids, docs, flags, size = _Numbers(), [], [], [], 0
        for part in parts:
            for doc, flag, text in zip(part["doc_id"], part["flag"], part["text"], strict=True):
                ws = words(text)
                ws.append(END)
                ids.append(np.fromiter(map(numbers.__getitem__, ws), np.uint32, len(ws)))
                docs.append(doc)
                flags.append(flag)
                size += len(ws)
                if size > most:
                    yield block(at, numbers, ids, docs, flags)
                    at += 1
                    numbers, ids, docs, flags, size = _Numbers(), [], [], [], 0
        if ids:
            yield block(at, numbers, ids, docs, flags)

    return run


class _Block:
    """A block's tokens, its distinct pairs and the buckets they are in."""

    def __init__(self, row):
        self.docs, self.flags = _get(row.a, "<i8"), _get(row.b, "u1")
        self.sizes, self.tokens = _get(row.c, "<u4").astype(np.int64), _get(row.d, "<u4").astype(np.int64)
        self.hashes = np.frombuffer(row.e, "<u8")
        self.trained = np.repeat(self.flags & 1 == 0, self.sizes)

    def words(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """Numbers of the words of each bucket, in order of their hashes."""
        order = np.argsort(self.hashes)
        return [(b, order[x]) for b, x in _dealt(_mix(self.hashes[order]) % np.uint64(buckets))]

    def pairs(self, frequent: Frequent, buckets: int) -> list[tuple[int, np.ndarray]]:
        """Finds the distinct pairs; returns those of each bucket, ordered by context."""
        starts = np.cumsum(self.sizes) - self.sizes
        end = self.tokens[starts[0] + self.sizes[0] - 1]
        before = np.concatenate([[end], self.tokens[:-1]])  # a text's last token is its end
        key, self.pair_of = np.unique(before << 32 | self.tokens, return_inverse=True)
        self.context, self.word = key >> 32, key & 0xFFFFFFFF
        parts = frequent.parts(self.hashes)[self.context]
        deal = self.hashes[self.context] + _mix(self.hashes[self.word]) % parts
        return _dealt(_mix(deal) % np.uint64(buckets))


def _none() -> Frequent:
    """No frequent words, as long as they are not known."""
    return Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)


def _dealt(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[x[0]]), x) for x in np.split(order, edge) if len(x)]


def _ask_words(frequent_of, buckets: int):
    """A row for each block and bucket of words: hashes and their number in training texts."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = frequent_of()
        for part in parts:
            for row in part.itertuples():
                block = _Block(row)
                n = np.bincount(block.tokens[block.trained], minlength=len(block.hashes))
                yield _frame([_row(b, BLOCK, row.key, frequent.put(block.hashes[at]), _put(n[at], "<u4")) for b, at in block.words(buckets)])

    return run


def _ask_pairs(shared, buckets: int):
    """A row for each block and bucket of pairs: contexts, how many pairs each has, words, their number in training texts."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = shared.value
        for part in parts:
            for row in part.itertuples():
                block = _Block(row)
                dealt = block.pairs(frequent, buckets)
                n = np.bincount(block.pair_of[block.trained], minlength=len(block.word))
                yield _frame([_row(b, BLOCK, row.key, *_runs(frequent, block.hashes[block.context[at]], block.hashes[block.word[at]]), _put(n[at], "<u4")) for b, at in dealt])

    return run


def _runs(frequent: Frequent, u: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes, bytes]:
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    return frequent.put(u[first]), _put(np.diff(np.append(first, len(u))), "<u4"), frequent.put(w)


def _unrun(frequent: Frequent, row) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(frequent.get(row.a), _get(row.b, "<u4")), frequent.get(row.c)


# ---- buckets of words and of pairs

def _count_words(rows: pd.DataFrame) -> pd.DataFrame:
    h, at = np.unique(np.concatenate([_none().get(x) for x in rows["a"]]), return_inverse=True)
    n = np.bincount(at, np.concatenate([_get(x, "<u4") for x in rows["b"]])).astype(np.int64)
    h, n = h[n > 0], n[n > 0]
    if not len(h):
        return _frame([])
    return _frame([_row(int(rows["key"].iloc[0]), TABLE, -1, h.tobytes(), _put(n, "<u8"), sums=[float(len(h)), float(n.sum())])])


def _sums_of(key: int, kind: int, frequent: Frequent, buckets: int, u: np.ndarray, w: np.ndarray, n: np.ndarray) -> list[tuple]:
    """A row for each bucket of words: sums of ``n`` by word and by context."""
    h, at = np.unique(np.concatenate([w, u]), return_inverse=True)
    by_word, by_context = np.bincount(at[:len(w)], n, len(h)), np.bincount(at[len(w):], n, len(h))
    return [_row(b, kind, key, frequent.put(h[x]), _put(by_word[x], "<u4"), _put(by_context[x], "<u8"))
            for b, x in _dealt(_mix(h) % np.uint64(buckets))]


def _count_pairs(shared, word_buckets: int):
    """Counts of a bucket's pairs: the state of those met more than once, sums for the words, and an answer to each block."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        frequent, key = shared.value, int(rows["key"].iloc[0])
        asked = [_unrun(frequent, r) for r in rows.itertuples()]
        us, u = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
        ws, w = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True)
        pair, at = np.unique(u * len(ws) + w, return_inverse=True)
        count = np.bincount(at, np.concatenate([_get(x, "<u4") for x in rows["d"]])).astype(np.int64)
        u, w = us[pair // len(ws)], ws[pair % len(ws)]
        one, many = count == 1, count > 1
        out = _sums_of(key, ONCE, frequent, word_buckets, u[one], w[one], count[one])
        if many.any():
            out += _sums_of(key, SUMS, frequent, word_buckets, u[many], w[many], np.ones(int(many.sum()), np.int64))
            out.append(_row(key, STATE, -1, *_runs(frequent, u[many], w[many]), _put(count[many], "<u8"), _put(np.ones(int(many.sum())), "<u4")))
        edge = np.cumsum([0, *[len(x[0]) for x in asked]])
        out += [_row(int(src), PAIRS, key, _put(count[at[i:j]], "<u8")) for src, i, j in zip(rows["src"], edge[:-1], edge[1:], strict=True)]
        out.append(_row(key, -1, -1, sums=[float(one.sum()), float((count == 2).sum())]))
        return _frame(out)

    return run


def _seat_words(shared, totals: Totals, sweep: int):
    """The words' totals after a sweep of the pairs, the parent's seating and an answer to each bucket of pairs."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        frequent = shared.value
        by_kind = {k: x for k, x in rows.groupby("kind")}
        if TABLE not in by_kind:
            return _frame([])
        mine = next(by_kind[TABLE].itertuples())
        h, key = np.frombuffer(mine.a, "<u8"), int(mine.key)
        once = _get(mine.c, "<u8").reshape(2, -1) if mine.c is not None else np.zeros((2, len(h)), np.int64)
        past = _get(mine.d, "<u8").astype(np.int64).reshape(-1, 3, len(h)) if mine.d is not None else np.zeros((0, 3, len(h)), np.int64)

        def added(kind: int) -> tuple[np.ndarray, list]:
            total, places = np.zeros((2, len(h)), np.int64), []
            for r in by_kind[kind].itertuples() if kind in by_kind else ():
                at = np.searchsorted(h, frequent.get(r.a))
                total[0] += np.bincount(at, _get(r.b, "<u4"), len(h)).astype(np.int64)
                total[1] += np.bincount(at, _get(r.c, "<u8"), len(h)).astype(np.int64)
                places.append((int(r.src), at))
            return total, places

        once = once + added(ONCE)[0]
        (customers, tables), places = added(SUMS)
        customers, tables = customers + once[0], tables + once[1]
        if sweep:
            base = np.full(len(h), 1.0 / (totals.vocabulary + 1))
            parent = seat(customers, totals.tables[-1] - past[-1, 1], totals.parent_discount, base, _mix(h) + np.uint64(sweep))
        else:
            parent = np.ones(len(h), np.int64)
        now = np.stack([customers, parent, tables])
        out = [_row(key, TABLE, -1, mine.a, mine.b, _put(once, "<u8"), _put(np.concatenate([past, now[None]]), "<u8"),
                    sums=[float(customers.sum()), float(parent.sum()), float((customers == 1).sum()), float((customers == 2).sum())])]
        out += [_row(src, ANSWER, key, _put(now[:, at], "<u8")) for src, at in places]
        return _frame(out)

    return run


def _seat_pairs(shared, totals: Totals, sweep: int, word_buckets: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        frequent, key = shared.value, int(rows["key"].iloc[0])
        mine = next(rows[rows["kind"] == STATE].itertuples())
        u, w = _unrun(frequent, mine)
        count, tables = _get(mine.d, "<u8").astype(np.int64), _get(mine.e, "<u4").astype(np.int64)
        h = np.unique(np.concatenate([w, u]))
        facts = np.zeros((3, len(h)), np.int64)
        answers = {int(r.src): r.a for r in rows[rows["kind"] == ANSWER].itertuples()}
        for b, x in _dealt(_mix(h) % np.uint64(word_buckets)):
            facts[:, x] = _get(answers[b], "<u8").reshape(3, -1)
        of_w, of_u = np.searchsorted(h, w), np.searchsorted(h, u)
        tables = totals.reseat(sweep, count, tables, facts[2, of_u], facts[0, of_w], facts[1, of_w], pair_key(u, w))
        return _frame([*_sums_of(key, SUMS, frequent, word_buckets, u, w, tables), _row(key, STATE, -1, mine.a, mine.b, mine.c, mine.d, _put(tables, "<u4"))])

    return run


def _tell_blocks(shared):
    """What the blocks asked of a bucket of words: counts and totals of each sweep."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h, facts = np.zeros(0, np.uint64), np.zeros((1 + 3 * (SWEEPS + 1), 0), np.int64)
        for mine in rows[rows["kind"] == TABLE].itertuples():
            h = np.frombuffer(mine.a, "<u8")
            facts = np.concatenate([_get(mine.b, "<u8")[None], _get(mine.d, "<u8").reshape(-1, len(h))]).astype(np.int64)
        facts = np.concatenate([facts, np.zeros((len(facts), 1), np.int64)], 1)  # the last column is that of unknown words
        out = []
        for r in rows[rows["kind"] == BLOCK].itertuples():
            asked = shared.value.get(r.a)
            at = np.searchsorted(h, asked)
            at[np.append(h, np.uint64(0))[at] != asked] = len(h)
            out.append(_row(int(r.src), WORDS, int(r.key), _put(facts[:, at], "<u8")))
        return _frame(out)

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_block(shared, totals: Totals, pair_buckets: int, word_buckets: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block = _Block(next(rows[rows["kind"] == BLOCK].itertuples()))
        told = {(int(r.kind), int(r.src)): r.a for r in rows[rows["kind"] != BLOCK].itertuples()}
        facts = np.zeros((1 + 3 * (SWEEPS + 1), len(block.hashes)), np.int64)
        for b, x in block.words(word_buckets):
            facts[:, x] = _get(told[WORDS, b], "<u8").reshape(len(facts), -1)
        n, past = facts[0], facts[1:].reshape(SWEEPS + 1, 3, -1)
        dealt = block.pairs(shared.value, pair_buckets)
        u, w = block.context, block.word
        count = np.zeros(len(u), np.int64)
        for b, x in dealt:
            count[x] = _get(told[PAIRS, b], "<u8")
        customers, parent_tables, tables = past[:, 0, w], past[:, 1, w], past[:, 2, u]
        seats = totals.replay(count, tables, customers, parent_tables, pair_key(block.hashes[u], block.hashes[w]))
        score = np.log10(totals.chance(count, n[u], seats, tables, customers, parent_tables))[block.pair_of]
        base = np.log10((n + 0.1) / (totals.tokens + 0.1 * (totals.vocabulary + 1)))[block.tokens]
        starts = np.cumsum(block.sizes) - block.sizes
        return pd.DataFrame({
            "doc_id": pd.array(block.docs, "Int64"), "held_out": block.flags & 1 == 1, "n_tokens": block.sizes,
            "n_known": np.add.reduceat((n[block.tokens] > 0).astype(np.int64), starts), "train_tokens": totals.tokens,
            "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(score, starts),
        }).assign(doc_id=lambda x: x["doc_id"].mask(block.flags & 2 == 2))

    return run


# ---- the model

def _total(rows: DataFrame, size: int) -> list[float]:
    got = rows.agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]).first()
    return [x or 0.0 for x in got]


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / max(1.0, once + 2 * twice), 0.05, 0.95))


def _most_frequent(words_table: DataFrame) -> Frequent:
    """FREQUENT words at most: those whose counts are in the highest steps of 2 ** (1 / 8) that hold no more."""
    def step(n: np.ndarray) -> np.ndarray:
        return np.floor(8 * np.log2(n)).astype(np.int64)

    def sizes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for packed in part["b"]:
                k, n = np.unique(step(_get(packed, "<u8")), return_counts=True)
                yield pd.DataFrame({"step": k, "n": n})

    total, least = 0, math.inf
    for r in words_table.select("b").mapInPandas(sizes, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy(F.desc("step")).collect():
        total += r["n"]  # 8 * 64 rows at most
        if total > FREQUENT:
            break
        least = r["step"]

    def chosen(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a, b in zip(part["a"], part["b"], strict=True):
                n = _get(b, "<u8").astype(np.int64)
                keep = step(n) >= least
                yield pd.DataFrame({"h": np.frombuffer(a, "<u8")[keep].view("<i8"), "n": n[keep]})

    got = words_table.select("a", "b").mapInPandas(chosen, "h long, n long").collect()
    return Frequent(np.array([r.h for r in got], np.int64).view(np.uint64), np.array([r.n for r in got], np.int64), PART_TOKENS)


class Model:
    """Words by bucket with their totals of each sweep, counts of the blocks' pairs, and what holds for all."""

    def __init__(self, blocks, words_table, answers, totals, frequent, pair_buckets, word_buckets):
        self.blocks, self.words, self.answers, self.totals = blocks, words_table, answers, totals
        self.frequent, self.pair_buckets, self.word_buckets = frequent, pair_buckets, word_buckets


def train(docs: DataFrame) -> Model:
    """Learn from the rows of ``docs(doc_id, held_out, text)`` that are not held out; the others' pairs are looked up only.

    A null text is an empty one. Repeated rows count each time.
    """
    flag = F.col("held_out").cast("int") + F.when(F.col("doc_id").isNull(), 2).otherwise(0)
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), flag.alias("flag"), "text")
    blocks = session.cut(texts.mapInPandas(tidy(_blocks(BLOCK_TOKENS)), SCHEMA), "blocks")
    tokens, kinds = _total(blocks, 2)
    pair_buckets, word_buckets = (max(LEAST_BUCKETS, math.ceil(n / most)) for n, most in ((tokens, BUCKET_TOKENS), (kinds, BUCKET_WORDS)))
    spark = docs.sparkSession

    def grouped(rows: DataFrame, run, name: str) -> tuple[DataFrame, str]:
        path = session.scratch(spark, name)
        rows.groupBy("key").applyInPandas(run, SCHEMA).write.partitionBy("kind").parquet(path)
        return spark.read.schema(SCHEMA).parquet(path), path

    def of(rows: DataFrame, *kinds: int) -> DataFrame:
        return rows.filter(F.col("kind").isin(*kinds)).select(*COLUMNS)

    now, now_path = grouped(blocks.mapInPandas(_ask_words(_none, word_buckets), SCHEMA), _count_words, "words")
    vocabulary, trained = _total(now, 2)
    shared = spark.sparkContext.broadcast(_most_frequent(now))
    counted, path = grouped(blocks.mapInPandas(_ask_pairs(shared, pair_buckets), SCHEMA), _count_pairs(shared, word_buckets), "pairs")
    totals = Totals(int(vocabulary), int(trained), _discount(*_total(of(counted, -1), 2)))
    state, sums, old = of(counted, STATE), of(counted, ONCE, SUMS), [f"{path}/kind={ONCE}", f"{path}/kind={SUMS}"]
    state_path = f"{path}/kind={STATE}"
    for sweep in range(SWEEPS + 1):
        if sweep:
            seated, path = grouped(state.unionByName(of(now, ANSWER)), _seat_pairs(shared, totals, sweep, word_buckets), "seating")
            session.remove(spark, state_path)
            state, sums, old, state_path = of(seated, STATE), of(seated, SUMS), [f"{path}/kind={SUMS}"], f"{path}/kind={STATE}"
        after, path = grouped(of(now, TABLE).unionByName(sums), _seat_words(shared, totals, sweep), "parent")
        for done in (now_path, *old):  # what no later step reads
            session.remove(spark, done)
        now, now_path = after, path
        customers, tables, once, twice = _total(of(now, TABLE), 4)
        totals.customers.append(customers)
        totals.tables.append(tables)
        if not sweep:
            totals.parent_discount = _discount(once, twice)
    session.remove(spark, state_path)
    return Model(blocks, of(now, TABLE), of(counted, PAIRS), totals, shared, pair_buckets, word_buckets)


def score(model: Model) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row the model was given, held out or not.

    The score is the log10 probability of the text's words and its end. A null
    text is an empty one, whose end is its one token. Repeated rows are scored
    alike. A model without words gives each token the uniform probability of one
    unknown word.
    """
    frequent = model.frequent
    asked = model.blocks.mapInPandas(_ask_words(lambda: frequent.value, model.word_buckets), SCHEMA).withColumn("b", F.lit(None).cast("binary"))
    told = asked.unionByName(model.words).groupBy("key").applyInPandas(_tell_blocks(frequent), SCHEMA)
    return model.blocks.unionByName(model.answers).unionByName(told).groupBy("key").applyInPandas(
        _score_block(frequent, model.totals, model.pair_buckets, model.word_buckets), RESULT)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity of the held-out texts and of the training texts, by the model and by the base."""
    tokens = F.sum("n_tokens")
    return scores.groupBy("held_out").agg(
        tokens.alias("tokens"), F.pow(F.lit(10.0), -F.sum("score") / tokens).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / tokens).alias("base_perplexity"))


def with_split(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, text)``: texts whose id's checksum is divisible by 10 are held out (so are those without an id)."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))


@query("op4_pitman_yor")
def op4_pitman_yor(spark, sf):
    docs = with_split(table(spark, sf, "documents"))
    return score(train(docs))

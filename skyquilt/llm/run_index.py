"""A run-length index of repeated byte contexts.

Every window of a corpus holds an anchor, its gram of least hash, so equal windows
have equal anchors at equal places. A text is cut into segments of windows with one
anchor. The index of a set of segments is the Burrows-Wheeler transform of the
suffixes that begin at windows: it starts from the suffixes at the anchors, sorted,
and each step moves the rows one byte to the left. Rows with the same byte before
them form runs, and a step moves runs, not rows: their order is that of the bytes,
and inside a run it stays. Runs carry samples of the documents at their ends, which
say where no earlier document can match. The matching statistics are streamed along:
a row's match is what it has in common with an earlier document's row to the left
of the anchor (its interval) and to the right (the least common prefix between them).
"""

from __future__ import annotations

import numpy as np

from skyquilt.llm.raw import spread

#: Bytes of an anchor, and positions that one step in a task hashes.
GRAM = 16
STEP = 1 << 16
_PLACE = 20  # low bits of a key, which hold the anchor's place inside a step
_LOW = np.uint64((1 << _PLACE) - 1)


def _gram_hash(buf: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each of the first n places; ``buf`` is longer by GRAM at least."""
    eight = np.ndarray((n + 8,), "<u8", buf, 0, (1,))
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eight[8:]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h


class Segments:
    """Segments of texts: windows ``start .. start + count - 1`` with one anchor, which lies ``before`` bytes behind ``start``."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.ends = np.cumsum([len(t) for t in texts])
        self.buf = np.frombuffer(b"".join(texts) + bytes(length + GRAM + 8), np.uint8)
        grams = length - GRAM + 1
        n = int(self.ends[-1]) if len(texts) else 0
        last = np.zeros(n + 1, np.int8)  # 1 where windows of a text begin to be possible, -1 where they end
        sizes = np.array([len(t) for t in texts], np.int64)
        long = sizes >= length
        last[(self.ends - sizes)[long]] += 1
        last[(self.ends - length + 1)[long]] -= 1
        valid = np.cumsum(last[:n], dtype=np.int8).view(bool)
        starts, counts, before, anchors = [], [], [], []
        for at in range(0, n, STEP):
            m = min(STEP, n - at)
            key = _gram_hash(self.buf[at:], m + grams - 1)
            key &= ~_LOW
            key |= np.arange(len(key), dtype=np.uint64)
            width = 1
            while width < grams:  # least key of so many neighbours
                step = min(width, grams - width)
                key = np.minimum(key[:-step], key[step:])
                width += step
            ok = valid[at:at + m]
            new = ok.copy()
            new[1:] &= ~ok[:-1] | (key[1:] != key[:-1])
            first = np.flatnonzero(new)
            if not len(first):
                continue
            total = np.concatenate([[0], np.cumsum(ok)])
            counts.append(np.diff(np.append(total[first], total[m])))
            starts.append(first + at)
            before.append((key[first] & _LOW).astype(np.int64) - first)
            anchors.append(key[first] >> np.uint64(_PLACE))
        empty = [np.zeros(0, np.int64)]
        self.start, self.count, self.before = (np.concatenate(x or empty) for x in (starts, counts, before))
        self.anchor = np.concatenate(anchors) if anchors else np.zeros(0, np.uint64)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")


def matrix(buf: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """``buf[start:start + size]`` as rows of ``width`` bytes, with zeros behind."""
    out = np.zeros((len(start), width), np.uint8)
    row = np.repeat(np.arange(len(start)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = buf[spread(start, size)]
    return out


def row_hash(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of a matrix whose width is a multiple of 8."""
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1] // 8):
        h += rows[:, 8 * k:8 * k + 8].copy().view("<u8").ravel()
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h * np.uint64(0xD6E8FEB86659FD93)


class RunIndex:
    """Index of segments: bytes ``content[offset:offset + count + length - 1]``, anchor ``before`` bytes in, document ``doc``."""

    def __init__(self, content: np.ndarray, offset: np.ndarray, count: np.ndarray, before: np.ndarray, doc: np.ndarray, length: int):
        size = count + length - 1
        right = matrix(content, offset + before, np.minimum(size - before, length), -(-length // 8) * 8)
        keys = right.view(">u8").astype(np.uint64)
        self.order = np.lexsort(tuple(keys[:, k] for k in range(keys.shape[1] - 1, -1, -1)))
        right = right[self.order, :length]
        same = right[1:] == right[:-1]
        common = np.where(same.all(1), length, same.argmin(1)) if len(same) else np.zeros(0, np.int64)
        #: bytes that a row's right context has in common with that of the row before it
        self.common = np.concatenate([[0], common]).astype(np.int64)[:len(offset)]
        self.content, self.length = content, length
        self.anchor_at, self.count, self.before, self.doc = offset[self.order] + before[self.order], count[self.order], before[self.order], doc[self.order]
        #: runs and rows moved, as a measure of the compression
        self.n_runs = self.n_rows = 0

    def repeated(self) -> np.ndarray:
        """For each segment a bit mask: bit w is set if its window w also begins in a document with a smaller id."""
        mask = np.zeros(len(self.order), np.uint64)
        rows = np.arange(len(self.order))
        head = self.common < GRAM  # rows that begin an interval: rows whose bytes from here to the anchor are equal
        for left in range(self.length - GRAM + 1):
            rows, head = self._partners(rows, head)
            if not len(rows):
                break
            self._mark(rows, head, left, mask)
            rows, head = self._step(rows, head, left)
        out = np.zeros(len(mask), np.uint64)
        out[self.order] = mask
        return out

    def _partners(self, rows: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the intervals that hold two documents; runs' samples tell, so single rows leave at once."""
        if not len(rows):
            return rows, head
        first = np.flatnonzero(head)
        least, most = np.minimum.reduceat(self.doc[rows], first), np.maximum.reduceat(self.doc[rows], first)
        keep = np.repeat(least < most, np.diff(np.append(first, len(rows))))
        return rows[keep], head[keep]

    def _mark(self, rows: np.ndarray, head: np.ndarray, left: int, mask: np.ndarray) -> None:
        """Windows that begin ``left`` bytes before the anchor."""
        before = self.before[rows]
        use = (left <= before) & (left > before - self.count[rows])
        if not use.any():
            return
        interval = np.cumsum(head)[use]
        rows, before = rows[use], before[use]
        # rows agree for the rest of the window if no row between them, in the order at the anchor, has less in common
        rest = np.cumsum(self.common < self.length - left)[rows]
        first = np.flatnonzero(np.concatenate([[True], (interval[1:] != interval[:-1]) | (rest[1:] != rest[:-1])]))
        least = np.repeat(np.minimum.reduceat(self.doc[rows], first), np.diff(np.append(first, len(rows))))
        hit = least < self.doc[rows]
        mask[rows[hit]] |= np.uint64(1) << (before[hit] - left).astype(np.uint64)

    def _step(self, rows: np.ndarray, head: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows one byte further to the left, in the transform's order."""
        interval = np.cumsum(head)
        more = self.before[rows] > left
        rows, interval = rows[more], interval[more]
        if not len(rows):
            return rows, head[:0]
        key = interval * 256 + self.content[self.anchor_at[rows] - left - 1]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(rows)))
        self.n_runs, self.n_rows = self.n_runs + len(first), self.n_rows + len(rows)
        order = np.argsort(key[first], kind="stable")
        key, size = key[first][order], size[order]
        rows = rows[spread(first[order], size)]
        head = np.zeros(len(rows), bool)
        begin = np.cumsum(size) - size
        head[begin[np.concatenate([[True], key[1:] != key[:-1]])]] = True
        return rows, head

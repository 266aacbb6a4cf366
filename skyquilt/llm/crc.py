"""CRC-32 of many spans at once.

The CRC is linear: a span's value is the XOR of one number per byte, which
depends on the byte and its distance from the span's end, and of one number for
the span's length. The per-byte numbers come from a table, and a whole array of
spans is folded by one ``bitwise_xor.reduceat``. Spans longer than the table are
cut into blocks of its length, whose values are moved on block by block.
"""

from __future__ import annotations

import zlib

import numpy as np

from skyquilt.llm.raw import Words, spread

#: Distances from the end that the table holds.
DEPTH = 64
#: Words handled at once, which bounds memory whatever a text's length.
BLOCK = 1 << 16


def _table() -> np.ndarray:
    """The number of a byte at each distance from the end, the byte innermost."""
    rows = [[zlib.crc32(bytes([b]) + bytes(d)) ^ zlib.crc32(bytes(d + 1)) for b in range(256)] for d in range(DEPTH)]
    return np.array(rows, np.uint32).ravel()


TABLE = _table()
#: CRC of so many zero bytes: what a span's length adds.
LENGTH = np.array([zlib.crc32(bytes(n)) for n in range(DEPTH + 1)], np.uint32)


def _onward() -> np.ndarray:
    """How DEPTH further bytes move a value on, for each of its four bytes (the least first)."""
    one = np.array([[0 if b == 0 else _zeros(b << (8 * k), DEPTH) for b in range(256)] for k in range(4)], np.uint32)
    return one


def _zeros(state: int, n: int) -> int:
    """A value without its length's part after n zero bytes."""
    for _ in range(n):
        state = (state >> 8) ^ int(TABLE[state & 255])
    return state


ONWARD = _onward()


def _moved(value: np.ndarray) -> np.ndarray:
    return ONWARD[0][value & 255] ^ ONWARD[1][value >> 8 & 255] ^ ONWARD[2][value >> 16 & 255] ^ ONWARD[3][value >> 24]


def spans(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of ``buf[first:first + size]`` for each span, of any length."""
    blocks = np.maximum(1, -(-size // DEPTH))
    # a span's first block takes what is over, all others are full
    lead = size - (blocks - 1) * DEPTH
    value = _linear(buf, first, lead)
    at, left = first + lead, blocks - 1
    while (more := np.flatnonzero(left)).size:
        value[more] = _moved(value[more]) ^ _linear(buf, at[more], np.full(len(more), DEPTH))
        at[more] += DEPTH
        left[more] -= 1
    return value ^ _length(size)


def _length(size: np.ndarray) -> np.ndarray:
    out = LENGTH[np.minimum(size, DEPTH)]
    for i in np.flatnonzero(size > DEPTH):
        out[i] = _zeros_crc(int(size[i]))
    return out


def _zeros_crc(n: int) -> int:
    value, step = 0, bytes(1 << 16)
    while n > 0:
        value = zlib.crc32(step[:n], value)
        n -= len(step)
    return value


def _linear(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XOR of the table's numbers over each span of DEPTH bytes at most."""
    out = np.zeros(len(first), np.uint32)
    some = np.flatnonzero(size > 0)
    if some.size:
        n = size[some]
        ends = np.cumsum(n)
        distance = np.repeat(ends, n) - 1 - np.arange(ends[-1])
        out[some] = np.bitwise_xor.reduceat(TABLE[distance * 256 + buf[spread(first[some], n)]], ends - n)
    return out


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each word, and of each word with the next one and a space between.

    The second array's last entry, and those at a text's last word, belong to no
    feature; the caller leaves them out.
    """
    n = len(words.first)
    one, two = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK + 1)  # one word more, for the last pair
        first, size = words.first[lo:hi], words.end[lo:hi] - words.first[lo:hi]
        keep = min(n, lo + BLOCK) - lo
        short = size <= DEPTH
        value = np.zeros(len(first), np.uint32)
        value[~short] = spans(words.buf, first[~short], size[~short])
        pair = np.zeros(len(first), np.uint32)
        following = np.append(size[1:], 0)
        fits = size + 1 + following <= DEPTH
        fits[-1] = False
        use = np.flatnonzero(short)
        if use.size:
            m = size[use]
            ends = np.cumsum(m)
            distance = np.repeat(ends, m) - 1 - np.arange(ends[-1])
            data = words.buf[spread(first[use], m)]
            plain = np.bitwise_xor.reduceat(TABLE[distance * 256 + data], ends - m)
            value[use] = plain ^ LENGTH[m]
            # the same bytes as the first part of a pair lie further from its end
            further = distance + np.repeat(np.where(fits[use], following[use] + 1, 0), m)
            moved = np.bitwise_xor.reduceat(TABLE[further * 256 + data], ends - m)
            linear = np.zeros(len(first), np.uint32)
            linear[use] = plain
            at = np.flatnonzero(fits[use])
            here = use[at]
            pair[here] = moved[at] ^ TABLE[following[here] * 256 + 32] ^ linear[here + 1] ^ LENGTH[size[here] + 1 + following[here]]
        for i in np.flatnonzero(~fits[:-1]):
            pieces = [words.buf[first[i]:first[i] + size[i]], np.array([32], np.uint8), words.buf[first[i + 1]:first[i + 1] + size[i + 1]]]
            whole = np.concatenate(pieces)
            pair[i] = spans(whole, np.array([0]), np.array([len(whole)]))[0]
        one[lo:lo + keep], two[lo:lo + keep] = value[:keep], pair[:keep]
    return one, two

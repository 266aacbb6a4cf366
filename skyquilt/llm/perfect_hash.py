"""A minimal perfect hash of 64-bit keys, built and looked up in whole arrays.

Level by level, keys that fall alone on a bit of the level's array own it; keys
that collide go on to the next level. A key's slot is the number of set bits
before its own, so n keys get the slots 0 to n - 1.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers for each salt."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of all levels one after the other, and each level's size. Keys must differ."""
    bits, sizes, left = [], [], keys.astype(np.uint64)
    while len(left):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("keys of a minimal perfect hash must differ")
        size = max(8, int(GAMMA * len(left)))
        at = (mix(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        bits.append(alone)
        sizes.append(size)
        left = left[~alone[at]]
    return (np.concatenate(bits) if bits else np.zeros(0, bool)), np.array(sizes, np.int64)


class Lookup:
    """Slots of keys; a key that was not built gets any slot or -1."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.rank = np.concatenate([[0], np.cumsum(bits)])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = (mix(keys[left], level + 1) % np.uint64(size)).astype(np.int64) + base
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        return out

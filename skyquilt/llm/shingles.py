"""Hashed word shingles of many texts at once, in whole arrays."""

from __future__ import annotations

import numpy as np

from skyquilt.llm.perfect_hash import mix

WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(256, dtype=np.uint64), 11)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Keeps tables that grow to the longest batch met."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and each text's number of words. Words are runs without ASCII white space, A-Z lowered."""
        raw = np.frombuffer(b"\n" + b"\n".join(texts).lower() + b"\n", np.uint8)
        if len(raw) > len(self.up):
            self.up, self.down = _powers(_BASE, len(raw)), _powers(_INVERSE, len(raw))
        gap = _SPACE[raw]
        first = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * self.up[:len(raw)])])
        value = mix((total[end] - total[first]) * self.down[first], 12) + (end - first).astype(np.uint64)
        edge = np.cumsum([1] + [len(t) + 1 for t in texts])
        return value, np.diff(np.searchsorted(first, edge))

    def sets(self, texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
        """Sorted distinct shingles of ``size`` words of each text; fewer words make one shingle, none make none."""
        value, counts = self.words(texts)
        at = np.concatenate([[0], np.cumsum(counts)])
        with np.errstate(over="ignore"):
            full = np.zeros(max(0, len(value) - size + 1), np.uint64)
            for k in range(size):
                full = full * np.uint64(0xD6E8FEB86659FD93) + value[k:k + len(full)]
            full = mix(full, 13)
        out = []
        for i, n in enumerate(counts):
            if n >= size:
                out.append(np.unique(full[at[i]:at[i + 1] - size + 1]))
            else:
                short = np.zeros(min(n, 1), np.uint64)
                for w in value[at[i]:at[i + 1]]:
                    short = mix(short + w, 14)
                out.append(short)
        return out


def coefficients(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(n, dtype=np.uint64), salt) | np.uint64(1)
    return a[:, None], mix(np.arange(n, dtype=np.uint64), salt + 1)[:, None]


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 2048) -> np.ndarray:
    """For each hash function the least value over the shingles (32 bits)."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), step):
        least = np.minimum(least, (shingles[None, k:k + step] * a + b).min(1))
    return (least >> np.uint64(32)).astype(np.uint32)

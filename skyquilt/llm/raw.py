"""Texts of Arrow batches as bytes, and their words as places in one buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step in a task works on (a longer text is a step of its own).
STEP_BYTES = 1 << 20
#: A-Z to lower case, digits, letters and bytes from 0x80 on as they are, all else a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def steps(batch: pa.RecordBatch, size: int = STEP_BYTES, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of about ``size`` bytes of text, and their texts."""
    texts = texts_of(batch, column)
    begin = total = 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > size:
            yield batch.slice(begin, i - begin), texts[begin:i]
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield batch.slice(begin), texts[begin:]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges ``starts[i] .. starts[i] + counts[i] - 1``, one after the other."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


class Words:
    """Words of texts: runs of ASCII digits, letters (A-Z lowered) and bytes from 0x80 on."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(FOLD), np.uint8)
        inside = self.buf != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.first, self.end = edge[0::2], edge[1::2]
        borders = np.cumsum([1] + [len(t) + 1 for t in texts])
        self.of = np.searchsorted(self.first, borders)  # words of text i: of[i] to of[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

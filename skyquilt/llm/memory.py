"""Memory that tasks give back when they end, as Python workers live on between stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of texts that Spark hands to a Python worker at once, at most (one row may be larger).
BATCH_BYTES = 8 << 20
Run = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, as rows of text differ in length by orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Hand freed memory of Arrow and of the C library to the system (the latter only where it has ``malloc_trim``)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Run) -> Run:
    """The same function over batches, which gives freed memory back at its end."""
    def wrapped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(parts)
        finally:
            give_back()

    return wrapped

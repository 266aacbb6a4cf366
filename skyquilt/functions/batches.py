"""Row functions of tasks on slices of an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are Python objects at a time.
ROWS = 256


def map_slices(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType, rows: int = ROWS) -> DataFrame:
    """``mapInPandas`` that turns ``rows`` rows at a time into objects.

    A batch of tiles with their strips is a few times larger as Python objects than
    as Arrow columns, and so is what is made of it; here neither grows with the batch.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(kind)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows).to_pandas()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in run(parts(batches)):
            yield pa.RecordBatch.from_pandas(pdf, schema=fields, preserve_index=False)

    return df.mapInArrow(go, kind)

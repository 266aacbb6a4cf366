"""Number formatting with C ``printf`` rounding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fixed_text(col: str | Column, digits: int) -> Column:
    """``%.nf`` of the exact binary value (the JVM formatter rounds half up)."""
    @F.pandas_udf(T.StringType())
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda x: f"{x:.{digits}f}", na_action="ignore")

    c = F.col(col) if isinstance(col, str) else col
    return text(c.cast("double"))

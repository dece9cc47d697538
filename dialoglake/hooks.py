"""The one place where a model may be called: a vectorised function over Arrow batches of columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_with(df: DataFrame, fn: Callable[..., pd.Series], in_cols: list[str], out_col: str, out_type: str = "double") -> DataFrame:
    """Adds out_col = fn(*columns), a batch at a time. Give distinct texts and join the result back when texts repeat."""
    return df.withColumn(out_col, F.pandas_udf(fn, out_type)(*(F.col(c) for c in in_cols)))


def score_distinct(df: DataFrame, fn: Callable[..., pd.Series], in_cols: list[str], out_col: str, out_type: str = "double") -> DataFrame:
    """score_with over the distinct values of in_cols only."""
    return df.join(score_with(df.select(*in_cols).distinct(), fn, in_cols, out_col, out_type), in_cols, "left")

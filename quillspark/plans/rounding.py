"""Rounding of results, so that two engines' sums in different orders compare equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All floating columns rounded, minus zero made zero, dates as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(c, digits) + F.lit(0.0)).alias(name) if kind in ("double", "float") else c.cast("string").alias(name) if kind == "date" else c.cast("bigint").alias(name) if kind in ("int", "smallint", "tinyint") else c)
    return df.select(out)

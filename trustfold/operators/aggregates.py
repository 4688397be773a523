"""Per-key aggregates (K1-K3, K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustfold.plans.percentiles import group_percentiles


def median_per_key(df: DataFrame, key: str, cols, names=None) -> DataFrame:
    """K1 / K2: exact median of each column per key.  A key that holds a third of all rows is many partial counts."""
    names = list(names or cols)
    return group_percentiles(df, [key], {n: (F.col(c), 0.5) for c, n in zip(cols, names)})


def max_per_key(df: DataFrame, key: str, col: str, name: str | None = None) -> DataFrame:
    """K3."""
    return df.groupBy(key).agg(F.max(col).alias(name or f"max_{col}"))

"""Imputation (I1-I3, I5).  The per-chunk median fill (I4) is ``consensus.fill_missing``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustfold.plans.percentiles import group_percentiles

UNKNOWN = "Unknown"


def _kinds(df: DataFrame, exclude=()):
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
    cat = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    return num, cat


def fill_stats(df: DataFrame, numeric=None, categorical=None) -> dict:
    """Medians of numeric columns (I1) and modes of string columns (I2), the smallest of equally frequent ones.

    Medians come from ``group_percentiles`` and modes from a grouped count per column, so that no task holds a column's
    values.
    """
    n, c = _kinds(df)
    numeric = n if numeric is None else list(numeric)
    categorical = c if categorical is None else list(categorical)
    stats = {}
    if numeric:
        row = group_percentiles(df, [], {f"n{i}": (F.col(x), 0.5) for i, x in enumerate(numeric)}).first()
        stats.update({x: row[f"n{i}"] if row else None for i, x in enumerate(numeric)})
    for x in categorical:
        counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        mode = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v")).first()["v"]
        stats[x] = mode if mode is not None else UNKNOWN
    return stats


def impute(df: DataFrame, numeric=None, categorical=None) -> DataFrame:
    """I1 + I2: numeric nulls (and NaN) take the column median, strings the mode or 'Unknown'."""
    stats = fill_stats(df, numeric, categorical)
    exprs = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in stats:
            v = stats[f.name]
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
            if v is not None:
                c = F.coalesce(c, F.lit(v).cast(f.dataType))
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


def mean_fill(df: DataFrame, cols, group=()) -> DataFrame:
    """Nulls take the mean of their group (whole column when no group)."""
    if not group:
        row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
        return df.fillna({c: row[c] for c in cols if row[c] is not None})
    means = df.groupBy(*group).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    out = df.join(means, list(group), "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_m_{c}"))).drop(f"_m_{c}")
    return out


def zero_fill(df: DataFrame, cols=None) -> DataFrame:
    """Nulls become 0 after an outer join or a pivot."""
    return df.fillna(0, subset=cols) if cols else df.fillna(0)

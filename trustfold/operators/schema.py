"""Schema, validation, projection and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustfold.functions.scalars import all_whole

NUMERICAL, CATEGORICAL, UNKNOWN = "numerical", "categorical", "unknown"

def column_kinds(df: DataFrame, target: str | None = None) -> list[tuple[str, str]]:
    """B1: (column, kind) for every column except the target."""
    out = []
    for f in df.schema.fields:
        if f.name == target:
            continue
        if isinstance(f.dataType, T.NumericType):
            out.append((f.name, NUMERICAL))
        elif isinstance(f.dataType, T.StringType):
            out.append((f.name, CATEGORICAL))
        else:
            out.append((f.name, UNKNOWN))
    return out


def column_kinds_frame(spark: SparkSession, df: DataFrame, target: str | None = None) -> DataFrame:
    return spark.createDataFrame(column_kinds(df, target), "column string, kind string")


def require_columns(df: DataFrame, cols) -> None:
    """Raise with the missing names."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def target_check_frame(df: DataFrame, target: str) -> DataFrame:
    """B2 statistics in one aggregation: rows, nulls, and the integer-like test."""
    require_columns(df, [target])
    t = F.col(target)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(t.isNull()).alias("n_null"),
        F.count_distinct(t).alias("n_distinct"),
        all_whole(t).alias("all_whole"),
    )


def check_target(df: DataFrame, target: str) -> None:
    """B2: non-empty, present, numeric, without nulls."""
    require_columns(df, [target])
    if not isinstance(df.schema[target].dataType, T.NumericType):
        raise ValueError(f"target {target!r} is not numeric")
    row = target_check_frame(df, target).first()
    if row["n_rows"] == 0:
        raise ValueError("empty table")
    if row["n_null"]:
        raise ValueError(f"target {target!r} has {row['n_null']} nulls")


def numeric_only(df: DataFrame, cols) -> None:
    """No non-numeric feature may reach training."""
    bad = [c for c in cols if not isinstance(df.schema[c].dataType, T.NumericType)]
    if bad:
        raise ValueError(f"non-numeric features: {bad}")


def single_value_column(df: DataFrame, key: str) -> str:
    """Exactly one value column besides the key; returns its name."""
    rest = [c for c in df.columns if c != key]
    if len(rest) != 1:
        raise ValueError(f"expected one value column besides {key!r}, found {rest}")
    return rest[0]


def project(df: DataFrame, cols) -> DataFrame:
    """B4."""
    require_columns(df, cols)
    return df.select(*cols)


def exclude(df: DataFrame, cols) -> DataFrame:
    """B5."""
    return df.drop(*cols)


def where_class(df: DataFrame, value: str, col: str = "True_Class") -> DataFrame:
    """B6."""
    return df.where(F.col(col) == F.lit(value))


def inf_to_null(c):
    """B9."""
    return F.when(F.abs(c) == F.lit(float("inf")), F.lit(None)).otherwise(c)


def trim_names(df: DataFrame) -> DataFrame:
    """B15."""
    return df.toDF(*[c.strip() for c in df.columns])


def tag_source(df: DataFrame, value: str, col: str = "Dataset_Source") -> DataFrame:
    """B11."""
    return df.withColumn(col, F.lit(value))

"""Encoding and scaling.

Fitted state is small and explicit: category lists (at most ``onehot_limit``
values per column), code tables (a DataFrame, joined back), and scaler
statistics (two numbers per column).  Population standard deviation is used
on purpose: ``pyspark.ml.feature.StandardScaler`` uses the sample one, and
``MinMaxScaler`` maps a constant column to 0.5 instead of 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustfold.plans.ordered import global_row_number

ONEHOT_LIMIT = 15


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def distinct_counts(df: DataFrame, cols) -> DataFrame:
    """E1 statistics: one row, ``count_distinct`` per column (nulls not counted)."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in cols])


def cardinality_split(df: DataFrame, cols, limit: int = ONEHOT_LIMIT) -> tuple[list[str], list[str]]:
    """Columns with at most ``limit`` distinct values go one-hot, the rest label-encoded."""
    if not cols:
        return [], []
    row = distinct_counts(df, cols).first()
    onehot = [c for c in cols if row[c] <= limit]
    return onehot, [c for c in cols if c not in onehot]


def categories(df: DataFrame, col: str, limit: int = ONEHOT_LIMIT) -> list:
    vals = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(vals) > limit:
        raise ValueError(f"{col} has more than {limit} categories; label-encode it")
    return sorted(vals)


def onehot(df: DataFrame, col: str, cats=None, drop_first: bool = False, keep_source: bool = False) -> DataFrame:
    """``col_value`` 0/1 columns over sorted categories; unseen values give all zeros."""
    cats = categories(df, col) if cats is None else list(cats)
    if drop_first:
        cats = cats[1:]
    out = df.select(
        "*", *[F.coalesce((F.col(col) == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{col}_{v}") for v in cats]
    )
    return out if keep_source else out.drop(col)


def code_table(df: DataFrame, col: str) -> DataFrame:
    """E3 code table: rank of each distinct value in sorted order, 0-based.

    Built with the range-partitioned global numbering, so a column with
    millions of distinct values is not sorted in one task.
    """
    d = df.select(col).where(F.col(col).isNotNull()).distinct()
    return global_row_number(d, [col], out=f"{col}__code")


def label_encode(df: DataFrame, col: str, table: DataFrame | None = None) -> DataFrame:
    """Replace ``col`` by its code (always refit unless a table is given)."""
    table = code_table(df, col) if table is None else table
    out = df.join(table, col, "left").drop(col).withColumnRenamed(f"{col}__code", col)
    return out.select(*df.columns)


@dataclass
class ScalerModel:
    kind: str
    stats: dict[str, tuple[float, float]]  # column -> (center, scale)

    def transform(self, df: DataFrame) -> DataFrame:
        """Scaled columns; a null, and every value of a constant column, becomes 0 (as ``scale_grouped``)."""
        return df.select(*[scaled(F.col(c), *map(F.lit, self.stats[c])).alias(c) if c in self.stats else F.col(c) for c in df.columns])

    @classmethod
    def from_frame(cls, frame: DataFrame) -> "ScalerModel":
        rows = frame.collect()  # one row per column
        return cls(rows[0]["kind"] if rows else "standard", {r["column"]: (r["center"], r["scale"]) for r in rows})

    def to_frame(self, spark) -> DataFrame:
        rows = [(c, self.kind, float(a) if a is not None else None, float(b) if b is not None else None) for c, (a, b) in self.stats.items()]
        return spark.createDataFrame(rows, "column string, kind string, center double, scale double")


def fit_scaler(df: DataFrame, cols, kind: str = "standard") -> ScalerModel:
    """Fit once (one aggregation), apply later with literals."""
    if kind == "standard":
        aggs = [F.avg(c).alias(f"a_{i}") for i, c in enumerate(cols)] + [F.stddev_pop(c).alias(f"b_{i}") for i, c in enumerate(cols)]
        row = df.agg(*aggs).first()
        stats = {c: (row[f"a_{i}"], row[f"b_{i}"]) for i, c in enumerate(cols)}
    elif kind == "minmax":
        aggs = [F.min(c).alias(f"a_{i}") for i, c in enumerate(cols)] + [F.max(c).alias(f"b_{i}") for i, c in enumerate(cols)]
        row = df.agg(*aggs).first()
        stats = {}
        for i, c in enumerate(cols):
            lo, hi = row[f"a_{i}"], row[f"b_{i}"]
            stats[c] = (lo, None if lo is None else hi - lo)
    else:
        raise ValueError(f"unknown scaler {kind!r}")
    return ScalerModel(kind, stats)


def scaled(value: Column, center: Column, scale: Column) -> Column:
    """(value - center) / scale, 0 where that is not a number."""
    scale = scale.cast("double")
    return F.coalesce((value - center.cast("double")) / F.when(scale != 0, scale), F.lit(0.0))


def scale_grouped(df: DataFrame, value: str, group, kind: str = "standard") -> DataFrame:
    """Scale ``value`` per group (e.g. per chunk and column): stats by groupBy, joined back."""
    if kind == "standard":
        st = df.groupBy(*group).agg(F.avg(value).alias("_a"), F.stddev_pop(value).alias("_b"))
    else:
        st = df.groupBy(*group).agg(F.min(value).alias("_a"), (F.max(value) - F.min(value)).alias("_b"))
    return df.join(st, list(group)).withColumn(value, scaled(F.col(value), F.col("_a"), F.col("_b"))).drop("_a", "_b")


def encode_features(df: DataFrame, numeric, categorical, limit: int = ONEHOT_LIMIT) -> tuple[DataFrame, list[str]]:
    """Numeric, then one-hot, then label-encoded columns; returns the frame and the feature names."""
    oh, lab = cardinality_split(df, list(categorical), limit)
    out = df
    names = list(numeric)
    for c in oh:
        cats = categories(df, c, limit)
        out = onehot(out, c, cats)
        names += [f"{c}_{v}" for v in cats]
    for c in lab:
        out = label_encode(out, c)
        names.append(c)
    return out, names


def validate_target_feature(df: DataFrame, target: str) -> tuple[DataFrame, str]:
    """Label-encode every string feature and reject nulls anywhere."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
    bad = sorted(c for c, n in nulls.items() if n)
    if bad:
        raise ValueError(f"null values in columns {bad}")
    out = df
    for c in string_columns(df, exclude=(target,)):
        out = label_encode(out, c)
    return out, target

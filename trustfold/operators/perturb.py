"""Perturbation of a table (P1-P4, S10): outlier and missing-cell injection,
weighted draws and location jitter, all from seeded hashes so results are
reproducible on any partitioning and checkable in SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustfold.functions.scalars import hashed_uniform
from trustfold.operators.sampling import disjoint_samples
from trustfold.plans.ordered import global_row_number
from trustfold.sources.tables import ROW_ID

EARTH_RADIUS_M = 6371008.8


def weighted_draw(u: Column, values, weights) -> Column:
    """Category whose cumulative weight first exceeds u (u in [0, 1))."""
    total = float(sum(weights))
    acc = 0.0
    expr = F.lit(values[-1])
    bounds = []
    for v, w in zip(values, weights):
        acc += w / total
        bounds.append((acc, v))
    for bound, v in reversed(bounds[:-1]):
        expr = F.when(u < F.lit(bound), F.lit(v)).otherwise(expr)
    return expr


def destination(lat: Column, lon: Column, dist_m: Column, bearing_rad: Column) -> tuple[Column, Column]:
    """Point at a distance and bearing on a sphere (degrees in, degrees out)."""
    phi1, lam1 = F.radians(lat), F.radians(lon)
    delta = dist_m / F.lit(EARTH_RADIUS_M)
    phi2 = F.asin(F.sin(phi1) * F.cos(delta) + F.cos(phi1) * F.sin(delta) * F.cos(bearing_rad))
    lam2 = lam1 + F.atan2(F.sin(bearing_rad) * F.sin(delta) * F.cos(phi1), F.cos(delta) - F.sin(phi1) * F.sin(phi2))
    return F.degrees(phi2), F.degrees(lam2)


def jitter_location(df: DataFrame, lat: str, lon: str, max_m: float = 200.0, key: str = ROW_ID, seed: str = "geo") -> DataFrame:
    """Move each point to a hashed random spot within ``max_m`` metres."""
    d = hashed_uniform(seed + ":d", F.col(key)) * F.lit(max_m)
    b = hashed_uniform(seed + ":b", F.col(key)) * F.lit(2 * math.pi)
    la, lo = destination(F.col(lat), F.col(lon), d, b)
    # both from the original point, in one projection
    return df.select(*[la.alias(c) if c == lat else lo.alias(c) if c == lon else F.col(c) for c in df.columns])


def inject_outliers(df: DataFrame, intentional: dict, unintentional: dict, i_perc: float, u_perc: float, overlap: float,
                    key: str = ROW_ID, seed: str = "42") -> DataFrame:
    """On the disjoint row sets of L5, overwrite one hashed-random column
    from the intentional generators, one from the unintentional ones, or both
    (for rows in the overlap).  Generators map column -> Column expression and
    address columns by name.
    """
    sets = disjoint_samples(df, overlap, i_perc, u_perc, key=key, seed=seed)
    s = F.col("sample_set")
    gets_i = s.isin("both", "A")
    gets_u = s.isin("both", "B")
    i_cols, u_cols = list(intentional), list(unintentional)
    pick_i = F.floor(hashed_uniform(seed + ":ci", F.col(key)) * len(i_cols)).cast("int")
    pick_u = F.floor(hashed_uniform(seed + ":cu", F.col(key)) * len(u_cols)).cast("int")
    out = sets
    for c in dict.fromkeys(i_cols + u_cols):
        e = F.col(c)
        if c in unintentional:
            e = F.when(gets_u & (pick_u == u_cols.index(c)), unintentional[c].cast(df.schema[c].dataType)).otherwise(e)
        if c in intentional:
            e = F.when(gets_i & (pick_i == i_cols.index(c)), intentional[c].cast(df.schema[c].dataType)).otherwise(e)
        out = out.withColumn(c, e)
    return out


def inject_nulls(df: DataFrame, columns, rate: float, key: str = ROW_ID, seed: str = "42") -> DataFrame:
    """int(rows * cols * rate) draws of (row, column) with replacement; drawn cells become null.

    The draws are a ``spark.range`` sized from the table; each draw hashes to
    a row position and a column; positions come from the range-partitioned
    global numbering, so no draw list passes through the driver.
    """
    spark = df.sparkSession
    n_rows = df.count()
    cols = list(columns)
    n_draws = int(n_rows * len(cols) * rate)
    if n_draws == 0 or n_rows == 0:
        return df
    draws = spark.range(n_draws).select(
        F.floor(hashed_uniform(seed + ":r", F.col("id")) * n_rows).cast("long").alias("_pos"),
        F.floor(hashed_uniform(seed + ":c", F.col("id")) * len(cols)).cast("int").alias("_col"),
    ).groupBy("_pos").agg(F.collect_set("_col").alias("_cols"))
    numbered = global_row_number(df, [key], out="_pos")
    j = numbered.join(draws, "_pos", "left")
    for i, c in enumerate(cols):
        j = j.withColumn(c, F.when(F.coalesce(F.array_contains("_cols", F.lit(i)), F.lit(False)), F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return j.drop("_pos", "_cols")

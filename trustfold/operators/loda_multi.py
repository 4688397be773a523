"""Multi-column LODA (D7, Pevny 2016) over a vector column.

R sparse random projections (sqrt(d) non-zero N(0, 1) weights each, from a
seeded generator: a parameter set of size R x sqrt(d), not data) turn every
vector into R numbers with one ``posexplode``; every projection gets an
equal-width histogram; a vector's score is the mean of -ln(bin share) over
the projections, and the top c fraction (D9) is flagged.

Per-projection statistics come from ``groupBy`` with partial aggregation and
have R and R x bins rows, a bound fixed by the parameters, so they are
broadcast.  The threshold is one global exact percentile, a scalar that
``group_percentiles`` finds without holding the scores in one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_PROJECTIONS = 100
BINS = 10
SEED = 42
DIGITS = 9  # scores are rounded before thresholding, so summation order cannot flip a flag


def projections(dim: int, n: int = N_PROJECTIONS, seed: int = SEED) -> list[list[tuple[int, float]]]:
    """Sparse Gaussian projections: per projection, sorted (index, weight) pairs."""
    rng = np.random.default_rng(seed)
    k = max(1, int(math.sqrt(dim)))
    out = []
    for _ in range(n):
        idx = np.sort(rng.choice(dim, size=k, replace=False))
        w = rng.standard_normal(k)
        out.append([(int(i), float(x)) for i, x in zip(idx, w)])
    return out


def _projected(vec: str, projs) -> Column:
    """All R projections of a row as one array: ``transform`` over a literal
    projection table, ``aggregate`` over its sorted (index, weight) terms (a
    small expression, so code generation stays within method limits)."""
    table = F.array(*[
        F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(w).alias("w")) for i, w in p]) for p in projs
    ])
    v = F.col(vec)
    return F.transform(table, lambda p: F.aggregate(
        p, F.lit(0.0), lambda acc, e: acc + e["w"] * F.element_at(v, e["i"]).cast("double")))


def loda_scores(df: DataFrame, id_col: str, vec: str, dim: int, n: int = N_PROJECTIONS, bins: int = BINS,
                seed: int = SEED) -> DataFrame:
    projs = projections(dim, n, seed)
    zs = df.select(id_col, F.posexplode(_projected(vec, projs)).alias("r", "z"))
    st = zs.groupBy("r").agg(F.min("z").alias("_min"), F.max("z").alias("_max"), F.count(F.lit(1)).alias("_n"))
    width = (F.col("_max") - F.col("_min")) / F.lit(bins)
    b = zs.join(F.broadcast(st), "r").withColumn(
        "_bin", F.when(F.col("_max") == F.col("_min"), F.lit(0)).otherwise(
            F.least(F.floor((F.col("z") - F.col("_min")) / width).cast("int"), F.lit(bins - 1))))
    cnt = b.groupBy("r", "_bin").agg(F.count(F.lit(1)).alias("_nb"))
    scored = b.join(F.broadcast(cnt), ["r", "_bin"]).groupBy(id_col).agg(
        F.round(F.avg(-F.log(F.col("_nb") / F.col("_n"))), DIGITS).alias("score"))
    return scored


def loda_flags(df: DataFrame, id_col: str, vec: str, dim: int, contamination: float, **kw) -> DataFrame:
    from trustfold.plans.percentiles import group_percentiles
    from trustfold.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    scored = loda_scores(df, id_col, vec, dim, **kw).checkpoint()
    row = group_percentiles(scored, [], {"t": (F.col("score"), 1.0 - contamination)}).first()
    return scored.withColumn("is_outlier", F.coalesce(F.col("score") > F.lit(row["t"] if row else None).cast("double"), F.lit(False)))


def oracle_sql(table: str, id_col: str, vec: str, dim: int, contamination: float, n: int = N_PROJECTIONS,
               bins: int = BINS, seed: int = SEED) -> str:
    """DuckDB text of the same computation (weights as exact literals)."""
    exprs = []
    for p in projections(dim, n, seed):
        terms = [f"{w:.17e} * CAST({vec}[{i + 1}] AS DOUBLE)" for i, w in p]
        exprs.append("(" + " + ".join(terms) + ")")
    arr = "[" + ", ".join(exprs) + "]"
    return f"""WITH zs AS (SELECT {id_col}, r - 1 AS r, zl[r] AS z
              FROM (SELECT {id_col}, {arr} AS zl FROM {table}) a, range(1, {n + 1}) t(r)),
  st AS (SELECT r, min(z) AS mn, max(z) AS mx, count(*) AS n FROM zs GROUP BY r),
  b AS (SELECT zs.*, st.n, CASE WHEN mx = mn THEN 0 ELSE least(CAST(floor((z - mn) / ((mx - mn) / {bins})) AS INTEGER), {bins - 1}) END AS bin
          FROM zs JOIN st USING (r)),
  c AS (SELECT r, bin, count(*) AS nb FROM b GROUP BY r, bin),
  s AS (SELECT {id_col}, round(avg(-ln(nb / n)), {DIGITS}) AS score FROM b JOIN c USING (r, bin) GROUP BY {id_col})
SELECT {id_col}, score, COALESCE(score > (SELECT quantile_cont(score, CAST({1.0 - contamination!r} AS DOUBLE)) FROM s), FALSE) AS is_outlier FROM s"""

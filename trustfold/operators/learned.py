"""Model-based detectors (D6 Isolation Forest, D8 one-class SVM).

Both fit one model of fixed size per (chunk, column) group and score all rows
in vectorised batches:

* IForest (Liu et al. 2008): 100 trees of 256 rows each, depth limit
  ceil(log2 256).  Trees draw their rows by hash from the whole group: in a
  round, rows are dealt into n / 256 disjoint sets, each a tree's sample, and
  small groups are dealt in as many rounds as give 100 sets.  Draws and cuts come
  from the MD5 of (round, row) and (group, tree, node), so any engine can grow
  the same forest.  In one dimension the forest's mean path length is a step
  function of x, which is the model; scores are rounded to 9 digits.
* OC-SVM (Schoelkopf et al. 2001), re-aimed for scale: RBF kernel
  approximated by 64 random Fourier features (Rahimi & Recht 2007), primal
  sub-gradient descent with nu = 0.5.  All rows take part, as a histogram of
  4096 equal-width cells with each cell's count and mean; the score is the
  signed margin.

Both feed the contamination threshold (D9).  SQL replays the forest; for the
machine there is no oracle, and tests check properties instead (flag share at
most c plus ties).
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustfold.functions.scalars import hashed_uniform

N_TREES = 100
DIGITS = 9  # of a forest's score, so that the order of summation cannot flip a flag
SUBSAMPLE = 256
RFF_DIM = 64
OCSVM_NU = 0.5
OCSVM_CELLS = 4096
OCSVM_STEPS = 200
_G = ["chunk_id", "column"]


def _group_seed(chunk_id, column) -> int:
    return zlib.crc32(f"{chunk_id}|{column}".encode()) & 0x7FFFFFFF


def _collect(fitted: DataFrame) -> tuple[dict, list[str]]:
    """({group: arrays}, errors): one model per group, of a size that the data do not change."""
    rows = fitted.collect()
    errors = [r["error"] for r in rows if r["error"]]
    return {(r["chunk_id"], r["column"]): [np.array(a, dtype=float) for a in r["model"]] for r in rows if not r["error"]}, errors


_FIT_SCHEMA = "chunk_id int, column string, model array<array<double>>, error string"


def _fitted(fit):
    """``fit(chunk_id, column, pdf)`` as a grouped map that returns the error of a group whose fit fails."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk_id, column = int(pdf["chunk_id"].iloc[0]), pdf["column"].iloc[0]
        try:
            model, error = [np.asarray(a, dtype=float).tolist() for a in fit(chunk_id, column, pdf)], None
        except Exception as e:  # noqa: BLE001 - the caller decides what a failed model means
            model, error = [], f"{type(e).__name__}: {e} (chunk {chunk_id}, column {column})"
        return pd.DataFrame({"chunk_id": [chunk_id], "column": [column], "model": [model], "error": [error]})

    return run


# --- isolation forest -----------------------------------------------------------


def path_correction(n: int) -> float:
    """Mean path length of an unsuccessful search among n points (the usual harmonic estimate)."""
    return 0.0 if n <= 1 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _uniform(*parts) -> float:
    """``scalars.hashed_uniform`` of the parts."""
    return int(hashlib.md5("#".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def _grow(x: np.ndarray, name: tuple, limit: int) -> list[tuple[float, float]]:
    """Leaves of one isolation tree as (lower bound, path length); they tile the line.  Node 1 is the root, node i has the
    children 2i (below the cut) and 2i + 1."""
    stack, leaves = [(x, 0, -np.inf, 1)], []
    while stack:
        xs, depth, low, node = stack.pop()
        if depth >= limit or len(xs) <= 1 or xs.min() == xs.max():
            leaves.append((low, depth + path_correction(len(xs))))
            continue
        cut = xs.min() + _uniform("cut", *name, node) * (xs.max() - xs.min())
        stack.append((xs[xs < cut], depth + 1, low, 2 * node))
        stack.append((xs[xs >= cut], depth + 1, cut, 2 * node + 1))
    return sorted(leaves)


def _forest(chunk_id, column, pdf: pd.DataFrame):
    """(lower bounds, scores) of the forest's step function."""
    limit = math.ceil(math.log2(SUBSAMPLE))
    samples = {int(t): x["value"].to_numpy(dtype=float) for t, x in pdf.groupby("tree")}
    trees = [_grow(x, (chunk_id, column, t), limit) for t, x in samples.items()]
    lows = np.unique([low for leaves in trees for low, _ in leaves])
    total = np.zeros(len(lows))
    for leaves in trees:
        at = np.searchsorted([low for low, _ in leaves], lows, side="right") - 1
        total += np.array([h for _, h in leaves])[at]
    size = min(SUBSAMPLE, max(len(x) for x in samples.values()))
    return lows, np.round(np.power(2.0, -(total / len(trees)) / max(path_correction(size), 1e-12)), DIGITS)


def tree_samples(long: DataFrame, stats: DataFrame, trees: int = N_TREES, size: int = SUBSAMPLE) -> DataFrame:
    """(chunk_id, column, tree, value): about ``size`` rows for each of ``trees`` trees, whatever the group's size."""
    sets = F.greatest(F.lit(1), F.ceil(F.col("_n") / size)).cast("int")
    rounds = F.ceil(F.lit(trees) / F.col("sets")).cast("int")
    rows = long.join(F.broadcast(stats.select(*_G, sets.alias("sets"))), _G).withColumn("round", F.explode(F.sequence(F.lit(0), rounds - 1)))
    draw = F.floor(hashed_uniform("tree", F.concat_ws("#", F.col("round").cast("string"), F.col("row_id").cast("string"))) * F.col("sets"))
    tree = F.col("round") * F.col("sets") + draw.cast("int")
    return rows.withColumn("tree", tree).where(F.col("tree") < trees).select(*_G, "tree", "value")


def fit_forests(long: DataFrame, stats: DataFrame):
    return _collect(tree_samples(long, stats).groupBy(*_G).applyInPandas(_fitted(_forest), _FIT_SCHEMA))


# --- one-class SVM ---------------------------------------------------------------


def _features(z: np.ndarray, omega: np.ndarray, b: np.ndarray) -> np.ndarray:
    return math.sqrt(2.0 / RFF_DIM) * np.cos(np.outer(z, omega) + b)


def _machine(chunk_id, column, pdf: pd.DataFrame):
    """(mean, sd, rho), w, omega, b; ``pdf`` has the mean and the rows of each cell."""
    x, n = pdf["mean"].to_numpy(dtype=float), pdf["rows"].to_numpy(dtype=float)
    mu, sd = float(pdf["_mean"].iloc[0]), float(pdf["_sd"].iloc[0]) or 1.0
    rng = np.random.default_rng(_group_seed(chunk_id, column))
    omega, b = rng.normal(size=RFF_DIM), rng.uniform(0, 2 * math.pi, size=RFF_DIM)
    phi, share = _features((x - mu) / sd, omega, b), n / n.sum()
    w = share @ phi
    order = np.argsort(phi @ w)
    rho = float((phi @ w)[order][np.searchsorted(np.cumsum(share[order]), OCSVM_NU)])
    for t in range(1, OCSVM_STEPS + 1):
        below = phi @ w < rho
        w = w - (w - share[below] @ phi[below] / OCSVM_NU) / (t + 10)
        rho -= (share[below].sum() / OCSVM_NU - 1.0) / (t + 10)
    return [mu, sd, rho], w, omega, b


def fit_machines(long: DataFrame, stats: DataFrame):
    rows = long.join(F.broadcast(stats), _G)  # one row per chunk and column
    width = (F.col("_max") - F.col("_min")) / OCSVM_CELLS
    cell = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_min")) / width), F.lit(OCSVM_CELLS - 1))).otherwise(F.lit(0))
    cells = rows.groupBy(*_G, "_mean", "_sd", cell.alias("cell")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("rows"))
    return _collect(cells.groupBy(*_G).applyInPandas(_fitted(_machine), _FIT_SCHEMA))


# --- scores ----------------------------------------------------------------------


def _forest_scores(model, x: np.ndarray) -> np.ndarray:
    lows, scores = model
    return scores[np.searchsorted(lows, x, side="right") - 1]


def _machine_scores(model, x: np.ndarray) -> np.ndarray:
    (mu, sd, rho), w, omega, b = model
    return rho - _features((x - mu) / sd, omega, b) @ w


def with_scores(rows: DataFrame, models: dict) -> DataFrame:
    """``rows`` (chunk_id, column, value, ...) with one score column per model, by its method's name."""
    if not models:
        return rows
    score = {"IForest": _forest_scores, "OC-SVM": _machine_scores}
    shared = rows.sparkSession.sparkContext.broadcast(models)  # groups x a fixed size

    def run(batches):
        for pdf in batches:
            for name, by_group in shared.value.items():
                out = np.full(len(pdf), np.nan)
                for group, at in pdf.groupby(_G, sort=False).indices.items():
                    out[at] = score[name](by_group[group], pdf["value"].to_numpy()[at])
                pdf[name] = out
            yield pdf

    schema = T.StructType(list(rows.schema.fields) + [T.StructField(n, T.DoubleType()) for n in models])
    return rows.mapInPandas(run, schema)

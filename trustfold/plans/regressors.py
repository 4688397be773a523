"""Two regressors that Spark ML lacks, fitted by Spark jobs (M3).

Both read the feature columns of a frame in batches; what tasks send back is
summed by Spark and has the size of the model, whatever the rows.

* Extremely randomised trees (Geurts et al. 2006): all trees grow one level at a
  time. A first job finds each open node's feature ranges, the driver draws a few
  (feature, cut) pairs per node, and a second job sums the rows on either side of
  each; the pair that explains most variance becomes the split.
* Stochastic gradient descent: in each epoch every task goes over its rows in
  small steps from the same weights, and the tasks' weights are averaged by
  their rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 420


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]) if len(names) else np.zeros((batch.num_rows, 0))


def _predicted(df: DataFrame, names: Sequence[str], predict) -> DataFrame:
    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(predict(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    return df.withColumn("prediction", score(*[F.col(f"`{n}`").cast("double") for n in names]))


@dataclass
class Trees:
    """Trees as heaps: node i has children 2i + 1 and 2i + 2; feature -1 marks a leaf."""

    names: list[str]
    feature: np.ndarray  # (tree, node)
    cut: np.ndarray
    value: np.ndarray

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """(tree, row): the node in which each row ends."""
        at = np.zeros((len(self.feature), len(x)), dtype=np.int64)
        tree = np.arange(len(self.feature))[:, None]
        while True:
            f = self.feature[tree, at]
            if (f < 0).all():
                return at
            left = x[np.arange(len(x)), np.maximum(f, 0)] <= self.cut[tree, at]
            at = np.where(f < 0, at, 2 * at + np.where(left, 1, 2))

    def transform(self, df: DataFrame) -> DataFrame:
        tree = np.arange(len(self.feature))[:, None]
        return _predicted(df, self.names, lambda x: self.value[tree, self.nodes(x)].mean(axis=0))


@dataclass
class Line:
    names: list[str]
    weights: np.ndarray  # the last is the constant

    def transform(self, df: DataFrame) -> DataFrame:
        return _predicted(df, self.names, lambda x: x @ self.weights[:-1] + self.weights[-1])


def save(model: Trees | Line, path: str) -> None:
    fields = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(model).items()}
    SparkSession.active().createDataFrame([(type(model).__name__, json.dumps(fields))], "kind string, fields string").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Trees | Line:
    r = spark.read.parquet(path).first()
    fields = json.loads(r["fields"])
    arrays = {k: v if k == "names" else np.array(v) for k, v in fields.items()}
    return {"Trees": Trees, "Line": Line}[r["kind"]](**arrays)


def _ranges(data: DataFrame, model: Trees, open_nodes: np.ndarray) -> dict:
    """{(tree, node): (rows, sum, sum of squares, least and greatest of each feature)} of the open nodes."""
    names, width = model.names, model.feature.shape[1]

    def run(batches):
        n_keys = len(model.feature) * width
        sums = np.zeros((3, n_keys))
        low, high = np.full((len(names), n_keys), np.inf), np.full((len(names), n_keys), -np.inf)
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b, names), b.column("label").to_numpy(zero_copy_only=False)
                key = (model.nodes(x) + np.arange(len(model.feature))[:, None] * width).ravel()
                for i, v in enumerate((np.ones(len(y)), y, y * y)):
                    sums[i] += np.bincount(key, np.tile(v, len(model.feature)), n_keys)
                for f in range(len(names)):
                    each = np.tile(x[:, f], len(model.feature))
                    np.minimum.at(low[f], key, each)
                    np.maximum.at(high[f], key, each)
        keys = [k for k in np.flatnonzero(sums[0]) if open_nodes[k // width, k % width]]
        rows = [(int(k), f, *sums[:, k].tolist(), float(low[f, k]), float(high[f, k])) for k in keys for f in range(len(names))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "f", "n", "y", "yy", "low", "high"])

    got = data.mapInArrow(run, "key long, f long, n double, y double, yy double, low double, high double")
    out: dict = {}
    for r in got.groupBy("key", "f").agg(*[F.sum(c).alias(c) for c in ("n", "y", "yy")], F.min("low").alias("low"), F.max("high").alias("high")).collect():
        node = out.setdefault((r["key"] // width, r["key"] % width), [r["n"], r["y"], r["yy"], {}])
        node[3][r["f"]] = (r["low"], r["high"])
    return out


def _sides(data: DataFrame, model: Trees, drawn: dict) -> dict:
    """{(tree, node): [(rows, sum, sum of squares) left of each drawn pair]}"""
    names = model.names

    def run(batches):
        sums = {k: np.zeros((len(pairs), 3)) for k, pairs in drawn.items()}
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b, names), b.column("label").to_numpy(zero_copy_only=False)
                at = model.nodes(x)
                for (tree, node), pairs in drawn.items():
                    here = at[tree] == node
                    if here.any():
                        for i, (f, cut) in enumerate(pairs):
                            left = y[here & (x[:, f] <= cut)]
                            sums[tree, node][i] += len(left), left.sum(), (left * left).sum()
        rows = [(t, n, i, *v.tolist()) for (t, n), s in sums.items() for i, v in enumerate(s) if v[0]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["tree", "node", "i", "n", "y", "yy"])

    got = data.mapInArrow(run, "tree long, node long, i long, n double, y double, yy double")
    out = {k: [(0.0, 0.0, 0.0)] * len(pairs) for k, pairs in drawn.items()}
    for r in got.groupBy("tree", "node", "i").agg(*[F.sum(c).alias(c) for c in ("n", "y", "yy")]).collect():
        out[r["tree"], r["node"]][r["i"]] = (r["n"], r["y"], r["yy"])
    return out


def extra_trees(data: DataFrame, names: Sequence[str], trees: int = 20, depth: int = 6, tries: int | None = None, least: int = 5) -> Trees:
    """Fit on ``data`` (feature columns ``names``, label); nodes of fewer than 2 ``least`` rows are leaves. ``tries`` pairs are
    drawn per node, by default as many as there are features, which the method advises for regression."""
    rng = np.random.default_rng(SEED)
    width = 2 ** (depth + 1) - 1
    model = Trees(list(names), np.full((trees, width), -1), np.zeros((trees, width)), np.zeros((trees, width)))
    data = data.select(*[F.col(f"`{n}`").cast("double").alias(n) for n in names], "label")
    open_nodes = np.zeros((trees, width), dtype=bool)
    open_nodes[:, 0] = True
    spread = lambda n, y, yy: yy - y * y / n if n else 0.0
    for level in range(depth + 1):
        found = _ranges(data, model, open_nodes)
        drawn = {}
        for (t, node), (n, y, _, ranges) in sorted(found.items()):
            model.value[t, node] = y / n
            wide = [f for f, (a, b) in sorted(ranges.items()) if a < b]
            if level < depth and n >= 2 * least and wide:
                drawn[t, node] = [(int(f), float(rng.uniform(*ranges[f]))) for f in rng.choice(wide, tries or len(names))]
        open_nodes[:] = False
        if not drawn:
            break
        for (t, node), sides in _sides(data, model, drawn).items():
            n, y, yy, _ = found[t, node]
            gains = [spread(n, y, yy) - spread(*s) - spread(n - s[0], y - s[1], yy - s[2]) if 0 < s[0] < n else -1.0 for s in sides]
            i = int(np.argmax(gains))
            if gains[i] > 0:
                model.feature[t, node], model.cut[t, node] = drawn[t, node][i]
                open_nodes[t, 2 * node + 1] = open_nodes[t, 2 * node + 2] = True
        if not open_nodes.any():
            break
    return model


def sgd(data: DataFrame, names: Sequence[str], epochs: int = 8, rate: float = 0.5, decay: float = 1e-4, step: int = 32) -> Line:
    """Least squares by averaged gradient descent on ``data`` (scaled feature columns ``names``, label). A step is divided by
    the mean squared length of its rows, so that it cannot overshoot."""
    rows = data.select(*[F.col(f"`{n}`").cast("double").alias(n) for n in names], "label")
    weights = np.zeros(len(names) + 1)
    for epoch in range(epochs):
        def run(batches, start=weights, pace=rate / (1 + epoch / 2)):
            w, n = start.copy(), 0
            for b in batches:
                x, y = _matrix(b, names), b.column("label").to_numpy(zero_copy_only=False)
                x = np.column_stack([x, np.ones(len(x))])
                for i in range(0, len(x), step):
                    part = x[i : i + step]
                    slope = part.T @ (part @ w - y[i : i + step]) / len(part) + decay * w
                    w = w - pace * slope / (part * part).sum(axis=1).mean()  # at least 1, by the constant
                n += len(x)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(w)), pa.int32()), pa.array(w * n), pa.array([float(n)] * len(w))], names=["i", "w", "n"])

        mean = rows.mapInArrow(run, "i int, w double, n double").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).collect()
        for r in mean:
            weights[r["i"]] = r["w"]
        weights = weights.copy()
    return Line(list(names), weights)

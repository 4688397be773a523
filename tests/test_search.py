import numpy as np
import pytest
from pyspark.sql import functions as F

from trustfold.plans import models as M
from trustfold.plans import regressors as G

NAMES = ["a", "b", "c"]


def frame(spark, n=400, parts=4):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] > 0.3, 2.0, 0.0) + 0.5 * x[:, 1] + rng.normal(size=n) * 0.05
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, label double").repartition(parts)


def score(model, data):
    return M.r2(model.transform(data)).first()["r2"]


def test_extra_trees_learn_a_step_that_a_line_cannot(spark):
    data = frame(spark).checkpoint()
    trees, line = G.extra_trees(data, NAMES), G.sgd(data, NAMES, epochs=12)
    assert score(trees, data) > score(line, data) > 0.6
    assert line.weights[1] == pytest.approx(0.5, abs=0.15) and abs(line.weights[2]) < 0.15
    # every row is in one leaf of each tree, and a leaf's value is the mean of its rows
    pdf = data.toPandas()
    at = trees.nodes(pdf[NAMES].to_numpy())
    for t in range(3):
        for node in np.unique(at[t]):
            assert trees.feature[t, node] == -1 and trees.value[t, node] == pytest.approx(pdf["label"][at[t] == node].mean())


def test_fits_do_not_depend_on_the_partitions(spark):
    one, many = (G.extra_trees(frame(spark, 200, n), NAMES, trees=4, depth=3) for n in (1, 7))
    assert np.array_equal(one.feature, many.feature) and np.allclose(one.cut, many.cut) and np.allclose(one.value, many.value)


def test_models_survive_a_reload(spark, tmp_path):
    data = frame(spark, 100)
    for i, model in enumerate((G.extra_trees(data, NAMES, trees=3, depth=2), G.sgd(data, NAMES, epochs=2))):
        G.save(model, f"{tmp_path}/{i}")
        again = G.load(spark, f"{tmp_path}/{i}")
        both = [m.transform(data).select("row_id", F.col("prediction").alias(n)) for m, n in ((model, "p"), (again, "q"))]
        assert both[0].join(both[1], "row_id").where("abs(p - q) > 1e-12").count() == 0


def test_constant_and_tiny_data(spark):
    same = spark.createDataFrame([(1.0, 2.0)] * 30, "a double, label double")
    assert score_of(G.extra_trees(same, ["a"], trees=2, depth=3), same) == {2.0}
    few = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "a double, label double")
    assert score_of(G.extra_trees(few, ["a"], trees=2, depth=3), few) == {3.5}


def score_of(model, data):
    return {r["prediction"] for r in model.transform(data).collect()}


class _Fake:
    def __init__(self, quality, log, name):
        self.quality, self.log, self.name = quality, log, name

    def __call__(self, data, names):
        self.log.append((self.name, data.count()))
        return self

    def transform(self, df):
        return df.withColumn("prediction", F.col("label") + F.lit(self.quality) * (F.col("a") + 0.1))


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_halving_starts_with_all_and_ends_with_the_best(spark, rounds):
    log: list = []
    entries = [M.Candidate(f"f{i}", _Fake(0.1 * (i + 1), log, f"f{i}")) for i in (3, 0, 4, 1, 2)]
    data = frame(spark, 300).withColumns({"_fold": F.col("row_id") % 5, "_u": F.col("row_id") / 300.0}).checkpoint()
    left = M.halving(data, NAMES, entries, M._evaluator("regression"), rounds, 4)
    assert left[0][0].family == "f0" and len(left) == {1: 5, 2: 3, 3: 2}[rounds]
    sizes = {}
    for name, n in log:
        sizes.setdefault(n, set()).add(name)
    assert sizes[min(sizes)] == {"f0", "f1", "f2", "f3", "f4"} and max(sizes) == 240 and len(sizes) == rounds


def test_every_family_enters_both_searches():
    families = {e: {c.family for c in M.candidates("regression", e)} for e in "AB"}
    assert families["A"] == {"LinearRegression", "DecisionTreeRegressor", "RandomForestRegressor", "GBTRegressor"}
    assert families["B"] == {"RandomForestRegressor", "GBTRegressor", "ExtraTrees", "SGD"}


def test_search_finds_the_step(spark):
    df = frame(spark).withColumnRenamed("label", "y")
    for engine in "AB":
        res = M.search(df, NAMES, "y", engine, budget=2)
        assert res.holdout > 0.85 and res.in_sample > 0.85 and res.task == "regression"

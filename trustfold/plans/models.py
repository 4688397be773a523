"""Model jobs with Spark ML (M1-M8).

The original runs two single-machine AutoML searches under a time budget; here
both are successive halving, over candidates and rows, on Spark:

* search A (M2): linear and elastic net, decision trees, random forest and
  boosted trees; the last candidates are scored by 5-fold cross-validation;
* search B (M3): random forest, boosted trees of two depths, extremely
  randomised trees and stochastic gradient descent, scored on a hold-out fold;
* every family enters the first round. The budget is the number of rounds: each
  further one begins with half the rows, and halves the candidates once more;
* M4 / M8: encode and scale the features, with the replay source where there is
  one, train on an exact seeded sample (or on all rows), score **all** rows with
  both models, and take each user's median prediction;
* M6: in-sample score written to an append-mode ledger (plus hold-out);
* M7 / E7: the fitted pipeline, scaler and categories are saved and loaded together.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustfold.functions.scalars import integer_like
from trustfold.operators.aggregates import median_per_key
from trustfold.operators.encode import ScalerModel, categories, fit_scaler, onehot
from trustfold.operators.sampling import seeded_sample
from trustfold.operators.schema import check_target, numeric_only, require_columns
from trustfold.plans import regressors
from trustfold.session import ensure_checkpoint_dir
from trustfold.sources.tables import ROW_ID, USER

SEED = 420


def task_type(df: DataFrame, target: str) -> str:
    """M1: classification if the target is non-numeric, or numeric with at most 10 whole values."""
    if not isinstance(df.schema[target].dataType, T.NumericType):
        return "classification"
    return "classification" if df.agg(integer_like(F.col(target)).alias("whole")).first()["whole"] else "regression"


@dataclass(frozen=True)
class Candidate:
    """A family and the fit of one of its settings: (rows, feature names) -> model with ``transform``."""

    family: str
    fit: Callable[[DataFrame, list[str]], Any]


def _spark_ml(family: str, make, **settings) -> Candidate:
    def fit(data: DataFrame, names: list[str]):
        assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
        return Pipeline(stages=[assembler, make(featuresCol="features", labelCol="label", **settings)]).fit(data)

    return Candidate(family, fit)


def candidates(task: str, engine: str) -> list[Candidate]:
    """All that enter a search: the families of the engine, each with its settings."""
    trees = {"seed": SEED}
    if task == "classification":
        out = [_spark_ml("LogisticRegression", LogisticRegression, regParam=r) for r in (0.0, 0.1)]
        out += [_spark_ml("DecisionTreeClassifier", DecisionTreeClassifier, maxDepth=d, **trees) for d in (3, 5)]
        return [*out, _spark_ml("RandomForestClassifier", RandomForestClassifier, maxDepth=5, numTrees=20, **trees)]
    forest = _spark_ml("RandomForestRegressor", RandomForestRegressor, maxDepth=5, numTrees=20, **trees)
    boosted = lambda depth: _spark_ml("GBTRegressor", GBTRegressor, maxDepth=depth, maxIter=10, **trees)
    if engine == "A":
        out = [_spark_ml("LinearRegression", LinearRegression, regParam=r, elasticNetParam=e) for r, e in ((0.0, 0.0), (0.1, 0.0), (0.1, 0.5))]
        out += [_spark_ml("DecisionTreeRegressor", DecisionTreeRegressor, maxDepth=d, **trees) for d in (3, 5)]
        return [*out, forest, boosted(3)]
    return [forest, boosted(5), boosted(3), Candidate("ExtraTrees", regressors.extra_trees), Candidate("SGD", regressors.sgd)]


def _evaluator(task: str):
    if task == "regression":
        return RegressionEvaluator(metricName="r2", labelCol="label", predictionCol="prediction")
    return MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label", predictionCol="prediction")


@dataclass
class FitResult:
    model: Any  # a PipelineModel, or a model of ``regressors``
    engine: str
    task: str
    in_sample: float
    holdout: float | None
    best: str


def _prepare(df: DataFrame, features, target):
    numeric_only(df, features)
    return df.withColumn("label", F.col(target).cast("double"))


FOLDS = 5
ROWS_A_TASK = 20_000  # of a search's data


def _packed(data: DataFrame, names: list[str]) -> DataFrame:
    """``data``, a stored table, in no more partitions than its rows fill, in a fixed order.

    A search runs thousands of short jobs over its data. A sample of some thousand rows comes in as many partitions as the
    log that it was drawn from, and nearly all of a job's time would be the start of tasks without rows.
    """
    wanted = max(1, math.ceil(data.count() / ROWS_A_TASK))
    if data.rdd.getNumPartitions() <= wanted:
        return data
    order = ["_u", "_fold", *[f"`{n}`" for n in names], "label"]
    return data.repartition(wanted, "_u").sortWithinPartitions(*order).checkpoint()


def _in_parallel(spark, parallelism: int, fn, items: list) -> list:
    with ThreadPool(max(1, min(parallelism, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), items)


def halving(data: DataFrame, names: list[str], entries: list[Candidate], evaluator, rounds: int, parallelism: int) -> list[tuple[Candidate, float]]:
    """(candidate, last score) of the last round, the best first.

    Each round fits the candidates left on the rows of four folds, in the first round on 2^(1 - rounds) of them and in each
    further one on twice as many, and scores them on the fifth; the better half goes on. ``data`` has ``_fold`` and ``_u``, a
    uniform number by which the rows of a round hold those of the rounds before.
    """
    test = data.where("_fold = 0")
    left = [(c, float("-inf")) for c in entries]
    for r in range(rounds):
        train = data.where((F.col("_fold") != 0) & (F.col("_u") < 2.0 ** (r + 1 - rounds)))
        scores = _in_parallel(data.sparkSession, parallelism, lambda c: evaluator.evaluate(c[0].fit(train, names).transform(test)), left)
        ranked = sorted(range(len(left)), key=lambda i: (-scores[i], i))
        left = [(left[i][0], scores[i]) for i in ranked]
        if r + 1 < rounds:
            left = left[: max(1, (len(left) + 1) // 2)]
    return left


def cross_validated(data: DataFrame, names: list[str], entries: list[Candidate], evaluator, parallelism: int) -> list[float]:
    """Mean score of each candidate over all folds."""
    runs = [(c, k) for c in entries for k in range(FOLDS)]
    one = lambda ck: evaluator.evaluate(ck[0].fit(data.where(F.col("_fold") != ck[1]), names).transform(data.where(F.col("_fold") == ck[1])))
    scores = _in_parallel(data.sparkSession, parallelism, one, runs)
    return [sum(scores[i * FOLDS : (i + 1) * FOLDS]) / FOLDS for i in range(len(entries))]


def search(df: DataFrame, features, target: str, engine: str = "A", budget: int = 3, parallelism: int = 8) -> FitResult:
    """M2 (engine A) or M3 (engine B) in ``budget`` rounds; the winner is fitted on all rows."""
    task = task_type(df, target)
    names = list(features)
    ensure_checkpoint_dir(df.sparkSession)
    rows = _prepare(df, names, target)
    key = [F.col(f"`{n}`") for n in names] + [F.col("label")]
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(SEED + salt), *key), F.lit(1 << 20))  # noqa: E731 - equal rows share a fold
    data = rows.withColumns({"_fold": draw(0) % FOLDS, "_u": draw(1) / (1 << 20)}).checkpoint()
    data = _packed(data, names)
    ev = _evaluator(task)
    left = halving(data, names, candidates(task, engine), ev, max(1, budget), parallelism)
    best, score = left[0]
    if engine == "A" and len(left) > 1:
        last = [c for c, _ in left[:2]]
        scores = cross_validated(data, names, last, ev, parallelism)
        at = max(range(len(last)), key=lambda i: (scores[i], -i))
        best, score = last[at], scores[at]
    model = best.fit(data, names)
    return FitResult(model, engine, task, ev.evaluate(model.transform(data)), score, best.family)


@dataclass
class Features:
    """Fitted feature preparation: scaled numeric columns, one-hot categories, the names that models see."""

    scaler: ScalerModel
    categories: dict[str, list[str]]
    names: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.scaler.transform(df)
        for c, cats in self.categories.items():
            out = onehot(out, c, cats, keep_source=True)
        return out

    def save(self, spark, path: str) -> None:
        self.scaler.to_frame(spark).write.mode("overwrite").parquet(f"{path}/scaler")
        rows = [(i, c, v) for c, cats in self.categories.items() for i, v in enumerate(cats)]
        spark.createDataFrame(rows, "place int, column string, value string").write.mode("overwrite").parquet(f"{path}/categories")
        spark.createDataFrame(list(enumerate(self.names)), "place int, name string").write.mode("overwrite").parquet(f"{path}/names")

    @classmethod
    def load(cls, spark, path: str) -> "Features":
        cats: dict[str, list[str]] = {}
        for r in sorted(spark.read.parquet(f"{path}/categories").collect(), key=lambda r: (r["column"], r["place"])):
            cats.setdefault(r["column"], []).append(r["value"])
        names = [r["name"] for r in sorted(spark.read.parquet(f"{path}/names").collect(), key=lambda r: r["place"])]
        return cls(ScalerModel.from_frame(spark.read.parquet(f"{path}/scaler")), cats, names)


def fit_features(df: DataFrame, numeric, categorical) -> Features:
    """M8: numeric columns standard-scaled, categories one-hot; the replay source is one of the categories."""
    require_columns(df, [*numeric, *categorical])
    cats = {c: categories(df, c) for c in categorical}
    return Features(fit_scaler(df, list(numeric), "standard"), cats, [*numeric, *[f"{c}_{v}" for c in categorical for v in cats[c]]])


def train_and_score(df: DataFrame, features: Features, target: str, sample_size: int | None, engine: str = "A", budget: int = 3,
                    parallelism: int = 8) -> tuple[FitResult, DataFrame]:
    """M4 / M5: fit on an exact seeded sample (all rows if ``sample_size`` is None), score every row."""
    ready = features.transform(df)
    sample = ready if sample_size is None else seeded_sample(ready, sample_size)
    res = search(sample, features.names, target, engine, budget, parallelism)
    return res, res.model.transform(_prepare(ready, features.names, target))


def check_scored(df: DataFrame, scored: DataFrame) -> None:
    """M5: as many predictions as rows."""
    rows, got = df.count(), scored.where(F.col("prediction").isNotNull()).count()
    if rows != got:
        raise ValueError(f"{got} predictions for {rows} rows")


def predict_final_reputations(df: DataFrame, features: Features, target: str, sample_size: int | None, budget: int = 3,
                              parallelism: int = 8) -> tuple[DataFrame, dict[str, FitResult]]:
    """M4: both searches, all rows scored, each user's median prediction of each (K2)."""
    check_target(df, target)
    results, scored = {}, df.select(ROW_ID, USER)
    for engine in ("A", "B"):
        results[engine], out = train_and_score(df, features, target, sample_size, engine, budget, parallelism)
        check_scored(df, out)
        scored = scored.join(out.select(ROW_ID, F.col("prediction").alias(f"prediction_{engine}")), ROW_ID)
    return predicted_medians(scored), results


def predicted_medians(scored: DataFrame) -> DataFrame:
    """K2: per user, the median of both predictions."""
    return median_per_key(scored, USER, ["prediction_A", "prediction_B"], ["Predicted_Final_Reputation_A", "Predicted_Final_Reputation_B"])


_LEDGER = "prefix string, engine string, pipeline string, task string, score double, holdout double"


def ledger_row(spark, prefix: str, res: FitResult) -> DataFrame:
    """M6: one result row."""
    holdout = None if res.holdout is None else float(res.holdout)
    return spark.createDataFrame([(prefix, res.engine, res.best, res.task, float(res.in_sample), holdout)], _LEDGER)


def append_ledger(row: DataFrame, path: str) -> DataFrame:
    """Append to the ledger and return the whole of it."""
    row.write.mode("append").parquet(path)
    return row.sparkSession.read.schema(_LEDGER).parquet(path)


def save(res: FitResult, features: Features, path: str) -> None:
    """Model, scaler and categories."""
    if isinstance(res.model, PipelineModel):
        res.model.write().overwrite().save(f"{path}/model")
    else:
        regressors.save(res.model, f"{path}/model")
    SparkSession.active().createDataFrame([(isinstance(res.model, PipelineModel),)], "pipeline boolean").write.mode("overwrite").parquet(f"{path}/kind")
    features.save(SparkSession.active(), f"{path}/features")


def load_and_predict(path: str, df: DataFrame, target: str) -> DataFrame:
    """M7: load a saved model with its feature preparation and score."""
    features = Features.load(df.sparkSession, f"{path}/features")
    pipeline = df.sparkSession.read.parquet(f"{path}/kind").first()["pipeline"]
    model = PipelineModel.load(f"{path}/model") if pipeline else regressors.load(df.sparkSession, f"{path}/model")
    return model.transform(_prepare(features.transform(df), features.names, target))


def r2(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M6 as one aggregate over the prediction table: r2 = 1 - sum((y - p)^2) / (n var_pop(y))."""
    y, p = F.col(label), F.col(prediction)
    return scored.agg((F.lit(1.0) - F.sum((y - p) * (y - p)) / (F.count(y) * F.var_pop(y))).alias("r2"), F.count(F.lit(1)).alias("n_rows"))

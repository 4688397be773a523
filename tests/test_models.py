import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from trustfold.functions.rules import label
from trustfold.operators import encode as E
from trustfold.operators.reputation import source_from_class
from trustfold.plans import models as M
from trustfold.plans import regressors
from trustfold.sources.tables import load_log


def _log(spark):
    return label(load_log(spark, SF)).withColumn("Dataset_Source", source_from_class())


def test_model_scaler_and_categories_survive_a_reload(spark, tmp_path):
    """What is loaded scores every row as what was saved."""
    log = _log(spark)
    features = M.fit_features(log, ["User_Experience", "value", "k"], ["event_type", "Dataset_Source"])
    assert features.names[:3] == ["User_Experience", "value", "k"] and "Dataset_Source_normal" in features.names
    res, scored = M.train_and_score(log, features, "User_Reputation", 300, engine="B", budget=1)
    M.check_scored(log, scored)
    M.save(res, features, str(tmp_path / "m"))
    again = M.load_and_predict(str(tmp_path / "m"), log, "User_Reputation")
    both = scored.select("row_id", F.col("prediction").alias("a")).join(again.select("row_id", F.col("prediction").alias("b")), "row_id")
    assert both.count() == log.count() and both.where("abs(a - b) > 1e-12").count() == 0
    with pytest.raises(ValueError, match="predictions"):
        M.check_scored(log, scored.limit(5))


def test_ledger_appends(spark, tmp_path):
    """A6 / M6."""
    log = _log(spark)
    features = M.fit_features(log, ["value", "k"], [])
    res, _ = M.train_and_score(log, features, "User_Reputation", None, engine="B", budget=1)
    for n in (1, 2):
        assert M.append_ledger(M.ledger_row(spark, f"run{n}", res), str(tmp_path / "ledger")).count() == n
    row = M.append_ledger(M.ledger_row(spark, "run3", res), str(tmp_path / "ledger")).where("prefix = 'run1'").first()
    assert row["score"] == pytest.approx(res.in_sample) and row["task"] == "regression"


def test_r2_is_one_minus_residual_share(spark):
    rows = [(1.0, 0.5), (2.0, 2.5), (4.0, 3.0)]
    got = M.r2(spark.createDataFrame(rows, "label double, prediction double")).first()
    mean = sum(y for y, _ in rows) / 3
    assert got["n_rows"] == 3 and got["r2"] == pytest.approx(1 - sum((y - p) ** 2 for y, p in rows) / sum((y - mean) ** 2 for y, _ in rows))


def test_task_type(spark):
    frame = spark.createDataFrame([(i % 2, float(i % 2), i / 7.0, "x") for i in range(40)], "a int, b double, c double, d string")
    assert [M.task_type(frame, c) for c in "abcd"] == ["classification", "classification", "regression", "classification"]


def test_one_scaler(spark):
    """Grouped and fitted scaling agree, on nulls and on a constant column too."""
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, None, 5.0), (0, 4.0, 5.0)], "g int, x double, c double")
    for kind in ("standard", "minmax"):
        fitted = E.fit_scaler(df, ["x", "c"], kind).transform(df)
        grouped = E.scale_grouped(E.scale_grouped(df, "x", ["g"], kind), "c", ["g"], kind)
        key = lambda r: (r["x"], r["c"])
        assert sorted(map(key, fitted.collect())) == sorted(map(key, grouped.collect()))
        assert all(r["c"] == 0 for r in fitted.collect())


def test_search_data_is_packed(spark, monkeypatch):
    """A search's short jobs run over a sample's rows, all of them, and not over the partitions of the log it came from."""
    seen = []

    def fit(data, names):
        seen.append((data.rdd.getNumPartitions(), data.count()))
        return regressors.sgd(data, names, epochs=1)

    monkeypatch.setattr(M, "candidates", lambda task, engine: [M.Candidate("Seen", fit)])
    df = spark.range(400).selectExpr("id / 400.0D AS x", "id * 2.5D + 0.25D AS y").repartition(40)
    res = M.search(df, ["x"], "y", "B", budget=1)
    assert seen[-1] == (1, 400) and {p for p, _ in seen} == {1} and res.best == "Seen"

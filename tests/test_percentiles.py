import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustfold.plans import percentiles as P


def check(spark, rows, qs=(0.0, 0.25, 0.5, 0.99, 1.0), parts=6):
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    got = {r["g"]: r for r in P.group_percentiles(df, ["g"], {f"p{i}": (F.col("v"), q) for i, q in enumerate(qs)}).collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = [v for v in vs if v is not None and not math.isnan(v)]
        for i, q in enumerate(qs):
            if not vs:
                assert got[g][f"p{i}"] is None
            else:
                assert got[g][f"p{i}"] == pytest.approx(float(np.percentile(vs, 100 * q)), rel=1e-12, abs=1e-300), (g, q)


def corpus(n=3000):
    rng = np.random.default_rng(1)
    kinds = {
        "normal": rng.normal(size=n), "ties": np.round(rng.normal(size=n)), "wide": np.exp(rng.normal(size=n) * 100),
        "signs": np.concatenate([-np.exp(rng.normal(size=n)), [0.0] * 50, [-0.0] * 50]), "one": np.full(n, 7.5),
        "close": 1.0 + np.arange(n) * 2.0**-52, "tiny": np.arange(n) * 5e-324, "hot": np.concatenate([np.full(3 * n, 0.1), rng.random(n)])}
    rows = [(g, float(v)) for g, vs in kinds.items() for v in vs]
    return rows + [("normal", None), ("normal", float("nan")), ("none", None), (None, 1.0), (None, 3.0), ("few", 2.0)] + [("nulls", None)] * 200


def test_groups_at_once(spark):
    check(spark, corpus(300))


def test_refined_ranks(spark, monkeypatch):
    monkeypatch.setattr(P, "SMALL", 100)
    check(spark, corpus())


def test_refined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(P, "SMALL", 10)
    monkeypatch.setattr(P, "BROADCAST_GROUPS", 1)
    check(spark, corpus(200), qs=(0.5, 0.9))


def test_infinities_and_whole_frame(spark, monkeypatch):
    monkeypatch.setattr(P, "SMALL", 5)
    vs = [float("-inf")] * 3 + [float(i) for i in range(-50, 50)] + [float("inf")] * 3
    df = spark.createDataFrame([(v,) for v in vs], "v double")
    r = P.group_percentiles(df, [], {"a": (F.col("v"), 0.0), "m": (F.col("v"), 0.5), "z": (F.col("v"), 1.0)}).first()
    assert (r["a"], r["m"], r["z"]) == (float("-inf"), -0.5, float("inf"))
    assert P.group_percentiles(df.limit(0), [], {"m": (F.col("v"), 0.5)}).first()["m"] is None


def test_no_window_over_values(spark, monkeypatch):
    """The only windows of a refinement run over cells, behind an aggregate."""
    monkeypatch.setattr(P, "SMALL", 10)
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = P.group_percentiles(df, ["g"], {"m": (F.col("v"), 0.5)})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort [v" not in plan

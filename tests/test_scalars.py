import datetime as dt

from pyspark.sql import functions as F

from trustfold.functions import scalars as S
from trustfold.operators.perturb import weighted_draw


def test_scalar_functions(spark):
    df = spark.createDataFrame(
        [("User_17", "2025-01-02 03:04:05", " Hello ", "12.5", "a/b/c.csv", 2.5, "Normal (Supervised)")],
        "u string, t string, s string, n string, p string, x double, lab string",
    )
    r = df.select(
        S.user_number(F.col("u")).alias("u"),
        S.parse_ts(F.col("t")).alias("t"),
        S.parse_ts(F.lit("not a time")).alias("bad"),
        S.norm_text(F.col("s")).alias("s"),
        S.to_number(F.col("n")).alias("n"),
        S.to_number(F.lit("x")).alias("nan"),
        S.base_name(F.col("p")).alias("p"),
        S.round_half_even(F.col("x")).alias("x"),
        S.label_head(F.col("lab")).alias("lab"),
        S.clamp(F.lit(1.7), 0.0, 1.0).alias("c"),
        S.percent_of(F.lit(1), F.lit(0)).alias("z"),
        S.category_order(F.lit("Normal"), ["Intentional", "Unintentional", "Normal"]).alias("o"),
    ).first()
    assert r["u"] == 17 and r["t"] == dt.datetime(2025, 1, 2, 3, 4, 5) and r["bad"] is None
    assert r["s"] == "hello" and r["n"] == 12.5 and r["nan"] is None and r["p"] == "c.csv"
    assert r["x"] == 2.0 and r["lab"] == "Normal" and r["c"] == 1.0 and r["z"] == 0.0 and r["o"] == 2


def test_hashed_uniform_and_weighted_draw(spark):
    df = spark.range(20000).select(S.hashed_uniform("road", F.col("id")).alias("u"))
    lo, hi = df.agg(F.min("u"), F.max("u")).first()
    assert 0.0 <= lo and hi < 1.0
    drawn = df.select(weighted_draw(F.col("u"), ["1way", "2way", "4way"], [0.3, 0.5, 0.2]).alias("v"))
    share = {r["v"]: r["count"] / 20000 for r in drawn.groupBy("v").count().collect()}
    assert abs(share["1way"] - 0.3) < 0.02 and abs(share["2way"] - 0.5) < 0.02 and abs(share["4way"] - 0.2) < 0.02

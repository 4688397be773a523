"""Report tables behind the charts.

All reports first reduce the log to day grain (a few hundred rows per year),
so the rolling windows and the pivot run on tiny inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustfold.functions.rules import CLASSES, INTENTIONAL, NORMAL, UNINTENTIONAL
from trustfold.operators.aggregates import max_per_key
from trustfold.operators.impute import zero_fill
from trustfold.operators.schema import inf_to_null
from trustfold.sources.tables import TS, USER

DAY = "Day"
# Tie order for the daily majority (Intentional first).
PRIORITY = [INTENTIONAL, UNINTENTIONAL, NORMAL]


def with_day(df: DataFrame, ts: str = TS) -> DataFrame:
    """S3: the day as a timestamp truncated to midnight (keeps TIMESTAMP_NTZ)."""
    return df.withColumn(DAY, F.date_trunc("day", F.col(ts)))


def rolling_mean(c: str, n: int = 7, require_non_null: bool = False) -> Column:
    """Mean of the last ``n`` rows, null until ``n`` rows (non-null rows for W6) exist.

    The window has no partition: it runs on a day-grain table whose size is
    the number of days, not the number of events.
    """
    w = Window.orderBy(DAY).rowsBetween(-(n - 1), 0)
    have = F.count(F.col(c)).over(w) if require_non_null else F.count(F.lit(1)).over(w)
    return F.when(have == n, F.avg(F.col(c)).over(w))


def _pivot(long: DataFrame, col: str, values, agg: Column) -> DataFrame:
    """One column per category, absent ones as 0."""
    return zero_fill(long.groupBy(DAY).pivot(col, list(values)).agg(agg), list(values))


#: Users that a sketch holds one by one, as a power of two. Up to so many counts are exact; beyond, the standard error is
#: 2^(-SKETCH_LOG2 / 2), 0.8%.
SKETCH_LOG2 = 14


def user_sketches(series: DataFrame, log2: int = SKETCH_LOG2) -> DataFrame:
    """K5, approximate form: Day, series, users_sketch, a mergeable sketch of the distinct users, of bounded size."""
    return series.where(F.col(USER).isNotNull()).groupBy(DAY, "series").agg(F.theta_sketch_agg(USER, log2).alias("users_sketch"))


def add_sketches(series: DataFrame, path: str, log2: int = SKETCH_LOG2) -> DataFrame:
    """Append the daily sketches of new rows to the stored ones and return them all. A day may come in several parts: a
    user seen in two of them counts once, as sketches are united."""
    user_sketches(series, log2).write.mode("append").parquet(path)
    return series.sparkSession.read.parquet(path)


def users_by_period(sketches: DataFrame, period: str, log2: int = SKETCH_LOG2) -> DataFrame:
    """start, series, users: distinct users of each day, week or month from daily sketches; no row of the log is read again."""
    start = F.date_trunc(period, F.col(DAY)).alias("start")
    united = sketches.groupBy(start, "series").agg(F.theta_union_agg("users_sketch", log2).alias("_all"))
    return united.select("start", "series", F.theta_sketch_estimate("_all").cast("bigint").alias("users"))


def daily_users(series: DataFrame, names, approximate: bool = False) -> DataFrame:
    """R2: distinct users per day for each series, plus 7-row means.

    ``series`` holds Day, User_Id and ``series`` (one name per class series).  ``approximate`` counts by sketches.
    """
    if approximate:
        per_day = users_by_period(user_sketches(series), "day").withColumnRenamed("start", DAY)
    else:
        per_day = series.groupBy(DAY, "series").agg(F.count_distinct(USER).alias("users"))
    wide = _pivot(per_day, "series", names, F.first("users"))
    for n in names:
        wide = wide.withColumn(n, F.col(n).cast("bigint"))
    return wide.select(DAY, *names, *[F.round(rolling_mean(n), 6).alias(f"{n}_7d") for n in names])


def daily_majority(labelled: DataFrame, category: str = "True_Class") -> DataFrame:
    """Each user counts once per day, under the class of most of their rows.

    Ties go to Intentional, then Unintentional, then Normal.  ``min_by`` over
    (-count, priority) aggregates partially, so a busy user is not one task.
    """
    prio = F.when(F.col(category) == INTENTIONAL, 0).when(F.col(category) == UNINTENTIONAL, 1).otherwise(2)
    counts = labelled.groupBy(DAY, USER, category).agg(F.count(F.lit(1)).alias("_n"))
    major = counts.groupBy(DAY, USER).agg(F.min_by(F.col(category), F.struct(-F.col("_n"), prio)).alias("Category"))
    per_day = major.groupBy(DAY, "Category").agg(F.count_distinct(USER).alias("users"))
    wide = _pivot(per_day, "Category", CLASSES, F.first("users"))
    for c in CLASSES:
        wide = wide.withColumn(c, F.col(c).cast("bigint"))
    return wide.select(DAY, *CLASSES, *[F.round(rolling_mean(c), 6).alias(f"{c}_7d") for c in CLASSES])


def daily_share(labelled: DataFrame, category: str = "True_Class", twice: bool = False) -> DataFrame:
    """Per-day share of submissions per class (sums to 100), 7-row mean; W6 rolls it again."""
    counts = labelled.groupBy(DAY, F.col(category).alias("Category")).agg(F.count(F.lit(1)).alias("_n"))
    wide = _pivot(counts, "Category", CLASSES, F.sum("_n"))
    wide = wide.withColumn("_total", sum((F.col(c) for c in CLASSES), F.lit(0)))
    total = F.col("_total")
    wide = wide.select(DAY, *[F.when(total == 0, F.lit(0.0)).otherwise(F.col(c) / total * 100.0).alias(c) for c in CLASSES])
    out = wide.select(DAY, *CLASSES, *[rolling_mean(c).alias(f"{c}_7d") for c in CLASSES])
    if twice:
        out = out.select(DAY, *CLASSES, *[F.col(f"{c}_7d") for c in CLASSES],
                         *[rolling_mean(f"{c}_7d", require_non_null=True).alias(f"{c}_7d2") for c in CLASSES])
    return out.select(*[F.round(F.col(c), 6).alias(c) if c != DAY else F.col(c) for c in out.columns])


def experience_vs_reputation(experience: DataFrame, final: DataFrame) -> DataFrame:
    """Max experience per user, left join final reputation, drop incomplete rows."""
    mx = max_per_key(experience, USER, "User_Experience", "Max_Experience")
    return mx.join(final.select(USER, "Final_Reputation"), USER, "left").dropna(subset=["Max_Experience", "Final_Reputation"])


def stage_comparison(stages: dict[str, DataFrame]) -> DataFrame:
    """One row per user with the reputation of every stage (inner joins on User_Id).

    Each stage is a per-user table (key plus one value column, B14); they are
    small, so AQE broadcasts them.
    """
    from trustfold.operators.schema import single_value_column

    out = None
    for name, df in stages.items():
        v = single_value_column(df, USER)
        s = df.select(USER, F.col(v).alias(name))
        out = s if out is None else out.join(s, USER, "inner")
    return out


def best_scores(ledger: DataFrame, order) -> DataFrame:
    """Best score per (engine, run type) from the model ledger, in a fixed row order."""
    from trustfold.functions.scalars import category_order

    x = ledger.withColumn("score", F.col("score").cast("string").try_cast("double")).dropna(subset=["score"])
    x = x.withColumn("score", inf_to_null(F.col("score"))).dropna(subset=["score"])
    best = x.groupBy("engine", "run_type").agg(F.max("score").alias("best_score"))
    return best.withColumn("_o", category_order(F.col("run_type"), order)).orderBy("_o", "engine").drop("_o")


# Per-stage result files of one scenario and the column each one
# becomes in the comparison table, in the original column order.
STAGE_FILES = [
    ("original_reputations", "Original_Reputation"),
    ("predicted_reputations_raw_tpot", "Predicted_TPOT_Raw"),
    ("predicted_reputations_raw_flaml", "Predicted_FLAML_Raw"),
    ("feedback_loop_reputations_supervised", "Feedback_Loop_Supervised"),
    ("predicted_reputations_processed_tpot_supervised", "Processed_TPOT_Supervised"),
    ("predicted_reputations_processed_flaml_supervised", "Processed_FLAML_Supervised"),
    ("feedback_loop_reputations_unsupervised", "Feedback_Loop_Unsupervised"),
    ("predicted_reputations_processed_tpot_unsupervised", "Processed_TPOT_Unsupervised"),
    ("predicted_reputations_processed_flaml_unsupervised", "Processed_FLAML_Unsupervised"),
]


def reputation_comparison(spark, folder: str, stages=STAGE_FILES) -> DataFrame:
    """R6 over written per-stage files: read each (A1), strip the ``User_``
    prefix to an integer id (S1), check there is exactly one value column
    (B14), rename it (B12), inner-join all stages on the id (J1)."""
    from trustfold.functions.scalars import user_number
    from trustfold.operators.schema import single_value_column, trim_names
    from trustfold.sources.io import load_csv

    tables = {}
    for file, name in stages:
        df = trim_names(load_csv(spark, folder, file, schema=None))
        v = single_value_column(df, USER)
        tables[name] = df.select(user_number(F.col(USER)).alias(USER), F.col(v).cast("double").alias(name))
    return stage_comparison(tables).orderBy(USER)


# Model ledger mapping (prefix, run type, pipeline file, engine
# label) and the row order of the comparison, as in the original report.
MODEL_MAPPING = [
    ("tpot", "Supervised", "final_processed_supervised_tpot.py", "TPOT"),
    ("tpot", "Unsupervised", "final_processed_unsupervised_tpot.py", "TPOT"),
    ("tpot", "Raw", "final_raw_tpot.py", "TPOT"),
    ("flaml", "Raw", "final_raw_flaml.py", "FLAML"),
    ("flaml", "Supervised", "final_processed_supervised_flaml.py", "FLAML"),
    ("flaml", "Unsupervised", "final_processed_unsupervised_flaml.py", "FLAML"),
]
MODEL_ORDER = ["TPOT (Raw)", "TPOT (Supervised)", "TPOT (Unsupervised)", "FLAML (Raw)", "FLAML (Supervised)", "FLAML (Unsupervised)"]


def model_comparison(ledger: DataFrame, mapping=MODEL_MAPPING, order=MODEL_ORDER) -> DataFrame:
    """Best score per (engine, run type) from a result ledger (prefix, pipeline_file, score).

    S4 / B8: scores coerced to numbers, unparsable ones dropped; B10: only
    ``.py`` pipeline files, matched case-insensitively on the base name;
    U2: exact duplicates dropped; W8: best row per mapping entry; B9: infinite
    scores dropped; S6 / S11: label "ENGINE (Run)" in a fixed order.
    The mapping has six rows (a fixed bound), so it is broadcast.
    """
    from trustfold.functions.scalars import base_name, category_order

    spark = ledger.sparkSession
    x = ledger.select(
        F.col("prefix").cast("string").alias("prefix"),
        F.trim(F.coalesce(F.col("pipeline_file").cast("string"), F.lit(""))).alias("pipeline_file"),
        F.col("score").cast("string").try_cast("double").alias("score"),
    )
    x = x.where(F.col("pipeline_file").endswith(".py") & (F.col("pipeline_file") != "")).dropna(subset=["score"])
    x = x.dropDuplicates(["pipeline_file", "prefix", "score"])
    m = spark.createDataFrame(mapping, "m_prefix string, run_type string, m_file string, engine string")
    j = x.join(F.broadcast(m), (F.lower(F.col("prefix")) == F.col("m_prefix"))
               & (F.lower(base_name(F.col("pipeline_file"))) == F.lower(F.col("m_file"))))
    best = j.groupBy("engine", "run_type").agg(
        F.max_by(F.struct("pipeline_file", "score"), F.col("score")).alias("_b"))
    out = best.select(
        F.concat(F.col("engine"), F.lit(" ("), F.col("run_type"), F.lit(")")).alias("engine_run_type"),
        "engine", "run_type", F.col("_b.pipeline_file").alias("pipeline_file"), F.col("_b.score").alias("score"),
    )
    out = out.withColumn("score", inf_to_null(F.col("score"))).dropna(subset=["score"])
    return out.withColumn("_o", category_order(F.col("engine_run_type"), order)).orderBy("_o").drop("_o")

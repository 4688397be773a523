import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from trustfold.functions.rules import label
from trustfold.operators.reputation import replay, source_from_class
from trustfold.params import scenario
from trustfold.plans.ordered import keyed_row_number, segmented_clamp_scan
from trustfold.sources.tables import load_log

INF = float("inf")
STEP = {0: (0.005, -INF, 1.0), 1: (-0.005, 0.0, INF), 2: (-0.015, 0.0, INF)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), min_size=1, max_size=120),
       st.floats(-0.5, 1.5))
def test_segmented_scan_matches_sequential_fold(rows, r0):
    rows = sorted(rows, key=lambda r: r[0])  # keys arrive sorted, as in a range partition
    keys = np.array([k for k, _ in rows])
    s, lo, hi = (np.array([STEP[c][i] for _, c in rows]) for i in range(3))
    S, L, H = segmented_clamp_scan(keys, s, lo, hi)
    got = np.minimum(H, np.maximum(L, r0 + S))
    cur = {}
    for i, (k, c) in enumerate(rows):
        x = cur.get(k, r0)
        inc, a, b = STEP[c]
        x = min(b, max(a, x + inc))
        cur[k] = x
        assert abs(got[i] - x) < 1e-12


def _labelled(spark):
    return label(load_log(spark, SF)).withColumn("Dataset_Source", source_from_class())


def test_fold_independent_of_partitioning(spark):
    lab = _labelled(spark)
    results = []
    for n in (1, 5, 23):
        per_user, trace = replay(lab, scenario(1), num_partitions=n)
        results.append(sorted((r["User_Id"], round(r["Final_Reputation"], 9)) for r in per_user.collect()))
        assert trace.count() == lab.count()
    assert results[0] == results[1] == results[2]


def test_fold_stays_in_unit_interval_and_final_is_last_trace(spark):
    per_user, trace = replay(_labelled(spark), scenario(3), num_partitions=7)
    lo, hi = trace.agg(F.min("new_reputation"), F.max("new_reputation")).first()
    assert 0.0 <= lo and hi <= 1.0
    last = trace.groupBy("User_Id").agg(F.max_by("new_reputation", F.struct("Timestamp", "row_id")).alias("v"))
    diff = last.join(per_user, "User_Id").where(F.abs(F.col("v") - F.col("Final_Reputation")) > 1e-12).count()
    assert diff == 0


def test_carry_over_starts_from_previous_final(spark):
    lab = _labelled(spark)
    first, _ = replay(lab, scenario(1))
    second, _ = replay(lab, scenario(1), initial=first)
    j = first.alias("a").join(second.alias("b"), "User_Id")
    assert j.where(F.abs(F.col("a.Final_Reputation") - F.col("b.Original_Reputation")) > 1e-12).count() == 0


def test_keyed_row_number_matches_window(spark):
    from pyspark.sql import Window

    log = load_log(spark, SF)
    w = Window.partitionBy("User_Id").orderBy("Timestamp", "row_id")
    ref = log.select("row_id", F.row_number().over(w).alias("rn"))
    got = keyed_row_number(log, "User_Id", ["Timestamp", "row_id"], num_partitions=9).select("row_id", "rn")
    assert got.count() == log.count()
    assert got.exceptAll(ref).count() == 0


def test_null_times_come_last_and_null_users_count(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    rows = [(1, 7, None, "intentional", 0.9), (2, 7, t, "normal", 0.5), (3, None, t, "normal", 0.3), (4, None, None, "intentional", 0.8)]
    log = spark.createDataFrame(rows, "row_id long, User_Id long, Timestamp timestamp_ntz, Dataset_Source string, User_Reputation double")
    log = log.withColumn("User_Experience", F.lit(0.1))
    for n in (1, 4):
        per_user, trace = replay(log, scenario(1), num_partitions=n)
        got = {r["User_Id"]: (r["Original_Reputation"], round(r["Final_Reputation"], 6)) for r in per_user.collect()}
        assert got == {7: (0.5, 0.49), None: (0.3, 0.29)}
        assert {r["row_id"]: round(r["new_reputation"], 6) for r in trace.collect()} == {1: 0.49, 2: 0.505, 3: 0.305, 4: 0.29}
        rn = keyed_row_number(log, "User_Id", ["Timestamp", "row_id"], num_partitions=n)
        assert {r["row_id"]: r["rn"] for r in rn.collect()} == {1: 2, 2: 1, 3: 1, 4: 2}


def test_no_shuffle_after_the_range_exchange(spark):
    """The plans of trace, per-key fold and numbering read the stored, sorted rows and exchange nothing."""
    from trustfold.operators.reputation import capped_experience, replay_trace

    log = _labelled(spark)
    for df in (replay_trace(log, scenario(1)), capped_experience(log)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_user_over_many_segments(spark):
    """One user holds all rows and runs over every partition; a carried-over value starts it."""
    log = _labelled(spark).withColumn("User_Id", F.lit(5).cast("long"))
    start = spark.createDataFrame([(5, 0.25), (6, 0.9)], "User_Id long, Final_Reputation double")
    one = replay(log, scenario(1), initial=start, num_partitions=1)
    many = replay(log, scenario(1), initial=start, num_partitions=40)
    a, b = one[0].collect(), many[0].collect()
    assert len(a) == len(b) == 1 and a[0]["Original_Reputation"] == b[0]["Original_Reputation"] == 0.25
    assert abs(a[0]["Final_Reputation"] - b[0]["Final_Reputation"]) < 1e-9
    j = one[1].alias("x").join(many[1].alias("y"), "row_id")
    assert j.count() == log.count() and j.where("abs(x.new_reputation - y.new_reputation) > 1e-9").count() == 0

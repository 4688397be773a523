import os
import tempfile
import time

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.conftest import SF
from trustfold.functions.rules import EVENT_RULES
from trustfold.operators import detectors as D
from trustfold.operators.reputation import source_from_class
from trustfold.params import scenario
from trustfold.plans.pipeline import run
from trustfold.sources.tables import behaviour_log, load_log
from trustfold.streaming.replay import replay_to_table


def test_late_rows_are_flagged_in_arrival_order(spark):
    t = pq.read_table(f"{SF}/events.parquet").to_pandas().sort_values("ts")
    half = len(t) // 2
    src_dir = tempfile.mkdtemp(prefix="trustfold-late-")
    # newer half arrives first, older half second
    t.iloc[half:].to_parquet(os.path.join(src_dir, "a.parquet"), index=False)
    time.sleep(1.1)
    t.iloc[:half].to_parquet(os.path.join(src_dir, "b.parquet"), index=False)
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src_dir)
    log = behaviour_log(src).withColumn("True_Class", EVENT_RULES.class_expr()).withColumn("Dataset_Source", source_from_class())
    out = replay_to_table(spark, log, scenario(1), base=tempfile.mkdtemp(prefix="trustfold-out-")).cache()
    first_ts = t.iloc[half]["ts"]
    newer = out.where(F.col("Timestamp") >= F.lit(first_ts))
    older = out.where(F.col("Timestamp") < F.lit(first_ts))
    assert out.count() == len(t)
    assert newer.where("late").count() == 0
    seen = newer.select("User_Id").distinct()
    # every older row of a user already seen in the first batch is late; unseen users start fresh
    late_expected = older.join(seen, "User_Id", "left_semi").count()
    assert older.where("late").count() == late_expected > 0
    lo, hi = out.agg(F.min("new_reputation"), F.max("new_reputation")).first()
    assert 0.0 <= lo and hi <= 1.0


def test_end_to_end_run_with_carry_over(spark):
    log = load_log(spark, SF)
    res = run(log, scenario(1), methods=list(D.SQL_CHECKABLE), carry_over=True)
    users = log.select("User_Id").distinct().count()
    assert res["unsup_user"].count() == users and res["sup_user"].count() == users
    assert res["unsup_trace"].count() == log.count() == res["sup_trace"].count()
    j = res["unsup_user"].alias("u").join(res["sup_user"].alias("s"), "User_Id")
    assert j.where(F.abs(F.col("u.Final_Reputation") - F.col("s.Original_Reputation")) > 1e-12).count() == 0
    srcs = {r[0] for r in res["unsupervised"].select("Dataset_Source").distinct().collect()}
    assert srcs <= {"normal", "unintentional", "intentional"} and "normal" in srcs


def test_replay_over_long_lineage_keeps_every_row_on_repeat(spark):
    """Segment ids must agree between the summary and the row branch even when
    the input's lineage (consensus, votes, numbering) is evaluated again."""
    from trustfold.operators.reputation import replay
    from trustfold.plans.pipeline import unsupervised_sources

    for _ in range(3):
        log = load_log(spark, SF)
        uns = unsupervised_sources(log, scenario(1), methods=list(D.SQL_CHECKABLE))
        per_user, trace = replay(uns, scenario(1))
        assert trace.count() == 1000
        assert per_user.count() == log.select("User_Id").distinct().count()


def _stream(spark, folder, **options):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    src = spark.readStream.schema(schema).options(**options).parquet(folder)
    return behaviour_log(src).withColumn("True_Class", EVENT_RULES.class_expr()).withColumn("Dataset_Source", source_from_class())


def test_stream_reads_a_folder_of_part_files(spark):
    """Files in time order give the batch trace, whatever their number and the cut into micro-batches."""
    from trustfold.functions.rules import label
    from trustfold.operators.reputation import replay_trace

    t = pq.read_table(f"{SF}/events.parquet").to_pandas().sort_values(["ts", "event_id"])
    folder = os.path.join(tempfile.mkdtemp(prefix="trustfold-parts-"), "events.parquet")
    os.makedirs(folder)
    for i in range(3):
        t.iloc[i * 334 : (i + 1) * 334].to_parquet(os.path.join(folder, f"part-{i}.parquet"), index=False)
        os.utime(os.path.join(folder, f"part-{i}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    log = label(load_log(spark, SF)).withColumn("Dataset_Source", source_from_class())
    want = {r["row_id"]: round(r["new_reputation"], 9) for r in replay_trace(log, scenario(1)).collect()}
    for options in ({}, {"maxFilesPerTrigger": "1"}):
        rows = replay_to_table(spark, _stream(spark, folder, **options), scenario(1)).collect()
        assert {r["row_id"]: round(r["new_reputation"], 9) for r in rows} == want and len(rows) == len(t)
        assert not any(r["late"] for r in rows)


def test_rows_beyond_the_delay_are_left_out(spark):
    import datetime as dt

    from trustfold.streaming.replay import STATE_SCHEMA, apply_batch

    t = dt.datetime(2025, 1, 10)
    schema = "row_id long, User_Id long, Timestamp timestamp_ntz, Dataset_Source string, User_Reputation double"
    first = spark.createDataFrame([(1, 7, t, "normal", 0.5), (2, None, None, "normal", 0.2)], schema)
    trace, state = apply_batch(first, spark.createDataFrame([], STATE_SCHEMA), scenario(1))
    assert trace.count() == 2
    state = state.checkpoint()
    late = [(3, 7, t - dt.timedelta(hours=1), "normal", 0.9), (4, 7, t - dt.timedelta(days=3), "normal", 0.9), (5, 8, t, "normal", 0.4)]
    trace, after = apply_batch(spark.createDataFrame(late, schema), state, scenario(1), max_delay="1 DAY")
    assert {r["row_id"]: (r["late"], round(r["new_reputation"], 6)) for r in trace.collect()} == {3: (True, 0.51), 5: (False, 0.405)}
    got = {r["User_Id"]: (round(r["Final_Reputation"], 6), r["last_ts"], r["last_row"]) for r in after.collect()}
    assert got == {7: (0.51, t, 1), None: (0.205, None, 2), 8: (0.405, t, 5)}

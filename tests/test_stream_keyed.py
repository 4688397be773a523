import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trustfold.operators.reputation import replay_trace
from trustfold.params import scenario
from trustfold.streaming.keyed import drain, replay_keyed, stateful_trace

SCHEMA = "row_id long, User_Id long, Timestamp timestamp_ntz, Dataset_Source string, User_Reputation double"
T0 = dt.datetime(2024, 3, 1)


def rows(n, users=6, seed=1):
    rnd = random.Random(seed)
    kinds = ["normal", "unintentional", "intentional", "normal", "other"]
    return [(i, rnd.choice([None, *range(users)]), T0 + dt.timedelta(minutes=10 * rnd.randrange(n)), rnd.choice(kinds), 0.2 + 0.1 * rnd.randrange(6)) for i in range(n)]


def append(spark, folder, batch):
    spark.createDataFrame(batch, SCHEMA).coalesce(2).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(folder)


def values(df):
    return {r["row_id"]: (r["User_Id"], r["Timestamp"], r["Dataset_Source"], r["new_reputation"] and round(r["new_reputation"], 9)) for r in df.collect()}


def batch_trace(spark, batch):
    return values(replay_trace(spark.createDataFrame(batch, SCHEMA), scenario(2)))


def test_one_batch_is_the_batch_replay(spark, tmp_path):
    data = rows(300) + [(1000, 1, None, "normal", 0.5), (1001, None, None, "intentional", 0.5), (1002, 50, None, "normal", 0.3)]
    append(spark, f"{tmp_path}/in", data)
    out = replay_keyed(stream(spark, f"{tmp_path}/in"), scenario(2), base=f"{tmp_path}/s")
    assert values(out) == batch_trace(spark, data) and out.where("late").count() == 0


def test_restart_goes_on_from_the_offsets_and_writes_touched_users_only(spark, tmp_path):
    data = sorted(rows(240, users=40), key=lambda r: (r[2], r[0]))
    parts = [data[:160], [r for r in data[160:] if r[1] in (1, 2, 3)]]
    for part in parts:
        append(spark, f"{tmp_path}/in", part)
        q = drain(stateful_trace(stream(spark, f"{tmp_path}/in"), scenario(2)), f"{tmp_path}/c", path=f"{tmp_path}/out")
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
    assert written == [len({r[1] for r in parts[1]})]
    out = spark.read.parquet(f"{tmp_path}/out")
    assert values(out) == batch_trace(spark, parts[0] + parts[1]) and out.where("late").count() == 0
    # nothing new: nothing is written again
    drain(stateful_trace(stream(spark, f"{tmp_path}/in"), scenario(2)), f"{tmp_path}/c", path=f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(parts[0] + parts[1])


def test_old_rows_without_a_delay_are_flagged_and_applied(spark, tmp_path):
    append(spark, f"{tmp_path}/in", [(1, 7, T0, "normal", 0.5)])
    replay_keyed(stream(spark, f"{tmp_path}/in"), scenario(1), base=f"{tmp_path}/s")
    append(spark, f"{tmp_path}/in", [(2, 7, T0 - dt.timedelta(hours=1), "normal", 0.9), (3, 7, T0 + dt.timedelta(hours=1), "intentional", 0.9), (4, 8, T0, "normal", 0.1)])
    out = replay_keyed(stream(spark, f"{tmp_path}/in"), scenario(1), base=f"{tmp_path}/s")
    assert {r["row_id"]: (r["late"], round(r["new_reputation"], 6)) for r in out.collect()} == {
        1: (False, 0.505), 2: (True, 0.51), 3: (False, 0.495), 4: (False, 0.105)}


def test_shuffled_arrival_within_the_delay_gives_the_batch_result(spark, tmp_path):
    """Rows come up to 5 hours out of order, the delay is 6; the last rows wait for a watermark that has not come."""
    data = rows(200)
    rnd = random.Random(5)
    arrival = sorted(data, key=lambda r: r[2] + dt.timedelta(hours=5 * rnd.random()))
    delay = dt.timedelta(hours=6)
    for i in range(0, 200, 50):
        append(spark, f"{tmp_path}/in", arrival[i : i + 50])
        out = replay_keyed(stream(spark, f"{tmp_path}/in"), scenario(2), 6 * 3_600_000, f"{tmp_path}/s")
    mark = max(r[2] for r in data) - delay
    want = batch_trace(spark, data)
    done = {r[0] for r in data if r[2] < mark}
    assert values(out) == {i: v for i, v in want.items() if i in done} and out.where("late").count() == 0


def test_rows_behind_the_watermark_are_flagged_and_move_nothing(spark, tmp_path):
    h = dt.timedelta(hours=1)
    batches = [[(1, 7, T0, "normal", 0.5), (2, 7, T0 + 10 * h, "normal", 0.5)], [(3, 7, T0 + 7 * h, "intentional", 0.5), (4, 7, T0 + 9 * h, "normal", 0.5),
                (5, 9, T0 + 2 * h, "normal", 0.5), (6, 9, None, "normal", 0.25)], [(7, 1, T0 + 40 * h, "normal", 0.5)]]
    for b in batches:
        append(spark, f"{tmp_path}/in", b)
        out = replay_keyed(stream(spark, f"{tmp_path}/in"), scenario(1), 2 * 3_600_000, f"{tmp_path}/s")
    got = {r["row_id"]: (r["late"], r["new_reputation"] and round(r["new_reputation"], 6)) for r in out.collect()}
    assert got == {1: (False, 0.505), 2: (False, 0.515), 3: (True, None), 4: (False, 0.51), 5: (True, None), 6: (False, 0.255)}


def test_users_share_state_rows(spark, tmp_path, monkeypatch):
    """As many state rows as buckets, however many users there are; each user's values are its own."""
    from trustfold.streaming import keyed

    monkeypatch.setattr(keyed, "BUCKETS", 3)
    data = sorted(rows(200, users=50), key=lambda r: (r[2], r[0]))
    for part in (data[:90], data[90:]):
        append(spark, f"{tmp_path}/in", part)
        q = drain(stateful_trace(stream(spark, f"{tmp_path}/in"), scenario(2), 3_600_000), f"{tmp_path}/c", path=f"{tmp_path}/out")
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) == 3
    out, mark = spark.read.parquet(f"{tmp_path}/out"), data[-1][2] - dt.timedelta(hours=1)
    done = {r[0] for r in data if r[2] < mark}
    assert values(out) == {i: v for i, v in batch_trace(spark, data).items() if i in done} and out.where("late").count() == 0

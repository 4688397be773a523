import datetime as dt
import random

import pytest

from trustfold.operators.reputation import replay_scenario_users, replay_scenarios, replay_trace, replay_users
from trustfold.params import SCENARIOS

SCHEMA = "row_id long, User_Id long, Timestamp timestamp_ntz, Dataset_Source string, User_Reputation double"
ALL = list(SCENARIOS.values())


def log(spark, n, hot=0.5):
    """A user with half of all rows, null users and times, ties."""
    rnd = random.Random(n)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1 if rnd.random() < hot else rnd.choice([None, 2, 3, *range(10, 40)]), rnd.choice([None, *[t0 + dt.timedelta(hours=rnd.randrange(60))] * 9]),
             rnd.choice(["normal", "unintentional", "intentional", "?"]), 0.1 * rnd.randrange(10)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("n,parts", [(1, 3), (300, 1), (700, 25), (200, 90)])
def test_each_scenario_equals_its_own_replay(spark, n, parts):
    rows = log(spark, n).checkpoint()
    got = replay_scenarios(rows, ALL, num_partitions=parts).collect()
    users = replay_scenario_users(rows, ALL, num_partitions=parts).collect()
    assert len(got) == 3 * n
    for p in ALL:
        trace = {r["row_id"]: r["new_reputation"] for r in got if r["scenario_id"] == p.scenario_id}
        want = {r["row_id"]: r["new_reputation"] for r in replay_trace(rows, p).collect()}
        assert trace.keys() == want.keys() and all(trace[i] == pytest.approx(v, abs=1e-12) for i, v in want.items())
        final = {r["User_Id"]: (r["Original_Reputation"], r["Final_Reputation"]) for r in users if r["scenario_id"] == p.scenario_id}
        once = {r["User_Id"]: (r["Original_Reputation"], r["Final_Reputation"]) for r in replay_users(rows, p).collect()}
        assert final.keys() == once.keys() and all(final[u] == pytest.approx(v, abs=1e-12) for u, v in once.items())


def test_one_range_sort_for_all(spark):
    rows = log(spark, 200).checkpoint()
    sc = spark.sparkContext
    jobs = []
    for ps in (ALL[:1], ALL):
        sc.setJobGroup(f"scenarios{len(ps)}", "")
        replay_scenarios(rows, ps).count()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"scenarios{len(ps)}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_empty_log(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert replay_scenarios(rows, ALL).count() == 0 and replay_scenario_users(rows, ALL).count() == 0

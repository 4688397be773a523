import hashlib

import pytest
from pyspark.sql import functions as F

from trustfold.operators import sampling as S
from trustfold.plans import reports as R


def md5(k, seed="42"):
    return hashlib.md5(f"{seed}#{k}".encode()).hexdigest()


def test_cuts_equal_a_sort(spark):
    keys = [*range(5000), *[7] * 40, *[4321] * 3]
    df = spark.createDataFrame([(k,) for k in keys], "row_id long").repartition(5)
    order = sorted(md5(k) for k in keys)
    ranks = [1, 2, 500, 4999, 5043, 5044, order.index(md5(7)) + 20]
    for rank, cut in zip(ranks, S.hash_cuts(df, ranks)):
        if rank > len(keys):
            assert cut is None
        else:
            h = order[rank - 1]
            assert cut == (h, order.index(h), order.count(h))


@pytest.mark.parametrize("n", [0, 1, 17, 999, 1000, 5000])
def test_sample_is_exact_whatever_the_partitions(spark, n):
    df = spark.range(1000).select(F.col("id").alias("row_id"))
    want = sorted(sorted(range(1000), key=md5)[:n])
    for parts in (1, 9):
        assert sorted(r[0] for r in S.seeded_sample(df.repartition(parts), n).collect()) == want


def test_no_sort_in_the_plan(spark):
    plan = S.seeded_sample(spark.range(1000).select(F.col("id").alias("row_id")), 50)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan and "Exchange" not in plan


def test_repeated_keys_at_the_threshold(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(50)], "row_id long, x int")
    for n in (30, 50, 70):
        got = S.seeded_sample(df, n).collect()
        assert len(got) == n and len(set(got)) == n
    sets = S.disjoint_samples(df, 0.1, 0.3, 0.4).groupBy("sample_set").count().collect()
    assert {r["sample_set"]: r["count"] for r in sets} == {"both": 10, "A": 20, "B": 30, None: 40}


@pytest.mark.parametrize("shares", [(0.0, 0.1, 0.2), (0.05, 0.05, 0.05), (0.1, 0.5, 0.6), (0.0, 0.0, 0.0)])
def test_sets_by_thresholds_are_sets_by_rank(spark, shares):
    df = spark.range(333).select(F.col("id").alias("row_id")).repartition(4)
    overlap, a, b = (int(333 * x) for x in shares)
    order = sorted(range(333), key=md5)
    want = dict.fromkeys(order)
    for name, part in (("both", order[:overlap]), ("A", order[overlap:a]), ("B", order[a : a + b - overlap])):
        want.update(dict.fromkeys(part, name))
    got = {r["row_id"]: r["sample_set"] for r in S.disjoint_samples(df, *shares).collect()}
    assert got == want


def test_sketches_add_up_within_their_error(spark, tmp_path):
    """5,000 users over 30 days in three loads: exact where they fit, and within three standard errors where they don't."""
    rows = spark.range(30_000).select(
        (F.col("id") * 7919 % 5000).alias("User_Id"), F.expr("timestampadd(DAY, cast(id % 30 as int), timestamp_ntz'2024-01-01')").alias("Day"),
        F.lit("all").alias("series"), F.col("id"))
    exact = {r["m"]: r["n"] for r in rows.groupBy(F.date_trunc("month", "Day").alias("m")).agg(F.count_distinct("User_Id").alias("n")).collect()}
    for log2, share in ((14, 0.0), (8, 3 / 16)):
        path = f"{tmp_path}/{log2}"
        for part in range(3):
            sketches = R.add_sketches(rows.where(F.col("id") % 3 == part).drop("id"), path, log2)
        got = {r["start"]: r["users"] for r in R.users_by_period(sketches, "month", log2).collect()}
        assert got.keys() == exact.keys() and all(abs(got[m] - n) <= share * n for m, n in exact.items())
    nobody = rows.limit(3).withColumn("User_Id", F.lit(None).cast("long")).drop("id")
    assert R.user_sketches(nobody).count() == 0

from pyspark.sql import functions as F

from tests.conftest import SF
from trustfold.functions.rules import label
from trustfold.operators import consensus as C
from trustfold.operators import detectors as D
from trustfold.operators.reputation import source_from_class
from trustfold.plans import reports as R
from trustfold.sources.tables import load_log


def test_consensus_split_partitions_the_input(spark):
    log = load_log(spark, SF)
    c = C.consensus(log, D.DetectorParams(0.01, 3.0), methods=list(D.SQL_CHECKABLE))
    n, m = c["normal"].select("row_id"), c["misbehaving"].select("row_id")
    assert n.count() + m.count() == log.count()
    assert n.join(m, "row_id").count() == 0


def test_chunks_are_contiguous_and_near_equal(spark):
    ch = C.chunk(load_log(spark, SF))
    sizes = [r["count"] for r in ch.groupBy("chunk_id").count().orderBy("chunk_id").collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 1000
    bounds = ch.groupBy("chunk_id").agg(F.min(F.struct("Timestamp", "row_id")).alias("lo"),
                                        F.max(F.struct("Timestamp", "row_id")).alias("hi")).orderBy("chunk_id").collect()
    for a, b in zip(bounds, bounds[1:]):
        assert a["hi"] < b["lo"]


def _labelled(spark):
    return R.with_day(label(load_log(spark, SF)).withColumn("Dataset_Source", source_from_class()))


def test_daily_shares_sum_to_100(spark):
    share = R.daily_share(_labelled(spark))
    bad = share.where(F.abs(F.col("Normal") + F.col("Unintentional") + F.col("Intentional") - 100) > 1e-4).count()
    assert bad == 0


def test_daily_majority_counts_each_active_user_once(spark):
    lab = _labelled(spark)
    maj = R.daily_majority(lab).select("Day", (F.col("Normal") + F.col("Unintentional") + F.col("Intentional")).alias("s"))
    active = lab.groupBy("Day").agg(F.count_distinct("User_Id").alias("a"))
    assert maj.join(active, "Day").where(F.col("s") != F.col("a")).count() == 0

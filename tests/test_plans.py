"""Plan-shape checks: the properties the scale design relies on."""

from tests.conftest import SF
from trustfold.operators import detectors as D
from trustfold.sources.tables import read_table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_group_spans_several_tasks(spark):
    """One (chunk, column) group: no step hashes its rows into one partition, and its masks come from many."""
    from pyspark.sql import functions as F

    long = spark.range(0, 40000, 1, 8).select(F.lit(0).alias("chunk_id"), F.col("id").alias("row_id"), F.lit("x").alias("column"),
                                              F.rand(1).alias("value")).checkpoint()
    masks, _ = D.masks(long, D.DetectorParams(), ["HBOS", "kNN", "Z-Score", "IQR", "MAD"])
    sizes = [r["count"] for r in masks.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 20000
    assert "Window" not in _plan(masks)


def test_scan_reads_only_needed_columns(spark):
    from pyspark.sql import functions as F

    o = read_table(spark, SF, "orders").groupBy("o_custkey").agg(F.median("o_totalprice"))
    plan = _plan(o)
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan


def test_filter_reaches_parquet_scan(spark):
    from pyspark.sql import functions as F

    df = read_table(spark, SF, "events").where(F.col("user_id") == 7).select("event_id")
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in _plan(df)

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF

FAST = ["label_events", "label_counts", "final_reputation", "reputation_trace", "reputation_carry_over", "kafka_payload",
        "baseline_by_user", "capped_experience", "median_by_user", "chunks", "zscore", "knn20", "daily_share",
        "impute_median_mode", "seeded_sample", "disjoint_samples", "inject_nulls", "weighted_draw", "onehot", "label_encode",
        "label_count_if", "max_by_user", "mean_fill", "column_kinds", "target_check", "cardinality_split", "standard_scale",
        "minmax_scale", "iqr", "mad", "hbos", "loda", "daily_majority", "daily_share_rolled_twice", "experience_vs_reputation",
        "inject_outliers", "geo_offset", "csv_roundtrip", "consensus_split", "vote_topn_split"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb_oracle(spark, name):
    from tools.oracle_check import digest, duck, spark_rows
    import __spark_entry__ as E

    s = spark_rows(E.queries()[name](spark, SF))
    o = duck(SF).sql(E.oracle_sql()[name]).df()
    assert digest(s) == digest(o)


def test_stream_equals_batch(spark):
    import __spark_entry__ as E

    stream = E.queries()["stream_reputation"](spark, SF)
    batch = E.queries()["reputation_trace"](spark, SF)
    assert stream.where("late").count() == 0
    assert stream.drop("late").exceptAll(batch).count() == 0 and batch.count() == stream.count()


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["User_Id", "Original_Reputation", "Final_Reputation"]
    assert df.count() > 0
    assert df.where((F.col("Final_Reputation") < 0) | (F.col("Final_Reputation") > 1)).count() == 0

import os
import tempfile

import pytest

from trustfold.sources.io import export, load_csv


def test_missing_file_raises(spark):
    with pytest.raises(FileNotFoundError):
        load_csv(spark, tempfile.mkdtemp(prefix="trustfold-io-"), "nothing_here")


def test_csv_null_tokens_and_round_trip(spark):
    d = tempfile.mkdtemp(prefix="trustfold-io-")
    with open(os.path.join(d, "log.csv"), "w") as f:
        f.write("User_Id,Timestamp,x,s\nUser_1,2025-01-01T00:00:01.000001,1.5,a\nUser_2,2025-01-02T00:00:00.000000,None,\n")
    df = load_csv(spark, d, "log", schema="User_Id string, Timestamp timestamp_ntz, x double, s string")
    rows = df.orderBy("User_Id").collect()
    assert rows[0]["x"] == 1.5 and rows[0]["Timestamp"].microsecond == 1
    assert rows[1]["x"] is None and rows[1]["s"] is None
    out = os.path.join(d, "copy.csv")
    export(df, out)
    back = load_csv(spark, d, "copy", schema="User_Id string, Timestamp timestamp_ntz, x double, s string")
    assert back.exceptAll(df).count() == 0 and back.count() == 2


def test_write_by_class_prunes_on_read(spark):
    from pyspark.sql import functions as F

    from tests.conftest import SF
    from trustfold.functions.rules import label
    from trustfold.sources.io import write_by_class
    from trustfold.sources.tables import load_log

    lab = label(load_log(spark, SF))
    out = os.path.join(tempfile.mkdtemp(prefix="trustfold-io-"), "by_class")
    write_by_class(lab, out)
    parts = sorted(d for d in os.listdir(out) if d.startswith("True_Class="))
    assert parts == ["True_Class=Intentional", "True_Class=Normal", "True_Class=Unintentional"]
    back = spark.read.parquet(out).where(F.col("True_Class") == "Intentional")
    assert "PartitionFilters: [isnotnull(True_Class" in back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == lab.where(F.col("True_Class") == "Intentional").count()

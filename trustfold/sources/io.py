"""Delimited and columnar sources and sinks.

``load_csv`` reads with a declared schema when given (no inference at
scale), treats ``""`` and ``"None"`` as null, and checks the path and the
table are not empty.  ``export`` writes a time-sorted table with a range
partitioned sort (no single-partition sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustfold.sources.tables import ROW_ID, TS

# Full microsecond precision (Spark's CSV default keeps milliseconds only).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return bool(fs.globStatus(p)) and len(fs.globStatus(p)) > 0


def load_csv(spark: SparkSession, folder: str, file: str, sep: str = ",", schema: T.StructType | str | None = None,
             allow_empty: bool = False) -> DataFrame:
    """A1 + A2: read ``folder/file[.csv]``; blank and ``None`` cells become null."""
    name = file if file.endswith(".csv") else f"{file}.csv"
    path = f"{folder.rstrip('/')}/{name}"
    if not _path_exists(spark, path):
        raise FileNotFoundError(path)
    reader = (spark.read.option("header", True).option("sep", sep).option("nullValue", "None").option("mode", "PERMISSIVE")
              .option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    exprs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when((F.trim(c) == "") | (c == "None"), F.lit(None)).otherwise(c)
        exprs.append(c.alias(f.name))
    df = df.select(*exprs)
    if not allow_empty and df.isEmpty():
        raise ValueError(f"empty table: {path}")
    return df


def export(df: DataFrame, path: str, fmt: str = "csv", append: bool = False, sep: str = ",", partition_by=None) -> None:
    """A3 / A4: time-sorted output if a Timestamp column exists; overwrite or append; optional partition column."""
    out = df
    if TS in df.columns:
        order = [TS] + ([ROW_ID] if ROW_ID in df.columns else [])
        out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    w = out.write.mode("append" if append else "overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).option("sep", sep).option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT).csv(path)
    else:
        w.format(fmt).save(path)


def write_by_class(df: DataFrame, path: str, col: str = "True_Class", fmt: str = "parquet") -> None:
    """A4: one output folder per class value (``partitionBy``), prunable on read."""
    export(df, path, fmt=fmt, partition_by=col)

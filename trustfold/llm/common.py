"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustfold.session import scratch_path, ship_package

#: A word: a run of anything but ASCII white space. ``bytes.split()`` cuts UTF-8 text at the same places.
WORD = r"[^\x20\x09-\x0D]+"


#: Most rows and bytes that go to a Python worker at once, where the session leaves Spark's defaults. Texts are long: Spark's
#: default of 10000 rows is some tens of megabytes, which a worker holds several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and lower the Arrow batch sizes unless the session sets its own."""
    ship_package(spark)
    for name, (default, value) in BATCH.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` below the cluster's checkpoint folder and read it back.

    This cuts the lineage, survives the loss of any executor, and gives every
    later reader the same rows. ``trustfold.session.clear_scratch`` removes what has been written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words in ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(df: DataFrame, *cols: str) -> Column:
    """64-bit key of a row. Rows equal in ``cols`` are one document and share it; nulls are values."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def free_names(df: DataFrame, *names: str) -> None:
    """Refuse a frame whose extra columns would clash with the operator's own."""
    taken = sorted(set(df.columns) & set(names))
    if taken:
        raise ValueError(f"rename these columns first: {taken}")


#: Rows of two long columns that a driver-approved broadcast may hold (some tens of megabytes in memory).
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` hinted for broadcast if it has at most ``rows`` rows, which a bounded count checks; else as it is,
    for a shuffled join. ``df`` should be a stored table of a few fixed-width columns."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

"""Driver tables and the behaviour-log view over ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_ID = "row_id"
USER = "User_Id"
TS = "Timestamp"
TARGET = "User_Reputation"

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def k_value(props: str = "props") -> Column:
    """Numeric ``k`` from the JSON ``props`` cell; bad text becomes null."""
    return F.expr(f"try_cast(get_json_object({props}, '$.k') AS BIGINT)")


def baseline_reputation(user: Column) -> Column:
    # Fixed rule of the test mapping: 0.25 + (user_id mod 51) / 100.
    return F.lit(0.25) + (user % 51).cast("double") / F.lit(100.0)


def baseline_experience(user: Column) -> Column:
    # Fixed rule of the test mapping: 0.001 + (user_id mod 400) / 1000.
    return F.lit(0.001) + (user % 400).cast("double") / F.lit(1000.0)


def behaviour_log(events: DataFrame, blank_cells: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Map ``events`` onto the behaviour log: one row per user submission.

    Columns: row_id, User_Id, Timestamp, event_type, value, k,
    User_Reputation, User_Experience.  With ``blank_cells`` the fixed
    missing-cell rule is applied (value blank on every 7th id, event_type on
    every 11th), which feeds the imputation operators; all rows are kept.
    ``keep`` names further columns of ``events`` to carry.
    """
    user = F.col("user_id")
    value = F.col("value")
    etype = F.col("event_type")
    if blank_cells:
        value = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(value)
        etype = F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("string")).otherwise(etype)
    return events.select(
        F.col("event_id").alias(ROW_ID),
        user.alias(USER),
        F.col("ts").alias(TS),
        etype.alias("event_type"),
        value.alias("value"),
        k_value().alias("k"),
        baseline_reputation(user).alias(TARGET),
        baseline_experience(user).alias("User_Experience"),
        *keep,
    )


def load_log(spark: SparkSession, sf_dir: str, blank_cells: bool = False) -> DataFrame:
    return behaviour_log(read_table(spark, sf_dir, "events"), blank_cells=blank_cells)


# SQL text of the same view, for DuckDB oracles (tables are pre-registered views).
LOG_SQL = """(SELECT event_id AS row_id, user_id AS User_Id, ts AS "Timestamp", event_type, value,
        TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        0.25 + CAST(user_id % 51 AS DOUBLE) / 100.0 AS User_Reputation,
        0.001 + CAST(user_id % 400 AS DOUBLE) / 1000.0 AS User_Experience
   FROM events)"""

LOG_BLANK_SQL = """(SELECT event_id AS row_id, user_id AS User_Id, ts AS "Timestamp",
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
        TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        0.25 + CAST(user_id % 51 AS DOUBLE) / 100.0 AS User_Reputation,
        0.001 + CAST(user_id % 400 AS DOUBLE) / 1000.0 AS User_Experience
   FROM events)"""

"""Stateful reputation stream.

Every micro-batch of the event stream is replayed with the batch fold, which
splits hot users over many tasks, starting from the state that the batch before
left: one row per user (reputation, last time, last row).  State is a table per
batch, written before the batch is committed; a batch that runs again overwrites
its own output and state, so results are exactly once.

Order (T3): inside a micro-batch rows are applied by (Timestamp, row_id), null
times last; across batches in order of arrival.  A row older than the last one
applied for its user is flagged ``late`` (the original replays a fully sorted
table, so it never sees one); with ``max_delay`` rows later than that are left
out.

Outputs are tables under the shared checkpoint folder; nothing is collected to
the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustfold.operators.reputation import SOURCE, replay_trace, replay_users
from trustfold.params import Scenario
from trustfold.session import scratch_path
from trustfold.sources.tables import ROW_ID, TS, USER

STATE_SCHEMA = "User_Id long, Final_Reputation double, last_ts timestamp_ntz, last_row long"
Sink = Callable[[DataFrame, int], None]


def table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Stream of ``folder``/``table``.parquet, be it one file or a folder of part files."""
    top, name = folder.rstrip("/"), f"{table}.parquet"
    schema = spark.read.parquet(f"{top}/{name}").schema
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{name}")
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs_path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{top}/{name}")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(top)  # a file source reads folders


def table_sink(path: str) -> Sink:
    """Each batch's rows as Parquet under ``path``/batch=<id>."""
    return lambda frame, batch_id: frame.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def apply_batch(batch: DataFrame, state: DataFrame, p: Scenario, max_delay: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(trace, state) after one micro-batch.  trace has ``late``; a null user is a user."""
    last = state.select(F.col(USER).alias("_user"), "last_ts", "last_row")
    rows = batch.join(last, F.col(USER).eqNullSafe(F.col("_user")), "left")
    place = F.struct(F.col(TS).isNull(), F.col(TS), F.col(ROW_ID))
    late = F.coalesce(place < F.struct(F.col("last_ts").isNull(), F.col("last_ts"), F.col("last_row")), F.lit(False)) & F.col("last_row").isNotNull()
    if max_delay:
        rows = rows.where(~late | F.coalesce(F.col(TS) >= F.col("last_ts") - F.expr(f"INTERVAL {max_delay}"), F.lit(True)))
    rows = rows.withColumn("late", late).drop("_user", "last_ts", "last_row").checkpoint()
    initial = state.select(USER, "Final_Reputation")
    trace = replay_trace(rows, p, initial=initial, carry_cols=(ROW_ID, SOURCE, "late"))
    newest = F.max(F.struct(F.col(TS).isNull().alias("none"), F.col(TS).alias("ts"), F.col(ROW_ID).alias("row")))
    seen = rows.groupBy(F.col(USER).alias("_user")).agg(newest.alias("_new"))
    users = replay_users(rows, p, initial=initial).select(F.col(USER).alias("_u"), F.col("Final_Reputation").alias("_now"))
    moved = seen.join(users, F.col("_user").eqNullSafe(F.col("_u"))).drop("_u")
    both = state.join(moved, F.col(USER).eqNullSafe(F.col("_user")), "full")
    touched = F.col("_new").isNotNull()
    ahead = touched & (F.col("last_row").isNull() | (
        F.struct(F.col("last_ts").isNull().alias("none"), F.col("last_ts").alias("ts"), F.col("last_row").alias("row")) < F.col("_new")))
    new_state = both.select(
        F.when(touched, F.col("_user")).otherwise(F.col(USER)).alias(USER), F.when(touched, F.col("_now")).otherwise(F.col("Final_Reputation")).alias("Final_Reputation"),
        F.when(ahead, F.col("_new.ts")).otherwise(F.col("last_ts")).alias("last_ts"), F.when(ahead, F.col("_new.row")).otherwise(F.col("last_row")).alias("last_row"))
    return trace, new_state


def replay_stream(spark: SparkSession, events: DataFrame, p: Scenario, sink: Sink, base: str | None = None,
                  max_delay: str | None = None) -> None:
    """Drain the labelled event stream, as far as it is available, through the fold into ``sink(trace, batch_id)``."""
    root = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}" if base else scratch_path(spark, "stream")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(STATE_SCHEMA).parquet(f"{root}/state/{batch_id - 1}") if batch_id else session.createDataFrame([], STATE_SCHEMA)
        trace, after = apply_batch(batch, before, p, max_delay)
        sink(trace, batch_id)
        after.write.mode("overwrite").parquet(f"{root}/state/{batch_id}")

    q = events.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def replay_to_table(spark: SparkSession, events: DataFrame, p: Scenario, base: str | None = None, frame=None, max_delay: str | None = None) -> DataFrame:
    """Drain the stream into a table and read it back.  ``frame`` turns a trace into what is written, for example
    ``kafka_frame`` for the JSON messages (T2)."""
    path = f"{base.rstrip('/')}/stream-out-{uuid.uuid4().hex}" if base else scratch_path(spark, "stream-out")
    to = table_sink(path)
    replay_stream(spark, events, p, lambda trace, batch_id: to(frame(trace) if frame else trace, batch_id), base, max_delay)
    return spark.read.parquet(path).drop("batch")

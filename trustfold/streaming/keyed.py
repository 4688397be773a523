"""Reputation stream with keyed state and event time.

Users' states live in Spark's state store, and a restart goes on from the
checkpoint.  A user's state is the reputation and the place of the last row
applied.  ``BUCKETS`` state rows hold the users by hash: a micro-batch reads and
writes the buckets that it touches, and one call works on all users of a bucket
as arrays, as a call for each user costs more than the work on its rows.

Without a delay, the rows of a micro-batch are applied by (Timestamp, row_id),
null times last; a row older than the last one applied for its user is flagged
``late`` and applied all the same.

With a delay, rows wait in a buffer in their bucket's state until the watermark,
the greatest time seen so far less the delay, has passed them, and are then
applied in order of time: an event-time timer wakes buckets without new rows.  So
rows that arrive out of order within the delay give the result of the batch
replay.  A row that is older than the watermark when it arrives comes out
flagged ``late`` without a value, and moves nothing.  A row without a time is
applied when it comes.

Spark drops rows behind its own watermark before a stateful function sees them.
Its watermark is therefore set ``HORIZON`` further back, and the function adds
that span again; only rows later than the horizon are lost.

A bucket's rows of one micro-batch are one call's work, so bound the micro-batches
(``maxFilesPerTrigger``); ``replay.replay_stream`` splits a hot user's rows over
many tasks instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trustfold.operators.reputation import SOURCE, with_steps
from trustfold.params import Scenario
from trustfold.plans.ordered import segmented_clamp_scan
from trustfold.session import scratch_path
from trustfold.sources.tables import ROW_ID, TARGET, TS, USER

HORIZON_MS = 20 * 365 * 86_400_000
_NO_TIME = np.iinfo(np.int64).max  # sorts null times last
BUCKETS = 1024
#: Columns of the state, all arrays: of the users that have a value, and of the rows that wait. ``none`` is 1 for the null user.
_KNOWN = {"u": "long", "none": "long", "value": "double", "us": "long", "row": "long"}
_HELD = {"u": "long", "none": "long", "us": "long", "row": "long", "src": "string", "x0": "double", "s": "double", "lo": "double", "hi": "double"}
_STATE = ", ".join(f"{top}_{n} array<{t}>" for top, kinds in (("known", _KNOWN), ("held", _HELD)) for n, t in kinds.items())
_OUT = f"{USER} long, us long, {ROW_ID} long, {SOURCE} string, new_reputation double, late boolean"
_TYPES = {"long": np.int64, "double": np.float64, "string": object}

Rows = dict[str, np.ndarray]


def _rows(kinds: dict[str, str], columns) -> Rows:
    return {n: np.array(c, dtype=_TYPES[t]) for (n, t), c in zip(kinds.items(), columns)}


def _take(rows: Rows, at: np.ndarray) -> Rows:
    return {n: c[at] for n, c in rows.items()}


def _join(parts: list[Rows]) -> Rows:
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def _apply(known: Rows, ready: Rows) -> tuple[Rows, np.ndarray, np.ndarray, Rows]:
    """(rows in order, reputation after each, whether it is older than its user's last row, users after them).

    Without a value a user's first row gives its start.
    """
    names = np.stack([np.concatenate([known[n], ready[n]]) for n in ("none", "u")], axis=1)
    users, code = np.unique(names, axis=0, return_inverse=True)
    old, code = np.split(code.ravel(), [len(known["u"])])
    has, value = np.zeros(len(users), dtype=bool), np.zeros(len(users))
    us, row = np.zeros(len(users), dtype=np.int64), np.zeros(len(users), dtype=np.int64)
    has[old], value[old], us[old], row[old] = True, known["value"], known["us"], known["row"]
    order = np.lexsort((ready["row"], ready["us"], code))
    ready, code = _take(ready, order), code[order]
    begins = np.r_[True, code[1:] != code[:-1]]
    first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    S, L, H = segmented_clamp_scan(code, ready["s"], ready["lo"], ready["hi"])
    start = np.where(has[code], value[code], ready["x0"][first])
    after = np.minimum(np.maximum(start + S, L), H)
    before = lambda a_us, a_row, b_us, b_row: (a_us < b_us) | ((a_us == b_us) & (a_row < b_row))
    behind = has[code] & before(ready["us"], ready["row"], us[code], row[code])
    end = np.flatnonzero(np.r_[begins[1:], True])
    at = code[end]
    ahead = ~(has[at] & before(ready["us"][end], ready["row"][end], us[at], row[at]))
    value[at], has[at] = after[end], True
    us[at[ahead]], row[at[ahead]] = ready["us"][end][ahead], ready["row"][end][ahead]
    return ready, after, behind, {"u": users[:, 1], "none": users[:, 0], "value": value, "us": us, "row": row}


def _update(delayed: bool):
    def run(key, frames, state: GroupState):
        arrays = state.get if state.exists else ((),) * (len(_KNOWN) + len(_HELD))
        known, held = _rows(_KNOWN, arrays[: len(_KNOWN)]), _rows(_HELD, arrays[len(_KNOWN) :])
        nothing = _take(held, np.zeros(0, dtype=np.int64))
        new = [] if state.hasTimedOut else [_rows(_HELD, [f[n].to_numpy() for n in _HELD]) for f in frames]
        rows = _join([nothing, *new])
        late = np.zeros(len(rows["us"]), dtype=bool)
        if delayed:
            spark_mark = state.getCurrentWatermarkMs()
            mark = (spark_mark + HORIZON_MS) * 1000 if spark_mark > 0 else np.iinfo(np.int64).min  # none yet
            timed = rows["us"] != _NO_TIME
            late = timed & (rows["us"] < mark)
            waiting = _join([held, _take(rows, timed & ~late)])
            passed = waiting["us"] < mark
            ready = _join([_take(waiting, passed), _take(rows, ~timed)])
            held = _take(waiting, ~passed)
        else:
            ready, held = rows, nothing
        out = []
        if late.any():
            out.append((_take(rows, late), np.nan, True))
        if len(ready["us"]):
            ready, after, behind, known = _apply(known, ready)
            out.append((ready, after, np.zeros(len(behind), dtype=bool) if delayed else behind))
        state.update((*[known[n].tolist() for n in _KNOWN], *[held[n].tolist() for n in _HELD]))
        if delayed and len(held["us"]):
            state.setTimeoutTimestamp(int(held["us"].min()) // 1000 - HORIZON_MS)
        for o, after, behind in out:
            user = pd.arrays.IntegerArray(o["u"], o["none"] != 0)
            yield pd.DataFrame({USER: user, "us": o["us"], ROW_ID: o["row"], SOURCE: o["src"], "new_reputation": after, "late": behind})

    return run


def stateful_trace(events: DataFrame, p: Scenario, delay_ms: int | None = None) -> DataFrame:
    """Streaming frame of the trace of ``events``, a stream of labelled rows: User_Id, Timestamp, row_id, Dataset_Source,
    new_reputation, late; in the order of time per user, within ``delay_ms`` if it is given."""
    us = F.coalesce(F.unix_micros(F.col(TS).cast("timestamp")), F.lit(_NO_TIME))
    bucket = F.pmod(F.xxhash64(F.col(USER).isNull(), F.col(USER)), F.lit(BUCKETS))
    rows = with_steps(events, p).select(
        bucket.alias("bucket"), F.coalesce(F.col(USER).cast("long"), F.lit(0)).alias("u"), F.col(USER).isNull().cast("long").alias("none"),
        us.alias("us"), F.col(ROW_ID).alias("row"), F.col(SOURCE).alias("src"), F.col(TARGET).cast("double").alias("x0"),
        F.col("_s").alias("s"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col(TS).cast("timestamp").alias("event_time"))
    timeout = GroupStateTimeout.NoTimeout
    if delay_ms is not None:
        rows, timeout = rows.withWatermark("event_time", f"{delay_ms + HORIZON_MS} milliseconds"), GroupStateTimeout.EventTimeTimeout
    trace = rows.groupBy("bucket").applyInPandasWithState(_update(delay_ms is not None), _OUT, _STATE, "append", timeout)
    when = F.when(F.col("us") != _NO_TIME, F.timestamp_micros("us")).cast("timestamp_ntz")
    value = F.when(~F.isnan("new_reputation"), F.col("new_reputation"))
    return trace.select(USER, when.alias(TS), ROW_ID, SOURCE, value.alias("new_reputation"), "late")


def drain(frame: DataFrame, checkpoint: str, fmt: str = "parquet", **options: str) -> StreamingQuery:
    """Run the stream as far as its input is available, from where ``checkpoint`` says, into a sink."""
    q = frame.writeStream.format(fmt).options(**options).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


def replay_keyed(events: DataFrame, p: Scenario, delay_ms: int | None = None, base: str | None = None) -> DataFrame:
    """Drain the stream into a table and read it back.  A second call with the same ``base`` goes on from the first."""
    spark = events.sparkSession
    top = base.rstrip("/") if base else scratch_path(spark, "keyed-stream")
    drain(stateful_trace(events, p, delay_ms), f"{top}/checkpoint", path=f"{top}/trace")
    return spark.read.parquet(f"{top}/trace")

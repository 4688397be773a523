"""Ordered work per key without putting a whole key into one task.

``repartitionByRange`` on (key, order...) samples the data and cuts the key
space by row density, so a key holding a third of all rows is spread over many
partitions ("segments").  Inside a partition rows are sorted, keys come in runs,
and only the first run of a partition can continue one that began earlier.

So each partition summarises its runs; the first and last of them, two rows per
partition, go to the driver, which works out the state that enters each
partition.  That state, one entry per partition, is all that the second pass
over the rows needs: there is no join and no shuffle after the range exchange.
Null times come last in the order, and a null key is a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustfold.session import ensure_checkpoint_dir, shuffle_partitions

LID = "_lid"
SEG = "_seg"
_RUN = "_run"  # hash of the key, by which runs are told apart


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x).asc_nulls_last() if isinstance(x, str) else x for x in xs]


def range_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], num_partitions: int | None = None,
                 materialize: bool = True) -> DataFrame:
    """Range-partition on keys+order (nulls last), sort inside partitions, add ``_lid`` and ``_seg``.

    The range bounds come from a sample seeded by the RDD id, and the ids
    come from the physical position of a row, so any second evaluation of
    this plan (another branch, a cache miss, a recomputed upstream) may cut
    the data differently.  A caller that reads the result twice therefore has
    it written as a reliable checkpoint: the ids become stored data, identical
    for every reader and after any executor loss.
    """
    n = num_partitions or shuffle_partitions(df.sparkSession)
    cols = _cols(list(keys) + list(order))
    out = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    out = out.withColumn(LID, F.monotonically_increasing_id())
    out = out.withColumn(SEG, F.shiftright(F.col(LID), 33).cast("int"))
    if not materialize:
        return out
    ensure_checkpoint_dir(df.sparkSession)
    return out.checkpoint(eager=True)


def global_row_number(df: DataFrame, order: Sequence[str | Column], out: str = "rn", num_partitions: int | None = None,
                      total: str | None = None) -> DataFrame:
    """0-based global position in ``order`` without a one-partition sort.

    The offset table has one row per range partition, a size fixed by
    configuration, so broadcasting it (and windowing over it) is safe.  With
    ``total`` the row count of the whole frame is attached as a column, which
    saves a separate count job.
    """
    r = range_sorted(df, [], order, num_partitions)
    segs = r.groupBy(SEG).agg(F.min(LID).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    cols = [SEG, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")]
    if total:
        cols.append(F.sum("_n").over(Window.partitionBy()).alias(total))
    offs = segs.select(*cols)
    res = r.join(F.broadcast(offs), SEG).withColumn(out, F.col("_off") + (F.col(LID) - F.col("_first")))
    return res.drop("_first", "_off", LID, SEG)


# --- runs ---------------------------------------------------------------------


def _with_run(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(_RUN, F.xxhash64(F.col(key).isNull(), F.col(key)))


def _starts(run: np.ndarray, last) -> np.ndarray:
    """Whether each row begins a run; ``last`` is the run of the row before, None at a partition's start."""
    out = np.ones(len(run), dtype=bool)
    out[1:] = run[1:] != run[:-1]
    if len(run) and last is not None:
        out[0] = run[0] != last
    return out


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _append(batch: pa.RecordBatch, drop: Sequence[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(new.values()), names=names + list(new))


def keyed_row_number(df: DataFrame, key: str, order: Sequence[str], out: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """1-based row number per key in ``order`` (skew-safe ``row_number() OVER (PARTITION BY key ORDER BY ...)``)."""
    rows = _with_run(range_sorted(df, [key], order, num_partitions), key)
    ends = rows.groupBy(SEG).agg(
        F.min_by(_RUN, LID).alias("first"), F.max_by(_RUN, LID).alias("last"), F.count(F.lit(1)).alias("rows"))
    runs = rows.join(F.broadcast(ends), SEG).groupBy(SEG).agg(  # one row per partition
        F.first("first").alias("first"), F.first("last").alias("last"), F.first("rows").alias("rows"),
        F.count_if(F.col(_RUN) == F.col("last")).alias("n_last"))
    entering, open_run, count = {}, None, 0
    for r in sorted(runs.collect(), key=lambda r: r[SEG]):
        entering[r[SEG]] = count if r["first"] == open_run else 0
        count = r["n_last"] + (entering[r[SEG]] if r["n_last"] == r["rows"] else 0)
        open_run = r["last"]
    known = df.sparkSession.sparkContext.broadcast(entering)

    def number(batches):
        last, base, first = None, 0, True
        for b in batches:
            if not b.num_rows:
                continue
            run = _column(b, _RUN)
            if first:
                base, last, first = known.value[int(_column(b, SEG)[0])], run[0], False
            starts = _starts(run, last)
            at = np.arange(len(run))
            begin = np.maximum.accumulate(np.where(starts, at, -1))
            rn = np.where(begin < 0, base + at + 1, at - begin + 1)
            last, base = run[-1], int(rn[-1])
            yield _append(b, (_RUN, SEG, LID), {out: pa.array(rn, pa.int64())})

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])
    return rows.mapInArrow(number, schema)


# ---------------------------------------------------------------------------
# Clamp-shift scan.  A step is f(x) = min(hi, max(lo, x + s)); the family is
# closed under composition: (s1,lo1,hi1) then (s2,lo2,hi2) is
# (s1+s2, c2(lo1+s2), c2(hi1+s2)) with c2 the clamp to [lo2, hi2].


def _clip(x, lo, hi):
    return np.minimum(np.maximum(x, lo), hi)


def segmented_clamp_scan(keys: np.ndarray, s: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Inclusive prefix composition per run of equal keys (Hillis-Steele, O(n log n) vectorised)."""
    n = len(keys)
    S, L, H = s.astype(float).copy(), lo.astype(float).copy(), hi.astype(float).copy()
    if n == 0:
        return S, L, H
    starts = np.ones(n, dtype=bool)
    starts[1:] = keys[1:] != keys[:-1]
    first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    off = 1
    while off < n:
        j = np.arange(off, n)
        j = j[(j - off) >= first[off:]]
        if len(j) == 0:
            break
        p = j - off
        s2, l2, h2 = S[j], L[j], H[j]
        nS = S[p] + s2
        nL = _clip(L[p] + s2, l2, h2)
        nH = _clip(H[p] + s2, l2, h2)
        S[j], L[j], H[j] = nS, nL, nH
        off *= 2
    return S, L, H


_STATE = ("_S", "_L", "_H")
_SUMMARY = T.StructType(
    [T.StructField(_RUN, T.LongType()), T.StructField(SEG, T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("start", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in _STATE] + [T.StructField("rows", T.LongType())])


def _steps(steps: DataFrame, key: str, order: Sequence[str], start: str, carry_cols: Sequence[str], initial: DataFrame | None,
           initial_col: str) -> DataFrame:
    """The fold's rows: key, order and carried columns, the step and ``_x0``, a row's start value if it is its key's first.

    A key's carried-over value is one more row, sorted before the others, that moves nothing: no join is needed.
    """
    names = list(dict.fromkeys([key, *order, *carry_cols]))
    rows = steps.select(*names, F.col(start).cast("double").alias("_x0"), "_s", "_lo", "_hi", F.lit(1).alias("_real"))
    if initial is None:
        return rows
    inf = float("inf")
    first = initial.select(
        *[F.col(key) if n == key else F.lit(None).cast(steps.schema[n].dataType).alias(n) for n in names],
        F.col(initial_col).cast("double").alias("_x0"), F.lit(0.0).alias("_s"), F.lit(-inf).alias("_lo"), F.lit(inf).alias("_hi"), F.lit(0).alias("_real"))
    return rows.unionByName(first)


def _scan(batches, with_rows: Callable, entering: dict | None = None):
    """Compose the steps of each run of a partition, batch by batch.

    ``with_rows(batch, run, starts, S, L, H, x0)`` gets each batch with the compositions since its run began in this
    partition and the value they apply to, and may yield.  ``entering`` gives that value for a first run that goes on
    from an earlier partition.
    """
    last, carry, x0_open, runs, x_in = None, None, float("nan"), 0, None
    for b in batches:
        if not b.num_rows:
            continue
        run = _column(b, _RUN)
        starts = _starts(run, last)
        S, L, H = segmented_clamp_scan(run, _column(b, "_s"), _column(b, "_lo"), _column(b, "_hi"))
        if last is None:
            x_in = (entering or {}).get(int(_column(b, SEG)[0]))
        elif not starts[0]:
            m = np.cumsum(starts) == 0
            low, high = L[m], H[m]
            L[m], H[m], S[m] = _clip(carry[1] + S[m], low, high), _clip(carry[2] + S[m], low, high), carry[0] + S[m]
        begin = np.maximum.accumulate(np.where(starts, np.arange(len(run)), -1))
        x0 = np.where(begin < 0, x0_open, _column(b, "_x0").astype(float)[np.maximum(begin, 0)])
        number = runs + np.cumsum(starts)  # of each row's run, from 1
        if x_in is not None:
            x0 = np.where(number == 1, x_in[1], x0)
        yield from with_rows(b, run, starts, S, L, H, x0)
        last, carry, x0_open, runs = run[-1], (S[-1], L[-1], H[-1]), x0[-1], int(number[-1])


def _summaries(batches):
    """One row per run of a partition: its order in the partition, start value, composition and number of real rows."""
    open_row, number = None, -1

    def runs(b, run, starts, S, L, H, x0):
        nonlocal open_row, number
        real, seg = _column(b, "_real"), int(_column(b, SEG)[0])
        first = np.flatnonzero(starts)
        if len(first) == 0 or first[0] > 0:
            stop = first[0] if len(first) else len(run)
            open_row = [*open_row[:4], S[stop - 1], L[stop - 1], H[stop - 1], open_row[7] + int(real[:stop].sum())]
        done = []
        for s, e in zip(first, np.append(first[1:], len(run))):
            if open_row:
                done.append(open_row)
            number += 1
            open_row = [run[s], seg, number, x0[s], S[e - 1], L[e - 1], H[e - 1], int(real[s:e].sum())]
        if done:
            yield _summary_batch(done)

    yield from _scan(batches, runs)
    if open_row:
        yield _summary_batch([open_row])


def _summary_batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
    names = (_RUN, SEG, "at", "start", *_STATE, "rows")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _entering(runs: DataFrame) -> tuple[dict[int, tuple[float, float]], set[int]]:
    """({partition: (start, value)} of the run that goes on from an earlier partition, partitions whose last run goes on).

    Reads the first and the last run of each partition.
    """
    edge = runs.groupBy(SEG).agg(
        F.min_by(F.struct(_RUN, "start", *_STATE), "at").alias("first"), F.max_by(F.struct(_RUN, "start", *_STATE), "at").alias("last"),
        F.max("at").alias("n")).collect()
    entering, goes_on = {}, set()
    open_run = None  # run, start, value, partition
    for r in sorted(edge, key=lambda r: r[SEG]):
        for part in (["first"] if r["n"] == 0 else ["first", "last"]):
            e = r[part]
            start = value = e["start"]
            if part == "first" and open_run and open_run[0] == e[_RUN]:
                _, start, value, before = open_run
                entering[r[SEG]] = (start, value)
                goes_on.add(before)
            open_run = (e[_RUN], start, float(_clip(value + e["_S"], e["_L"], e["_H"])), r[SEG])
    return entering, goes_on


def fold_per_key(steps: DataFrame, key: str, order: Sequence[str], start: str, initial: DataFrame | None = None,
                 initial_col: str = "initial", num_partitions: int | None = None) -> DataFrame:
    """(key, start_value, final_value) of a clamp-shift fold; see ``fold_trace``.  Only the runs' summaries are written."""
    rows = _with_run(_steps(steps, key, order, start, (), initial, initial_col), key)
    r = range_sorted(rows, [key, "_real"], order, num_partitions, materialize=False)
    def run(batches):
        firsts: list = []  # keys of the runs that have begun

        def seen():
            last = None
            for b in batches:
                if b.num_rows:
                    starts = _starts(_column(b, _RUN), last)
                    last = _column(b, _RUN)[-1]
                    firsts.append(b.column(key).filter(pa.array(starts)))
                yield b

        for out in _summaries(seen()):
            named = pa.concat_arrays(firsts)
            firsts[:] = [named.slice(out.num_rows)]
            yield _append(out, (), {"_key": named.slice(0, out.num_rows)})

    ensure_checkpoint_dir(steps.sparkSession)
    schema = T.StructType([*_SUMMARY.fields, T.StructField("_key", steps.schema[key].dataType)])
    runs = r.mapInArrow(run, schema).checkpoint(eager=True)
    entering, goes_on = _entering(runs)
    # one entry per partition at most; a run that goes on is told by its last part
    spark = steps.sparkSession
    known = spark.createDataFrame([(s, *entering.get(s, (None, None)), s in goes_on) for s in {*entering, *goes_on}] or [(-1, None, None, False)],
                                  f"{SEG} int, in_start double, in_value double, on boolean")
    last = runs.groupBy(SEG).agg(F.max("at").alias("n"))
    whole = runs.join(F.broadcast(last), SEG).join(F.broadcast(known), SEG, "left")
    first = (F.col("at") == 0) & F.col("in_value").isNotNull()
    x = F.when(first, F.col("in_value")).otherwise(F.col("start"))
    ended = whole.where(~(F.coalesce("on", F.lit(False)) & (F.col("at") == F.col("n"))))
    value = F.least(F.col("_H"), F.greatest(F.col("_L"), x + F.col("_S")))
    # a key that has only a carried-over value has no rows in this log
    return ended.where((F.col("rows") > 0) | first).select(
        F.col("_key").alias(key), F.when(first, F.col("in_start")).otherwise(F.col("start")).alias("start_value"), value.alias("final_value"))


def fold_trace(steps: DataFrame, key: str, order: Sequence[str], start: str, carry_cols: Sequence[str] = (), initial: DataFrame | None = None,
               initial_col: str = "initial", num_partitions: int | None = None) -> DataFrame:
    """Every row of ``steps`` with ``value``, its key's value after the row.

    ``steps`` holds per row the clamp-shift step ``_s, _lo, _hi`` and ``start``, of which the key's first row counts.
    ``initial`` (key, ``initial_col``) gives the start of the keys it contains.
    """
    rows = _with_run(_steps(steps, key, order, start, carry_cols, initial, initial_col), key)
    r = range_sorted(rows, [key, "_real"], order, num_partitions)
    ensure_checkpoint_dir(steps.sparkSession)
    entering, _ = _entering(r.mapInArrow(_summaries, _SUMMARY).checkpoint(eager=True))
    known = steps.sparkSession.sparkContext.broadcast(entering)  # one entry per partition
    drop = (_RUN, SEG, LID, "_x0", "_s", "_lo", "_hi", "_real")
    schema = T.StructType([f for f in rows.schema.fields if f.name not in drop] + [T.StructField("value", T.DoubleType())])

    def run(batches):
        def emit(b, run, starts, S, L, H, x0):
            out = _append(b, drop, {"value": pa.array(_clip(x0 + S, L, H))})
            yield out.filter(b.column("_real").cast(pa.bool_()))

        yield from _scan(batches, emit, known.value)

    return r.mapInArrow(run, schema)

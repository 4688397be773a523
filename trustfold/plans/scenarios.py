"""One clamped fold for several scenarios.

The log is range-sorted once.  A row's steps are arrays with one entry per
scenario, and all compositions run on arrays (row, scenario), so that a further
scenario costs arithmetic and no sort, no shuffle and no job.  As in
``ordered.fold_trace``, each partition sends the compositions of its first and
last run, and learns from the others which values enter it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustfold.plans.ordered import SEG, range_sorted, segmented_clamp_scan

_RUN = "_run"
_STEP = ("_s", "_lo", "_hi")


def _scalar(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _clip(x, lo, hi):
    return np.minimum(np.maximum(x, lo), hi)


def _scan(batches, entering=None):
    """Per batch of a partition: (batch, run of each row, number of the run, start and compositions S, L, H of each row and
    scenario).  ``entering`` gives the start of a first run that goes on from an earlier partition."""
    last, carry, start, number = None, None, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        run = _scalar(b, _RUN)
        begins = np.ones(len(run), dtype=bool)
        begins[1:] = run[1:] != run[:-1]
        S, L, H = segmented_clamp_scan(run, *[_matrix(b, c) for c in _STEP])
        x0 = np.repeat(_scalar(b, "_x0").astype(float)[:, None], S.shape[1], axis=1)
        if last is None:
            if entering is not None:
                x0[0] = entering.get(int(_scalar(b, SEG)[0]), x0[0])
        elif run[0] == last:
            begins[0] = False
            go_on = np.cumsum(begins) == 0
            low, high, shift = L[go_on], H[go_on], S[go_on]
            S[go_on], L[go_on], H[go_on] = carry[0] + shift, _clip(carry[1] + shift, low, high), _clip(carry[2] + shift, low, high)
            x0[0] = start
        first = np.maximum.accumulate(np.where(begins, np.arange(len(run)), 0))
        x0 = x0[first]
        numbers = number + np.cumsum(begins)
        yield b, run, numbers, x0, S, L, H
        last, carry, start, number = run[-1], (S[-1], L[-1], H[-1]), x0[-1], int(numbers[-1])


_ENDS = ", ".join(["seg int, single boolean"] + [f"{e}_run long, {e}_start array<double>, {e}_s array<double>, {e}_lo array<double>, {e}_hi array<double>"
                                                 for e in ("first", "last")])


def _ends(batches):
    """One row per partition: the start and composition of its first and of its last run."""
    seg, first, last, n = None, None, None, 0
    for b, run, numbers, x0, S, L, H in _scan(batches):
        seg = int(_scalar(b, SEG)[0])
        own = np.flatnonzero(numbers == 1)
        if len(own):
            i = own[-1]
            first = [run[i], x0[i], S[i], L[i], H[i]]
        last, n = [run[-1], x0[-1], S[-1], L[-1], H[-1]], int(numbers[-1])
    if n:
        names = ["seg", "single"] + [f"{e}_{c}" for e in ("first", "last") for c in ("run", "start", "s", "lo", "hi")]
        arrays = [pa.array([seg], pa.int32()), pa.array([n == 1])]
        for r in (first, last):
            arrays += [pa.array([r[0]], pa.int64()), *[pa.array([x.tolist()], pa.list_(pa.float64())) for x in r[1:]]]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _entering(ends: list) -> dict[int, np.ndarray]:
    """Per partition the values, by scenario, that its first run starts from, if it goes on from the partition before."""
    out, open_run, value = {}, None, None
    for e in ends:
        for end in ("first",) if e["single"] else ("first", "last"):
            start = np.array(e[f"{end}_start"])
            if end == "first" and open_run == e["first_run"]:
                out[e["seg"]] = start = value
            open_run = e[f"{end}_run"]
            value = _clip(start + np.array(e[f"{end}_s"]), np.array(e[f"{end}_lo"]), np.array(e[f"{end}_hi"]))
    return out


def fold_scenarios(rows: DataFrame, key: str, order: Sequence[str], start: str, steps: Sequence[tuple[Column, Column, Column]],
                   carry_cols: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """key, order and carried columns and ``values``: each key's values after the row, one per scenario.

    ``steps`` has each scenario's (s, lo, hi): x becomes min(hi, max(lo, x + s)). ``start`` counts on a key's first row.
    """
    names = list(dict.fromkeys([key, *order, *carry_cols]))
    columns = [F.array(*[c.cast("double") for c in part]).alias(n) for n, part in zip(_STEP, zip(*steps))]
    wide = rows.select(*names, F.col(start).cast("double").alias("_x0"), *columns).withColumn(_RUN, F.xxhash64(F.col(key).isNull(), F.col(key)))
    r = range_sorted(wide, [key], order, num_partitions)
    sent = r.select(_RUN, SEG, "_x0", *_STEP).mapInArrow(_ends, _ENDS).collect()  # one row per partition
    known = rows.sparkSession.sparkContext.broadcast(_entering(sorted(sent, key=lambda e: e["seg"])))
    m = len(steps)

    def run(batches):
        for b, _, _, x0, S, L, H in _scan(batches, known.value):
            values = pa.FixedSizeListArray.from_arrays(pa.array(_clip(x0 + S, L, H).ravel()), m).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], values], names=[*names, "values"])

    schema = T.StructType([rows.schema[n] for n in names] + [T.StructField("values", T.ArrayType(T.DoubleType()))])
    return r.select(*names, _RUN, SEG, "_x0", *_STEP).mapInArrow(run, schema)

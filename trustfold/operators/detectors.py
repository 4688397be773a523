"""One-dimensional outlier detectors on the long form.

Input: ``(chunk_id, row_id, column, value)`` without nulls (fill first).
Output of ``masks``: the input keys and ``mask``, one bit per method.

A (chunk, column) group is never held in one task.  Everything a detector
needs to know of its group is a small row of statistics, made by partial
aggregation: moments, range, bin counts, exact percentiles
(``trustfold.plans.percentiles``) and fitted models of fixed size.  There are as
many rows as chunks times columns, which the chunk rule and the schema bound, so
they are broadcast, and all methods' flags are computed in one pass.  Only
kNN needs order: values are range-partitioned, and partitions exchange the
values at their edges.

Constants that the original leaves to library defaults are ours and
documented here: HBOS 10 equal-width bins with regulariser 0.1; kNN 20
neighbours, distance to the farthest of them; LODA bins chosen per group by
penalised likelihood among 5, 10, 20, 40.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustfold.operators import learned
from trustfold.plans.ordered import SEG, range_sorted
from trustfold.plans.percentiles import group_percentiles, weighted_percentiles
from trustfold.session import ensure_checkpoint_dir, stored

G = ["chunk_id", "column"]
KEYS = ["chunk_id", "row_id", "column"]
TIMES = "_times"  # rows of a group that have the value
_RUN = "_run"  # hash of the group, by which runs are told apart
FLOOR = 1e-9
HBOS_BINS = 10
HBOS_ALPHA = 0.1
KNN_K = 20
LODA_BIN_CHOICES = (5, 10, 20, 40)

# The published method names, in registry order, which breaks ties.
METHODS = ("HBOS", "kNN", "IForest", "LODA", "OC-SVM", "Z-Score", "IQR", "MAD")
SQL_CHECKABLE = ("HBOS", "kNN", "LODA", "Z-Score", "IQR", "MAD")


@dataclass(frozen=True)
class DetectorParams:
    contamination: float = 0.01
    threshold: float = 3.0

    @classmethod
    def from_scenario(cls, s) -> "DetectorParams":
        return cls(s.contamination_rate, s.threshold)


@dataclass(frozen=True)
class Detector:
    """A caller's own method (D10), in one of two forms.

    ``flag(p)`` is a condition on ``value``, its group's moments (_mean, _sd, _min, _max, _n) and the columns that
    ``statistics(rows)`` adds, if it is given: it gets the rows with their moments and returns one row per group, of
    ``G`` and its own columns. Or ``rows(long, p)`` returns KEYS and ``is_outlier`` for any of the rows.
    """

    name: str
    flag: Callable[[DetectorParams], Column] | None = None
    statistics: Callable[[DataFrame], DataFrame] | None = None
    rows: Callable[[DataFrame, DetectorParams], DataFrame] | None = None


_OWN: dict[str, Detector] = {}
MAX_METHODS = 31  # bits of a mask


def known() -> tuple[str, ...]:
    """All method names in the order that breaks ties and numbers bits: the published ones, then a caller's as registered."""
    return (*METHODS, *_OWN)


def register(*detectors: Detector) -> None:
    """Make detectors known; from then on every consensus and vote without a list of methods uses them too."""
    for d in detectors:
        if d.name in known():
            raise ValueError(f"there is a method called {d.name!r}")
        if (d.flag is None) == (d.rows is None):
            raise ValueError(f"{d.name}: give either flag or rows")
        if len(known()) == MAX_METHODS:
            raise ValueError(f"there can be {MAX_METHODS} methods")
        _OWN[d.name] = d


def unregister(*names: str) -> None:
    """Forget a caller's detectors. Bits are numbered by place, so masks made before are not to be read after."""
    for n in names:
        del _OWN[n]


@contextmanager
def registered(*detectors: Detector):
    """Detectors that are known within the block."""
    before = set(_OWN)
    try:
        register(*detectors)
        yield
    finally:
        unregister(*[n for n in list(_OWN) if n not in before])


def priority(name: str) -> int:
    return known().index(name)


def bit(name: str) -> int:
    return 1 << priority(name)


# --- group statistics -------------------------------------------------------------


def moments(long: DataFrame) -> DataFrame:
    """One row per group: _mean, _sd, _min, _max, _n."""
    return long.groupBy(*G).agg(
        F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"), F.min("value").alias("_min"),
        F.max("value").alias("_max"), F.count(F.lit(1)).alias("_n"))


def _bin(bins: Column) -> Column:
    """Equal-width bin of ``value`` between ``_min`` and ``_max``; 0 if they are equal."""
    width = (F.col("_max") - F.col("_min")) / bins
    raw = F.floor((F.col("value") - F.col("_min")) / width)
    return F.when(F.col("_max") == F.col("_min"), F.lit(0)).otherwise(F.least(raw.cast("int"), (bins - 1).cast("int")))


def _score_threshold(scores: DataFrame, c: float, name: str) -> DataFrame:
    """D9 for scores that come as (score, rows) per group: the (1 - c) linear percentile."""
    n = scores.groupBy(*G).agg(F.sum("rows").alias("_all"))
    rows = scores.groupBy(*G, "score").agg(F.sum("rows").alias("rows")).join(n, G)
    return weighted_percentiles(rows, G, "score", "rows", F.lit(1.0 - c), F.col("_all"), name)


def _bin_scores(counts: DataFrame, name: str, p: DetectorParams) -> DataFrame:
    """One row per group: ``_{name}``, the scores by bin, and ``_{name}_cut``.  ``counts``: bin, rows, score."""
    by_bin = counts.groupBy(*G).agg(F.map_from_entries(F.collect_list(F.struct("bin", "score"))).alias(f"_{name}"))
    return by_bin.join(_score_threshold(counts.select(*G, "score", "rows"), p.contamination, f"_{name}_cut"), G)


def hbos_stats(binned: DataFrame, p: DetectorParams) -> DataFrame:
    """A bin's score is -log2(histogram density + alpha). ``binned``: values with TIMES and their group's moments."""
    width = F.when(F.col("_max") == F.col("_min"), F.lit(1.0)).otherwise((F.col("_max") - F.col("_min")) / F.lit(HBOS_BINS))
    counts = binned.groupBy(*G, "_min", "_max", "_n", _bin(F.lit(HBOS_BINS)).alias("bin")).agg(F.sum(TIMES).alias("rows"))
    return _bin_scores(counts.withColumn("score", -F.log2(F.col("rows") / (F.col("_n") * width) + F.lit(HBOS_ALPHA))), "hbos", p)


def loda_stats(binned: DataFrame, p: DetectorParams) -> DataFrame:
    """D7 in one dimension: -ln(bin share) of an equal-width histogram, and ``_loda_k``, its bins.

    Every random projection of one column only rescales or mirrors it, so the ensemble reduces to one histogram; its bin
    count is picked per group by the penalised likelihood sum_b n_b ln(k n_b / N) - (k - 1 + ln(k)^2.5) (ties to the smaller k).
    """
    picks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _bin(F.lit(k)).alias("bin")) for k in LODA_BIN_CHOICES]))
    counts = binned.select(*G, "_n", TIMES, picks.alias("_e")).groupBy(*G, "_n", "_e.k", "_e.bin").agg(F.sum(TIMES).alias("rows"))
    fit = F.sum(F.col("rows") * F.log(F.col("k") * F.col("rows") / F.col("_n"))) - (F.col("k") - 1 + F.pow(F.log(F.col("k").cast("double")), F.lit(2.5)))
    best = counts.groupBy(*G, "k").agg(fit.alias("fit")).groupBy(*G).agg(F.max(F.struct("fit", (-F.col("k")).alias("nk"))).alias("b"))
    best = best.select(*G, (-F.col("b.nk")).alias("k"))
    chosen = counts.join(best, [*G, "k"]).withColumn("score", -F.log(F.col("rows") / F.col("_n")))
    return _bin_scores(chosen, "loda", p).join(best.withColumnRenamed("k", "_loda_k"), G)


# --- kNN --------------------------------------------------------------------------


def kth_distances(x: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> np.ndarray:
    """Distance from each of the sorted ``x`` to its k-th nearest other value, NaN if there are fewer; ``before`` and
    ``after`` are the sorted values next to x.  The k nearest are j to the left and k - j to the right for some j."""
    pad = np.full(k, np.nan)
    line = np.concatenate([pad, before[-k:] if len(before) else before, x, after[:k], pad])
    at = k + min(k, len(before)) + np.arange(len(x))
    best = np.full(len(x), np.nan)
    for j in range(k + 1):
        best = np.fmin(best, np.maximum(x - line[at - j], line[at + k - j] - x))
    return best


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _pieces(batches):
    """(batch, run) for each piece of a batch that lies in one run, in order."""
    for b in batches:
        if b.num_rows:
            run = _column(b, _RUN)
            cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1), len(run)]
            for s, e in zip(cuts, cuts[1:]):
                yield b.slice(s, e - s), int(run[s])


def _ends(k: int):
    """What a range partition sends: the first k values of its first run, the last k of its last run, and if they are one."""
    def run(batches):
        seg, runs, first, last = None, [], np.zeros(0), np.zeros(0)
        for piece, key in _pieces(batches):
            x = _column(piece, "value")
            if not runs or runs[-1] != key:
                seg, last = int(_column(piece, SEG)[0]), np.zeros(0)
                runs = [*runs[:1], key]
            if len(runs) == 1:
                first = np.concatenate([first, x[: k - len(first)]])
            last = np.concatenate([last, x[-k:]])[-k:]
        if runs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([seg], pa.int32()), pa.array([runs[0]], pa.int64()), pa.array([first.tolist()], pa.list_(pa.float64())),
                 pa.array([runs[-1]], pa.int64()), pa.array([last.tolist()], pa.list_(pa.float64())), pa.array([len(runs) == 1])],
                names=["seg", "first_run", "first", "last_run", "last", "single"])

    return run


_ENDS = "seg int, first_run long, first array<double>, last_run long, last array<double>, single boolean"


def _halo(ends: list, k: int) -> dict[int, tuple[list[float], list[float]]]:
    """Per partition the k values before its first run and after its last run, from the partitions beside it. A partition
    that is one run of fewer than k values passes on what lies beyond it."""
    out = {}
    for i, e in enumerate(ends):
        before: list[float] = []
        for t in reversed(ends[max(0, i - k) : i]):
            if t["last_run"] != e["first_run"]:
                break
            before = [*t["last"], *before]
            if len(before) >= k or not t["single"]:
                break
        after: list[float] = []
        for t in ends[i + 1 : i + 1 + k]:
            if t["first_run"] != e["last_run"]:
                break
            after += t["first"]
            if len(after) >= k or not t["single"]:
                break
        if before or after:
            out[e["seg"]] = (before[-k:], after[:k])
    return out


def _repeated(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """Each value as often as it comes, but no more than k + 1 times: its k nearest others are then all among the copies."""
    times = np.minimum(_column(batch, TIMES), k + 1)
    return batch.take(pa.array(np.repeat(np.arange(batch.num_rows), times)))


def knn_scores(long: DataFrame, k: int = KNN_K) -> DataFrame:
    """KEYS, value and D5 score of every row, exact in one dimension."""
    rows = _knn(long.withColumn(TIMES, F.lit(1).cast("long")), k, [*KEYS, "value"], ["value", "row_id"])
    return rows.select(*KEYS, "value", "score")


def value_scores(values: DataFrame, k: int = KNN_K) -> DataFrame:
    """``values`` (G, value, TIMES: its rows) with the D5 score that each row of the value has, as ``score``."""
    return _knn(values, k, [*G, "value", TIMES], ["value"])


def _knn(rows: DataFrame, k: int, names: list[str], order: list[str]) -> DataFrame:
    """``names`` and ``score``, the distance of a value to the k-th nearest other; a value that comes TIMES times is a row.

    Rows are range-sorted by group and value, so that the k nearest values lie among the k before and the k after. Across a
    partition's edges they come by a halo exchange: each partition sends its outermost k values, at most 2k numbers
    whatever it holds, and gets those next to its own. A task holds k values and one batch.
    """
    own = [n for n in names if n != TIMES]
    keyed = rows.select(*own, TIMES).withColumn(_RUN, F.xxhash64(*G))
    sorted_rows = range_sorted(keyed, G, order)
    ends = _ends(k)
    sent = sorted_rows.select(_RUN, SEG, "value", TIMES).mapInArrow(
        lambda batches: ends(_repeated(b, k) for b in batches), _ENDS).collect()  # one row per partition
    shared = rows.sparkSession.sparkContext.broadcast(_halo(sorted(sent, key=lambda r: r["seg"]), k))

    def score(batches):
        key, before, after = None, np.zeros(0), np.zeros(0)  # the run, the k values before those held, the partition's halo
        held: list[pa.RecordBatch] = []  # rows that wait for k values after them

        def scored(following: np.ndarray, keep: int):
            """Score the rows held but for the last ``keep``, which are among ``following`` values."""
            nonlocal before, held
            if not held:
                return
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            whole = whole[0] if whole else held[0]
            n = whole.num_rows - keep
            if n > 0:
                copies = np.minimum(_column(whole, TIMES), k + 1)
                first = np.concatenate([[0], np.cumsum(copies)])  # place of each row's first copy
                x, m = np.repeat(_column(whole, "value"), copies), first[n]
                score = kth_distances(x[:m], before, np.concatenate([x[m:], following]), k)[first[:n]]
                yield pa.RecordBatch.from_arrays([*whole.slice(0, n).select(names).columns, pa.array(score, pa.float64(), from_pandas=True)], names=[*names, "score"])
                before = np.concatenate([before, x[:m]])[-k:]
            held = [whole.slice(max(n, 0))] if keep else []

        for piece, run in _pieces(batches):
            if key is None:
                halo = shared.value.get(int(_column(piece, SEG)[0]), ((), ()))
                before, after, key = np.array(halo[0], dtype=float), np.array(halo[1], dtype=float), run
            elif run != key:
                yield from scored(np.zeros(0), 0)
                before, key = np.zeros(0), run
            held.append(piece.select([*own, TIMES]))
            yield from scored(np.zeros(0), k)
        yield from scored(after, 0)

    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("score", T.DoubleType())])
    return sorted_rows.select(*own, TIMES, _RUN, SEG).mapInArrow(score, schema)


# --- all methods ---------------------------------------------------------------------


def _fit_models(long: DataFrame, stats: DataFrame, names, on_error: str) -> tuple[dict, list[str]]:
    """Fitted models of the learned methods by group, and the methods left.  A model that fails fails its method: at
    ``on_error="skip"`` the method is dropped with a warning."""
    models, left = {}, list(names)
    for name, fit in (("IForest", learned.fit_forests), ("OC-SVM", learned.fit_machines)):
        if name not in names:
            continue
        got, errors = fit(long, stats)
        if errors:
            if on_error != "skip":
                raise RuntimeError(f"{name}: {errors[0]}")
            warnings.warn(f"{name} left out: {errors[0]}", stacklevel=3)
            left.remove(name)
        else:
            models[name] = got
    return models, left


def _outside(p: DetectorParams) -> Column:
    width = F.lit(p.threshold) * (F.col("_q3") - F.col("_q1"))
    return (F.col("value") < F.col("_q1") - width) | (F.col("value") > F.col("_q3") + width)


def _floored(c: str) -> Column:
    return F.when(F.col(c) == 0, F.lit(FLOOR)).otherwise(F.col(c))


def _above(name: str):
    """Above the (1 - c) percentile of the group's scores."""
    return lambda p: F.col(f"`{name}`") > F.col(f"`_{name}_cut`")


#: Each method's condition on a row, its scores and its group's statistics.
FLAGS: dict[str, Callable[[DetectorParams], Column]] = {
    "HBOS": lambda p: F.col("_hbos")[_bin(F.lit(HBOS_BINS))] > F.col("_hbos_cut"),
    "kNN": _above("kNN"), "IForest": _above("IForest"), "OC-SVM": _above("OC-SVM"),
    "LODA": lambda p: F.col("_loda")[_bin(F.col("_loda_k"))] > F.col("_loda_cut"),
    "Z-Score": lambda p: F.abs((F.col("value") - F.col("_mean")) / _floored("_sd")) > F.lit(p.threshold),
    "IQR": _outside,
    "MAD": lambda p: F.abs(F.lit(0.6745) * (F.col("value") - F.col("_med")) / _floored("_mad")) > F.lit(p.threshold),
}


def counted_values(long: DataFrame) -> DataFrame:
    """G, value, TIMES: the distinct values of each group and their rows. All that a detector needs of a group is in it, and
    a 0/1 column of any length is two rows."""
    return long.groupBy(*G, "value").agg(F.count(F.lit(1)).alias(TIMES))


HITS = 200_000  # values with a score above their group's cut that are broadcast


def _scored(values: DataFrame, models: dict, names: Sequence[str]) -> DataFrame:
    """``values`` with a score column for kNN and each fitted model."""
    rows = value_scores(values) if "kNN" in names else values.withColumn("score", F.lit(None).cast("double"))
    return stored(learned.with_scores(rows.withColumnRenamed("score", "kNN"), models), "values")


def _with_hits(rows: DataFrame, scores: DataFrame, side: DataFrame, flags: dict, names: list[str]) -> DataFrame:
    """``rows`` with ``_by_score``, the bits of the methods whose score of the row's value is above the cut.

    They are few values, at most the contamination's share of a group for each method. Rows of groups without any are not
    looked up.
    """
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.coalesce(flags[n], F.lit(False)), F.lit(bit(n))).otherwise(F.lit(0)) for n in names])
    hits = stored(scores.join(F.broadcast(side), G).select(*G, "value", bits.alias("_by_score")).where("_by_score <> 0"), "hits")
    if hits.limit(HITS + 1).count() <= HITS:
        return rows.join(F.broadcast(hits), [*G, "value"], "left")
    groups = F.broadcast(hits.select(*G).distinct())
    looked_up = rows.join(groups, G, "left_semi").join(hits, [*G, "value"], "left")
    return looked_up.unionByName(rows.join(groups, G, "left_anti").withColumn("_by_score", F.lit(None).cast("int")))


def _masks(long: DataFrame, p: DetectorParams, names: list[str], on_error: str) -> tuple[DataFrame, list[str]]:
    stats = moments(long).checkpoint()
    models, names = _fit_models(long, stats, names, on_error)
    if not names:
        raise ValueError("no outlier method could be used")
    rows, values = long, stored(counted_values(long), "values")
    by_score = [n for n in ("kNN", *models) if n in names]
    scores = _scored(values, models, names) if by_score else values
    binned = values.join(F.broadcast(stats), G)
    flags, sides = {n: FLAGS[n](p) for n in names if n in FLAGS}, [stats]
    largest = values.groupBy(*G).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    ranks: dict[str, tuple[Column, float]] = {}
    if "IQR" in names:
        ranks |= {"_q1": (F.col("value"), 0.25), "_q3": (F.col("value"), 0.75)}
    if "MAD" in names:
        ranks["_med"] = (F.col("value"), 0.5)
    for name in by_score:
        ranks[f"_{name}_cut"] = (F.col(f"`{name}`"), 1.0 - p.contamination)
    if ranks:
        sides.append(group_percentiles(scores, G, ranks, largest, TIMES).checkpoint())
    if "MAD" in names:
        far = values.join(F.broadcast(sides[-1].select(*G, "_med")), G)
        sides.append(group_percentiles(far, G, {"_mad": (F.abs(F.col("value") - F.col("_med")), 0.5)}, largest, TIMES))
    if "HBOS" in names:
        sides.append(hbos_stats(binned, p))
    if "LODA" in names:
        sides.append(loda_stats(binned, p))
    own = [(i, d) for i, d in enumerate(_OWN[n] for n in names if n in _OWN)]
    for i, d in own:
        if d.rows:
            hits = d.rows(long, p).where("is_outlier").select(*KEYS).distinct().withColumn(f"_hit{i}", F.lit(True))
            rows, flags[d.name] = rows.join(hits, KEYS, "left"), F.col(f"_hit{i}")
            continue
        if d.statistics:
            added = d.statistics(long.join(F.broadcast(stats), G))
            clash = sorted(set(added.columns) & {c for s in [rows, scores, *sides] for c in s.columns} - set(G))
            if clash:
                raise ValueError(f"{d.name}: rename these statistics: {clash}")
            sides.append(added)
        flags[d.name] = d.flag(p)
    side = reduce(lambda a, b: a.join(b, G), sides).checkpoint()  # one row per group
    if by_score:
        rows = _with_hits(rows, scores, side, flags, by_score)
    each = [F.when(F.coalesce(flags[n], F.lit(False)), F.lit(bit(n))).otherwise(F.lit(0)) for n in names if n not in by_score]
    if by_score:
        each.append(F.coalesce("_by_score", F.lit(0)))
    mask = reduce(lambda a, b: a.bitwiseOR(b), each)
    return rows.join(F.broadcast(side), G).select(*KEYS, mask.alias("mask")), names


def masks(long: DataFrame, p: DetectorParams, methods=None, on_error: str = "raise") -> tuple[DataFrame, list[str]]:
    """(frame, methods): KEYS and ``mask``, whose bit ``bit(name)`` says that the method flags the row, for every row of
    ``long``; and the methods that ran: those asked for, or all that are known.

    ``on_error="skip"`` (G16) leaves out, with a warning, any method that is unknown or fails: the masks are then written at once,
    and should that fail, each method is tried by itself and those that come to an end are run together.
    """
    names = list(methods or known())
    unknown = [n for n in names if n not in known()]
    if unknown:
        if on_error != "skip":
            raise ValueError(f"unknown outlier methods: {unknown}")
        warnings.warn(f"unknown outlier methods left out: {unknown}", stacklevel=2)
        names = [n for n in names if n in known()]
    ensure_checkpoint_dir(long.sparkSession)
    if on_error != "skip":
        return _masks(long, p, names, on_error)
    try:
        out, used = _masks(long, p, names, on_error)
        return out.checkpoint(), used
    except Exception:  # noqa: BLE001 - whichever method failed is found next
        if len(names) < 2:
            raise
    left = []
    for n in names:
        try:
            _masks(long, p, [n], "raise")[0].checkpoint()
            left.append(n)
        except Exception as e:  # noqa: BLE001 - the method's failure, of any kind, is what is skipped
            warnings.warn(f"{n} left out: {str(e).splitlines()[0] if str(e) else type(e).__name__}", stacklevel=2)
    if not left:
        raise ValueError("no outlier method could be used")
    return _masks(long, p, left, "raise")


def detect(long: DataFrame, p: DetectorParams, method: str) -> DataFrame:
    """KEYS and ``is_outlier`` of one method."""
    out, _ = masks(long, p, [method])
    return out.select(*KEYS, (F.col("mask") > 0).alias("is_outlier"))

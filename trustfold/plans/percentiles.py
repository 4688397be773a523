"""Exact percentiles per group without holding a group in one task.

Groups of at most ``SMALL`` rows are aggregated as they are. In larger ones, of
which there can be no more than rows / SMALL, each wanted rank is found by
refining a histogram:

1. Every value falls into a cell of a function that never decreases: its sign
   and binary logarithm, eight cells to each power of two. Cells are counted by
   partial sums, with the least and greatest value in each.
2. The running sum over a group's cells names the one in which a rank lies. If
   it holds one value, that is the answer.
3. Otherwise only values between the cell's least and greatest go on, and the
   cell is cut into 4096 equal ones. A cell spans less than a factor of two, so
   each round settles twelve of a double's bits, and five rounds are enough.

Values never meet in one task, are never sorted, and no window runs over them:
windows run over at most 34,000 cells of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustfold.session import ensure_checkpoint_dir

SMALL = 65_536  # rows of a group that one aggregation buffer may hold
CELLS = 4096
BROADCAST_GROUPS = 100_000


def weighted_percentiles(counts: DataFrame, keys: Sequence[str], value: str, weight: str, q: Column, n: Column, out: str = "percentile") -> DataFrame:
    """keys + ``out``: the linear percentile ``q`` (column) of ``n`` rows given as few (value, weight) per group."""
    upto = F.sum(weight).over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    at = q * (n - 1)
    rows = counts.withColumns({"_upto": upto, "_at": at, "_lo": F.floor(at), "_hi": F.ceil(at)})
    two = rows.groupBy(*keys).agg(
        F.max("_at").alias("_at"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
        F.min(F.when(F.col("_upto") > F.col("_lo"), F.col(value))).alias("_a"), F.min(F.when(F.col("_upto") > F.col("_hi"), F.col(value))).alias("_b"))
    return two.select(*keys, _between("_a", "_b", "_at", "_lo", "_hi").alias(out))


def _between(a: str, b: str, at: str, lo: str, hi: str) -> Column:
    a, b, at, lo, hi = map(F.col, (a, b, at, lo, hi))
    return F.when((lo == hi) | (a == b), a).otherwise((hi - at) * a + (at - lo) * b)


def _first_cell(v: Column) -> Column:
    """A cell that never decreases with ``v``: by sign and binary logarithm, eight to a power of two."""
    size = F.when(F.abs(v) == float("inf"), F.lit(8200)).otherwise(F.floor(F.log2(F.abs(v)) * 8).cast("int")) + 8700  # least double: 2^-1074
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))


def _cell(v: Column) -> Column:
    """One of ``CELLS`` equal cells between ``_low`` and ``_high``."""
    return F.least(F.floor((v - F.col("_low")) / (F.col("_high") - F.col("_low")) * CELLS).cast("int"), F.lit(CELLS - 1))


def _histogram(rows: DataFrame, keys: Sequence[str], cell: Column) -> DataFrame:
    times = F.sum("_w") if "_w" in rows.columns else F.count(F.lit(1))
    return rows.groupBy(*keys, cell.alias("_cell")).agg(
        times.alias("_rows"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))


def _boundary(hist: DataFrame, keys: Sequence[str], before: Column, rank: Column) -> DataFrame:
    """keys, _low, _high, _before: the cell in which ``rank`` (from 0) lies, and the rows below it."""
    upto = before + F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    hit = hist.withColumns({"_upto": upto, "_rank": rank}).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_rows") <= F.col("_rank")))
    return hit.select(*keys, "_rank", F.col("_least").alias("_low"), F.col("_most").alias("_high"), (F.col("_upto") - F.col("_rows")).alias("_before"))


def _few(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else side


def _null_safe(keys: Sequence[str]) -> tuple[dict[str, str], list[Column]]:
    """New names for the keys of the right side of a join, and its conditions; null keys are keys."""
    return {k: f"_k_{k}" for k in keys}, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]


def select_ranks(rows: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """keys, t, _rank, value: of the values ``_v`` of ``rows`` (keys, t, _v), the ``_rank``-th, from 0, of each (keys, t) in
    order, for every row of ``wanted`` (keys, t, _rank). ``rows`` is read once a round, at most six times. With a column ``_w`` a
    row stands for so many."""
    by = [*keys, "t"]
    names, on = _null_safe(by)
    counted = _histogram(rows, by, _first_cell(F.col("_v"))).checkpoint()
    asked = wanted.withColumnsRenamed(names)
    found = _boundary(counted.join(asked, on).drop(*names.values()).withColumnRenamed("_rank", "_r"), [*by, "_r"], F.lit(0), F.col("_r"))
    found = found.drop("_r").checkpoint()
    done = []
    while True:
        done.append(found.where("_low = _high").select(*by, "_rank", F.col("_low").alias("value")))
        left = found.where("_low < _high")
        if not left.limit(1).count():
            break
        inside = rows.join(_few(left.withColumnsRenamed(names)), on).where(F.col("_v").between(F.col("_low"), F.col("_high"))).drop(*names.values())
        hist = _histogram(inside, [*by, "_rank", "_before"], _cell(F.col("_v"))).withColumnsRenamed({"_rank": "_r", "_before": "_b"})
        found = _boundary(hist, [*by, "_r", "_b"], F.col("_b"), F.col("_r")).drop("_r", "_b").checkpoint()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _refined(values: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """keys, p0, p1, ...: the percentiles of the columns _v0, _v1, ... of ``values`` by rank selection."""
    each = F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"_v{i}").isNotNull(), F.struct(F.lit(i).alias("t"), F.col(f"_v{i}").alias("_v"))) for i in range(len(qs))])))
    weight = [c for c in ("_w",) if c in values.columns]
    rows = values.select(*keys, *weight, each.alias("_e")).select(*keys, *weight, "_e.*")
    q = F.get(F.array(*map(F.lit, qs)), F.col("t"))
    sizes = rows.groupBy(*keys, "t").agg((F.sum("_w") if weight else F.count(F.lit(1))).alias("_n")).withColumn("_at", q * (F.col("_n") - 1))
    sizes = sizes.withColumns({"_lo": F.floor("_at"), "_hi": F.ceil("_at")}).checkpoint()
    wanted = sizes.select(*keys, "t", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_rank"))
    names, on = _null_safe([*keys, "t"])
    found = sizes.join(select_ranks(rows, keys, wanted).withColumnsRenamed(names), on)
    both = found.groupBy(*keys, "t", "_at", "_lo", "_hi").agg(
        F.max(F.when(F.col("_rank") == F.col("_lo"), F.col("value"))).alias("_a"), F.max(F.when(F.col("_rank") == F.col("_hi"), F.col("value"))).alias("_b"))
    mid = both.select(*keys, "t", _between("_a", "_b", "_at", "_lo", "_hi").alias("p"))
    return mid.groupBy(*keys).agg(*[F.max(F.when(F.col("t") == i, F.col("p"))).alias(f"p{i}") for i in range(len(qs))])


def group_percentiles(df: DataFrame, keys: Sequence[str], targets: Mapping[str, tuple[Column, float]], largest: int | None = None,
                      weight: str | None = None) -> DataFrame:
    """One row per group (nulls are a group): keys and, per target, the linear percentile q of its non-null values, NaN
    counting as null.

    ``df`` is read once if no group has more than ``SMALL`` rows, and otherwise once a round; an input that is dear to make
    should be a stored table. ``largest`` says how many rows the largest group has, if the caller knows. A row of ``df`` stands
    for as many rows as its column ``weight`` says, if that is given.
    """
    ensure_checkpoint_dir(df.sparkSession)
    names, qs = list(targets), [targets[t][1] for t in targets]
    times = [] if weight is None else [F.col(weight).alias("_w")]
    values = df.select(*keys, *times, *[targets[t][0].cast("double").alias(f"_v{i}") for i, t in enumerate(names)])
    values = values.select(*keys, *["_w" for _ in times], *[F.when(~F.isnan(f"_v{i}"), F.col(f"_v{i}") + F.lit(0.0)).alias(f"_v{i}") for i in range(len(names))])  # -0.0 is 0.0
    at_once = lambda rows: rows.groupBy(*keys).agg(*[F.percentile(f"_v{i}", q, F.col("_w") if times else F.lit(1)).alias(f"p{i}") for i, q in enumerate(qs)])
    final = [*keys, *[F.col(f"p{i}").alias(t) for i, t in enumerate(names)]]
    if largest is not None and largest <= SMALL:
        return at_once(values).select(*final)
    large = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")).where(F.col("_all") > SMALL).select(*keys, "_all").checkpoint()
    if not large.limit(1).count():
        return at_once(values).select(*final)
    if not keys:
        out = _refined(values, keys, qs)
    else:
        renamed, on = _null_safe(keys)
        side = _few(large.drop("_all").withColumnsRenamed(renamed))
        out = at_once(values.join(side, on, "left_anti")).unionByName(_refined(values.join(side, on, "left_semi"), keys, qs))
        empty = large.drop("_all").withColumnsRenamed(renamed).join(out, on, "left_anti")  # large groups of nulls only
        out = out.unionByName(empty.select(*[F.col(f"_k_{k}").alias(k) for k in keys]), allowMissingColumns=True)
    return out.select(*final)

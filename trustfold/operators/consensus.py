"""Consensus outlier split.

The log is cut into contiguous chunks in time order; every detector runs on
every (chunk, column) group at once; per group the method whose removal count
is nearest the median count wins (ties by registry order); rows flagged by a
winning method on any column are Misbehaving, the rest Normal.

All methods' flags of a row and column are one bit mask.  Metrics are one
grouped count per bit, and a row is flagged if the winner's bit is set: no
table of rows x columns x methods exists.

Mode ``independent`` (default) checks every column on all rows of the chunk
in one job.  Mode ``sequential`` reproduces the original order dependence:
rows removed on one column are gone before the next column is checked; it
loops over columns and cuts lineage with a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustfold.operators import detectors as D
from trustfold.operators.encode import encode_features, numeric_columns, scale_grouped, string_columns
from trustfold.plans.ordered import global_row_number
from trustfold.plans.percentiles import group_percentiles
from trustfold.session import ensure_checkpoint_dir, stored
from trustfold.sources.tables import ROW_ID, TS, USER

#: Never checked for outliers: keys, the target and what is derived from it.
EXCLUDE = (USER, TS, "User_Reputation", "User_Experience", ROW_ID, "chunk_id")


def chunk(df: DataFrame, order=(TS, ROW_ID), chunk_percent: float = 0.1) -> DataFrame:
    """G1: ``chunk_id`` of contiguous near-equal slices (the first N mod n slices one row longer).

    The row count comes with the global numbering, so no separate count job is needed.
    """
    numbered = global_row_number(df, list(order), out="_i", total="_cnt")
    i, total = F.col("_i"), F.col("_cnt")
    size = F.greatest(F.lit(1), F.floor(total * F.lit(float(chunk_percent))))
    numbered = numbered.withColumn("_nc", F.greatest(F.lit(1), F.floor(total / size)).cast("long"))
    nc = F.col("_nc")
    q, r = F.floor(total / nc), total % nc
    cut = r * (q + 1)
    cid = F.when(i < cut, F.floor(i / (q + 1))).otherwise(r + F.floor((i - cut) / F.greatest(q, F.lit(1))))
    return numbered.withColumn("chunk_id", cid.cast("int")).drop("_i", "_cnt", "_nc")


def checked_columns(df: DataFrame, exclude=EXCLUDE) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns of the frame that are not excluded."""
    return numeric_columns(df, exclude), string_columns(df, exclude)


def long_form(df: DataFrame, columns, ids=("chunk_id", ROW_ID)) -> DataFrame:
    cols = [F.col(c).cast("double").alias(c) for c in columns]
    wide = df.select(*ids, *cols)
    return wide.unpivot(list(ids), list(columns), "column", "value")


def fill_missing(long: DataFrame, group=tuple(D.G)) -> DataFrame:
    """I4: a null takes its group's median.  (The mean fill I3 that follows in the original has nothing left to fill:
    a group without a median has no mean either.)  A frame without nulls is returned as it is."""
    if not long.where(F.col("value").isNull()).limit(1).count():
        return long
    medians = group_percentiles(long, list(group), {"_med": (F.col("value"), 0.5)})
    return long.join(F.broadcast(medians), list(group)).withColumn("value", F.coalesce("value", "_med")).drop("_med")


def detection_frame(chunked: DataFrame, numeric=None, categorical=None, scaler: str | None = None) -> tuple[DataFrame, list[str]]:
    """Encode (numeric, one-hot, label), go long, fill per (chunk, column); (frame, column names).

    Without lists, all columns that are not excluded are checked.  Scaling is optional: the original standard-scales
    each chunk first, but every SQL-checkable detector gives the same flags under a shift or a positive scale (apart
    from the 1e-9 floors), so the default skips it.  The frame is written once, as every detector reads it.
    """
    if numeric is None and categorical is None:
        numeric, categorical = checked_columns(chunked)
    enc, names = encode_features(chunked, list(numeric or ()), list(categorical or ()))
    ensure_checkpoint_dir(chunked.sparkSession)
    written = stored(long_form(enc, names), "long")
    long = fill_missing(written)
    if scaler:
        long = scale_grouped(long, "value", D.G, scaler)
    return (written if long is written else stored(long, "long")), names


def metrics(masks: DataFrame, methods) -> DataFrame:
    """Per (chunk, column, method): rows before, removed and after."""
    has = lambda m: F.col("mask").bitwiseAND(F.lit(D.bit(m))) != 0
    counts = masks.groupBy("chunk_id", "column").agg(
        F.count(F.lit(1)).alias("original_size"), *[F.count_if(has(m)).alias(f"_{i}") for i, m in enumerate(methods)])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(D.priority(m)).alias("priority"), F.col(f"_{i}").alias("outliers_removed"))
                               for i, m in enumerate(methods)]))
    rows = counts.select("chunk_id", "column", "original_size", each.alias("_m")).select("chunk_id", "column", "_m.*", "original_size")
    return rows.withColumn("cleaned_size", F.col("original_size") - F.col("outliers_removed"))


def outlier_ids(masks: DataFrame, methods) -> DataFrame:
    """The removed row ids, one row each: chunk_id, column, method, row_id."""
    hit = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(D.bit(m))) != 0, F.lit(m)) for m in methods]))
    return masks.select("chunk_id", "column", F.explode(hit).alias("method"), ROW_ID)


def best_methods(m: DataFrame) -> DataFrame:
    """Per (chunk, column) the method nearest the median removal count, ties by registry order."""
    w = Window.partitionBy("chunk_id", "column")  # one row per method
    ranked = m.withColumn("_med", F.percentile(F.col("outliers_removed").cast("double"), 0.5).over(w)).withColumn(
        "_r", F.row_number().over(w.orderBy(F.abs(F.col("outliers_removed") - F.col("_med")), "priority"))
    )
    return ranked.where(F.col("_r") == 1).drop("_r", "_med")


def flagged_rows(masks: DataFrame, best: DataFrame) -> DataFrame:
    """Distinct (chunk, row) flagged by the winning method of any column."""
    winner = best.select("chunk_id", "column", F.call_function("shiftleft", F.lit(1), F.col("priority")).alias("_bit"))
    return masks.join(F.broadcast(winner), ["chunk_id", "column"]).where("mask & _bit <> 0").select("chunk_id", ROW_ID).distinct()


def tag(log: DataFrame, flagged: DataFrame) -> DataFrame:
    """The log with ``is_misbehaving``, in one join."""
    hit = flagged.select(ROW_ID, F.lit(True).alias("_hit")).distinct()
    return log.join(hit, ROW_ID, "left").withColumn("is_misbehaving", F.coalesce("_hit", F.lit(False))).drop("_hit")


def summary(tagged: DataFrame) -> DataFrame:
    """Original, cleaned, unique removed and percent removed, in one row and one pass."""
    both = tagged.agg(F.count(F.lit(1)).alias("original_rows"), F.count_if(~F.col("is_misbehaving")).alias("cleaned_rows"))
    removed = F.col("original_rows") - F.col("cleaned_rows")
    return both.select(
        "original_rows",
        "cleaned_rows",
        removed.alias("unique_removed"),
        F.when(F.col("original_rows") == 0, F.lit(0.0)).otherwise(F.round(removed / F.col("original_rows") * 100, 6)).alias("percent_removed"),
    )


def by_method(m: DataFrame) -> DataFrame:
    """Total removed per method and its percent of the grand total."""
    t = m.groupBy("method").agg(F.sum("outliers_removed").alias("total_removed"))
    grand = F.sum("total_removed").over(Window.partitionBy())  # one row per method
    return t.withColumn("percent", F.when(grand == 0, F.lit(0.0)).otherwise(F.round(F.col("total_removed") / grand * 100, 6)))


def consensus(log: DataFrame, p: D.DetectorParams, numeric=None, categorical=None, methods=None,
              mode: str = "independent", chunk_percent: float = 0.1, on_error: str = "raise"):
    """Full G1-G10 pass.  Returns a dict: long, columns, methods, masks, metrics, best, flagged, tagged, normal, misbehaving."""
    long, names = detection_frame(chunk(log, chunk_percent=chunk_percent), numeric, categorical)
    if mode == "independent":
        masks, used = D.masks(long, p, methods, on_error)
        masks = stored(masks, "masks")  # read by metrics, flagged rows and ids
        m = metrics(masks, used)
        best = best_methods(m).checkpoint()
        flagged = flagged_rows(masks, best)
    elif mode == "sequential":
        masks, used, m, best, flagged = _sequential(long, names, p, methods, on_error)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    tagged = tag(log, flagged).checkpoint()
    return {"long": long, "columns": names, "methods": used, "masks": masks, "metrics": m, "best": best, "flagged": flagged, "tagged": tagged,
            "normal": tagged.where("NOT is_misbehaving").drop("is_misbehaving"),
            "misbehaving": tagged.where("is_misbehaving").drop("is_misbehaving")}


def _sequential(long: DataFrame, names, p, methods, on_error):
    """Columns in order; rows flagged on a column leave the chunk before the next one."""
    removed, used = None, None
    all_masks, all_best = [], []
    for c in names:
        part = long.where(F.col("column") == c)
        if removed is not None:
            part = part.join(removed, ["chunk_id", ROW_ID], "left_anti")
        masks, used = D.masks(stored(part, "part"), p, methods, on_error)
        masks = stored(masks, "masks")
        best = best_methods(metrics(masks, used)).checkpoint()
        hit = flagged_rows(masks, best)
        removed = (hit if removed is None else removed.unionByName(hit)).checkpoint()
        all_masks.append(masks)
        all_best.append(best)
    union = lambda xs: xs[0] if len(xs) == 1 else xs[0].unionByName(union(xs[1:]))
    masks = union(all_masks)
    return masks, used, metrics(masks, used), union(all_best), removed

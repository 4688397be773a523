"""Split Misbehaving rows into Intentional / Unintentional by method votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustfold.operators import detectors as D
from trustfold.operators.consensus import fill_missing, long_form
from trustfold.operators.encode import numeric_columns, scale_grouped
from trustfold.plans.ordered import global_row_number
from trustfold.session import ensure_checkpoint_dir, stored
from trustfold.sources.tables import ROW_ID


def checked_columns(df: DataFrame, configured=("value", "k")) -> list[str]:
    """Configured columns that exist, else every numeric column."""
    cols = [c for c in configured if c in df.columns]
    return cols or numeric_columns(df, exclude=("chunk_id", ROW_ID))


def vote_counts(mis: DataFrame, p: D.DetectorParams, columns=("value", "k"), vote_on: str = "outlier",
                methods=None, on_error: str = "skip", scaler: str | None = None) -> DataFrame:
    """One vote per method that hits the row on at least one checked column.

    All rows are one chunk.  ``vote_on="outlier"`` counts flagged rows (as described); ``"inlier"``
    counts the rows a detector keeps, as the original code does.

    ``on_error="skip"`` (G16) is the original's rule: a method that fails casts no vote, and only a warning says so.  With
    "raise" the votes are those of all methods or there are none; every query asks for that.
    """
    cols = checked_columns(mis, columns)
    ensure_checkpoint_dir(mis.sparkSession)
    written = stored(long_form(mis.withColumn("chunk_id", F.lit(0)), cols), "votes")
    long = fill_missing(written)
    if scaler:  # the original min-max scales first; flags do not change under it
        long = scale_grouped(long, "value", D.G, scaler)
    masks, used = D.masks(written if long is written else stored(long, "votes"), p, methods, on_error)
    if on_error != "skip":  # written at once, as with "skip": a method that fails while rows are read fails here
        masks = masks.checkpoint()
    every = sum(D.bit(m) for m in used)
    hit = F.col("mask") if vote_on == "outlier" else F.bitwise_not("mask").bitwiseAND(F.lit(every))
    votes = masks.groupBy(ROW_ID).agg(F.bit_count(F.bit_or(hit)).cast("bigint").alias("votes"))
    return mis.select(ROW_ID).join(votes, ROW_ID, "left").fillna(0, ["votes"])


def n_top(rows: int, perc: float) -> int:
    """max(1, round(rows * perc)) with round half to even."""
    return max(1, int(round(rows * perc)))


def top_n_split(mis: DataFrame, votes: DataFrame, perc: float):
    """The top N rows by (votes desc, row_id) are intentional; none if N is 0 or all rows.

    N = max(1, round_half_even(rows * perc)) is computed on the row count the
    global numbering attaches (no separate count job).
    """
    ranked = global_row_number(votes, [F.desc("votes"), F.col(ROW_ID)], out="_rank", total="_rows")
    rows = F.col("_rows")
    n = F.greatest(F.lit(1), F.bround(rows * F.lit(float(perc)), 0).cast("long"))
    flag = F.when((n == rows) | (rows == 0), F.lit(0)).when(F.col("_rank") < n, F.lit(1)).otherwise(F.lit(0))
    marks = ranked.select(ROW_ID, "votes", flag.alias("Is_Intentional"))
    out = mis.join(marks, ROW_ID)
    return out, out.where(F.col("Is_Intentional") == 1), out.where(F.col("Is_Intentional") == 0)

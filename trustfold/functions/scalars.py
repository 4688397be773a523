"""Scalar column functions (S1-S13).  All are built-in expressions (no UDF).

Spark 4 runs in ANSI mode, so every lenient conversion uses the ``try_`` form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def user_number(c: Column) -> Column:
    """S1: 'User_17' -> 17 (null when not a number)."""
    return F.regexp_replace(c.cast("string"), "User_", "").try_cast("int")


def parse_ts(c: Column) -> Column:
    """Timestamp from text; invalid text becomes null."""
    return F.try_to_timestamp(c.cast("string"))


def to_number(c: Column) -> Column:
    """S4."""
    return c.cast("string").try_cast("double")


def norm_text(c: Column) -> Column:
    """Trimmed lower-case text."""
    return F.lower(F.trim(c.cast("string")))


def label_head(c: Column, sep: str = " (") -> Column:
    """The part of a label before ' ('."""
    return F.substring_index(c, sep, 1)


def base_name(c: Column) -> Column:
    """B10 helper: last path component."""
    return F.regexp_extract(c, r"[^/]+$", 0)


def clamp(c: Column, lo: float, hi: float) -> Column:
    """S9."""
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def round_half_even(c: Column, digits: int = 0) -> Column:
    """Python's round() is half-to-even."""
    return F.bround(c, digits)


def percent_of(part: Column, total: Column) -> Column:
    """Zero-guarded percent."""
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total * 100)


def all_whole(c: Column) -> Column:
    """S13 aggregate: no value has a fraction."""
    return F.coalesce(F.bool_and(c == F.floor(c)), F.lit(True))


def integer_like(c: Column, max_distinct: int = 10) -> Column:
    """S13 / M1 aggregate: at most ``max_distinct`` distinct values and all whole."""
    return (F.count_distinct(c) <= max_distinct) & all_whole(c)


def hashed_uniform(seed: str, *keys) -> Column:
    """Seeded uniform in [0, 1) from md5 of seed and keys (same value in any SQL engine)."""
    h = F.md5(F.concat_ws("#", F.lit(seed), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def category_order(c: Column, order) -> Column:
    """Position of a category in a fixed order (unknown last)."""
    expr = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        expr = F.when(c == F.lit(v), F.lit(i)).otherwise(expr)
    return expr

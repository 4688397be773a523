"""Quality rules whose thresholds are chosen under a proven limit on false rejection.

A rule compares a text statistic with a cutoff. Labelled documents are dealt by
a hash of their id into a design half and a holdout half. On the design half,
each stratum picks for each rule the cutoff with the largest gap between the
bad and the good documents it rejects, ranks the rules by that gap, and leaves
out those that add no gap to the rules before them. The holdout then tests the first rule, the first two together, and so on: with n
good holdout documents of which k would be rejected, a set is certified if a
binomial of n trials at the allowed rate gives k or fewer with probability at
most the error level (the exact, Clopper-Pearson bound). Sets grow in a fixed
order and testing ends at the first that fails, which needs no correction
within a stratum; the error level is divided by the number of strata
(Bonferroni). A stratum uses its largest certified set, or no rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustfold.llm.common import broadcast_if_small, free_names, row_key, stored, word_count

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    """Rejects if 100 * part > cutoff * whole; cutoffs from the loosest to the strictest."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[int, ...]


RULES = (
    Rule("symbols", "n_symbols", "n_words", (300, 200, 150, 100, 70, 50, 30, 20)),
    Rule("repeats", "n_repeat_words", "n_words", (45, 40, 35, 30, 25, 20, 15, 10)),
    Rule("lines", "n_dup_lines", "n_lines", (80, 60, 50, 40, 30, 20)),
    Rule("long_words", "word_chars", "n_words", (2000, 1500, 1200, 1000, 900, 800, 700)),
    Rule("capitals", "n_upper", "word_chars", (90, 70, 50, 40, 30, 20)),
)


# --- statistics ---------------------------------------------------------------


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=n)
    if len(names) == n:
        return 0
    # two steps, so that the numbers stay small for texts of any length
    _, pairs = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)
    _, at, times = np.unique(pairs[:-1] * np.int64(len(names)) + ids[2:], return_inverse=True, return_counts=True)
    hit = times[at] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


_COUNTS = ("n_lines", "n_dup_lines", "n_repeat_words")


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS]))
def _repeats(text: pd.Series) -> pd.DataFrame:
    out = np.zeros((len(text), 3), dtype=np.int64)
    for i, t in enumerate(text):
        if t:
            lines = [x for x in t.split(b"\n") if x.strip()]
            out[i] = len(lines), len(lines) - len(set(lines)), repeat_words(t.split())
    return pd.DataFrame(out, columns=list(_COUNTS))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def statistics(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with the text replaced by its counts (long), all 0 for null; base_failed is added."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    out = rows.select(
        *[c for c in rows.columns if c != text_col], word_count(t).alias("n_words"),
        _without(t, SPACE).cast("long").alias("word_chars"), (F.length(t) - _without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"), _repeats(t.cast("binary")).alias("r"))
    out = out.select("*", "r.*").drop("r")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


# --- thresholds ----------------------------------------------------------------


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), X binomial. Sums the tail on k's side of the mean, away from it, until the terms no longer count."""
    if k >= n:
        return 1.0
    below = k < n * p
    i = k if below else k + 1
    term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    total = 0.0
    while 0 <= i <= n and term > 1e-18 * total:
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p) if below else (n - i) * p / ((i + 1) * (1 - p))
        i += -1 if below else 1
    return min(1.0, total if below else 1.0 - total)


@F.pandas_udf(T.DoubleType())
def _tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    # above the allowed rate nothing can be certified
    return pd.Series([1.0 if b == 0 or a >= b * c else binomial_cdf(int(a), int(b), c) for a, b, c in zip(k, n, p)], dtype=float)


def rejects(rule: Rule, cutoff: Column) -> Column:
    return 100 * F.col(rule.part) > cutoff * F.col(rule.whole)


def in_design(id_col: Column) -> Column:
    """Half of the ids, by the first hex digit of the MD5 of the id as text."""
    return F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 1) < "8"


def design(labelled: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(stratum, rule, cutoff, rank): the cutoff of each rule that helps, and the rules' order, per stratum.

    ``labelled``: statistics with stratum and good (boolean). One grouped count; its size is strata x cutoffs.
    """
    tests = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("step"), F.lit(cutoff).alias("cutoff"), rejects(rule, F.lit(cutoff)).alias("hit"))
        for r, rule in enumerate(rules) for c, cutoff in enumerate(rule.cutoffs)])
    each = labelled.select("stratum", "good", F.explode(tests).alias("t")).select("stratum", "good", "t.*")
    good, bad = F.col("good"), ~F.col("good")
    gap = F.count_if(bad & F.col("hit")) * F.count_if(good) - F.count_if(good & F.col("hit")) * F.count_if(bad)
    rows = each.groupBy("stratum", "rule", "step", "cutoff").agg(gap.alias("gap"))
    best = Window.partitionBy("stratum", "rule").orderBy(F.col("gap").desc(), "step")  # a handful of cutoffs
    rows = rows.withColumn("n", F.row_number().over(best)).where("n = 1 AND gap > 0")
    order = Window.partitionBy("stratum").orderBy(F.col("gap").desc(), "rule")  # at most one row a rule
    return rows.select("stratum", "rule", "cutoff", F.row_number().over(order).alias("rank"))


def certified(labelled: DataFrame, rate: float, error: float, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per stratum with labels: cutoff_r and rank_r of each rule r (null if it does not help), n_good, k_1..k_m
    (good holdout documents that the first s rules reject) and certified, the number of rules that may be used.

    ``labelled``: statistics with stratum, id and good (boolean).
    """
    half = labelled.where(in_design(F.col("id")))
    chosen = design(half, rules).groupBy(F.col("stratum").alias("_stratum")).agg(*[
        F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{c}_{r}") for r in range(len(rules)) for c in ("cutoff", "rank")])
    chosen = broadcast_if_small(stored(chosen))
    columns = [c for c in chosen.columns if c != "_stratum"]
    at = F.col("stratum").eqNullSafe(F.col("_stratum"))
    chosen = broadcast_if_small(stored(_helpful(half.join(chosen, at), rules, columns)))
    holdout = labelled.where(~in_design(F.col("id")) & F.col("good"))
    held = holdout.join(chosen, at, "left").withColumn("hit", _first_hit(rules))
    steps = range(1, len(rules) + 1)
    counts = held.groupBy("stratum", *columns).agg(
        F.count(F.lit(1)).alias("n_good"), *[F.count_if(F.col("hit") <= s).alias(f"k_{s}") for s in steps])
    counts = stored(counts)
    strata = max(1, counts.count())
    passed, ends = F.lit(0), F.lit(True)
    for s in steps:
        ends = ends & (F.col(f"p_{s}") <= error / strata)
        passed = F.when(ends, F.lit(s)).otherwise(passed)
    tested = counts.withColumns({f"p_{s}": _tail(f"k_{s}", "n_good", F.lit(rate)) for s in steps})
    return tested.withColumn("certified", passed)


def _helpful(half: DataFrame, rules: tuple[Rule, ...], columns: list[str]) -> DataFrame:
    """(_stratum, cutoff_r, rank_r): null for the rules that add no gap to those ranked before them."""
    steps = range(len(rules) + 1)
    sums = half.withColumn("hit", _first_hit(rules)).groupBy("_stratum", *columns).agg(
        F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"),
        *[F.count_if((F.col("hit") <= s) & F.col("good")).alias(f"k_{s}") for s in steps],
        *[F.count_if((F.col("hit") <= s) & ~F.col("good")).alias(f"b_{s}") for s in steps])
    more = F.array(*[(F.col(f"b_{s}") - F.col(f"b_{s - 1}")) * F.col("n_good") > (F.col(f"k_{s}") - F.col(f"k_{s - 1}")) * F.col("n_bad")
                     for s in steps if s])
    keep = sums.withColumn("more", more)
    return keep.select("_stratum", *[F.when(F.get("more", F.col(f"rank_{r}") - 1), F.col(f"{c}_{r}")).alias(f"{c}_{r}")
                                     for r in range(len(rules)) for c in ("cutoff", "rank")])


def _first_hit(rules: tuple[Rule, ...]) -> Column:
    """Rank of the first rule that rejects, null if none does."""
    ranks = [F.when(rejects(rule, F.col(f"cutoff_{r}")), F.col(f"rank_{r}")) for r, rule in enumerate(rules)]
    return F.least(*ranks, F.lit(None).cast("int"))


def _verdicts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str, rate: float, error: float,
              rules: tuple[Rule, ...]) -> DataFrame:
    """(row, id, stratum, statistics, base_failed, kept)."""
    rows = docs.select(row_key(docs, id_col, text_col).alias("row"), F.col(id_col).alias("id"),
                       F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    stats = stored(statistics(rows, "text"))
    good = labels.where("quality IS NOT NULL").groupBy(F.col(id_col).alias("id")).agg((F.min("quality") > 0).alias("good"))
    table = certified(stats.where("NOT base_failed").join(good, "id"), rate, error, rules).withColumnRenamed("stratum", "_stratum")
    used = broadcast_if_small(stored(table.select("_stratum", "certified", *[f"{c}_{r}" for r in range(len(rules)) for c in ("cutoff", "rank")])))
    out = stats.join(used, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    caught = F.coalesce(_first_hit(rules) <= F.col("certified"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~caught).select(*stats.columns, "kept")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
                  rate: float = 0.05, error: float = 0.05, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, base_failed, kept) for
    every row of ``docs``.

    ``labels`` has the id and quality (0 or 1). With probability 1 - error, in no stratum do the rules reject more than
    the share ``rate`` of good documents that pass the base rules. Labels without id or quality are ignored; of several
    labels of an id the worst counts. A null stratum is a stratum of its own. A stratum with too few labels to prove
    anything, and every stratum if ``labels`` is empty, rejects by the base rules alone. A null text has no words.
    Repeated rows stay repeated. Other columns are not read.
    """
    got = _verdicts(docs, labels, id_col, text_col, stratum_col, rate, error, rules)
    return got.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "n_lines", "n_upper", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
              rate: float = 0.05, error: float = 0.05, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, unchanged."""
    free_names(docs, "_row")
    got = _verdicts(docs, labels, id_col, text_col, stratum_col, rate, error, rules)
    bad = broadcast_if_small(stored(got.where("NOT kept").select(F.col("row").alias("_row")).distinct()))
    return docs.withColumn("_row", row_key(docs, id_col, text_col)).join(bad, "_row", "left_anti").drop("_row")

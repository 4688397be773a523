"""Sort, sampling and set operations.

Seeded randomness is ``md5(seed#key)``: the same order on any partitioning
and in any SQL engine; ``rand()`` is never used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustfold.plans.ordered import global_row_number
from trustfold.sources.tables import ROW_ID, TS

SEED = "42"


def seeded_key(key: str = ROW_ID, seed: str = SEED) -> Column:
    return F.md5(F.concat_ws("#", F.lit(seed), F.col(key).cast("string")))


def time_order(df: DataFrame, ts: str = TS, tie: str = ROW_ID) -> DataFrame:
    """L1: sort by time, null times last; ties always end in the row id (range-partitioned sort)."""
    return df.orderBy(F.col(ts).asc_nulls_last(), F.col(tie))


def hash_cuts(df: DataFrame, ranks: Sequence[int], key: str = ROW_ID, seed: str = SEED) -> list[tuple[str, int, int] | None]:
    """For each of ``ranks`` (from 1) the seeded key at that place in order, the rows before it and the rows that have it; None
    for a rank beyond the frame.

    Rows are counted by the first three hex digits of their key, then the rows of the buckets in which the ranks lie by the
    next three, and so on, until a bucket holds one key. A round is one aggregate of at most 4096 rows a rank.
    """
    h = seeded_key(key, seed)
    at: list[tuple[str, int]] = [("", 0)] * len(ranks)  # prefix, rows before it
    out: list[tuple[str, int, int] | None] = [None] * len(ranks)
    todo = [i for i, r in enumerate(ranks) if r > 0]
    digits = 0
    while todo:
        rows = df.select(h.alias("_h"))
        if digits:
            rows = rows.where(F.substring("_h", 1, digits).isin(sorted({at[i][0] for i in todo})))
        digits += 3
        found = rows.groupBy(F.substring("_h", 1, digits).alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("a"), F.max("_h").alias("b")).collect()
        found.sort(key=lambda r: r["_p"])
        left = []
        for i in todo:
            prefix, before = at[i]
            for r in found:
                if r["_p"].startswith(prefix):
                    if before + r["n"] >= ranks[i]:
                        if r["a"] == r["b"]:
                            out[i] = (r["a"], before, r["n"])
                        else:
                            at[i] = (r["_p"], before)
                            left.append(i)
                        break
                    before += r["n"]
        todo = left
    return out


def seeded_sample(df: DataFrame, n: int, key: str = ROW_ID, seed: str = SEED) -> DataFrame:
    """L4: exactly min(n, N) rows without replacement, by a threshold on the seeded key: nothing is sorted or merged."""
    if n <= 0:
        return df.limit(0)
    (cut,) = hash_cuts(df, [n], key, seed)
    if cut is None:
        return df
    h, before, same = cut
    if before + same == n:
        return df.where(seeded_key(key, seed) <= h)
    # repeated keys straddle the threshold: any of them fill the sample
    return df.where(seeded_key(key, seed) < h).unionByName(df.where(seeded_key(key, seed) == h).limit(n - before))


def disjoint_samples(df: DataFrame, overlap: float, a: float, b: float, key: str = ROW_ID, seed: str = SEED, out: str = "sample_set") -> DataFrame:
    """Exact-size disjoint row sets 'both', 'A', 'B' (others null).

    Sizes as in the original: both = int(N*overlap), A only = int(N*a) - both,
    B only = int(N*b) - both; membership by seeded rank, told by thresholds on
    the seeded key. Only where a repeated key straddles a threshold are rows
    numbered.
    """
    n = df.count()
    n_both = int(n * overlap)
    ends = [n_both, int(n * a), int(n * a) + int(n * b) - n_both]  # of the three sets in order of the key
    names, h = ("both", "A", "B"), seeded_key(key, seed)
    cuts = hash_cuts(df, ends, key, seed)
    if all(c is None or c[1] + c[2] == e for c, e in zip(cuts, ends)):
        label = F.lit(None).cast("string")
        for name, c in reversed(list(zip(names, cuts))):
            if c:
                label = F.when(h <= c[0], F.lit(name)).otherwise(label)
        return df.withColumn(out, label)
    ranked = global_row_number(df.withColumn("_h", h), ["_h", key], out="_rank")
    label = F.lit(None).cast("string")
    for name, e in reversed(list(zip(names, ends))):
        label = F.when(F.col("_rank") < e, F.lit(name)).otherwise(label)
    return ranked.withColumn(out, label).drop("_h", "_rank")


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Union by column name; a column missing on one side is null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the first in ``order``.

    ``min_by`` over a struct aggregates partially before the shuffle, so a
    key holding a third of all rows costs one row per map task, not one task.
    """
    cols = [c for c in df.columns]
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*[F.col(o) for o in order])).alias("_r"))
    return packed.select("_r.*")


def id_difference(a: DataFrame, b: DataFrame, key: str = ROW_ID) -> DataFrame:
    """Ids of ``a`` not in ``b``."""
    return a.select(key).join(b.select(key), key, "left_anti")


def id_union(a: DataFrame, b: DataFrame, key: str = ROW_ID) -> DataFrame:
    """Distinct ids of both."""
    return a.select(key).union(b.select(key)).distinct()

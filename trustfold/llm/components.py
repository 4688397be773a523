"""Connected components of a link table, by alternating large-star and small-star contraction.

Every round is two grouped minima and two joins over the links that are left;
no node, link or component is gathered in one place. A star's centre can be a
neighbour of very many nodes: its minimum is a partial aggregate, and the join
that sends it out is a sort-merge join, whose skewed side adaptive execution
splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustfold.llm.common import stored


def _large_star(e: DataFrame) -> DataFrame:
    """Link each larger neighbour of u to the least of u and its neighbours."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the least of them. ``e`` has a < b."""
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    moved = e.join(least, "b")
    return moved.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m"), F.col("b")))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b): node pairs, in any order, repeats and loops allowed.

    Returns (node, root): the least node of each linked node's component, one
    row per node that has a link to another node. Rounds stop when a round
    changes no link; the number needed grows with the logarithm of the longest chain.
    """
    e = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = stored(e)
    sig = None
    for _ in range(max_rounds):
        e = stored(_small_star(_large_star(e).distinct()).where("a < b").distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == sig:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                e.select(F.col("a"), F.col("a")).distinct()
            )
        sig = tuple(now)
    raise RuntimeError("components did not settle")

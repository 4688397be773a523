"""Mix sources to target weights by nested hash thresholds.

A source with target T and S words is taken floor(T / S) times whole; the rest
is filled with its documents below a hash threshold. To find the threshold,
words are summed by (source, leading hash bits); the histogram's running sum
names the one bucket in which the budget ends, and only that bucket's documents
are summed again by their next bits, until the bucket holds a single hash
value. Documents are then filtered by comparing their hash with the threshold:
nothing is sorted, and a source with a third of all rows is many partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustfold.llm.common import broadcast_if_small, free_names, stored, word_count
from trustfold.plans.ordered import global_row_number

HASH_BITS = 60
STEP_BITS = 12


def unit_hash(id_col: Column) -> Column:
    """60 leading bits of the MD5 of the id as text; a null id hashes as the empty text."""
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def fill_targets(sources: DataFrame, limit: float = 3.0) -> DataFrame:
    """Add ``target`` to ``sources`` (size, weight): all sizes' sum is shared by weight, a target stops at ``limit``
    times its source's size, and the excess is shared by weight among the others until none is above.

    Each round is one aggregate over the sources that returns one row.
    """
    cap = F.col("size") * F.lit(limit)
    total, weight = sources.agg(F.sum("size"), F.sum("weight")).first()
    if not total:
        return sources.withColumn("target", F.lit(0.0))
    level, capped = total / weight, -1
    while True:
        full = F.col("weight") * F.lit(level) > cap
        n, used, free = sources.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == capped:
            return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)).cast("double"))
        capped, level = n, (total - used) / free


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """(no_source, source, size, weight, target), one row per source in code point order, null last; weights repeat."""
    sources = stored(sized.groupBy("no_source", "source").agg(F.sum("size").alias("size")))
    ranked = global_row_number(sources, ["no_source", "source"], out="rank")
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    return fill_targets(stored(ranked.select("no_source", "source", "size", cycle.alias("weight"))), limit)


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(no_source, source, below, at): take the documents with hash < below, and those at ``below`` if ``at`` is true.

    ``sized`` has no_source, source, hash, size; ``budgets`` has no_source, source, rest (words to take, below the
    source's size). The document group in which the budget ends is taken if that comes as near or nearer to the budget.
    """
    keys = ["no_source", "source"]
    # prefix: leading bits of the boundary bucket; before: words of the source in lower buckets
    bound = budgets.select(*keys, "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    running = Window.partitionBy(*keys).orderBy("bucket")  # at most 2^STEP_BITS buckets a source
    for done in range(0, HASH_BITS, STEP_BITS):
        left = HASH_BITS - done
        inside = sized.withColumn("prefix", F.shiftright("hash", left)).join(bound, [*keys, "prefix"])
        hist = inside.groupBy(*keys, "rest", "before", F.shiftright("hash", left - STEP_BITS).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("least"), F.max("hash").alias("most")
        )
        upto = hist.withColumn("upto", F.col("before") + F.sum("words").over(running)).where("upto > rest")
        first = F.min_by(F.struct("bucket", "words", "upto", "least", "most"), F.col("bucket"))
        bound = stored(upto.groupBy(*keys, "rest").agg(first.alias("b")).select(
            *keys, "rest", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.words")).alias("before"),
            F.col("b.upto").alias("upto"), F.col("b.least").alias("least"), F.col("b.most").alias("most")))
        if not bound.where("least < most").limit(1).count():
            break
    return bound.select(*keys, F.col("least").alias("below"), (F.col("upto") - F.col("rest") <= F.col("rest") - F.col("before")).alias("at"))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        word_count(F.col(text_col)).alias("size"), unit_hash(F.col(id_col)).alias("hash"))


def source_plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """(no_source, source, source_size, target, whole, below, at): how often each source is taken whole, and the hash
    threshold that fills the rest of its target."""
    targets = stored(source_targets(sized, weights, limit).withColumn(
        "whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")))
    budgets = targets.select("no_source", "source", (F.col("target") - F.col("whole") * F.col("size")).alias("rest")).where("rest > 0")
    return stored(targets.join(thresholds(sized, budgets), ["no_source", "source"], "left").select(
        "no_source", "source", F.col("size").alias("source_size"), "target", "whole", "below", "at"))


def copies() -> Column:
    """How often the mix repeats a row (hash) of a source (whole, below, at)."""
    extra = (F.col("hash") < F.col("below")) | ((F.col("hash") == F.col("below")) & F.col("at"))
    return F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken), one row per row of ``docs``.

    size: words of the text (0 for null); copies: how often the mix repeats the
    document, at most ceil(limit); taken: size times copies. A null source is a
    source of its own, last in order. Rows with the same id share a hash, and
    within a source are taken alike. Documents without words get the copies of
    their hash and take nothing. An empty table gives an empty result. Other
    columns are not read. Reruns and other partitionings give the same rows.
    """
    sized = stored(_rows(docs, id_col, text_col, source_col))
    out = sized.join(broadcast_if_small(source_plan(sized, weights, limit)), ["no_source", "source"]).withColumn("copies", copies())
    return out.select(
        F.col("id").alias(id_col), F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size",
        "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """The rows of ``docs`` that the mix takes at least once, unchanged, with size, source_size, target, copies, taken;
    see ``mix``. Extra columns pass through; they may not be called as the added ones."""
    added = ("size", "source_size", "target", "copies", "taken")
    free_names(docs, *added, "_no_source", "_source", "hash", "whole", "below", "at")
    plan = source_plan(stored(_rows(docs, id_col, text_col, source_col)), weights, limit)
    plan = plan.withColumnsRenamed({"no_source": "_no_source", "source": "_source"})
    rows = docs.withColumns({
        "_no_source": F.col(source_col).isNull(), "_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        "size": word_count(F.col(text_col)), "hash": unit_hash(F.col(id_col))})
    out = rows.join(broadcast_if_small(plan), ["_no_source", "_source"]).withColumn("copies", copies()).where("copies > 0")
    return out.withColumn("taken", F.col("size") * F.col("copies")).select(*[F.col(f"`{c}`") for c in docs.columns], *added)

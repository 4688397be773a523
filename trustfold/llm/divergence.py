"""How the sources of a language differ in their words.

1. Tasks count terms of their documents in memory, and hand out what they hold
   whenever it becomes much, so a source with a third of all rows is many
   partial sums. A document belongs to one source, so its share in a term's
   document count is a sum as well.
2. Each language keeps its frequent terms and numbers them in order.
3. A source's counts become sorted (term id, count) arrays, cut at every
   ``BLOCK`` term ids, so that no array grows with the vocabulary.
4. Unordered pairs of sources are tasks: the two sources' arrays of a block are
   co-grouped, a galloping intersection of the shorter with the longer finds
   shared terms, and shared, one-sided and absent terms are priced, each source
   against the other. ``TILE`` times ``TILE`` pairs share a group, so that an
   array is sent once to all of them. The blocks' prices are summed.

All arithmetic is in integers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustfold.llm.common import broadcast_if_small, stored
from trustfold.plans.ordered import keyed_row_number

MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
BLOCK = 8192
TILE = 8
HELD = 300_000  # distinct (source, term) counts that a task holds before it hands them out
PIECE = 1 << 22  # bytes of a text whose words are in memory at once

#: Of bytes: letters A-Z become small, a-z and all that is not ASCII stay, everything else is a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes, size: int):
    """Parts of ``text`` of ``size`` bytes or a little more, cut at spaces."""
    at = 0
    while len(text) - at > size and (cut := text.find(b" ", at + size)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:]


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of the term and documents with it, for each language and source."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))],
                       F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out():
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                     pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in batches:
            for lang, source, text in zip(*[b.column(i).to_pylist() for i in range(3)]):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for piece in _pieces((text or b"").translate(_LETTERS), PIECE):
                    words = piece.split()
                    n.update(words)
                    seen.update(words)
                d.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from out()
        yield from out()

    partial = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _price_column(count: str, total: str) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 terms)), with ``terms`` kept terms; exact, as the product is a decimal."""
    return F.expr(f"1 + (cast({UNIT} as decimal(11, 0)) * cast({count} + 2 as decimal(20, 0))) div ({total} + 2 * terms)")


def _gap_column(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def prices(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """As ``_price_column``, for an array; products beyond 63 bits are made of Python's integers."""
    if len(counts) and UNIT * (int(counts.max()) + 2) >= 1 << 63:
        return np.array([1 + UNIT * (int(c) + 2) // (total + 2 * terms) for c in counts], dtype=np.int64)
    return 1 + UNIT * (counts + 2) // (total + 2 * terms)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); prices are at most UNIT + 1, so the square has under 63 bits."""
    return (p - q) * (p - q) // (p + q)


def intersection(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``a`` and ``b`` of the values that both have.

    Each value of the shorter array is looked up in the longer one, starting at
    the place of the one before (``searchsorted`` keeps its bounds for ascending
    keys), so a short array gallops over a long one.
    """
    if len(a) > len(b):
        at_b, at_a = intersection(b, a)
        return at_a, at_b
    at = np.searchsorted(b, a)
    there = at < len(b)
    there[there] = b[at[there]] == a[there]
    return np.flatnonzero(there), at[there]


def pair_price(a: tuple, b: tuple, terms_here: int) -> int:
    """Sum of ``gap`` over the ``terms_here`` terms of a block; a and b: (ids, prices, price of a count of 0)."""
    (ids_a, p, p0), (ids_b, q, q0) = a, b
    at_a, at_b = intersection(ids_a, ids_b)
    only_a, only_b = np.delete(p, at_a), np.delete(q, at_b)
    absent = terms_here - len(ids_a) - len(ids_b) + len(at_a)
    both = int(gap(p[at_a], q[at_b]).sum()) + int(gap(only_a, q0).sum()) + int(gap(p0, only_b).sum())
    return both + absent * int(gap(p0, q0))


def _tile(group: pa.Table, size: int) -> pa.Table:
    """One block of the arrays of two tiles of sources: (lang, a, b, value) of each unordered pair across them."""
    rows = sorted(group.to_pylist(), key=lambda r: r["slot"])
    lang, lo, hi, terms = (rows[0][c] for c in ("lang", "lo", "hi", "terms"))
    here = min(size, terms - rows[0]["block"] * size)
    out = []
    if terms:
        sides = []
        for r in rows:
            counts = np.array([0, *(r["counts"] or ())], dtype=np.int64)
            p = prices(counts, r["total"], terms)
            sides.append((r["slot"] // TILE, r["source"], (np.array(r["ids"] or (), dtype=np.int64), p[1:], p[0])))
        for i, (tile_a, a, left) in enumerate(sides):
            out += [(a, b, pair_price(left, right, here)) for tile_b, b, right in sides[i + 1 :] if (tile_a, tile_b) == (lo, hi)]
    else:
        names = [(r["slot"] // TILE, r["source"]) for r in rows]
        out = [(a, b, 0) for i, (tile_a, a) in enumerate(names) for tile_b, b in names[i + 1 :] if (tile_a, tile_b) == (lo, hi)]
    a, b, value = zip(*out) if out else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()),
                     "value": pa.array(value, pa.int64())})


def _pairs(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value): for every ordered pair of a language's sources the sum over all its kept terms."""
    own = F.sort_array(F.collect_list(F.struct("id", "n")))
    arrays = terms.groupBy("lang", "source", F.floor(F.col("id") / BLOCK).alias("block")).agg(own.alias("own"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("terms") - 1) / BLOCK))))
    places = groups.select("*", blocks.alias("block"))
    rows = places.join(arrays, ["lang", "source", "block"], "left").select(
        "lang", "source", "block", "slot", "total", "terms", "sources", F.col("own.id").alias("ids"), F.col("own.n").alias("counts"))
    tile = F.floor(F.col("slot") / TILE)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / TILE)))
    sent = rows.withColumn("_other", other).withColumns({"lo": F.least(tile, "_other"), "hi": F.greatest(tile, "_other")}).drop("_other", "sources")

    def run(group):
        return _tile(group, BLOCK)

    each = sent.groupBy("lang", "block", "lo", "hi").applyInArrow(run, "lang string, a string, b string, value long")
    summed = each.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return summed.select("lang", F.explode(ways).alias("_w"), "value").select("lang", "_w.*", "value")


def _ranked(rows: DataFrame, part: str, top: int | None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if top:  # each task keeps its first ``top`` rows before the shuffle
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS,
               top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: every other source of the language and its distance, the sum
    over all kept terms. Part ``term``: the ``top`` terms that the source has
    more of than its language, by distance. A language keeps the terms that at
    least ``min_docs`` of its documents have. Ties are in order of the item's
    UTF-8 bytes.

    Null languages, sources and texts are empty ones. A source without kept
    terms has pairs and no terms, and all values of a language without kept
    terms are 0; a language of one source has no pairs. Repeated rows count as
    often as they come. Texts may have any length. An empty table gives an empty
    result. Other columns are not read.
    """
    counts = stored(term_counts(docs, lang_col, source_col, text_col))
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = stored(keyed_row_number(by_term.select("lang", "term", "all"), "lang", ["term"], out="id").withColumn("id", F.col("id") - 1))
    terms = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "id", "n", "all"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    names = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = keyed_row_number(names, "lang", ["source"], out="_rn")
    groups = numbered.join(numbered.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")), "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = stored(groups.select("lang", "source", (F.col("_rn") - 1).alias("slot"), "sources", zero("terms"), zero("lang_total"), zero("total")))
    priced = terms.join(broadcast_if_small(groups.select("lang", "source", "total", "terms", "lang_total")), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _price_column("n", "total").alias("p"), _price_column("`all`", "lang_total").alias("q"))
    more = priced.where("p > q").select("lang", "source", "item", _gap_column("p", "q").alias("value"))
    return _ranked(_pairs(groups, terms), "pair", None).unionByName(_ranked(more, "term", top))

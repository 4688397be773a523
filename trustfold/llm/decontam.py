"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

One pass over the documents looks every word n-gram up in a bitmap of the test
items' n-grams (a fixed number of bits, whatever the benchmark's size) and
writes, for each stretch of text with several hits, its words and hits, beside
per-task counts of the hits. From the counts each item's rarer half of n-grams
become its seeds. Hits join seeds on the n-gram hash; a document stretch and an
item that share enough seeds on about the same diagonal are aligned word by
word, and the best local score over the item's length decides.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustfold.llm.common import broadcast_if_small, free_names, row_key, stored

GRAM = 3
MIN_ITEM_WORDS = 8
MIN_SEEDS = 2
SCORE = 0.4
MISMATCH, GAP = 0.5, 0.5
BITMAP_BITS = 24  # 2 MB


# --- words and n-grams ----------------------------------------------------------


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): lower-cased runs of letters and digits of each text, one after another."""
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " "), " ")
    lists = pc.split_pattern(plain, " ")  # a text without words gives one empty word
    return np.asarray(lists.offsets), lists.flatten()


def gram_hashes(words: pa.Array, size: int) -> np.ndarray:
    """Hash of the n-gram that starts at each word but the last size - 1."""
    coded = words.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w.as_py()) for w in coded.dictionary], dtype=np.uint64)
    h = own[np.asarray(coded.indices)] if len(words) else np.zeros(0, dtype=np.uint64)
    out = h[: max(0, len(h) - size + 1)].copy()
    for k in range(1, size):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def item_grams(items: DataFrame, size: int) -> DataFrame:
    """(item, words, gram, pos): every n-gram of every item of MIN_ITEM_WORDS words or more."""

    def run(batches):
        for b in batches:
            at, words = words_of(b.column("text"))
            grams, names = gram_hashes(words, size), words.to_pylist()
            for i, item in enumerate(b.column("item").to_pylist()):
                lo, hi = int(at[i]), int(at[i + 1])
                if hi - lo >= max(MIN_ITEM_WORDS, size):
                    n = hi - lo - size + 1
                    yield pa.RecordBatch.from_pydict({
                        "item": pa.array([item] * n, pa.int64()), "words": pa.array([names[lo:hi]] * n, pa.list_(pa.string())),
                        "gram": pa.array(grams[lo : lo + n].view(np.int64)), "pos": pa.array(np.arange(n, dtype=np.int32))})

    return items.select("item", "text").mapInArrow(run, "item long, words array<string>, gram long, pos int")


def bitmap(grams: DataFrame) -> np.ndarray:
    """Bit g of 2^BITMAP_BITS is set if a gram's leading bits are g. Built by a bitmap aggregate of 32768 bits a row."""
    bit = F.shiftrightunsigned("gram", 64 - BITMAP_BITS) + 1  # Spark numbers bitmap positions from 1
    parts = grams.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("n")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()  # at most 2^BITMAP_BITS / 32768 rows
    out = np.zeros(1 << BITMAP_BITS, dtype=bool)
    for r in parts:
        bits = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), bitorder="little").view(bool)
        out[(r["n"] - 1) * 32768 :][: len(bits)] |= bits
    return out


# --- one pass over the documents --------------------------------------------------


def stretches(rows: DataFrame, bits: np.ndarray, size: int, reach: int) -> DataFrame:
    """``rows`` (row, text) to (row, words, start, at, gram, n): stretches of a text in which MIN_SEEDS or more hits lie
    at most ``reach`` words apart, with ``reach`` words on either side; at and gram list the hits. Rows whose ``row`` is
    null carry a task's hit counts: gram, n."""
    looked = rows.sparkSession.sparkContext.broadcast(np.packbits(bits))  # 2^BITMAP_BITS bits

    def run(batches):
        flat = np.unpackbits(looked.value).view(bool)
        seen: Counter = Counter()
        for b in batches:
            at, words = words_of(b.column("text"))
            grams = gram_hashes(words, size)
            hits = np.flatnonzero(flat[(grams >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
            doc = np.searchsorted(at, hits, side="right") - 1
            inside = hits + size <= at[doc + 1]  # an n-gram that ends in the next text is none
            hits, doc = hits[inside], doc[inside]
            keys = b.column("row").to_pylist()
            new = (np.diff(hits, prepend=-reach - 1) > reach) | (np.diff(doc, prepend=-1) != 0)
            first = np.flatnonzero(new)
            out: dict[str, list] = {k: [] for k in ("row", "words", "start", "at", "gram", "n")}
            for s, e in zip(first, np.append(first[1:], len(hits))):
                d = int(doc[s])
                if e - s >= MIN_SEEDS:
                    lo, hi = max(int(at[d]), int(hits[s]) - reach), min(int(at[d + 1]), int(hits[e - 1]) + size + reach)
                    out["row"].append(keys[d])
                    out["words"].append(words.slice(lo, hi - lo).to_pylist())
                    out["start"].append(lo - int(at[d]))
                    out["at"].append((hits[s:e] - lo).tolist())
                    out["gram"].append(grams[hits[s:e]].view(np.int64).tolist())
                    out["n"].append(None)
            pairs = np.unique(np.stack([doc, grams[hits].view(np.int64)]), axis=1) if len(hits) else np.zeros((2, 0), dtype=np.int64)
            seen.update(pairs[1].tolist())
            if out["row"]:
                yield _batch(out)
        if seen:
            k = len(seen)
            yield _batch({"row": [None] * k, "words": [None] * k, "start": [None] * k, "at": [None] * k,
                          "gram": [[g] for g in seen], "n": list(seen.values())})

    return rows.select("row", "text").mapInArrow(run, "row long, words array<string>, start int, at array<int>, gram array<long>, n long")


def _batch(cols: dict) -> pa.RecordBatch:
    kinds = {"row": pa.int64(), "words": pa.list_(pa.string()), "start": pa.int32(), "at": pa.list_(pa.int32()),
             "gram": pa.list_(pa.int64()), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(cols[k], t) for k, t in kinds.items()], names=list(kinds))


# --- alignment --------------------------------------------------------------------


def align(text: list[str], item: list[str]) -> float:
    """Best Smith-Waterman score of ``item`` against ``text``, words as letters, over the item's length: a match counts
    1, a mismatch and a gap take MISMATCH and GAP off."""
    names = {w: i for i, w in enumerate(dict.fromkeys(item))}
    codes = np.array([names.get(w, -1) for w in text])
    slope = GAP * np.arange(len(codes) + 1)
    above, best = np.zeros(len(codes) + 1), 0.0
    for w in item:
        here = np.zeros(len(codes) + 1)
        np.maximum(above[:-1] + np.where(codes == names[w], 1.0, -MISMATCH), 0, out=here[1:])
        np.maximum(here, above - GAP, out=here)
        here = np.maximum.accumulate(here + slope) - slope  # gaps along the text
        best, above = max(best, float(here.max())), here
    return best / len(item)


@F.pandas_udf(T.DoubleType())
def _score(text: pd.Series, item: pd.Series) -> pd.Series:
    return pd.Series([align(list(t), list(i)) for t, i in zip(text, item)], dtype=float)


# --- operator ---------------------------------------------------------------------


def _leaks(rows: DataFrame, items: DataFrame, size: int, score: float) -> DataFrame:
    """(row, item, score): document rows (row, text) that hold a passage of an item (item, text)."""
    grams = stored(item_grams(items, size))
    reach = grams.agg(F.max(F.size("words"))).first()[0]
    if reach is None:  # no item is long enough
        return rows.sparkSession.createDataFrame([], "row long, item long, score double")
    found = stored(stretches(rows, bitmap(grams), size, int(reach)))
    seen = found.where("row IS NULL").groupBy(F.col("gram")[0].alias("gram")).agg(F.sum("n").alias("df"))
    counted = grams.select("item", "gram", "pos", F.size("words").alias("len")).join(seen, "gram", "left").fillna(0, ["df"])
    middle = counted.groupBy("item").agg(F.percentile_approx("df", 0.5, 100_000).alias("mid"))
    seeds = stored(counted.join(middle, "item").where("df <= mid").select("gram", "item", "pos", "len"))
    spots = stored(found.where("row IS NOT NULL").withColumn("spot", F.xxhash64("row", "start", "words")))
    hits = spots.select("spot", F.explode(F.arrays_zip("at", "gram")).alias("h")).select("spot", "h.at", "h.gram")
    # the place in the stretch at which the item would begin, in two rows of cells that overlap by half an item
    begin = F.col("at") - F.col("pos")
    cell = F.explode(F.array(F.floor(begin / F.col("len")) * 2, F.floor((begin + F.col("len") / 2) / F.col("len")) * 2 + 1))
    votes = hits.join(seeds, "gram").select("spot", "item", "len", "pos", begin.alias("begin"), cell.alias("cell"))
    near = votes.groupBy("spot", "item", "len", "cell").agg(
        F.count_distinct("pos").alias("n"), F.min("begin").alias("lo"), F.max("begin").alias("hi")).where(F.col("n") >= MIN_SEEDS)
    half = (F.col("len") / 2).cast("int") + 1
    spans = near.select("spot", "item", F.greatest(F.col("lo") - half, F.lit(0)).alias("lo"), (F.col("hi") + F.col("len") + half).alias("hi")).distinct()
    passages = spans.join(spots.select("spot", "row", "words").distinct(), "spot").select(
        "row", "item", F.slice("words", F.col("lo") + 1, F.greatest(F.col("hi") - F.col("lo"), F.lit(0))).alias("text"))
    texts = grams.where("pos = 0").select("item", "words")
    scored = passages.join(texts, "item").repartition("row", "item").withColumn("score", _score("text", "words"))
    return scored.groupBy("row", "item").agg(F.max("score").alias("score")).where(F.col("score") >= score)


def _numbered(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, text): item is a key of the row, so that ids of any type, null and repeated ids work."""
    return benchmark.select(row_key(benchmark, item_col, text_col).alias("item"), F.col(item_col).alias("id"), F.col(text_col).alias("text")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
          size: int = GRAM, score: float = SCORE) -> DataFrame:
    """(id_col, item_col, score): one row for each document row and test item whose best alignment reaches ``score``.

    Words are lower-cased runs of letters and digits, so case, marks and line ends don't matter. Items under
    MIN_ITEM_WORDS words identify nothing and are skipped. Null and empty texts hold nothing. Rows equal in id and text
    count as one and give one row per item. An empty table on either side gives an empty result. Other columns are not read.
    """
    rows = docs.select(row_key(docs, id_col, text_col).alias("row"), F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    items = stored(_numbered(benchmark, item_col, text_col))
    got = stored(_leaks(rows, items.select("item", "text"), size, score))
    ids = rows.select("row", id_col).join(broadcast_if_small(got.select("row").distinct()), "row", "left_semi").distinct()
    return got.join(ids, "row").join(items.select("item", F.col("id").alias(item_col)), "item").select(id_col, item_col, "score")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
               size: int = GRAM, score: float = SCORE) -> DataFrame:
    """The rows of ``docs`` without those that hold a passage of a test item; see ``leaks``."""
    free_names(docs, "_row")
    rows = docs.select(row_key(docs, id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    items = stored(_numbered(benchmark, item_col, text_col))
    bad = stored(_leaks(rows, items.select("item", "text"), size, score).select(F.col("row").alias("_row")).distinct())
    return docs.withColumn("_row", row_key(docs, id_col, text_col)).join(broadcast_if_small(bad), "_row", "left_anti").drop("_row")

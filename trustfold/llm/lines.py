"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines equal after trimming are one line. Two lines are linked if their edit
distance is at most k. A line of length l is cut into k + 1 segments; a line
within k edits holds one of them unchanged, at a place that the length
difference bounds. So each distinct line puts its segments into an index, keyed
by (length, segment number, hash of the segment), and probes the index of each
length from l - k to l with the few substrings that can match (the
multi-match-aware windows). Keys that only one line has are dropped where they
meet. Of the lines that are left, pairs that share a key must also agree, within
2k, on a bag of letter counts; those that do are verified by a banded
bit-parallel edit distance. Links are contracted to classes, and of each class
the first line of the corpus stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustfold.llm.common import broadcast_if_small, free_names, let, row_key, stored
from trustfold.llm.components import components

EDITS = 2
#: Shorter lines are left alone unless the caller says otherwise; near copies are sought among lines of at least
#: NEAR_CHARS, from which on k + 1 segments find them all.
MIN_CHARS, NEAR_CHARS = 12, 2 * EDITS * (EDITS + 1) + 1
SPACE = " \t\r\x0b\x0c"
#: Letters whose counts, modulo 128, make the bag.
BAG = (" ", "e", "n", "t", "a", "r", "i", "o")
BAG_BITS = 7


# --- edit distance -----------------------------------------------------------


def _shared(a: Column, b: Column, limit: Column, part) -> Column:
    """Largest n <= limit with part(a, n) = part(b, n), by binary steps from the largest power of two within the limit."""
    powers = F.sequence(F.floor(F.log2(F.greatest(limit, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))
    steps = F.transform(powers, lambda i: F.call_function("shiftleft", F.lit(1), i))
    return F.aggregate(
        steps, F.lit(0),
        lambda n, s: F.when((n + s <= limit) & (part(a, n + s) == part(b, n + s)), n + s).otherwise(n))


def _band(a: Column, b: Column, k: int) -> Column:
    """Edit distance of ``a`` and ``b``, length(b) - length(a) in 0..k; exact up to k, above k otherwise.

    Bit i of a word stands for row j - k + i of column j: 2k + 1 rows around the diagonal. vp and vn hold the rows that
    are one above or below the row before them; a step takes the column's matches and moves the band one row down.
    """
    width = 2 * k + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    chars = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substr(s, i, F.lit(1)))
    diff = F.length(b) - F.length(a)

    def column(left: Column, right: Column, state: Column, j: Column) -> Column:
        def match(i: int) -> Column:
            row = j + (i - k)
            same = (row >= 1) & (row <= F.length(a)) & (F.get(left, row - 1) == F.get(right, j - 1))
            return F.when(same, F.lit(1 << i)).otherwise(F.lit(0))

        eq = match(0)
        for i in range(1, width):
            eq = eq.bitwiseOR(match(i))
        vp = F.shiftright(state["vp"], 1).bitwiseOR(F.lit(top))
        vn = F.shiftright(state["vn"], 1)

        def moved(x: Column) -> Column:
            eq, vp, vn = x["eq"], x["vp"], x["vn"]
            d0 = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(full))
            return let(d0, lambda d: let(F.struct(
                F.shiftleft(vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp))), 1).bitwiseOR(F.lit(1)).bitwiseAND(F.lit(full)).alias("hp"),
                F.shiftleft(d.bitwiseAND(vp), 1).bitwiseAND(F.lit(full)).alias("hn")), lambda h: F.struct(
                    h["hn"].bitwiseOR(F.bitwise_not(d.bitwiseOR(h["hp"]))).bitwiseAND(F.lit(full)).alias("vp"),
                    d.bitwiseAND(h["hp"]).alias("vn"),
                    (state["score"] + F.when((j > diff) & (F.getbit(d, F.lit(k) - diff) == 0), F.lit(1)).otherwise(F.lit(0))).alias("score"))))

        return let(F.struct(eq.alias("eq"), vp.alias("vp"), vn.alias("vn")), moved)

    start = F.struct(F.lit(full ^ ((1 << (k + 1)) - 1)).alias("vp"), F.lit((1 << (k + 1)) - 1).alias("vn"), diff.alias("score"))
    scan = let(F.struct(chars(a).alias("l"), chars(b).alias("r")), lambda c: F.aggregate(
        F.sequence(F.lit(1), F.length(b)), start, lambda s, j: column(c["l"], c["r"], s, j), lambda s: s["score"]))
    return F.when(F.length(a) == 0, F.length(b)).otherwise(scan)


def edit_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance of two texts if it is at most ``k``, else a number above ``k``. What both begin or end with is
    cut off first; the rest goes through the bit-parallel band."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    head = lambda s, n: F.substr(s, F.lit(1), n)
    tail = lambda s, n: F.right(s, n)

    def trimmed(p: Column) -> Column:
        n = _shared(p["a"], p["b"], F.length(p["a"]), head)
        cut = lambda s, c: F.substr(s, c + 1, F.length(s) - c)
        return let(n, lambda c: let(F.struct(cut(p["a"], c).alias("a"), cut(p["b"], c).alias("b")), ended))

    def ended(p: Column) -> Column:
        n = _shared(p["a"], p["b"], F.length(p["a"]), tail)
        cut = lambda s, c: F.substr(s, F.lit(1), F.length(s) - c)
        return let(n, lambda c: let(F.struct(cut(p["a"], c).alias("a"), cut(p["b"], c).alias("b")), lambda m: _band(m["a"], m["b"], k)))

    far = F.abs(F.length(a) - F.length(b)) > k
    return F.when(far, F.lit(k + 1)).otherwise(let(F.struct(short.alias("a"), long.alias("b")), trimmed))


# --- candidates ----------------------------------------------------------------


def placements(k: int) -> list[tuple[int, int, int]]:
    """(less, i, off): a line of length n looks for segment i of lines of length n - less, ``off`` places from where
    that segment begins. The first k + 1 are its own segments, which it also puts into the index."""
    own = [(0, i, 0) for i in range(k + 1)]
    others = [(less, i, off) for less in range(k + 1) for i in range(k + 1)
              for off in range(max(-i, less - (k - i)), min(i, less + k - i) + 1) if less or off]
    return own + others


def line_keys(distinct: DataFrame, k: int) -> DataFrame:
    """(lid, key, own): index keys (own) and probe keys of every line (lid, line) of more than 2k(k + 1) characters."""
    at = F.array(*[F.struct(F.lit(x).alias("less"), F.lit(i).alias("i"), F.lit(o).alias("off")) for x, i, o in placements(k)])
    # where every character is one byte, a segment is cut out of the bytes without counting characters from the line's start
    plain = F.octet_length("line") == F.length("line")
    rows = distinct.select("lid", "line", F.length("line").alias("chars"), F.when(plain, F.col("line").cast("binary")).alias("bytes"))
    rows = rows.select("lid", "line", "bytes", "chars", F.explode(at).alias("p")).select(
        "lid", "line", "bytes", (F.col("chars") - F.col("p.less")).alias("n"), F.col("p.i").alias("i"), F.col("p.off").alias("off"),
        ((F.col("p.less") == 0) & (F.col("p.off") == 0)).alias("own"))
    begin, end = F.expr(f"CAST(n * i DIV {k + 1} AS INT)"), F.expr(f"CAST(n * (i + 1) DIV {k + 1} AS INT)")
    cut = lambda x: F.substr(x, begin + 1 + F.col("off"), end - begin)
    segment = F.coalesce(cut(F.col("bytes")), cut(F.col("line")).cast("binary"))
    return rows.select("lid", F.xxhash64("n", "i", segment).alias("key"), "own")


def _bag(line: Column) -> Column:
    out = F.lit(0).cast("long")
    for i, c in enumerate(BAG):
        n = F.pmod(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))), F.lit(1 << BAG_BITS)).cast("long")
        out = out.bitwiseOR(F.shiftleft(n, i * BAG_BITS))
    return out


def _bag_distance(x: Column, y: Column) -> Column:
    """At most twice the edit distance of the lines."""
    total = F.lit(0)
    for i in range(len(BAG)):
        part = lambda z: F.shiftright(z, i * BAG_BITS).bitwiseAND(F.lit((1 << BAG_BITS) - 1))  # noqa: B023, E731
        d = F.abs(part(x) - part(y))
        total = total + F.least(d, F.lit(1 << BAG_BITS) - d)
    return total


def shared_keys(distinct: DataFrame, k: int = EDITS) -> DataFrame:
    """(lid, key, own): the rows of ``line_keys`` whose key is in the index and belongs to more than one row.

    Keys are counted by partial sums; a key that very many lines share is never gathered in one task unless the join is
    shuffled, and adaptive execution may split it there."""
    keys = line_keys(distinct, k)
    kept = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("index")).where("n > 1 AND index").select("key")
    return keys.join(broadcast_if_small(stored(kept)), "key").select("lid", "key", "own")


def edit_links(shared: DataFrame, texts: DataFrame, k: int = EDITS) -> DataFrame:
    """(a, b), a < b, each once: lines that share an index key and lie within ``k`` edits. ``texts``: (lid, line).

    Bags and distances are part of the join's condition, so a crowd of lines that share a key but are no near copies
    yields no rows, and adaptive execution may split the crowd.
    """
    rows = shared.join(texts.select("lid", "line", _bag(F.col("line")).alias("bag")), "lid")
    index = rows.where("own").select(F.col("lid").alias("a"), F.col("line").alias("line_a"), F.col("bag").alias("bag_a"), "key")
    probe = rows.select(F.col("lid").alias("b"), F.col("line").alias("line_b"), F.col("bag").alias("bag_b"), "own", F.col("key").alias("key_b"))
    meet = (F.col("key") == F.col("key_b")) & (F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b")))
    close = F.when(_bag_distance(F.col("bag_a"), F.col("bag_b")) <= 2 * k, edit_distance(F.col("line_a"), F.col("line_b"), k) <= k)
    met = index.join(probe, meet & close)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# --- classes -----------------------------------------------------------------


def _trimmed(line: Column) -> Column:
    """``line`` without white space at its ends. btrim walks the whole line, so lines that need none don't meet it."""
    ends = F.lit(False)
    for c in SPACE:
        ends = ends | F.startswith(line, F.lit(c)) | F.endswith(line, F.lit(c))
    return F.when(ends, F.btrim(line, F.lit(SPACE))).otherwise(line)


def _split_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(row, id, no, line, lid) for every line of ``min_chars`` or more; those under MIN_CHARS need a letter or digit."""
    rows = docs.select(row_key(docs, id_col, text_col).alias("row"), F.col(id_col).alias("id"),
                       F.posexplode(F.split(F.col(text_col), "\n")).alias("no", "line"))
    rows = rows.withColumn("line", _trimmed(F.col("line"))).where((F.length("line") >= min_chars) & ((F.length("line") >= MIN_CHARS) | F.col("line").rlike(r"[\p{L}\p{N}]")))
    return rows.withColumn("lid", F.xxhash64("line"))


def near_links(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(a, b): line ids within ``k`` edits. ``firsts``: (lid, first, n), the first occurrence of each line and how many
    there are; only first occurrences are cut into segments."""
    least = max(NEAR_CHARS, 2 * k * (k + 1) + 1)
    texts = _split_lines(docs, id_col, text_col, least)
    repeated = broadcast_if_small(stored(firsts.where("n > 1").select("lid", F.col("first.row").alias("at_row"), F.col("first.no").alias("at_no"))))
    is_first = F.col("at_row").isNull() | ((F.col("at_row") == F.col("row")) & (F.col("at_no") == F.col("no")))
    shared = stored(shared_keys(texts.join(repeated, "lid", "left").where(is_first).select("lid", "line"), k))
    # the texts of the lines that are left, read from the documents in which they first occur
    wanted = firsts.join(broadcast_if_small(stored(shared.select("lid").distinct())), "lid", "left_semi")
    places = wanted.groupBy(F.col("first.row").alias("row")).agg(F.collect_list(F.struct("lid", F.col("first.no").alias("no"))).alias("places"))
    found = docs.select(row_key(docs, id_col, text_col).alias("row"), F.col(text_col).alias("text")).join(broadcast_if_small(stored(places)), "row")
    named = found.select(F.explode("places").alias("p"), F.split("text", "\n").alias("lines")).select(
        F.col("p.lid").alias("lid"), F.btrim(F.get("lines", F.col("p.no")), F.lit(SPACE)).alias("line"))
    named = stored(named.groupBy("lid").agg(F.min("line").alias("line")))
    return stored(edit_links(shared, named, k))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = EDITS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(lines, classes): lines is (row, id, no, lid) of every line considered; classes is (lid, class, first), one row
    per line that has a copy or a near copy, where first is the class's first occurrence (no_id, id, row, no)."""
    lines = stored(_split_lines(docs, id_col, text_col, min_chars).select("row", "id", "no", "lid"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "no")
    firsts = stored(lines.groupBy("lid").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(near_links(docs, firsts, id_col, text_col, k)).withColumnRenamed("node", "lid")
    member = firsts.join(roots, "lid", "left").where("n > 1 OR root IS NOT NULL").withColumn("class", F.coalesce("root", "lid"))
    member = stored(member.select("lid", "class", "first"))
    least = member.groupBy("class").agg(F.min("first").alias("stays"))
    return lines, stored(member.join(least, "class").select("lid", "class", F.col("stays").alias("first"), F.col("first").alias("own")))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, n_exact, n_near, dropped): per document row key, its lines that repeat an earlier line exactly, those that
    only come within ``k`` edits of an earlier line, and the numbers of all of them, from 0."""
    lines, classes = line_classes(docs, id_col, text_col, k, min_chars)
    seen = lines.distinct().join(broadcast_if_small(classes), "lid")
    same = lambda at: (F.col(f"{at}.row") == F.col("row")) & (F.col(f"{at}.no") == F.col("no"))
    gone = seen.where(~same("first")).select("row", "no", same("own").alias("near"))
    return gone.groupBy("row").agg(
        F.count_if(~F.col("near")).alias("n_exact"), F.count_if("near").alias("n_near"), F.sort_array(F.collect_list("no")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with each text's repeated lines removed, and n_lines, n_exact, n_near (long) and dropped (line numbers).

    Of every class of equal or nearly equal lines the first stays: least id
    (null last), then row, then line. Lines under ``min_chars`` characters always
    stay, and so do those under MIN_CHARS without a letter or digit; near copies
    count from NEAR_CHARS characters on. A null text stays
    null and has no lines; an empty text stays empty. Rows that are equal in id
    and text are one document: their lines are not copies of each other. Extra
    columns pass through; they may not be called as the added ones.
    """
    free_names(docs, "row", "n_lines", "n_exact", "n_near", "dropped")
    gone = dropped_lines(docs, id_col, text_col, k, min_chars)  # grows with the corpus, so it is joined by a shuffle at every size
    text, zero = F.col(text_col), F.lit(0).cast("long")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("dropped"), i)), "\n")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    out = docs.withColumn("row", row_key(docs, id_col, text_col)).join(gone, "row", "left")
    return out.withColumns({
        text_col: F.when(F.col("dropped").isNull(), text).otherwise(left), "n_lines": F.coalesce((breaks + 1).cast("long"), zero),
        "n_exact": F.coalesce("n_exact", zero), "n_near": F.coalesce("n_near", zero),
        "dropped": F.coalesce("dropped", F.array().cast("array<int>"))}).drop("row")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                        k: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the columns they have: texts without repeated lines, ``length_col`` (if there) set to the new
    number of characters. A document that had words and keeps none goes; see ``dedup_lines``."""
    word = F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    out = dedup_lines(docs, id_col, text_col, k, min_chars).where((F.size("dropped") == 0) | word)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

"""SimHash near-duplicate groups by the generalised pigeonhole principle.

1. Each document gets a 64-bit fingerprint of its word shingles.
2. The 64 bits are grouped into partitions: bits that are correlated over all
   fingerprints go together, so that the partitions are as independent as the
   data allow.
3. If two fingerprints differ in at most d bits and the thresholds t_1..t_m of
   m partitions sum to d - m + 1, some partition i differs in at most t_i bits
   (a threshold of -1 skips the partition). Each fingerprint picks its own
   thresholds: a small dynamic programme over the partitions finds those with
   the least estimated probes and candidates, from histograms of all
   fingerprints. A fingerprint that sits in a crowded part of one partition so
   gives that partition -1 and spends its threshold elsewhere.
4. It probes the exact partition index with every value within its thresholds,
   candidates are verified on all 64 bits inside the join, and links are
   contracted to connected components.

Copies share a fingerprint and are one node, so a group of copies of any size is
one row from step 2 on.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustfold.llm.common import broadcast_if_small, free_names, row_key, stored
from trustfold.llm.components import components

BITS = 64
FOLD = 16  # histogram cells per partition, as a power of two
SEED = 42
_INF = 1e300


# --- fingerprints ---------------------------------------------------------


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words of lower-cased ``text``; of the whole sequence if it is shorter."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[size - 1 :])], dtype="<u8")


def fingerprint(text: bytes | None, size: int) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes. 0 for a text without words."""
    h = shingle_hashes(text or b"", size)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(rows: DataFrame, text_col: str = "text", size: int = 3) -> DataFrame:
    """``rows`` with the text replaced by ``fp``, its fingerprint as a signed long."""
    kept = [c for c in rows.columns if c != text_col]

    def run(batches):
        for pdf in batches:
            yield pdf[kept].assign(fp=[fingerprint(t, size) for t in pdf[text_col]])

    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("fp", T.LongType())])
    return rows.withColumn(text_col, F.col(text_col).cast("binary")).mapInPandas(run, schema)


# --- bit groups and histograms ---------------------------------------------


def _bit_rows(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_correlation(nodes: DataFrame) -> np.ndarray:
    """64 x 64 absolute correlations of the fingerprint bits, from co-occurrence counts summed over all rows."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for pdf in batches:
            b = _bit_rows(pdf["fp"].to_numpy()).astype(np.float64)
            n, both = n + len(b), both + b.T @ b
        i, j = np.indices((BITS, BITS))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": both.ravel(), "rows": float(n)})

    got = nodes.select("fp").mapInPandas(run, "i int, j int, n double, rows double").groupBy("i", "j")
    got = got.agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()  # 4096 rows
    both, rows = np.zeros((BITS, BITS)), 0.0
    for r in got:
        both[r["i"], r["j"]], rows = r["n"], r["rows"]
    if rows == 0:
        return np.eye(BITS)
    p = np.diag(both) / rows
    cov = both / rows - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return np.abs(cov / np.outer(sd, sd))


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits into ``parts`` groups of even size: each starts with the free bit that is most correlated with
    the other free bits, and takes the free bit with the highest mean correlation to the group until it is full."""
    free, groups = set(range(len(corr))), []
    for g in range(parts):
        size = len(corr) // parts + (g >= parts - len(corr) % parts)
        first = max(free, key=lambda b: (sum(corr[b, x] for x in free if x != b), -b))
        group = [first]
        free.discard(first)
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def part_values(fp: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """The value of each bit group, as int64."""
    u = fp.astype(np.int64).view(np.uint64)
    return [
        sum(((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k) for k, b in enumerate(g)).astype(np.int64) for g in groups
    ]


def _fold(values: np.ndarray) -> np.ndarray:
    """Histogram cell of a partition value."""
    return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(BITS - FOLD)).astype(np.int64)


def histograms(nodes: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """Rows of all fingerprints by partition and cell: partitions x 2^16 counts, a size that the data do not change."""

    def run(batches):
        cells = np.zeros((len(groups), 1 << FOLD), dtype=np.int64)
        for pdf in batches:
            for i, v in enumerate(part_values(pdf["fp"].to_numpy(), groups)):
                cells[i] += np.bincount(_fold(v), minlength=1 << FOLD)
        i, c = np.nonzero(cells)
        yield pd.DataFrame({"i": i, "c": c, "n": cells[i, c]})

    rows = nodes.select("fp").mapInPandas(run, "i int, c int, n long").groupBy("i", "c").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((len(groups), 1 << FOLD))
    out[rows["i"], rows["c"]] = rows["n"]
    return out


def part_count(n: int, distance: int) -> int:
    """Partitions with the least expected work for ``n`` fingerprints: probes, plus the index rows that they meet."""

    def work(m: int) -> float:
        t = [max(0, (distance - m + 1 + i) // m) for i in range(m)]
        widths = [BITS // m] * m
        probes = sum(sum(math.comb(w, x) for x in range(k + 1)) for w, k in zip(widths, t))
        return probes + sum(sum(math.comb(w, x) for x in range(k + 1)) * n / 2.0**w for w, k in zip(widths, t))

    return min(range(2, distance + 2), key=lambda m: (work(m), m)) if distance else 1


# --- thresholds --------------------------------------------------------------

PROBE_COST = 1.0  # one probe row against one candidate row


def allocate(values: list[np.ndarray], hist: np.ndarray, widths: list[int], distance: int) -> np.ndarray:
    """Thresholds per fingerprint and partition (rows x partitions), the sum of each row being distance - m + 1.

    Dynamic programme over the partitions; state: thresholds spent so far.
    """
    m, n = len(values), len(values[0])
    cost = np.zeros((m, distance + 2, n))  # threshold -1..distance
    for i, v in enumerate(values):
        ring = [hist[i][_fold(v)], sum(hist[i][_fold(v ^ (1 << b))] for b in range(widths[i]))]
        mean = hist[i].sum() / 2.0 ** widths[i]
        for t in range(distance + 1):
            near = ring[t] if t < 2 else np.full(n, math.comb(widths[i], t) * mean)
            cost[i, t + 1] = cost[i, t] + near + PROBE_COST * math.comb(widths[i], t)
    spend = distance - m + 1
    sums = list(range(-m, distance + 1))
    best = np.full((len(sums), n), _INF)
    best[sums.index(0)] = 0.0
    choice = []
    for i in range(m):
        now, took = np.full((len(sums), n), _INF), np.zeros((len(sums), n), dtype=np.int64)
        for s in sums:
            for t in range(-1, distance + 1):
                if s - t in sums:
                    c = best[sums.index(s - t)] + cost[i, t + 1]
                    k = sums.index(s)
                    better = c < now[k]
                    now[k], took[k] = np.where(better, c, now[k]), np.where(better, t, took[k])
        best = now
        choice.append(took)
    out, left = np.zeros((n, m), dtype=np.int64), np.full(n, spend)
    for i in range(m - 1, -1, -1):
        out[:, i] = choice[i][left + m, np.arange(n)]
        left = left - out[:, i]
    return out


def _masks(width: int, distance: int) -> np.ndarray:
    """Every value that flips at most ``distance`` of ``width`` bits."""
    return np.array([sum(1 << b for b in x) for k in range(distance + 1) for x in itertools.combinations(range(width), k)], dtype=np.int64)


_CHUNK = 400_000


def _index_rows(nodes: DataFrame, groups: list[list[int]]) -> DataFrame:
    def run(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            for i, v in enumerate(part_values(fp, groups)):
                yield pd.DataFrame({"key": (i << 32) + v, "b": fp})

    return nodes.select("fp").mapInPandas(run, "key long, b long")


def _probe_rows(nodes: DataFrame, groups: list[list[int]], hist, distance: int) -> DataFrame:
    widths = [len(g) for g in groups]
    cells = nodes.sparkSession.sparkContext.broadcast(hist)  # partitions x 2^16 counts

    def run(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            if not len(fp):
                continue
            values = part_values(fp, groups)
            t = allocate(values, cells.value, widths, distance)
            for i, v in enumerate(values):
                for radius in np.unique(t[:, i]):
                    if radius < 0:
                        continue
                    at, masks = np.flatnonzero(t[:, i] == radius), _masks(widths[i], int(radius))
                    step = max(1, _CHUNK // len(masks))
                    for k in range(0, len(at), step):
                        rows = at[k : k + step]
                        yield pd.DataFrame({"key": (i << 32) + (v[rows, None] ^ masks[None, :]).ravel(), "a": np.repeat(fp[rows], len(masks))})

    return nodes.select("fp").mapInPandas(run, "key long, a long")


def fingerprint_links(nodes: DataFrame, distance: int = 3, parts: int | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints in ``nodes`` (column fp) that differ in at most
    ``distance`` bits; a pair may come more than once. ``parts``: number of partitions, chosen by expected work if None."""
    m = parts or part_count(nodes.count(), distance)
    groups = group_bits(bit_correlation(nodes), m)
    probes = _probe_rows(nodes, groups, histograms(nodes, groups), distance)
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    index = _index_rows(nodes, groups)
    return probes.join(index, (probes["key"] == index["key"]) & near).select("a", "b")


# --- groups ---------------------------------------------------------------


def _groups(rows: DataFrame, text_col: str, size: int, distance: int, parts: int | None) -> DataFrame:
    """(id, [row], fp, root, component_id) for rows (id, [row], text)."""
    fps = stored(fingerprints(rows, text_col, size))
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(fingerprint_links(nodes, distance, parts))
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(least, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3,
                    parts: int | None = None) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    Documents whose fingerprints differ in at most ``distance`` bits are linked;
    component_id is the least id reachable, itself included. A null text counts
    as empty; all texts without words have fingerprint 0 and are linked like any
    other. Null ids count only in a group without an id, whose component_id is
    null. Repeated rows stay repeated. An empty table gives an empty result.
    Columns besides id and text are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return _groups(rows, "text", size, distance, parts).select(
        F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each near-duplicate group does: the one with the least id.

    Rows equal in id and text are one document and stay or go together. Rows
    without an id come last; among rows with the same id the least text hash stays.
    """
    free_names(docs, "_row")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(docs, id_col, text_col).alias("row"))
    member = _groups(rows, "text", size, distance, None).select("root", "id", "row")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    stays = member.groupBy("root").agg(F.min(order)["row"].alias("stays"))
    drop = member.join(stays, "root").where("row <> stays").select(F.col("row").alias("_row")).distinct()
    drop = broadcast_if_small(stored(drop))
    return docs.withColumn("_row", row_key(docs, id_col, text_col)).join(drop, "_row", "left_anti").drop("_row")

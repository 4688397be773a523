"""Exact duplicates by an exchange of compressed fingerprints.

1. The documents are read once. Each partition becomes parts of at most
   ``PART_ROWS`` rows, and of each part only ids and SHA-256 digests of the
   normalised texts are stored.
2. Every part sends the leading bits of its distinct digests, sorted and
   Golomb-Rice coded, to the owners of their ranges. An owner decodes all
   messages of its range and answers each with a bitmap: which of the
   fingerprints another part has sent too.
3. A part marks the rows whose fingerprint has a set bit or occurs twice in the
   part itself. These rows are suspects; all others are unique.
4. The documents are read again, and only texts of suspects move: they are
   grouped by their bytes, with partial groups before the shuffle, so a text
   that a third of all rows share is one row per task. A text is recognised as a
   suspect's by a bitmap over digests of at most ``FILTER_BITS`` bits. Where the
   bitmap is wrong, a unique text moves and turns out to be alone.
5. Groups go back to the stored rows by digest. Groups of more than a
   100,000th of all rows, of which there are at most 100,000, are broadcast, so
   no join key holds more rows than that.

Fingerprints have ten bits more than the row count needs, so about one unique
row in a thousand is a suspect; a Golomb-Rice code takes about 12 bits for each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustfold.llm.common import free_names, stored
from trustfold.session import shuffle_partitions

PART_ROWS = 1 << 17  # rows of a part; 4 MB of digests
PART_BITS = 24  # a task may have so many parts; a place has these, 17 bits for its row and 22 for its task
OWNER_ROWS = 1 << 22  # rows an owner takes on average; 32 MB of fingerprints
SPARE_BITS = 10
FILTER_BITS = 30
BIG_GROUPS = 100_000
DIGEST = 32
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def normalised(text: bytes) -> bytes:
    """``text`` with each run of ASCII white space as one space."""
    words = b" ".join(text.split())  # bytes.split() cuts at these six bytes and no others
    if not words:
        return b" " if text else b""
    return (b" " if text[0] in _SPACE else b"") + words + (b" " if text[-1] in _SPACE else b"")


# --- Golomb-Rice code -------------------------------------------------------------


def rice_encode(values: np.ndarray, width: int) -> bytes:
    """Gaps of the ascending ``values`` (uint64), each a unary quotient and a remainder of ``width`` bits.

    All unary parts come first, then all remainders, so that both sides work on whole arrays.
    """
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.zeros(int((quotients + 1).sum()), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(np.concatenate([unary, rest.ravel()])).tobytes()


def rice_decode(code: bytes, n: int, width: int) -> np.ndarray:
    """The ``n`` values that ``rice_encode`` got."""
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    ends = np.flatnonzero(bits)[:n]  # the n-th set bit ends the unary parts
    quotients = np.diff(ends, prepend=-1) - 1
    at = int(ends[-1]) + 1 if n else 0
    rest = bits[at : at + n * width].reshape(n, width).astype(np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(width)) + (rest << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def rice_width(n: int, span: int) -> int:
    """Remainder bits for ``n`` values spread over ``span``: about ln 2 of the mean gap."""
    return max(0, int(math.log2(max(1.0, 0.69 * span / max(n, 1)))))


# --- parts and messages -----------------------------------------------------------


def _fingerprints(digests: bytes, bits: int) -> np.ndarray:
    lead = np.frombuffer(digests, dtype=">u8").reshape(-1, DIGEST // 8)[:, 0].astype(np.uint64)
    return lead >> np.uint64(64 - bits)


def _parts(rows: DataFrame) -> DataFrame:
    """(part, ids, digests): the rows (id, text) of a part, their digests one after the other."""
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
                           T.StructField("digests", T.BinaryType()), T.StructField("n", T.LongType())])
    id_type = rows.schema["id"].dataType

    def run(batches):
        from hashlib import sha256

        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(id_type)
        ids, digests, part = [], [], TaskContext.get().partitionId() << PART_BITS

        def record():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(digests)], pa.int32()), pa.concat_arrays(ids)),
                 pa.array([b"".join(digests)], pa.binary()), pa.array([len(digests)], pa.int64())], names=["part", "ids", "digests", "n"])

        for b in batches:
            done = 0
            while done < b.num_rows:
                piece = b.slice(done, PART_ROWS - len(digests))
                done += piece.num_rows
                ids.append(piece.column(0).cast(kind))
                digests.extend(sha256(normalised(t or b"")).digest() for t in piece.column(1).to_pylist())
                if len(digests) == PART_ROWS:
                    yield record()
                    ids, digests, part = [], [], part + 1
        if digests:
            yield record()

    return rows.mapInArrow(run, schema)


def _owner_starts(bits: int, owners: int) -> np.ndarray:
    """First fingerprint of each owner's range, and the end of the last."""
    return np.array([(i << bits) // owners for i in range(owners + 1)], dtype=np.uint64)


def _messages(parts: DataFrame, bits: int, owners: int) -> DataFrame:
    """(owner, part, n, width, code): each part's distinct fingerprints by owner."""
    def run(batches):
        starts = _owner_starts(bits, owners)
        for b in batches:
            for part, digests in zip(b.column("part").to_pylist(), b.column("digests").to_pylist()):
                own = np.unique(_fingerprints(digests, bits))
                cuts = np.searchsorted(own, starts[:-1])
                ends = np.append(cuts[1:], len(own))
                out = []
                for o in np.flatnonzero(ends > cuts):
                    values = own[cuts[o] : ends[o]] - starts[o]
                    width = rice_width(len(values), int(starts[o + 1] - starts[o]))
                    out.append((int(o), part, len(values), width, rice_encode(values, width)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                    names=["owner", "part", "n", "width", "code"])

    return parts.select("part", "digests").mapInArrow(run, "owner int, part long, n int, width int, code binary")


def _replies(messages: DataFrame) -> DataFrame:
    """(part, owner, n, bitmap): per message a bit for each fingerprint, set if another part has it too."""
    def run(group):
        sizes = group.column("n").to_pylist()
        got = np.concatenate([rice_decode(c, n, w) for c, n, w in zip(group.column("code").to_pylist(), sizes, group.column("width").to_pylist())])
        _, where, times = np.unique(got, return_inverse=True, return_counts=True)
        shared = (times > 1)[where]
        ends = np.cumsum(sizes)
        bitmaps = [np.packbits(shared[e - n : e]).tobytes() for n, e in zip(sizes, ends)]
        return pa.table({"part": group.column("part"), "owner": group.column("owner"), "n": group.column("n"), "bitmap": pa.array(bitmaps, pa.binary())})

    return messages.groupBy("owner").applyInArrow(run, "part long, owner int, n int, bitmap binary")


def _marked(parts: DataFrame, replies: DataFrame, bits: int, id_type: T.DataType) -> DataFrame:
    """(id, digest, place, suspect), one row per document; place is unique."""
    answers = replies.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("owner", "n", "bitmap"))).alias("answers"))
    both = parts.join(answers, "part").select("part", "ids", "digests", F.col("answers.n").alias("sizes"), F.col("answers.bitmap").alias("bitmaps"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                digests = b.column("digests")[i].as_py()
                _, where, times = np.unique(_fingerprints(digests, bits), return_inverse=True, return_counts=True)
                shared = np.concatenate([np.unpackbits(np.frombuffer(m, dtype=np.uint8))[:n]
                                         for n, m in zip(b.column("sizes")[i].as_py(), b.column("bitmaps")[i].as_py())])
                suspect = (shared[where] > 0) | (times[where] > 1)
                n = len(where)
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids")[i].values, pa.Array.from_buffers(pa.binary(DIGEST), n, [None, pa.py_buffer(digests)]).cast(pa.binary()),
                     pa.array((b.column("part")[i].as_py() << 17) + np.arange(n), pa.int64()), pa.array(suspect)],
                    names=["id", "digest", "place", "suspect"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("digest", T.BinaryType()), T.StructField("place", T.LongType()),
                           T.StructField("suspect", T.BooleanType())])
    return both.mapInArrow(run, schema)


# --- suspects ---------------------------------------------------------------------


def _slot(digest: Column, bits: int) -> Column:
    """Leading ``bits`` bits of a digest, at most 32."""
    lead = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")
    return F.shiftright(lead, 32 - bits)


def _filter(suspects: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of 2^bits bits over the slots of the suspects' digests; its size is set by ``bits`` alone."""
    low = min(bits, 16)

    def run(key, group):
        page = np.zeros(1 << low, dtype=np.uint8)
        page[group.column("at").to_numpy()] = 1
        return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(page).tobytes()], pa.binary())})

    slots = suspects.select(_slot(F.col("digest"), bits).alias("slot")).distinct()
    pages = slots.select(F.shiftright("slot", low).alias("page"), F.col("slot").bitwiseAND((1 << low) - 1).alias("at"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    step = (1 << low) // 8
    for r in pages.groupBy("page").applyInArrow(run, "page long, bits binary").toLocalIterator(prefetchPartitions=True):
        out[r["page"] * step : (r["page"] + 1) * step] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _suspect_texts(rows: DataFrame, seen: np.ndarray, bits: int) -> DataFrame:
    """(id, digest, bytes) of the rows (id, text) whose digest is in the bitmap."""
    known = rows.sparkSession.sparkContext.broadcast(seen)

    def run(batches):
        from hashlib import sha256

        for b in batches:
            at, digests, texts = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                text = normalised(t or b"")
                digest = sha256(text).digest()
                slot = int.from_bytes(digest[:4], "big") >> (32 - bits)
                if known.value[slot >> 3] >> (7 - (slot & 7)) & 1:
                    at.append(i)
                    digests.append(digest)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int32())), pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], names=["id", "digest", "bytes"])

    schema = T.StructType([rows.schema["id"], T.StructField("digest", T.BinaryType()), T.StructField("bytes", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def _groups(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """(digest, keep, size, keep_place) of the texts that occur more than once.

    Raises if two different texts have one digest: ids and digests alone could then not tell them apart.
    """
    same = stored(texts.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("keep")).drop("bytes"))
    odd = same.groupBy("digest").count().where("count > 1").first()
    if odd:
        raise ValueError(f"different texts share the SHA-256 digest {odd['digest'].hex()}")
    # rows of one id and text: the first place stays
    first = marked.where("suspect").groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("first"))
    return stored(same.where("size > 1").join(first, "digest").select("digest", "keep", "size", F.col("first.place").alias("keep_place")))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal if they are the same bytes once each run of ASCII white
    space is one space; a null text is an empty one, and empty texts are equal.
    Of equal texts the row with the smallest id stays; null ids come last, and of
    rows equal in id and text one stays. ``text_sha256`` is the digest of the
    normalised text. An empty table gives an empty result. Other columns are not
    read. Texts of any length work: one is in memory at a time.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType
    parts = stored(_parts(rows))
    n = parts.agg(F.sum("n")).first()[0] or 0
    bits = min(63, max(16, math.ceil(math.log2(n + 1)) + SPARE_BITS))
    owners = max(shuffle_partitions(docs.sparkSession), math.ceil(n / OWNER_ROWS))
    marked = stored(_marked(parts, _replies(_messages(parts, bits, owners)), bits, id_type))
    suspects = marked.where("suspect")
    filter_bits = min(FILTER_BITS, max(16, math.ceil(math.log2(64 * suspects.count() + 1))))
    groups = _groups(_suspect_texts(rows, _filter(suspects, filter_bits), filter_bits), marked)
    big = F.col("size") > F.lit(n / BIG_GROUPS)
    alone = F.lit(None).cast("long")
    hot = groups.where(big)  # fewer than BIG_GROUPS, as together they have at most n rows
    few = groups.where(~big)
    in_hot = suspects.join(F.broadcast(hot), "digest")
    others = suspects.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(few, "digest", "left")
    single = marked.where("NOT suspect").select("id", "digest", "place", "suspect", F.col("id").alias("keep"), alone.alias("size"), alone.alias("keep_place"))
    names = ["id", "digest", "place", "keep", "size", "keep_place"]
    out = in_hot.select(*names).unionByName(others.select(*names)).unionByName(single.select(*names))
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("place") == F.col("keep_place"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; ids must be unique and not null, or rows of a repeated id
    stay or go together. See ``duplicates``."""
    free_names(docs, "keep_id", "group_size", "kept", "text_sha256")
    gone = duplicates(docs, id_col, text_col).where("NOT kept").select(id_col)
    return docs.join(gone, id_col, "left_anti")

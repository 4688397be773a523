import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustfold.llm import exact

SCHEMA = "doc_id long, text string, digest string, part string"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        digest = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, ids[0], len(ids), at == 0, digest) for at, i in enumerate(ids)]
    return sorted(out, key=str)


def check(spark, rows, parts=5):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    got = exact.duplicates(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def corpus():
    rnd = random.Random(4)
    words = ["a", "b", "é", "😀", " ", " ", "\x1c", "\x85"]
    gaps = [" ", "  ", "\n", "\t \r\n", "\x0b\x0c"]
    rows = [(i, "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randrange(5))) + rnd.choice(["", "a"])) for i in range(400)]
    rows += [(1000 + i, rnd.choice(gaps) + "one big group" + rnd.choice(gaps)) for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "\n\n"), (None, "null id"), (None, "null id"), (2004, "null id"), (None, "only null ids"), (None, "only null ids")]
    rows += [rows[3]] * 3 + [(2005, "long " * 100_000), (2006, "long\n" * 100_000), (2007, "long " * 99_999)]
    return rows


def test_against_brute_force(spark):
    check(spark, corpus())


def test_one_partition_and_many_small_parts(spark, monkeypatch):
    monkeypatch.setattr(exact, "PART_ROWS", 16)
    check(spark, corpus()[:300], 1)


def test_full_filter_and_few_owners_change_nothing(spark, monkeypatch):
    """A bitmap in which every slot is taken only sends more texts, and an owner may have any range."""
    monkeypatch.setattr(exact, "FILTER_BITS", 4)
    monkeypatch.setattr(exact, "SPARE_BITS", -20)
    monkeypatch.setattr(exact, "BIG_GROUPS", 20)
    check(spark, corpus())


def test_empty_and_single(spark):
    check(spark, [])
    check(spark, [(1, None)])
    check(spark, [(None, "x")])


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "u")], "name string, body string")
    got = {tuple(r)[:4] for r in exact.duplicates(docs, "name", "body").collect()}
    assert got == {("b", "a", 2, False), ("a", "a", 2, True), (None, None, 1, True)}


def test_keep_first(spark):
    rows = [(1, "x  y"), (2, "x y"), (3, "z"), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, "d", "p") for r in rows], SCHEMA)
    out = exact.keep_first(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]
    with pytest.raises(ValueError):
        exact.keep_first(docs.withColumn("kept", F.lit(1)))


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_rice_code_round_trip(n):
    rnd = np.random.default_rng(n)
    for bits in (16, 40, 63):
        values = np.unique(rnd.integers(0, 1 << bits, n, dtype=np.uint64))
        width = exact.rice_width(len(values), 1 << bits)
        code = exact.rice_encode(values, width)
        assert np.array_equal(exact.rice_decode(code, len(values), width), values)
        assert len(code) * 8 <= len(values) * (width + 4) + 72
    top = np.array([0, 5, (1 << 64) - 1], dtype=np.uint64)
    assert np.array_equal(exact.rice_decode(exact.rice_encode(top, 62), 3, 62), top)


def test_messages_are_smaller_than_hashes(spark):
    rows = spark.range(20_000).select(F.col("id"), F.col("id").cast("string").cast("binary").alias("text")).coalesce(2)
    parts = exact._parts(rows)
    size = exact._messages(parts, 25, 8).agg(F.sum(F.length("code")), F.sum("n")).first()
    assert size[0] * 8 < 15 * size[1]

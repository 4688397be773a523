from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trustfold.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def words(n):
    return " ".join(["w"] * n)


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)


def fill(sizes, weights, limit=3.0):
    """Round by round, as the rule is worded."""
    total, capped = sum(sizes.values()), {}
    while True:
        free = {s: weights[s] for s in sizes if s not in capped}
        left, w = total - sum(capped.values()), sum(free.values())
        over = {s: limit * sizes[s] for s in free if free[s] * left / w > limit * sizes[s]} if free else {}
        if not over:
            return {**capped, **{s: free[s] * left / w for s in free}}
        capped.update(over)


def test_targets_and_takes(spark):
    rows = [(i, words(1 + i * 7 % 23), f"s{i % 5}" if i % 11 else None) for i in range(600)]
    rows += [(1000 + i, words(2), "big") for i in range(900)] + [(5000, words(3), "tiny"), (5001, None, "tiny"), (5002, "", "empty")]
    got = mixing.mix(make(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: 1 + i % 3 for i, s in enumerate(order)}
    target = fill(sizes, weights)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6
    again = mixing.mix(make(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_thresholds_equal_a_sort(spark):
    rows = [(i, words(1 + i % 9), "a" if i % 3 else "b") for i in range(500)]
    docs = make(spark, rows)
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    hashes = {r[0]: r[1] for r in docs.select("doc_id", mixing.unit_hash(F.col("doc_id"))).collect()}
    for source in "ab":
        ids = sorted((i for i, _, s in rows if s == source), key=hashes.get)
        one = got[ids[0]]
        rest, upto = one["target"] % one["source_size"], 0
        base = int(one["target"] // one["source_size"])
        for i in ids:
            size = got[i]["size"]
            extra = upto + size <= rest or (upto <= rest and upto + size - rest <= rest - upto)
            assert got[i]["copies"] == base + extra
            upto += size


def test_ties_repeats_and_empty(spark):
    rows = [(7, words(5), "a")] * 6 + [(None, words(4), None)] * 3 + [(8, words(5), "a")]
    got = mixing.mix(make(spark, rows)).collect()
    assert len(got) == len(rows)
    assert len({r["copies"] for r in got if r["doc_id"] == 7}) == 1
    assert mixing.mix(make(spark, rows).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(make(spark, [(1, None, None), (2, " ", "x")])).collect()] == [0, 0]


def test_mixed_documents_keeps_rows(spark):
    docs = make(spark, [(i, words(3), f"s{i % 3}") for i in range(60)]).drop("size")
    out = mixing.mixed_documents(docs)
    assert out.columns[:3] == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert {r["doc_id"]: r["copies"] for r in out.collect()} == {i: n for i, n in copies.items() if n}
    with pytest.raises(ValueError):
        mixing.mixed_documents(docs.withColumn("taken", F.lit(1)))

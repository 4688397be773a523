import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from trustfold.llm import merkle
from trustfold.llm.queries import MERKLE_FIELDS, tampered_leaf

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, at string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    i, _, lang, source, n = row
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)])


def tree(leaves):
    """(root, [[(left, right), ...] per leaf])"""
    paths, level, owner = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        up, up_owner = [], []
        for i in range(0, len(level), 3):
            run = level[i : i + 3]
            for j in range(len(run)):
                for k in owner[i + j]:
                    paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h(*run))
            up_owner.append([k for o in owner[i : i + 3] for k in o])
        level, owner = up, up_owner
    return level[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in by[s]])
    if not order:
        return []
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(by[s], trees[s][1]):
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf(r, r[1].replace("\n", "") if cut else r[1])
            for left, right in path + top:
                node = h(left, node, right)
            siblings = "".join(a + b for a, b in path + top)
            out.append((r[0], leaf(r, r[1]), trees[s][0], root, h(siblings), node, node == root))
    return sorted(out, key=str)


def check(spark, rows, parts=3, step=merkle.STEP):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    got = merkle.audit(docs, tampered_leaf(), MERKLE_FIELDS, step=step)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def corpus(n, sources):
    rnd = random.Random(n)
    texts = ["one line", "two\nlines", "é😀\n\n", "", None, "\n"]
    rows = [(i, rnd.choice(texts), rnd.choice(["en", None, ""]), rnd.choice(sources), rnd.choice([None, i])) for i in rnd.sample(range(10 * n), n)]
    return rows + rows[:3] + [(None, "no id\n", "en", sources[0], 1)] * 2


def test_against_brute_force(spark):
    check(spark, corpus(700, [None, "", "é", "z", "Z", "hot", "hot", "hot", "hot"]) + [(-5, "x" * 300_000 + "\n", "en", "long", 3)])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_small_steps_and_sizes(spark, n):
    """A stored level after every second one; tree sizes at and beside powers of three."""
    check(spark, [(i, f"t\n{i}", "en", "a", i) for i in range(n)], step=2)


def test_full_subtree_and_one_more(spark):
    for n in (243, 244):
        check(spark, [(i, f"t{i}", "en", "a", i) for i in range(n)] + [(9000, "b", "en", "b", 1)])


def test_many_groups(spark):
    check(spark, [(i, f"t\n{i}", "en", f"s{i // 2}", i) for i in range(520)])


def test_empty_and_single(spark):
    check(spark, [])
    check(spark, [(3, None, None, None, None)])
    assert merkle.build(spark.createDataFrame([], SCHEMA), MERKLE_FIELDS).root() is None


def test_saved_manifest_proves_later(spark, tmp_path):
    rows = corpus(60, ["a", "b"])
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    manifest = merkle.build(docs, MERKLE_FIELDS, carry=["lang"])
    manifest.save(str(tmp_path / "m"))
    again = merkle.Manifest.load(spark, str(tmp_path / "m"))
    assert again.root() == manifest.root() == brute(rows)[0][3]
    got = merkle.proofs(again).withColumn("ok", merkle.fold(F.col("leaf")) == F.col("root"))
    assert got.columns[:3] == ["doc_id", "lang", "leaf"] and got.where("ok").count() == len(rows)


def test_clashing_carried_column_is_refused(spark):
    docs = spark.createDataFrame([(1, "t", "en", "a", 1, "x", "y")], SCHEMA)
    with pytest.raises(ValueError):
        merkle.build(docs, MERKLE_FIELDS, carry=["root"])

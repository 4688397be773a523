import random

import numpy as np
import xxhash

from trustfold.llm import simhash


def brute_fp(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = w.encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows):
    """component ids by comparing all pairs of fingerprints."""
    fps = sorted({brute_fp(t) for _, t in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        f = find(brute_fp(t))
        if i is not None:
            least[f] = min(least.get(f, i), i)
    return [(i, f"{brute_fp(t):016x}", least.get(find(brute_fp(t)))) for i, t in rows]


def corpus(n=150):
    rnd = random.Random(3)
    vocab = [f"word{i}" for i in range(400)] + ["ÉTÉ", "été", "x y"]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.5:
            w = (rnd.choice(rows)[1] or "").split(" ")
            for _ in range(rnd.choice([0, 0, 1, 2])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 5, 60, 200]))]
        rows.append((i if i % 29 else None, " ".join(w).replace("word1", "WORD1") if i % 31 else None))
    return rows + [rows[4]] * 3 + [(900, "\t\n \r"), (901, "a b")]


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(4)
    for parts in (None, 2, 3, 4):
        got = sorted(map(tuple, simhash.near_duplicates(docs, parts=parts).collect()), key=str)
        assert got == sorted(groups(rows), key=str)


def test_links_of_crowded_fingerprints(spark):
    """Every link of random fingerprints in tight families, whatever the thresholds."""
    rnd = random.Random(5)
    fps = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(60):
            f = base
            for _ in range(rnd.randrange(5)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    for parts in (2, 3, 4):
        assert {tuple(r) for r in simhash.fingerprint_links(nodes, 3, parts).distinct().collect()} == want


def test_thresholds_add_up():
    values = simhash.part_values(np.array([1, -5, 1 << 40]), [list(range(21)), list(range(21, 42)), list(range(42, 64))])
    hist = np.ones((3, 1 << simhash.FOLD))
    t = simhash.allocate(values, hist, [21, 21, 22], 3)
    assert (t.sum(axis=1) == 1).all() and t.min() >= -1


def test_keep_one(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, extra string").repartition(4)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = groups(rows)
    texts = {(i, t) for i, t in rows}
    per_group = {}
    for r in kept.distinct().collect():
        assert (r["doc_id"], r["text"]) in texts
        per_group.setdefault(brute_group(want, rows, r["doc_id"], r["text"]), set()).add(r["doc_id"])
    assert all(len(ids) == 1 for ids in per_group.values())
    assert len(per_group) == len({brute_group(want, rows, i, t) for i, t in rows})
    assert all(ids == {g[1]} for g, ids in per_group.items())


def brute_group(want, rows, i, t):
    """A name of the group of a row: fingerprint group by least fingerprint of its component id."""
    fps = {}
    for (a, fp, c), (b, text) in zip(want, rows):
        fps.setdefault((c, fp if c is None else ""), fp)
    for (a, fp, c), (b, text) in zip(want, rows):
        if (b, text) == (i, t):
            return ("", c) if c is not None else (fp, None)


def test_empty_table_and_long_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0
    long = " ".join(f"w{i}" for i in range(70_000))
    docs = spark.createDataFrame([(1, long), (2, long + " w")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(docs).collect()] == [1, 1]

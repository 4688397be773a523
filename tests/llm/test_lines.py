import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trustfold.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, s, n, letters):
    x = list(s)
    for _ in range(n):
        at, kind = rnd.randrange(len(x)), rnd.randrange(3)
        if kind == 0:
            x.insert(at, rnd.choice(letters))
        elif kind == 1 and len(x) > 1:
            del x[at]
        else:
            x[at] = rnd.choice(letters)
    return "".join(x)


def test_bit_parallel_distance(spark):
    rnd = random.Random(1)
    pairs = []
    for _ in range(1500):
        a = "".join(rnd.choice("abcé😀") for _ in range(rnd.randrange(1, 16)))
        pairs.append((a, edited(rnd, a, rnd.randrange(5), "abcé") if rnd.random() < 0.8 else ""))
    df = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    for k in (1, 2, 3):
        got = df.select("a", "b", lines.edit_distance(F.col("a"), F.col("b"), k).alias("d")).collect()
        assert all(min(r["d"], k + 1) == min(distance(r["a"], r["b"]), k + 1) for r in got)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_every_near_pair_shares_a_key(spark, k):
    rnd = random.Random(k)
    made, pairs = [], []
    for _ in range(300):
        a = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(2 * k * (k + 1) + 1, 50)))
        b = edited(rnd, a, rnd.randrange(1, k + 1), "abcd")
        if min(len(a), len(b)) > 2 * k * (k + 1) and a != b:
            pairs.append(tuple(sorted((len(made), len(made) + 1))))
            made += [(len(made), a), (len(made) + 1, b)]
    frame = spark.createDataFrame(made, "lid long, line string").repartition(3)
    found = {tuple(r) for r in lines.edit_links(lines.shared_keys(frame, k).checkpoint(), frame, k).collect()}
    assert set(pairs) <= found
    text = dict(made)
    assert all(distance(text[a], text[b]) <= k for a, b in found)


def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(3, 9))) for _ in range(60)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(4, 14))) for _ in range(60)]
    docs = []
    for i in range(150):
        text = "\n".join(edited(rnd, rnd.choice(base), rnd.choice([0, 0, 0, 1, 1, 2, 3]), "abcdeé") for _ in range(rnd.randrange(7)))
        docs.append((i if i % 17 else None, text if i % 13 else None, "clash"))
    long = "\n".join([base[0] + " tail"] * 4000)
    return docs + [docs[20], (300, "", "clash"), (301, long, "clash"), (302, "short\nshort\n\nshort", "clash")]


def test_keeps_the_first_line_of_each_class(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lid string").repartition(4)
    got = lines.dedup_lines(df).collect()
    assert len(got) == len(docs)
    # classes by comparing all pairs
    every = sorted({x.strip(" ") for _, t, _ in docs for x in (t or "").split("\n") if len(x.strip(" ")) >= lines.MIN_CHARS})
    root = {x: x for x in every}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = [x for x in every if len(x) >= lines.NEAR_CHARS]
    for i, a in enumerate(near):
        for b in near[:i]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                root[find(a)] = find(b)
    considered = lambda x: len(x.strip(" ")) >= lines.MIN_CHARS
    kept = Counter(find(x.strip(" ")) for _, t in {(r["doc_id"], r["text"]) for r in got} for x in (t or "").split("\n") if considered(x))
    assert set(kept) == {find(x) for x in every} and max(kept.values()) == 1
    # of each class the least id's line stays
    first = {}
    for i, t, _ in docs:
        for x in (t or "").split("\n"):
            if considered(x) and i is not None:
                c = find(x.strip(" "))
                first[c] = min(first.get(c, i), i)
    for r in got:
        for x in (r["text"] or "").split("\n"):
            if considered(x):
                assert r["doc_id"] == first.get(find(x.strip(" ")), r["doc_id"])
    by_id = {}
    for i, t, _ in docs:
        by_id.setdefault(i, []).append(t)
    for r in got:
        assert any(r["n_lines"] == (0 if t is None else len(t.split("\n"))) for t in by_id[r["doc_id"]])
        assert len(r["dropped"]) == r["n_exact"] + r["n_near"]
    assert [r["text"] for r in got if r["doc_id"] == 302] == ["short\nshort\n\nshort"]
    assert [r["text"] for r in got if r["doc_id"] == 300] == [""]


def test_drop_repeated_lines(spark):
    a = "this is the first line of them all"
    rows = [(1, a + "\nother words of the first document", 9), (2, a, 9), (3, a.replace("first", "fxrst"), 9), (4, "", 9), (5, None, 9), (6, "an own line of document six", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = lines.drop_repeated_lines(df, length_col="n_chars")
    assert out.columns == df.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {
        1: (rows[0][1], len(rows[0][1])), 4: ("", 0), 5: (None, None), 6: (rows[5][1], len(rows[5][1]))}
    assert lines.dedup_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lines.dedup_lines(df.withColumn("n_near", F.lit(1)))


def test_short_lines(spark):
    """Lines with a letter or digit are copies at any length, and near copies from 13 characters on."""
    docs = spark.createDataFrame([(1, "Ietzte.\n}\nshort line 13"), (2, "Ietzte.\n}\nshqrt line 13\nown"), (3, "ab\nab")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_exact"], r["n_near"]) for r in lines.dedup_lines(docs, min_chars=1).collect()}
    assert got == {1: ("Ietzte.\n}\nshort line 13", 0, 0), 2: ("}\nown", 1, 1), 3: ("ab", 1, 0)}


def test_white_space_at_either_end(spark):
    """CRLF, tab-indented and form-feed copies are exact copies; what stays keeps its own white space."""
    a, b = "a line of text", "this is a longer line of text, of more than thirty"
    docs = spark.createDataFrame([(1, f"{a}\r\n{b}\r"), (2, f"{a}\n\t\t\t\t{b}"), (3, f"\t{a}\x0b\n\x0c {b} \t")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_exact"], r["n_near"]) for r in lines.dedup_lines(docs).collect()}
    assert got == {1: (f"{a}\r\n{b}\r", 0, 0), 2: ("", 2, 0), 3: ("", 2, 0)}


def test_shared_keys_without_a_window(spark):
    """A segment that very many lines share is counted by partial sums, not gathered as one window group."""
    made = [(i, "the same opening of " + f"{i:010d}" * 2) for i in range(300)]
    frame = spark.createDataFrame(made, "lid long, line string")
    shared = lines.shared_keys(frame)
    assert "Window" not in shared._jdf.queryExecution().executedPlan().toString()
    keys = lines.line_keys(frame, lines.EDITS).collect()
    n, index = Counter(r["key"] for r in keys), {r["key"] for r in keys if r["own"]}
    assert Counter(map(tuple, shared.collect())) == Counter(tuple(r) for r in keys if n[r["key"]] > 1 and r["key"] in index)

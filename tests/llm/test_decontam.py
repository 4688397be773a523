import random

import numpy as np
import pytest

from trustfold.llm import decontam


def score(text, item):
    """Smith-Waterman cell by cell."""
    h = np.zeros((len(item) + 1, len(text) + 1))
    for i, w in enumerate(item, 1):
        for j, x in enumerate(text, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if w == x else -decontam.MISMATCH), h[i - 1, j] - decontam.GAP, h[i, j - 1] - decontam.GAP)
    return h.max() / len(item)


def test_alignment_by_cells():
    rnd = random.Random(1)
    for _ in range(60):
        item = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 25))]
        text = [rnd.choice("abcdefghxyz") for _ in range(rnd.randrange(0, 60))]
        if text and rnd.random() < 0.5:
            at = rnd.randrange(len(text))
            text[at:at] = [w for w in item if rnd.random() < 0.8]
        assert decontam.align(text, item) == pytest.approx(score(text, item))


def setup():
    rnd = random.Random(7)
    common = "the of and in to a is".split()
    vocab = [f"w{i}ing" for i in range(3000)]
    line = lambda n: [rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(vocab) for _ in range(n)]
    items = [line(rnd.randrange(10, 60)) for _ in range(30)]
    docs, want = [], set()
    for d in range(200):
        body = line(rnd.randrange(0, 400))
        if d % 4 == 0:
            k = rnd.randrange(len(items))
            passage = list(items[k])
            for _ in range(int(len(passage) * rnd.choice([0, 0, 0.1, 0.15]))):  # replaced, dropped and added words
                at = rnd.randrange(len(passage))
                passage[at : at + 1] = rnd.choice([[], [rnd.choice(vocab)], [passage[at], rnd.choice(vocab)]])
            at = rnd.randrange(len(body) + 1)
            body[at:at] = [w.upper() + "," for w in passage]
            want.add((d, k))
        docs.append((d, " ".join(body)))
    return [(k, " ".join(x).capitalize() + ".") for k, x in enumerate(items)], docs, want


def test_finds_edited_copies_and_leaves_the_rest(spark):
    items, docs, want = setup()
    docs += [(900, None), (901, ""), (902, items[3][1].replace(" ", "\n")), (None, items[4][1]), (903, items[5][1]), (903, items[5][1])]
    items += [(40, "two words"), (41, None), (42, "")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(d.drop("item_id"), b).collect()
    pairs = [(r["doc_id"], r["item_id"]) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want | {(902, 3), (None, 4), (903, 5)}
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    text, item = dict(docs), dict(items)
    for r in got:
        assert r["score"] == pytest.approx(score(words(text[r["doc_id"]]), words(item[r["item_id"]])), abs=1e-9)
    kept = decontam.drop_leaks(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in {p[0] for p in pairs})


def test_bitmap_holds_every_gram(spark):
    grams = spark.createDataFrame([(x - (1 << 63),) for x in [0, 1, 1 << 40, (1 << 64) - 1, 5 << 50]], "gram long")
    bits = decontam.bitmap(grams)
    at = [(r["gram"] % (1 << 64)) >> (64 - decontam.BITMAP_BITS) for r in grams.collect()]
    assert sorted(np.flatnonzero(bits)) == sorted(set(at))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    assert decontam.leaks(none, items).count() == 0 and decontam.leaks(some, items.limit(0)).count() == 0
    assert decontam.drop_leaks(some, items.limit(0)).count() == 1 and decontam.leaks(some, items).count() == 1

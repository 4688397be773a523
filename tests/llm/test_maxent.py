import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from trustfold.llm import maxent


def corpus(n=300):
    rnd = random.Random(4)
    a, b = [f"a{i}on" for i in range(40)], [f"b{i}eau" for i in range(40)]
    rows = []
    for i in range(n):
        vocab = a if i % 3 else b
        rows.append((i, " ".join(rnd.choice(vocab[: rnd.randrange(1, 40)]) for _ in range(rnd.randrange(0, 60))) + (f" Rare{i}" if i % 2 else "")))
    return rows + [(None, "a1on b1eau"), (1000, None), (1001, ""), (1002, " \t\n"), rows[3], rows[3], (1003, "NEVER seen"), (1004, "É é x y")]


def tokens(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split() + [b""]


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_base_model_by_hand_and_broadcast_bound(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    c = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in rows:
        w = tokens(t)
        want[i] = (out(i), len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    scores = []
    for s in (maxent.Settings(), maxent.Settings(frequent=8)):  # the second leaves most words to the join
        got = maxent.language_model_scores(docs, settings=s).collect()
        assert len(got) == len(rows)
        for r in got:
            h, k, known, total, base = want[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, k, known, total)
            assert abs(r["base_score"] - base) < 1e-6
        scores.append(got)
    held = [r for r in scores[0] if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_classes_are_a_distribution():
    """Class probabilities sum to 1, and within a class so do the known words and one unknown."""
    s = maxent.Settings(single=3, endings=5)
    t = maxent.tokenise(pa.array(["a b c a", None, "A b"]))
    assert [[t.words[k] for k in t.code[x:y]] for x, y in zip(t.starts, t.starts[1:])] == [[b"a", b"b", b"c", b"a", b""], [b""], [b"a", b"b", b""]]
    lex = maxent.Lexicon(np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.zeros(s.classes), np.zeros(s.classes), 0, 0)
    classes, features, place, _ = maxent.encode(t, lex, s)
    rng = np.random.default_rng(0)
    logs = maxent.class_logs(features, rng.normal(size=(s.rows, s.classes)).astype(np.float32), rng.normal(size=s.classes).astype(np.float32))
    assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-5) and (place == -1).all()
    assert classes.min() >= 0 and classes.max() < s.classes
    # a context stops at its text's start
    assert (features[t.starts[:-1]] == features[0]).all()


def test_known_words_of_a_class_sum_to_one(spark):
    rows = [(i, "x y x z ww") for i in range(20)]
    s = maxent.Settings(single=2, endings=3)
    counts = maxent.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), s).checkpoint()
    lex, rest = maxent.lexicon(counts, s)
    assert rest.count() == 0 and lex.tokens == 120 and lex.words == 5
    sizes = np.zeros(s.classes)
    for w in (b"x", b"y", b"z", b"ww", b""):
        at = lex.find(np.array([maxent.word_hash(w)]))[0]
        cls = 0 if w == b"" else 1 + lex.rank[at] if lex.rank[at] < s.single else maxent.ending_class(w, s)
        sizes[cls] += lex.count[at] + 1
        assert lex.class_tokens[cls] >= lex.count[at]
    used = sizes > 0
    assert np.allclose((sizes[used] + 1), 10 ** lex.class_logs[used])


def test_gradient_steps_lower_the_loss():
    s = maxent.Settings(batch=64)
    rng = np.random.default_rng(1)
    features = rng.integers(0, 50, size=(4000, maxent.FEATURES)).astype(np.uint16)
    classes = (features[:, 0] % s.classes).astype(np.int64)
    w, b, used = np.zeros((s.rows, s.classes), dtype=np.float32), np.zeros(s.classes, dtype=np.float32), np.zeros(s.rows, dtype=np.int64)
    loss = lambda: -maxent.class_logs(features, w, b)[np.arange(4000), classes].mean()
    before = loss()
    maxent.descend(classes, features, w, b, used, s)
    assert loss() < 0.7 * before and used.sum() == 4000 * maxent.FEATURES


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert maxent.language_model_scores(none).count() == 0
    held = next(i for i in range(100) if out(i))
    r = maxent.language_model_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0) and abs(r["score"] + 3 * math.log10(maxent.Settings().classes)) < 1e-5


def test_features_reach_three_words_back():
    s = maxent.Settings()
    t = maxent.tokenise(pa.array(["p x y z", "q x y z"]))
    names = sorted(maxent.word_hash(w) for w in t.words)
    lex = maxent.Lexicon(np.array(names), np.ones(len(names), dtype=np.int64), np.arange(len(names)), np.zeros(s.classes), np.zeros(s.classes), 0, 0)
    _, features, _, _ = maxent.encode(t, lex, s)
    z1, z2 = features[3], features[8]  # the same two words before, another one three back
    assert len(z1) == 4 and (z1[:3] == z2[:3]).all() and z1[3] != z2[3]
    assert (s.classes, s.single, s.rounds) == (48, 23, 3)


def test_own_logs_are_those_of_the_distribution():
    s = maxent.Settings()
    rng = np.random.default_rng(2)
    features = rng.integers(0, s.rows, size=(50, maxent.FEATURES)).astype(np.uint16)
    w, b = rng.normal(size=(s.rows, s.classes)).astype(np.float32), rng.normal(size=s.classes).astype(np.float32)
    y = rng.integers(0, s.classes, size=50)
    assert np.allclose(maxent.own_logs(y, features, w, b), maxent.class_logs(features, w, b)[np.arange(50), y], atol=1e-4)

import random
from collections import Counter
from math import comb

import pytest

from trustfold.llm import quality


def brute(t):
    w = (t or "").encode().split()
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    wins = list(zip(w, w[1:], w[2:]))
    c, covered = Counter(wins), set()
    for i, g in enumerate(wins):
        if c[g] > 1:
            covered |= {i, i + 1, i + 2}
    return (len(w), sum(len(x.decode()) for x in w), sum(x in quality.SYMBOLS for x in t or ""), len(lines) - len(set(lines)), len(covered))


def corpus():
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(30)] + ["É#t", "a b", "*"]
    texts = [" ".join(rnd.choice(vocab[: rnd.randrange(1, 33)]) for _ in range(rnd.randrange(90))).replace("w3 ", "w3\n") for _ in range(120)]
    return [(i, t, "en") for i, t in enumerate(texts)] + [(200, None, "en"), (201, "", None), (202, "a a a a", "en"), (203, "\n \n\t", "en"), (204, "x y z " * 20000, "de")]


def test_statistics_by_hand(spark):
    rows = corpus()
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3),
                                spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    want = {i: brute(t) for i, t, _ in rows}
    for r in got:
        have = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert have == want[r["doc_id"]]
        assert r["base_failed"] == (have[0] < 50 or 100 * have[4] > 50 * have[0]) and r["kept"] == (not r["base_failed"])


@pytest.mark.parametrize("n,p", [(10, 0.3), (60, 0.05), (200, 0.02)])
def test_binomial(n, p):
    for k in range(n + 1):
        assert quality.binomial_cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def labelled(spark, good, bad, noise=0):
    """Documents of 60 words; bad ones full of symbols, and so are ``noise`` good ones."""
    clean = lambda i: " ".join(f"w{i:03}x{j}" for j in range(60))
    junk = lambda i: " ".join(f"w{i:03}x{j}***" for j in range(60))
    rows, labels = [], []
    for lang in ("en", None):
        for i in range(good + bad):
            k = len(rows)
            rows.append((k, junk(k) if i >= good or i < noise else clean(k), lang))
            labels.append((k, int(i < good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")


def test_certified_rules_reject_junk_only(spark):
    docs, labels = labelled(spark, 300, 40)
    got = quality.quality_rules(docs, labels).join(labels, "doc_id").collect()
    assert all(r["kept"] == bool(r["quality"]) for r in got) and len(got) == 680
    kept = quality.keep_good(docs.withColumnRenamed("lang", "lang"), labels)
    assert kept.columns == docs.columns and kept.count() == 600


def test_no_rule_without_proof(spark):
    few = labelled(spark, 60, 40)  # too few good documents for a bound of 5%
    assert all(r["kept"] for r in quality.quality_rules(*few).collect())
    docs, labels = labelled(spark, 300, 40, noise=60)  # the rule would reject a fifth of the good ones
    assert all(r["kept"] for r in quality.quality_rules(docs, labels).collect())
    # nulls and conflicts among labels
    docs, labels = labelled(spark, 300, 40)
    odd = spark.createDataFrame([(None, 1), (5, None), (6, 0), (6, 1)], "doc_id long, quality int")
    assert quality.quality_rules(docs, labels.unionByName(odd)).where("NOT kept").count() == 80


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.quality_rules(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0
    text = " ".join(f"w{j}" for j in range(60))
    docs = spark.createDataFrame([(1, text, "en"), (1, text, "en"), (None, text, None), (2, "few", "en")], "doc_id long, text string, lang string")
    assert quality.quality_rules(docs, labels).count() == 4 and quality.keep_good(docs, labels).count() == 3

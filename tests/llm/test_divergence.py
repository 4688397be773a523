import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trustfold.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, total string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs=10, top=10):
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = [w.translate(UPPER) for w in TERM.findall(text or "")]
        groups[lang or "", source or ""].update(words)
        seen[lang or ""].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in seen.items()}
    out = []

    def price(count, terms):
        total = sum(count[t] for t in terms)
        return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(terms)) for t in terms}

    gap = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, terms in kept.items():
        own = {s: price(c, terms) for (la, s), c in groups.items() if la == lang}
        q = price(sum((c for (la, _), c in groups.items() if la == lang), Counter()), terms)
        for s, p in own.items():
            pairs = [(b, sum(gap(p[t], r[t]) for t in terms)) for b, r in own.items() if b != s]
            more = [(t, gap(p[t], q[t])) for t in terms if groups[lang, s][t] > 0 and p[t] > q[t]]
            for part, items, cut in (("pair", pairs, None), ("term", more, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(items[:cut])]
    return sorted(out)


def check(spark, rows, parts=4, **args):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    got = divergence.divergence(docs, **args)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, **args)


def corpus(n, sources, langs=("en", "de", None, "")):
    rnd = random.Random(n)
    words = ["The", "the", "café", "CAFÉ", "İx", "a1b", "x-y", "naïve", "日本", " em", "q"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    weights = {s: [rnd.random() ** 3 for _ in words] for s in sources}
    rows = []
    for i in range(n):
        s = rnd.choice(sources)
        rows.append((i, rnd.choice([" ", "\n", ", ", "\x00"]).join(rnd.choices(words, weights[s], k=rnd.randrange(40))), rnd.choice(langs), s))
    return rows + rows[:2] * 3 + [(None, None, "en", "no words"), (5000, "", "xx", "only"), (5001, "rare", "yy", "p"), (5002, "rare too", "yy", None)]


def test_against_brute_force(spark):
    check(spark, corpus(600, ["s1", "s2", "", None, "hot", "hot", "hot", "é"]))


def test_more_sources_than_a_tile_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 16)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PIECE", 8)
    check(spark, corpus(500, [f"s{i}" for i in range(19)], ("en",)), min_docs=5, top=3)


def test_ties_long_text_empty(spark):
    same = [(i, "b a c\n" * 3, "en", f"s{i % 4}") for i in range(40)]
    check(spark, same)
    check(spark, same + [(99, "a long text " * 200_000, "en", "s1")])
    check(spark, [])
    check(spark, [(1, None, None, None)])


def test_intersection():
    rnd = np.random.default_rng(3)
    for n, m in ((0, 0), (0, 5), (3, 500), (500, 3), (200, 200)):
        a, b = (np.unique(rnd.integers(0, 600, k)) for k in (n, m))
        at_a, at_b = divergence.intersection(a, b)
        assert list(a[at_a]) == sorted(set(a) & set(b)) == list(b[at_b])


@pytest.mark.parametrize("count", [0, 9_223_372_034, 10**15])
def test_prices_of_large_counts_are_exact(spark, count):
    total, terms = 3 * count + 7, 11
    want = 1 + 10**9 * (count + 2) // (total + 2 * terms)
    assert divergence.prices(np.array([count]), total, terms)[0] == want
    row = spark.sql(f"SELECT {count}L AS n, {total}L AS total, {terms}L AS terms").select(divergence._price_column("n", "total").alias("p")).first()
    assert row["p"] == want

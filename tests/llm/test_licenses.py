from collections import Counter

import regex

from trustfold.llm import licenses


def grams(text):
    w = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip().split(" ")
    return Counter(zip(w, w[1:]))


def brute(rows, templates, score=0.8):
    out = set()
    for i, t in set(rows):
        if t is None:
            continue
        units = list(enumerate(t.split("\n"))) + ([(-1, t)] if "\n" in t else [])
        for n, u in units:
            a, best = grams(u), None
            for k, name, text in templates:
                b = grams(text)
                if a and b:
                    d = 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
                    if d >= score and (best is None or d > best[0]):
                        best = (d, k, name)
            if best:
                out.add((i, n, best[2], best[1], round(best[0], 9)))
    return out


def test_against_all_templates(spark):
    mit = licenses.TEMPLATES[2][1]
    apache = licenses.TEMPLATES[1][1]
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!"), (3, None), (4, ""), (5, "the the the the the"),
            (6, apache), (7, apache.replace("not use", "never use")), (8, "\n".join(apache.split(" "))), (9, mit + " " + mit), (10, "Éé licence"),
            (11, "Licensed under CC BY-NC-SA 4.0."), (12, "word " * 5000), (None, mit), (13, mit), (13, mit), (14, "mit")]
    templates = [(i, *t) for i, t in enumerate(licenses.TEMPLATES)] + [(90, "twice", "go go go go stop"), (91, "one", "word"), (92, "MIT-tie", mit)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, line int").repartition(3)
    got = licenses.licenses(docs, spark.createDataFrame(templates, "template int, license string, text string"))
    found = [(r["doc_id"], r["line"], r["license"], r["template"], round(r["dice"], 9)) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, templates)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.licenses(none, licenses.default_templates(spark)).count() == 0
    some = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert licenses.licenses(some, spark.createDataFrame([], "template int, license string, text string")).count() == 0


def test_full_texts_match_as_a_whole(spark):
    """LICENSE files with a holder's name and other line breaks, and the MIT grant on one line inside a text."""
    text = dict(licenses.full_texts()[::-1])
    whole = {k: text[k].replace("<year>", "2019").replace("<copyright holder>", "A. Person").replace("<copyright holders>", "A. Person")
             for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0")}
    grant = next(t for k, t in licenses.full_texts() if k == "MIT" and t.startswith("Permission")).replace("\n", " ")
    rows = [(k, "Our project\n" + t.replace("\n", "\r\n")) for k, t in whole.items()] + [("one line", "words before\n" + grant + "\n" + "words after " * 300)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    found = {(r["doc_id"], r["line"]): r["license"] for r in licenses.licenses(docs, licenses.default_templates(spark)).collect()}
    assert {k: found.get((k, -1)) for k in whole} == {k: k for k in whole}
    assert found[("one line", 1)] == "MIT"

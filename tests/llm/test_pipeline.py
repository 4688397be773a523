"""The pipeline, stage by stage against plain Python, and the queries' contract."""

import math
import re

import pytest

import corpus_pipeline as P
from tests.conftest import SF
from tests.llm.test_decontam import score
from tests.llm.test_quality import brute
from tests.llm.test_simhash import groups


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, docs, SF).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        out.append(docs)
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1]) and set(columns) < set(stages[-1].columns)


def test_quality_stage(spark, stages):
    docs = dict(rows(spark.read.parquet(f"{SF}/documents.parquet")))
    kept = dict(rows(stages[0]))
    assert 0 < len(kept) < len(docs) and all(docs[i] == t for i, t in kept.items())
    for i, t in docs.items():
        n, _, _, _, again = brute(t)
        if n < 50 or 100 * again > 50 * n:
            assert i not in kept


def test_line_stage(stages):
    """No two of the lines that are left are equal; what is left stood there before."""
    before, after = dict(rows(stages[0])), rows(stages[1])
    seen = set()
    for i, t in after:
        old = before[i].split("\n")
        for x in t.split("\n"):
            assert x in old
            if len(x.strip(" ")) >= 12:
                assert x.strip(" ") not in seen
                seen.add(x.strip(" "))
    assert seen == {x.strip(" ") for t in before.values() for x in t.split("\n") if len(x.strip(" ")) >= 12} - near(before, seen)


def near(before, seen):
    """Lines within two edits of a line that stayed."""
    from tests.llm.test_lines import distance

    gone = {x.strip(" ") for t in before.values() for x in t.split("\n") if len(x.strip(" ")) >= 12} - seen
    return {x for x in gone if any(abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in seen)}


def test_near_duplicate_stage(stages):
    before, after = rows(stages[1]), {i for i, _ in rows(stages[2])}
    assert after == {i for i, _, c in groups(before) if i == c}


def test_decontamination_stage(spark, stages):
    words = lambda t: re.sub(r"[\W_]+", " ", t.lower()).split()
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    after = {i for i, _ in rows(stages[3])}
    for i, t in rows(stages[2]):
        w = words(t)
        leak = any(len(set(zip(x, x[1:], x[2:])) & set(zip(w, w[1:], w[2:]))) >= 2 and score(w, x) >= 0.4 for x in items)
        assert leak == (i not in after)


def test_mixing_stage(stages):
    before = dict(rows(stages[3]))
    size = {}
    for r in stages[3].collect():
        size.setdefault(r["source"], []).append(len((r["text"] or "").encode().split()))
    taken = {}
    for r in stages[4].collect():
        assert r["text"] == before[r["doc_id"]] and 1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["source_size"] == sum(size[r["source"]])
        assert abs(r["target"] - r["source_size"] * 3) < 1e-6 or r["target"] < 3 * r["source_size"]
    target = {r["source"]: r["target"] for r in stages[4].collect()}
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(size[s]) / 2 + 1e-6


def test_registered_queries(spark):
    import __spark_entry__ as E

    names = [q for q in E.queries() if q.startswith("op") or q == "pipeline"]
    assert sorted(int(m[1]) for q in names if (m := re.match(r"op(\d+)_", q))) == list(range(1, 11)) and "pipeline" in names
    scores = E.queries()["op6_maxent_lm"](spark, SF)
    assert {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"} <= set(scores.columns)
    assert all(math.isfinite(r["score"]) for r in scores.collect())

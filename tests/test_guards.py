import pytest

from trustfold.operators import detectors as D
from trustfold.operators.encode import validate_target_feature
from trustfold.operators.votes import n_top, top_n_split, vote_counts


def test_top_n_guard_all_rows_means_none(spark):
    mis = spark.createDataFrame([(1,), (2,)], "row_id long")
    votes = spark.createDataFrame([(1, 3), (2, 1)], "row_id long, votes long")
    # 2 rows * 0.75 -> round(1.5) = 2 = all rows -> nobody is intentional
    marked, intent, unint = top_n_split(mis, votes, 0.75)
    assert n_top(2, 0.75) == 2 and intent.count() == 0 and unint.count() == 2
    marked, intent, _ = top_n_split(mis, votes, 0.25)  # round(0.5) = 0 -> max(1, 0) = 1
    assert [r["row_id"] for r in intent.collect()] == [1]


def test_failing_method_is_skipped_in_votes_but_fatal_in_consensus(spark, monkeypatch):
    """The model fails in its Python worker, for one group only; the results are read, not counted."""
    from trustfold.operators import learned

    def broken(chunk_id, column, pdf):
        if column == "k":
            raise RuntimeError("broken detector")
        return real(chunk_id, column, pdf)

    real = learned._forest
    monkeypatch.setattr(learned, "_forest", broken)
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    mis = spark.createDataFrame([(i, t0 + dt.timedelta(minutes=i), float(i % 7) + 90 * (i == 5), i % 3) for i in range(60)],
                                "row_id long, Timestamp timestamp_ntz, value double, k long")
    p = D.DetectorParams(0.05, 3.0)
    with pytest.warns(UserWarning, match="IForest left out: RuntimeError: broken detector"):
        v = vote_counts(mis, p, methods=["Z-Score", "IForest"], on_error="skip")
    assert {r["row_id"]: r["votes"] for r in v.collect()} == {i: int(i == 5) for i in range(60)}
    with pytest.raises(RuntimeError, match="broken detector"):
        vote_counts(mis, p, methods=["Z-Score", "IForest"], on_error="raise")
    with pytest.raises(ValueError, match="unknown"):
        vote_counts(mis, p, methods=["No such method"], on_error="raise")


def _events(spark, folder) -> str:
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=i), i % 9, ("click", "view", "error")[i % 3], i * 37 % 101 / 7 + 300.0 * (i % 25 == 3), f'{{"k": {i * 13 % 17}}}')
            for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        f"{folder}/events.parquet")
    return str(folder)


def _fails_in_the_vote(monkeypatch, name) -> list:
    """The method's condition holds in the consensus, which comes first, and raises while the vote's rows are read."""
    from pyspark.sql import functions as F

    real, used = D.FLAGS[name], []

    def flag(p):
        used.append(name)
        return real(p) if len(used) == 1 else F.raise_error(F.lit("broken in the vote")).cast("boolean")

    monkeypatch.setitem(D.FLAGS, name, flag)
    return used


@pytest.mark.parametrize("query", ["final_reputation_all_methods", "final_reputation_unsupervised", "vote_counts", "vote_topn_split",
                                   "vote_split_guard"])
def test_a_method_that_fails_in_the_vote_fails_the_query(spark, monkeypatch, tmp_path, query):
    """A vote without one of its methods is not the query's answer, and has the same columns and rows as the whole one."""
    from trustfold.plans.catalog import QUERIES

    used = _fails_in_the_vote(monkeypatch, "MAD")
    with pytest.raises(Exception, match="broken in the vote"):
        QUERIES[query](spark, _events(spark, tmp_path)).collect()
    assert len(used) == 2


def test_a_model_that_fails_in_the_vote_fails_the_query(spark, monkeypatch, tmp_path):
    from trustfold.operators import learned
    from trustfold.plans.catalog import QUERIES

    real, fits = learned.fit_machines, []

    def fit(long, stats):
        fits.append(1)
        return real(long, stats) if len(fits) == 1 else ({}, ["broken in the vote"])

    monkeypatch.setattr(learned, "fit_machines", fit)
    with pytest.raises(RuntimeError, match="OC-SVM: broken in the vote"):
        QUERIES["final_reputation_all_methods"](spark, _events(spark, tmp_path)).collect()


def test_the_vote_of_a_run_skips_a_failing_method_if_told_to(spark, monkeypatch, tmp_path):
    from trustfold.params import scenario
    from trustfold.plans.pipeline import unsupervised_sources
    from trustfold.sources.tables import load_log

    log = load_log(spark, _events(spark, tmp_path))
    _fails_in_the_vote(monkeypatch, "MAD")
    with pytest.warns(UserWarning, match="MAD left out"):
        sources = unsupervised_sources(log, scenario(1), methods=["Z-Score", "MAD"], on_error="skip")
    assert sources.count() == 300


def test_validate_target_feature_rejects_nulls_and_label_encodes(spark):
    ok = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", 3.0)], "c string, y double")
    enc, target = validate_target_feature(ok, "y")
    assert target == "y" and sorted(r["c"] for r in enc.collect()) == [0, 1, 1]
    bad = spark.createDataFrame([("b", None), ("a", 2.0)], "c string, y double")
    with pytest.raises(ValueError, match="y"):
        validate_target_feature(bad, "y")

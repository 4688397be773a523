import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustfold.operators import detectors as D

P = D.DetectorParams(contamination=0.05, threshold=2.0)


def _long(spark, n=150):
    vals = np.round(np.random.default_rng(2).normal(size=n), 2)
    rows = [(c, i, "x", float(v)) for c in (0, 1) for i, v in enumerate(vals)] + [(0, n, "x", 40.0), (1, n, "x", -40.0)]
    return spark.createDataFrame(rows, "chunk_id int, row_id long, column string, value double")


FAR = D.Detector("Far", lambda p: F.abs(F.col("value") - F.col("_centre")) > 10 * p.threshold,
                 lambda rows: rows.groupBy(*D.G).agg(F.avg("value").alias("_centre")))
NEGATIVE = D.Detector("Negative", rows=lambda long, p: long.select(*D.KEYS, (F.col("value") < -30).alias("is_outlier")))


def flagged(out, name):
    return {(r["chunk_id"], r["row_id"]) for r in out.collect() if r["mask"] & D.bit(name)}


def test_registered_detectors_take_part(spark):
    long = _long(spark)
    with D.registered(FAR, NEGATIVE):
        assert D.known()[-2:] == ("Far", "Negative") and D.bit("Negative") == 1 << 9
        out, used = D.masks(long, P, ["Negative", "Z-Score", "Far"])
        assert used == ["Negative", "Z-Score", "Far"]
        assert flagged(out, "Far") == {(0, 150), (1, 150)} and flagged(out, "Negative") == {(1, 150)}
        assert {(0, 150), (1, 150)} <= flagged(out, "Z-Score")
        votes = D.detect(long, P, "Far").where("is_outlier").count()
        assert votes == 2
    assert D.known() == D.METHODS


def test_registry_refuses_what_it_cannot_number(spark):
    with pytest.raises(ValueError), D.registered(D.Detector("MAD", lambda p: F.lit(True))):
        pass
    with pytest.raises(ValueError):
        D.register(D.Detector("none"))
    with pytest.raises(ValueError), D.registered(*[D.Detector(f"d{i}", lambda p: F.lit(False)) for i in range(30)]):
        pass
    assert D.known() == D.METHODS
    clash = D.Detector("Clash", lambda p: F.lit(False), lambda rows: rows.groupBy(*D.G).agg(F.avg("value").alias("_mean")))
    with D.registered(clash), pytest.raises(ValueError, match="_mean"):
        D.masks(_long(spark), P, ["Z-Score", "Clash"])


@pytest.mark.parametrize("name", D.METHODS)
def test_any_method_that_fails_at_run_time_is_left_out(spark, monkeypatch, name):
    """The condition raises while rows are read; with "skip" the other methods' masks come out whole."""
    long = _long(spark, 60)
    others = [m for m in ("Z-Score", "HBOS") if m != name][:1]
    want = {(r["chunk_id"], r["row_id"], r["mask"]) for r in D.masks(long, P, others)[0].collect()}
    monkeypatch.setitem(D.FLAGS, name, lambda p: F.raise_error(F.lit("broken")).cast("boolean"))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        out, used = D.masks(long, P, [name, *others], "skip")
    assert used == others and any(name in str(w.message) for w in seen)
    assert {(r["chunk_id"], r["row_id"], r["mask"]) for r in out.collect()} == want
    with pytest.raises(Exception, match="broken"):
        D.masks(long, P, [name, *others])[0].collect()


def test_a_caller_s_broken_rows_are_left_out_of_the_vote(spark):
    from trustfold.operators.votes import vote_counts

    broken = D.Detector("Broken", rows=lambda long, p: long.select(*D.KEYS, F.raise_error(F.lit("no")).cast("boolean").alias("is_outlier")))
    mis = _long(spark, 40).where("chunk_id = 0").select("row_id", "value")
    with D.registered(broken), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        votes = vote_counts(mis, P, columns=("value",), methods=["Z-Score", "Broken"])
    assert votes.where("votes = 1").count() >= 1 and votes.count() == 41

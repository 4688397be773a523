"""Report tables over written result files, of the shapes that a finished run leaves."""

import random

import pytest
from pyspark.sql import functions as F

from trustfold.operators.consensus import by_method
from trustfold.plans.reports import MODEL_ORDER, STAGE_FILES, model_comparison, reputation_comparison
from trustfold.sources.io import load_csv


def _write(folder, name, header, rows):
    text = "\n".join([",".join(header), *(",".join(map(str, r)) for r in rows)]) + "\n"
    (folder / f"{name}.csv").write_text(text)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nine_way_join(spark, tmp_path, seed):
    """Ids with and without their prefix, names with blanks, a user that one stage lacks."""
    rnd = random.Random(seed)
    users = list(range(1, 13))
    values = {name: {u: round(rnd.random(), 12) for u in users} for _, name in STAGE_FILES}
    for k, (file, name) in enumerate(STAGE_FILES):
        ids = [u for u in users if not (k == 4 and u == 7)]
        rnd.shuffle(ids)
        shown = (lambda u: u) if k % 3 == 0 else (lambda u: f"User_{u:02d}")
        _write(tmp_path, file, ["User_Id", " Final_Reputation " if k % 2 else "Value"], [(shown(u), values[name][u]) for u in ids])
    got = reputation_comparison(spark, str(tmp_path)).collect()
    assert list(got[0].asDict()) == ["User_Id", *[name for _, name in STAGE_FILES]]
    assert [r["User_Id"] for r in got] == [u for u in users if u != 7]
    for r in got:
        assert all(abs(r[name] - values[name][r["User_Id"]]) < 1e-12 for _, name in STAGE_FILES)


def test_two_value_columns_are_refused(spark, tmp_path):
    for file, _ in STAGE_FILES:
        _write(tmp_path, file, ["User_Id", "a", "b"], [(1, 0.1, 0.2)])
    with pytest.raises(ValueError, match="one value column"):
        reputation_comparison(spark, str(tmp_path))


FIRST = {"TPOT (Raw)": 0.0034, "TPOT (Supervised)": 0.0, "TPOT (Unsupervised)": 0.0,
         "FLAML (Raw)": 0.0307, "FLAML (Supervised)": -0.0164, "FLAML (Unsupervised)": -0.0007}
SECOND = {"TPOT (Raw)": 0.0050, "TPOT (Supervised)": 0.0116, "TPOT (Unsupervised)": 0.0111,
          "FLAML (Raw)": 0.0181, "FLAML (Supervised)": 0.0146, "FLAML (Unsupervised)": 0.0079}


def _entry(label, score):
    engine, run = label[:-1].split(" (")
    e, run = engine.lower(), run.lower()
    name = f"final_raw_{e}.py" if run == "raw" else f"final_processed_{run}_{e}.py"
    return e, name, score


def test_best_score_of_each_model(spark, tmp_path):
    rows = [_entry(k, v) for k, v in FIRST.items()] + [_entry(k, v) for k, v in SECOND.items()]
    rows += [rows[0], ("TPOT", " runs/FINAL_RAW_TPOT.py ", 0.001), ("tpot", "final_raw_tpot.txt", 9), ("tpot", "", 9), ("flaml", "final_raw_flaml.py", "n/a"),
             ("flaml", "final_raw_tpot.py", 9), ("other", "other.py", 9)]
    _write(tmp_path, "model_results", ["prefix", "pipeline_file", "score"], rows)
    ledger = load_csv(spark, str(tmp_path), "model_results", schema="prefix string, pipeline_file string, score string")
    got = model_comparison(ledger).collect()
    assert [r["engine_run_type"] for r in got] == MODEL_ORDER
    assert {r["engine_run_type"]: r["score"] for r in got} == {k: max(FIRST[k], SECOND[k]) for k in FIRST}
    # an infinite best score leaves its model out
    more = ledger.unionByName(spark.createDataFrame([("tpot", "final_raw_tpot.py", "Infinity")], ledger.schema))
    assert [r["engine_run_type"] for r in model_comparison(more).collect()] == MODEL_ORDER[1:]


def test_percent_by_method(spark, tmp_path):
    """Totals per method and their percent of the grand total."""
    totals = {"MAD": 277995, "IQR": 31000, "HBOS": 12005, "kNN": 0}
    _write(tmp_path, "outlier_summary_by_method", ["method", "total_removed"], totals.items())
    rows = load_csv(spark, str(tmp_path), "outlier_summary_by_method", schema="method string, total_removed long")
    got = {r["method"]: (r["total_removed"], r["percent"]) for r in by_method(rows.select("method", F.col("total_removed").alias("outliers_removed"))).collect()}
    assert got == {m: (n, round(100 * n / 321000, 6)) for m, n in totals.items()}
    assert {r["percent"] for r in by_method(rows.where("total_removed = 0").select("method", F.col("total_removed").alias("outliers_removed"))).collect()} == {0.0}

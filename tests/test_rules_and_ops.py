from tests.conftest import SF
from trustfold.functions.rules import BEHAVIOUR_LOG_RULES, EVENT_RULES, label
from trustfold.operators import encode as E
from trustfold.operators import impute as I
from trustfold.operators import sampling as S
from trustfold.operators.schema import column_kinds, require_columns
from trustfold.sources.tables import load_log


def test_event_rules_priority_and_nulls(spark):
    rows = [(1, "error", 500.0, 1), (2, "view", 151.0, 50), (3, "view", 10.0, 2), (4, "view", 10.0, 3), (5, None, None, None)]
    df = spark.createDataFrame(rows, "row_id long, event_type string, value double, k long")
    got = {r["row_id"]: r["True_Class"] for r in label(df, EVENT_RULES).collect()}
    assert got == {1: "Intentional", 2: "Unintentional", 3: "Unintentional", 4: "Normal", 5: "Normal"}


def test_behaviour_log_rules(spark):
    schema = ("User_Activity string, University_Area string, Road_Accident int, Road_Type string, Speed_Limit int, "
              "Violation_Type string, Battery_Percentage int, Internet_Signal_Strength string, Accelerometer_Range int, "
              "Accelerometer_Resolution string, Latitude double, Longitude double")
    base = ["Walking", "Zep", 0, "1way", 50, "Speeding", 50, "-80", 0, "0.005", 40.0, 20.0]
    rows = [list(base) for _ in range(5)]
    rows[1][0] = "Flying"            # intentional
    rows[2][6] = 101                 # battery breach
    rows[3][7] = "weak"              # non-numeric signal is not a breach
    rows[4][0] = "Swimming"; rows[4][10] = 50.0  # both: intentional wins
    df = spark.createDataFrame([tuple(r) for r in rows], schema)
    got = [r["True_Class"] for r in label(df, BEHAVIOUR_LOG_RULES).collect()]
    assert got == ["Normal", "Intentional", "Unintentional", "Normal", "Intentional"]


def test_impute_median_mode_ties_smallest(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, None), (10.0, "b"), (None, "a")], "x double, c string")
    out = I.impute(df).collect()
    assert [r["x"] for r in out] == [1.0, 3.0, 3.0, 10.0, 3.0]
    assert [r["c"] for r in out] == ["b", "a", "a", "b", "a"]


def test_scalers_population_std_and_constant_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    std = E.fit_scaler(df, ["a", "b"], "standard").transform(df).collect()
    assert [round(r["a"], 9) for r in std] == [-1.0, 1.0] and [r["b"] for r in std] == [0.0, 0.0]
    mm = E.fit_scaler(df, ["a", "b"], "minmax").transform(df).collect()
    assert [r["a"] for r in mm] == [0.0, 1.0] and [r["b"] for r in mm] == [0.0, 0.0]


def test_onehot_unseen_is_all_zero_and_label_codes_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("z",)], "c string")
    oh = E.onehot(df, "c", cats=["a", "b"]).collect()
    assert [(r["c_a"], r["c_b"]) for r in oh] == [(0.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    codes = {r["c"] for r in E.label_encode(df, "c").collect()}
    assert codes == {0, 1, 2}


def test_disjoint_samples_exact_sizes(spark):
    log = load_log(spark, SF)
    n = log.count()
    sets = S.disjoint_samples(log, 0.05, 0.1, 0.2)
    got = {r["sample_set"]: r["count"] for r in sets.groupBy("sample_set").count().collect()}
    both = int(n * 0.05)
    assert got["both"] == both and got["A"] == int(n * 0.1) - both and got["B"] == int(n * 0.2) - both
    assert sum(got.values()) == n


def test_seeded_sample_stable_across_partitionings(spark):
    log = load_log(spark, SF)
    a = {r["row_id"] for r in S.seeded_sample(log, 50).collect()}
    b = {r["row_id"] for r in S.seeded_sample(log.repartition(13), 50).collect()}
    assert a == b and len(a) == 50


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 1, "y"), (2, 5, "z")], "k int, t int, v string")
    got = {r["k"]: r["v"] for r in S.first_per_key(df, ["k"], ["t"]).collect()}
    assert got == {1: "y", 2: "z"}


def test_schema_helpers(spark):
    log = load_log(spark, SF)
    kinds = dict(column_kinds(log, target="User_Reputation"))
    assert kinds["event_type"] == "categorical" and kinds["value"] == "numerical" and kinds["Timestamp"] == "unknown"
    try:
        require_columns(log, ["nope"])
        raise AssertionError("expected ValueError")
    except ValueError as e:
        assert "nope" in str(e)

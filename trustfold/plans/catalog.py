"""Query catalogue: every operator of the blueprint as a named query over the
driver's tables, with its DuckDB oracle where one exists.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over whole
tables.  Doubles are rounded to 6 places on both sides; integers are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustfold.functions.rules import LABEL_SQL, class_counts, label
from trustfold.operators import consensus as C
from trustfold.operators import detectors as D
from trustfold.operators.reputation import (
    capped_experience, first_in_time, replay_scenario_users, replay_scenarios, replay_trace, replay_users, source_from_class)
from trustfold.operators.votes import top_n_split, vote_counts
from trustfold.params import SCENARIOS, scenario
from trustfold.plans import oracle as O
from trustfold.sources.tables import LOG_BLANK_SQL, LOG_SQL, ROW_ID, TS, USER, behaviour_log, load_log, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

P1 = scenario(1)
P2 = scenario(2)
DP = D.DetectorParams.from_scenario(P1)
SEED = "42"


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def r6(c):
    return F.round(c, 6)


def labelled(spark, sf):
    log = load_log(spark, sf)
    return label(log).withColumn("Dataset_Source", source_from_class())


def seeded_order_sql(key: str = "row_id", seed: str = SEED) -> str:
    return f"md5(concat_ws('#', '{seed}', CAST({key} AS VARCHAR))), {key}"


# --------------------------------------------------------------- labelling C1-C4
@query("label_events", f"""SELECT row_id, User_Id, "Timestamp", event_type, value, k, {LABEL_SQL} AS True_Class FROM {LOG_SQL} t""")
def q_label_events(spark, sf):
    return label(load_log(spark, sf)).select(ROW_ID, USER, TS, "event_type", "value", "k", "True_Class")


@query("label_counts", f"""WITH l AS (SELECT *, {LABEL_SQL} AS True_Class FROM {LOG_SQL} t),
  s AS (SELECT * FROM l ORDER BY {seeded_order_sql()} LIMIT {P1.ground_sample_size}),
  a AS (SELECT True_Class, count(*) AS n_full FROM l GROUP BY 1),
  b AS (SELECT True_Class, count(*) AS n_sample FROM s GROUP BY 1)
SELECT True_Class, COALESCE(n_full, 0) AS n_full, COALESCE(n_sample, 0) AS n_sample FROM a FULL JOIN b USING (True_Class)""")
def q_label_counts(spark, sf):
    lab = label(load_log(spark, sf))
    return class_counts(lab, S.seeded_sample(lab, P1.ground_sample_size))


# --------------------------------------------------------------- replay W1-W3, K10, A5
def _fold_sql(p, src="Dataset_Source") -> str:
    return O.step_lambda(p.normal_increment, p.unintentional_penalty, p.intentional_penalty)


@query("final_reputation", f"""WITH l AS {O.LABELLED},
  agg AS (SELECT User_Id, arg_min(User_Reputation, ("Timestamp", row_id)) AS r0,
                 list(Dataset_Source ORDER BY "Timestamp", row_id) AS srcs FROM l GROUP BY User_Id)
SELECT User_Id, round(r0, 6) AS Original_Reputation, round(list_reduce(srcs, {_fold_sql(P1)}, r0), 6) AS Final_Reputation FROM agg""")
def q_final_reputation(spark, sf):
    per_user = replay_users(labelled(spark, sf), P1)
    return per_user.select(USER, r6(F.col("Original_Reputation")).alias("Original_Reputation"), r6(F.col("Final_Reputation")).alias("Final_Reputation"))


_TRACE_SQL = f"""WITH l AS {O.LABELLED},
  w AS (SELECT row_id, User_Id, "Timestamp", Dataset_Source,
               first_value(User_Reputation) OVER (PARTITION BY User_Id ORDER BY "Timestamp", row_id) AS r0,
               list(Dataset_Source) OVER (PARTITION BY User_Id ORDER BY "Timestamp", row_id
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS srcs FROM l)"""


@query("reputation_trace", _TRACE_SQL + f"""
SELECT row_id, User_Id, "Timestamp", Dataset_Source, round(list_reduce(srcs, {_fold_sql(P1)}, r0), 6) AS new_reputation FROM w""")
def q_reputation_trace(spark, sf):
    trace = replay_trace(labelled(spark, sf), P1)
    return trace.select(ROW_ID, USER, TS, "Dataset_Source", r6(F.col("new_reputation")).alias("new_reputation"))


@query("reputation_carry_over", f"""WITH l AS {O.LABELLED},
  agg AS (SELECT User_Id, arg_min(User_Reputation, ("Timestamp", row_id)) AS r0,
                 list(Dataset_Source ORDER BY "Timestamp", row_id) AS srcs FROM l GROUP BY User_Id)
SELECT User_Id, round(list_reduce(srcs, {_fold_sql(P2)}, list_reduce(srcs, {_fold_sql(P1)}, r0)), 6) AS Final_Reputation FROM agg""")
def q_reputation_carry_over(spark, sf):
    lab = labelled(spark, sf)
    first = replay_users(lab, P1)
    second = replay_users(lab, P2, initial=first)
    return second.select(USER, r6(F.col("Final_Reputation")).alias("Final_Reputation"))


def _each_scenario_sql(select) -> str:
    return " UNION ALL ".join(select(p) for p in SCENARIOS.values())


@query("reputation_by_scenario", f"""WITH l AS {O.LABELLED},
  agg AS (SELECT User_Id, arg_min(User_Reputation, ("Timestamp", row_id)) AS r0,
                 list(Dataset_Source ORDER BY "Timestamp", row_id) AS srcs FROM l GROUP BY User_Id)
""" + _each_scenario_sql(lambda p: f"SELECT {p.scenario_id} AS scenario_id, User_Id, round(r0, 6) AS Original_Reputation, "
                                   f"round(list_reduce(srcs, {_fold_sql(p)}, r0), 6) AS Final_Reputation FROM agg"))
def q_reputation_by_scenario(spark, sf):
    """W2-W3 under all scenarios, in one range sort of the log."""
    users = replay_scenario_users(labelled(spark, sf), list(SCENARIOS.values()))
    return users.select("scenario_id", USER, r6(F.col("Original_Reputation")).alias("Original_Reputation"), r6(F.col("Final_Reputation")).alias("Final_Reputation"))


@query("trace_by_scenario", _TRACE_SQL + _each_scenario_sql(
    lambda p: f"""SELECT {p.scenario_id} AS scenario_id, row_id, User_Id, "Timestamp", Dataset_Source, round(list_reduce(srcs, {_fold_sql(p)}, r0), 6) AS new_reputation FROM w"""))
def q_trace_by_scenario(spark, sf):
    """W1 under all scenarios, in one range sort of the log."""
    trace = replay_scenarios(labelled(spark, sf), list(SCENARIOS.values()))
    return trace.select("scenario_id", ROW_ID, USER, TS, "Dataset_Source", r6(F.col("new_reputation")).alias("new_reputation"))


@query("kafka_payload", _TRACE_SQL + f"""
SELECT CAST(User_Id AS VARCHAR) AS "key",
       to_json(struct_pack(user_id := CAST(User_Id AS VARCHAR),
                           new_reputation := round(list_reduce(srcs, {_fold_sql(P1)}, r0), 6),
                           dataset_source := Dataset_Source,
                           "timestamp" := strftime("Timestamp", '%Y-%m-%dT%H:%M:%S')
                                          || CASE WHEN epoch_us("Timestamp") % 1000000 = 0 THEN ''
                                                  ELSE strftime("Timestamp", '.%f') END)) AS "value"
  FROM w""")
def q_kafka_payload(spark, sf):
    from trustfold.streaming.sink import kafka_frame

    trace = replay_trace(labelled(spark, sf), P1)
    return kafka_frame(trace.withColumn("new_reputation", r6(F.col("new_reputation"))))


@query("baseline_by_user", f"""SELECT User_Id, round(arg_min(User_Reputation, ("Timestamp", row_id)), 6) AS Original_Reputation,
       round(arg_min(value, ("Timestamp", row_id)), 6) AS first_value FROM {LOG_SQL} t GROUP BY User_Id""")
def q_baseline_by_user(spark, sf):
    log = load_log(spark, sf)
    out = log.groupBy(USER).agg(first_in_time("User_Reputation").alias("Original_Reputation"), first_in_time("value").alias("first_value"))
    return out.select(USER, r6(F.col("Original_Reputation")).alias("Original_Reputation"), r6(F.col("first_value")).alias("first_value"))


# Fixed rule of the test mapping: every 9th event has no time, every 13th no user.
_GAPS_SQL = f"""(SELECT * REPLACE (CASE WHEN row_id % 13 = 0 THEN NULL ELSE User_Id END AS User_Id,
                        CASE WHEN row_id % 9 = 0 THEN NULL ELSE "Timestamp" END AS "Timestamp") FROM {O.LABELLED} g)"""


def _with_gaps(spark, sf):
    return labelled(spark, sf).withColumns({
        USER: F.when(F.col(ROW_ID) % 13 != 0, F.col(USER)), TS: F.when(F.col(ROW_ID) % 9 != 0, F.col(TS))})


@query("reputation_with_gaps", f"""WITH l AS {_GAPS_SQL},
  w AS (SELECT *, first_value(User_Reputation) OVER u AS r0,
               row_number() OVER u AS n, list(Dataset_Source) OVER (PARTITION BY User_Id ORDER BY "Timestamp" NULLS LAST, row_id
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS srcs FROM l
         WINDOW u AS (PARTITION BY User_Id ORDER BY "Timestamp" NULLS LAST, row_id))
SELECT row_id, COALESCE(User_Id, -1) AS User_Id, "Timestamp", round(list_reduce(srcs, {_fold_sql(P1)}, r0), 6) AS new_reputation,
       round(least({O.d(1.0)}, User_Experience + {O.d(0.001)} * n), 4) AS User_Experience FROM w""")
def q_reputation_with_gaps(spark, sf):
    """W1 and W4 over a log whose times and users have nulls: null times come last, a null user is a user."""
    log = _with_gaps(spark, sf)
    exp = capped_experience(log).select(ROW_ID, "User_Experience")
    user = F.coalesce(USER, F.lit(-1)).alias(USER)
    return replay_trace(log, P1).select(ROW_ID, user, TS, r6(F.col("new_reputation")).alias("new_reputation")).join(exp, ROW_ID)


@query("final_with_gaps", f"""WITH l AS {_GAPS_SQL},
  agg AS (SELECT User_Id, list(User_Reputation ORDER BY "Timestamp" NULLS LAST, row_id)[1] AS r0,
                 list(Dataset_Source ORDER BY "Timestamp" NULLS LAST, row_id) AS srcs FROM l GROUP BY User_Id)
SELECT COALESCE(User_Id, -1) AS User_Id, round(r0, 6) AS Original_Reputation, round(list_reduce(srcs, {_fold_sql(P1)}, r0), 6) AS Final_Reputation FROM agg""")
def q_final_with_gaps(spark, sf):
    per_user = replay_users(_with_gaps(spark, sf), P1)
    return per_user.select(F.coalesce(USER, F.lit(-1)).alias(USER), r6(F.col("Original_Reputation")).alias("Original_Reputation"), r6(F.col("Final_Reputation")).alias("Final_Reputation"))


_EXP_SQL = f"""SELECT row_id, User_Id,
       round(least({O.d(1.0)}, User_Experience + {O.d(0.001)} * row_number() OVER (PARTITION BY User_Id ORDER BY "Timestamp", row_id)), 4) AS User_Experience
  FROM {LOG_SQL} t"""


@query("capped_experience", _EXP_SQL)
def q_capped_experience(spark, sf):
    return capped_experience(load_log(spark, sf)).select(ROW_ID, USER, "User_Experience")


@query("max_by_user", f"SELECT User_Id, max(User_Experience) AS max_experience FROM ({_EXP_SQL}) e GROUP BY User_Id")
def q_max_by_user(spark, sf):
    return capped_experience(load_log(spark, sf)).groupBy(USER).agg(F.max("User_Experience").alias("max_experience"))


@query("median_by_user", """SELECT o_custkey AS User_Id, round(median(o_totalprice), 6) AS median_price,
       count(*) AS n_orders FROM orders GROUP BY o_custkey""")
def q_median_by_user(spark, sf):
    from trustfold.operators.aggregates import median_per_key

    o = read_table(spark, sf, "orders").withColumnRenamed("o_custkey", USER)
    med = median_per_key(o, USER, ["o_totalprice"], ["median_price"]).select(USER, r6(F.col("median_price")).alias("median_price"))
    return med.join(o.groupBy(USER).agg(F.count(F.lit(1)).alias("n_orders")), USER)


# --------------------------------------------------------------- outliers D, G, R1
def _chunked(spark, sf):
    return C.chunk(load_log(spark, sf))


def _long(spark, sf):
    long, _ = C.detection_frame(_chunked(spark, sf))
    return long


_CH = O.chunked(f"{LOG_SQL}")
_LONG = O.long_form(_CH)


@query("chunks", f"SELECT row_id, chunk_id FROM {_CH} c")
def q_chunks(spark, sf):
    return _chunked(spark, sf).select(ROW_ID, "chunk_id")


@query("fill_per_chunk", f"""SELECT chunk_id, row_id, "column", round(value, 6) AS value FROM {O.long_form(O.chunked(LOG_BLANK_SQL))} f""")
def q_fill_per_chunk(spark, sf):
    """I4: blank cells take their chunk's and column's median."""
    long, _ = C.detection_frame(C.chunk(load_log(spark, sf, blank_cells=True)))
    return long.select("chunk_id", ROW_ID, "column", r6(F.col("value")).alias("value"))


def _detector_query(name, method, sqlfn, arg):
    @query(name, f"SELECT chunk_id, row_id, \"column\", is_outlier FROM {sqlfn(_LONG, arg)} d")
    def q(spark, sf):
        return D.detect(_long(spark, sf), DP, method)

    return q


_detector_query("zscore", "Z-Score", O.zscore, DP.threshold)
_detector_query("iqr", "IQR", O.iqr, DP.threshold)
_detector_query("mad", "MAD", O.mad, DP.threshold)
_detector_query("hbos", "HBOS", O.hbos, DP.contamination)
_detector_query("knn20", "kNN", O.knn, DP.contamination)
_detector_query("loda", "LODA", O.loda, DP.contamination)


def _consensus(spark, sf):
    return C.consensus(load_log(spark, sf), DP, methods=list(D.SQL_CHECKABLE))


_CONS = "WITH " + O.consensus_ctes(P1)


@query("outlier_metrics", _CONS + """
SELECT chunk_id, "column", method, original_size, outliers_removed, cleaned_size FROM met""")
def q_outlier_metrics(spark, sf):
    return _consensus(spark, sf)["metrics"].drop("priority")


@query("best_method", _CONS + """
SELECT chunk_id, "column", method, outliers_removed FROM bst""")
def q_best_method(spark, sf):
    return _consensus(spark, sf)["best"].select("chunk_id", "column", "method", "outliers_removed")


@query("consensus_split", _CONS + """
SELECT row_id, User_Id, 'Normal' AS Split FROM normal UNION ALL SELECT row_id, User_Id, 'Misbehaving' FROM mis""")
def q_consensus_split(spark, sf):
    split = F.when(F.col("is_misbehaving"), F.lit("Misbehaving")).otherwise(F.lit("Normal"))
    return _consensus(spark, sf)["tagged"].select(ROW_ID, USER, split.alias("Split"))


@query("outlier_ids", _CONS + """
SELECT chunk_id, "column", method, row_id FROM flg WHERE is_outlier""")
def q_outlier_ids(spark, sf):
    """The rows that each method removes, as rows."""
    c = _consensus(spark, sf)
    return C.outlier_ids(c["masks"], c["methods"])


@query("misbehaving_by_time", _CONS + """
SELECT row_id, User_Id, "Timestamp", row_number() OVER (ORDER BY "Timestamp", row_id) - 1 AS place FROM mis""")
def q_misbehaving_by_time(spark, sf):
    """The misbehaving rows in time order, each with its place."""
    from trustfold.operators.sampling import time_order
    from trustfold.plans.ordered import global_row_number

    mis = _consensus(spark, sf)["misbehaving"].select(ROW_ID, USER, TS)
    return time_order(global_row_number(mis, [TS, ROW_ID], out="place"))


@query("outlier_summary", _CONS + """
SELECT o AS original_rows, c AS cleaned_rows, o - c AS unique_removed,
       CASE WHEN o = 0 THEN 0.0 ELSE round((o - c) / o * 100, 6) END AS percent_removed
  FROM (SELECT (SELECT count(*) FROM lg) AS o, (SELECT count(*) FROM normal) AS c) s""")
def q_outlier_summary(spark, sf):
    return C.summary(_consensus(spark, sf)["tagged"])


@query("outliers_by_method", _CONS + """
SELECT method, total_removed, CASE WHEN sum(total_removed) OVER () = 0 THEN 0.0
       ELSE round(total_removed / sum(total_removed) OVER () * 100, 6) END AS percent
  FROM (SELECT method, CAST(sum(outliers_removed) AS BIGINT) AS total_removed FROM met GROUP BY method) t""")
def q_outliers_by_method(spark, sf):
    return C.by_method(_consensus(spark, sf)["metrics"])


# Two detectors of a caller's own. Fixed values of the test: a band of twice the inner 90% of a group's values; a value that occurs once.
def _band_sql(src: str, _) -> str:
    return f"""(SELECT chunk_id, row_id, "column", value < lo - (hi - lo) / 2 OR value > hi + (hi - lo) / 2 AS is_outlier
   FROM (SELECT *, quantile_cont(value, {O.d(0.05)}) OVER ({O.W}) AS lo, quantile_cont(value, {O.d(0.95)}) OVER ({O.W}) AS hi FROM {src} u0) u1)"""


def _rare_sql(src: str, _) -> str:
    return f"""(SELECT chunk_id, row_id, "column", count(*) OVER (PARTITION BY chunk_id, "column", value) = 1 AND value > {O.d(400.0)} AS is_outlier FROM {src} v0)"""


def _own_detectors() -> tuple[D.Detector, ...]:
    from trustfold.plans.percentiles import group_percentiles

    half = (F.col("_band_hi") - F.col("_band_lo")) / 2
    ends = lambda rows: group_percentiles(rows, D.G, {"_band_lo": (F.col("value"), 0.05), "_band_hi": (F.col("value"), 0.95)})

    def rare(long, p):
        once = long.groupBy(*D.G, "value").agg(F.count(F.lit(1)).alias("_times"), F.min(ROW_ID).alias(ROW_ID)).where("_times = 1 AND value > 400")
        return once.select(*D.KEYS, F.lit(True).alias("is_outlier"))

    return (D.Detector("Band", lambda p: (F.col("value") < F.col("_band_lo") - half) | (F.col("value") > F.col("_band_hi") + half), ends),
            D.Detector("Rare", rows=rare))


_OWN_CTES = "WITH " + O.consensus_ctes(P1, own={"Band": (8, _band_sql), "Rare": (9, _rare_sql)})


@query("own_detector_metrics", _OWN_CTES + """
SELECT m.chunk_id, m."column", m.method, m.outliers_removed, b.method = m.method AS best FROM met m JOIN bst b USING (chunk_id, "column")""")
def q_own_detector_metrics(spark, sf):
    """Two registered detectors in the consensus, one by statistics and condition, one by rows."""
    with D.registered(*_own_detectors()):
        c = C.consensus(load_log(spark, sf), DP, methods=[*D.SQL_CHECKABLE, "Band", "Rare"])
    best = c["best"].select("chunk_id", "column", F.col("method").alias("_best"))
    return c["metrics"].join(F.broadcast(best), ["chunk_id", "column"]).select(
        "chunk_id", "column", "method", "outliers_removed", (F.col("method") == F.col("_best")).alias("best"))


@query("vote_counts", _CONS + ",\n  " + O.vote_ctes(P1) + """
SELECT row_id, votes FROM votes""")
def q_vote_counts(spark, sf):
    c = _consensus(spark, sf)
    return vote_counts(c["misbehaving"], DP, methods=list(D.SQL_CHECKABLE), on_error="raise")


@query("vote_topn_split", _CONS + ",\n  " + O.vote_ctes(P1) + """
SELECT row_id, votes, Is_Intentional FROM marks""")
def q_vote_topn_split(spark, sf):
    c = _consensus(spark, sf)
    votes = vote_counts(c["misbehaving"], DP, methods=list(D.SQL_CHECKABLE), on_error="raise")
    marked, _, _ = top_n_split(c["misbehaving"], votes, P1.intentional_perc)
    return marked.select(ROW_ID, "votes", F.col("Is_Intentional").cast("int").alias("Is_Intentional"))


@query("vote_split_guard", _CONS + ",\n  " + O.vote_ctes(P1.with_(intentional_perc=1.0)) + """
SELECT row_id, votes, Is_Intentional FROM marks""")
def q_vote_split_guard(spark, sf):
    """If all rows would be in the top N, none is intentional."""
    c = _consensus(spark, sf)
    votes = vote_counts(c["misbehaving"], DP, methods=list(D.SQL_CHECKABLE), on_error="raise")
    marked, _, _ = top_n_split(c["misbehaving"], votes, 1.0)
    return marked.select(ROW_ID, "votes", F.col("Is_Intentional").cast("int").alias("Is_Intentional"))


# --------------------------------------------------------------- unsupervised replay, reports
from trustfold.plans import reports as R  # noqa: E402
from trustfold.plans.pipeline import unsupervised_sources  # noqa: E402

_UNSUP_CTES = _CONS + ",\n  " + O.vote_ctes(P1) + """,
  unsup AS (SELECT lg.*, 'normal' AS Dataset_Source FROM lg WHERE row_id IN (SELECT row_id FROM normal)
            UNION ALL
            SELECT lg.*, CASE WHEN m.Is_Intentional = 1 THEN 'intentional' ELSE 'unintentional' END
              FROM lg JOIN marks m USING (row_id))"""


def _unsup(spark, sf):
    return unsupervised_sources(load_log(spark, sf), P1, methods=list(D.SQL_CHECKABLE))


@query("final_reputation_unsupervised", _UNSUP_CTES + f""",
  agg AS (SELECT User_Id, arg_min(User_Reputation, ("Timestamp", row_id)) AS r0,
                 list(Dataset_Source ORDER BY "Timestamp", row_id) AS srcs FROM unsup GROUP BY User_Id)
SELECT User_Id, round(r0, 6) AS Original_Reputation, round(list_reduce(srcs, {_fold_sql(P1)}, r0), 6) AS Final_Reputation FROM agg""")
def q_final_reputation_unsupervised(spark, sf):
    per_user = replay_users(_unsup(spark, sf), P1)
    return per_user.select(USER, r6(F.col("Original_Reputation")).alias("Original_Reputation"), r6(F.col("Final_Reputation")).alias("Final_Reputation"))


_SERIES = ["normal_sup", "unintentional_sup", "intentional_sup", "normal_unsup", "unintentional_unsup", "intentional_unsup"]


def _rolling_sql(c: str, n: int = 7, non_null: bool = False) -> str:
    have = f"count({c})" if non_null else "count(*)"
    return (f"CASE WHEN {have} OVER (ORDER BY Day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} "
            f"THEN avg({c}) OVER (ORDER BY Day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END")


@query("daily_users", _UNSUP_CTES + f""",
  s AS (SELECT date_trunc('day', "Timestamp") AS Day, User_Id, Dataset_Source || '_sup' AS series FROM {O.LABELLED} x
        UNION ALL SELECT date_trunc('day', "Timestamp"), User_Id, Dataset_Source || '_unsup' FROM unsup),
  p AS (SELECT Day, {", ".join(f"CAST(count(DISTINCT User_Id) FILTER (WHERE series = '{n}') AS BIGINT) AS {n}" for n in _SERIES)}
          FROM s GROUP BY Day)
SELECT Day, {", ".join(_SERIES)}, {", ".join(f"round({_rolling_sql(n)}, 6) AS {n}_7d" for n in _SERIES)} FROM p""")
def q_daily_users(spark, sf):
    sup = R.with_day(labelled(spark, sf)).select(R.DAY, USER, F.concat(F.col("Dataset_Source"), F.lit("_sup")).alias("series"))
    uns = R.with_day(_unsup(spark, sf)).select(R.DAY, USER, F.concat(F.col("Dataset_Source"), F.lit("_unsup")).alias("series"))
    return R.daily_users(sup.unionByName(uns), _SERIES)


@query("users_by_period", f"""WITH l AS {O.LABELLED}
SELECT 'week' AS period, date_trunc('week', "Timestamp") AS start, Dataset_Source AS series, count(DISTINCT User_Id) AS users FROM l GROUP BY ALL
UNION ALL SELECT 'month', date_trunc('month', "Timestamp"), Dataset_Source, count(DISTINCT User_Id) FROM l GROUP BY ALL""")
def q_users_by_period(spark, sf):
    """K5 by sketches: the log comes in three parts, each adds its daily sketches to the stored ones, and weeks and months are
    united from them. Exact up to 16,384 users."""
    from trustfold.session import scratch_path

    series = R.with_day(labelled(spark, sf)).select(R.DAY, ROW_ID, USER, F.col("Dataset_Source").alias("series"))
    path, sketches = scratch_path(spark, "sketches"), None
    for part in range(3):
        sketches = R.add_sketches(series.where(F.col(ROW_ID) % 3 == part), path)
    both = [R.users_by_period(sketches, p).select(F.lit(p).alias("period"), F.col("start").cast("timestamp_ntz").alias("start"), "series", "users") for p in ("week", "month")]
    return both[0].unionByName(both[1])


@query("daily_users_sketched", f"""WITH s AS (SELECT date_trunc('day', "Timestamp") AS Day, User_Id, Dataset_Source AS series FROM {O.LABELLED} x),
  p AS (SELECT Day, {", ".join(f"CAST(count(DISTINCT User_Id) FILTER (WHERE series = '{n}') AS BIGINT) AS {n}" for n in ("normal", "unintentional", "intentional"))}
          FROM s GROUP BY Day)
SELECT *, {", ".join(f"round({_rolling_sql(n)}, 6) AS {n}_7d" for n in ("normal", "unintentional", "intentional"))} FROM p""")
def q_daily_users_sketched(spark, sf):
    """R2 / K5 with the approximate count."""
    series = R.with_day(labelled(spark, sf)).select(R.DAY, USER, F.col("Dataset_Source").alias("series"))
    return R.daily_users(series, ["normal", "unintentional", "intentional"], approximate=True)


_CLS = ["Normal", "Unintentional", "Intentional"]


@query("daily_majority", f"""WITH l AS (SELECT date_trunc('day', "Timestamp") AS Day, * FROM {O.LABELLED} x),
  c AS (SELECT Day, User_Id, True_Class, count(*) AS n FROM l GROUP BY ALL),
  m AS (SELECT Day, User_Id, arg_min(True_Class, (-n, CASE True_Class WHEN 'Intentional' THEN 0 WHEN 'Unintentional' THEN 1 ELSE 2 END)) AS Category
          FROM c GROUP BY Day, User_Id),
  p AS (SELECT Day, {", ".join(f"CAST(count(DISTINCT User_Id) FILTER (WHERE Category = '{c}') AS BIGINT) AS {c}" for c in _CLS)} FROM m GROUP BY Day)
SELECT Day, {", ".join(_CLS)}, {", ".join(f"round({_rolling_sql(c)}, 6) AS {c}_7d" for c in _CLS)} FROM p""")
def q_daily_majority(spark, sf):
    return R.daily_majority(R.with_day(labelled(spark, sf)))


_SHARE_SQL = f"""WITH l AS (SELECT date_trunc('day', "Timestamp") AS Day, * FROM {O.LABELLED} x),
  p AS (SELECT Day, {", ".join(f"count(*) FILTER (WHERE True_Class = '{c}') AS {c}" for c in _CLS)}, count(*) AS total FROM l GROUP BY Day),
  s AS (SELECT Day, {", ".join(f"CASE WHEN total = 0 THEN 0.0 ELSE {c} / total * 100.0 END AS {c}" for c in _CLS)} FROM p),
  r AS (SELECT *, {", ".join(f"{_rolling_sql(c)} AS {c}_7d" for c in _CLS)} FROM s)"""


@query("daily_share", _SHARE_SQL + f"""
SELECT Day, {", ".join(f"round({c}, 6) AS {c}" for c in _CLS)}, {", ".join(f"round({c}_7d, 6) AS {c}_7d" for c in _CLS)} FROM r""")
def q_daily_share(spark, sf):
    return R.daily_share(R.with_day(labelled(spark, sf)))


@query("daily_share_rolled_twice", _SHARE_SQL + f"""
SELECT Day, {", ".join(f"round({c}, 6) AS {c}" for c in _CLS)}, {", ".join(f"round({c}_7d, 6) AS {c}_7d" for c in _CLS)},
       {", ".join(f"round({_rolling_sql(c + '_7d', non_null=True)}, 6) AS {c}_7d2" for c in _CLS)} FROM r""")
def q_daily_share_rolled_twice(spark, sf):
    return R.daily_share(R.with_day(labelled(spark, sf)), twice=True)


@query("experience_vs_reputation", f"""WITH e AS ({_EXP_SQL}),
  l AS {O.LABELLED},
  agg AS (SELECT User_Id, arg_min(User_Reputation, ("Timestamp", row_id)) AS r0,
                 list(Dataset_Source ORDER BY "Timestamp", row_id) AS srcs FROM l GROUP BY User_Id),
  f AS (SELECT User_Id, round(list_reduce(srcs, {_fold_sql(P1)}, r0), 6) AS Final_Reputation FROM agg),
  mx AS (SELECT User_Id, max(User_Experience) AS Max_Experience FROM e GROUP BY User_Id)
SELECT mx.User_Id, Max_Experience, Final_Reputation FROM mx LEFT JOIN f USING (User_Id)
 WHERE Max_Experience IS NOT NULL AND Final_Reputation IS NOT NULL""")
def q_experience_vs_reputation(spark, sf):
    log = load_log(spark, sf)
    per_user = replay_users(labelled(spark, sf), P1)
    final = per_user.select(USER, r6(F.col("Final_Reputation")).alias("Final_Reputation"))
    return R.experience_vs_reputation(capped_experience(log), final)


def _median_reputation(log):
    from trustfold.operators.aggregates import median_per_key

    med = median_per_key(log, USER, ["User_Reputation"], ["Original_Reputation"])
    return med.select(USER, r6(F.col("Original_Reputation")).alias("Original_Reputation"))


@query("stage_comparison", _UNSUP_CTES + f""",
  l AS {O.LABELLED},
  a AS (SELECT User_Id, arg_min(User_Reputation, ("Timestamp", row_id)) AS r0,
               list(Dataset_Source ORDER BY "Timestamp", row_id) AS srcs FROM l GROUP BY User_Id),
  b AS (SELECT User_Id, arg_min(User_Reputation, ("Timestamp", row_id)) AS r0,
               list(Dataset_Source ORDER BY "Timestamp", row_id) AS srcs FROM unsup GROUP BY User_Id),
  o AS (SELECT User_Id, round(median(User_Reputation), 6) AS Original_Reputation FROM lg GROUP BY User_Id)
SELECT o.User_Id, o.Original_Reputation,
       round(list_reduce(a.srcs, {_fold_sql(P1)}, a.r0), 6) AS Feedback_Loop_Supervised,
       round(list_reduce(b.srcs, {_fold_sql(P1)}, b.r0), 6) AS Feedback_Loop_Unsupervised
  FROM o JOIN a USING (User_Id) JOIN b USING (User_Id)""")
def q_stage_comparison(spark, sf):
    log = load_log(spark, sf)
    orig = _median_reputation(log)
    sup = replay_users(labelled(spark, sf), P1)
    uns = replay_users(_unsup(spark, sf), P1)
    return R.stage_comparison({
        "Original_Reputation": orig,
        "Feedback_Loop_Supervised": sup.select(USER, r6(F.col("Final_Reputation")).alias("v")),
        "Feedback_Loop_Unsupervised": uns.select(USER, r6(F.col("Final_Reputation")).alias("v")),
    })


# --------------------------------------------------------------- imputation, schema, encoding
from trustfold.operators import encode as E  # noqa: E402
from trustfold.operators import impute as I  # noqa: E402
from trustfold.operators import perturb as PT  # noqa: E402
from trustfold.operators import sampling as S  # noqa: E402
from trustfold.operators import schema as SC  # noqa: E402


def hu_sql(seed: str, key: str) -> str:
    """SQL twin of ``scalars.hashed_uniform``."""
    return (f"(CAST(('0x' || substring(md5(concat_ws('#', '{seed}', CAST({key} AS VARCHAR))), 1, 13)) AS BIGINT)"
            f" / CAST(4503599627370496 AS DOUBLE))")


@query("impute_median_mode", f"""WITH b AS {LOG_BLANK_SQL},
  st AS (SELECT median(value) AS m,
                (SELECT event_type FROM b WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1) AS md
           FROM b)
SELECT row_id, COALESCE(event_type, md) AS event_type, round(COALESCE(value, m), 6) AS value FROM b, st""")
def q_impute_median_mode(spark, sf):
    b = load_log(spark, sf, blank_cells=True)
    out = I.impute(b, numeric=["value"], categorical=["event_type"])
    return out.select(ROW_ID, "event_type", r6(F.col("value")).alias("value"))


@query("mean_fill", f"""WITH b AS {LOG_BLANK_SQL}
SELECT row_id, User_Id, round(COALESCE(value, avg(value) OVER (PARTITION BY User_Id)), 6) AS value FROM b""")
def q_mean_fill(spark, sf):
    b = load_log(spark, sf, blank_cells=True)
    return I.mean_fill(b, ["value"], group=[USER]).select(ROW_ID, USER, r6(F.col("value")).alias("value"))


@query("column_kinds", f"""SELECT column_name AS "column",
       CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT', 'TINYINT') OR column_type LIKE 'DECIMAL%' THEN 'numerical'
            WHEN column_type = 'VARCHAR' THEN 'categorical' ELSE 'unknown' END AS kind
  FROM (DESCRIBE SELECT * FROM {LOG_SQL} t) d WHERE column_name <> 'User_Reputation'""")
def q_column_kinds(spark, sf):
    return SC.column_kinds_frame(spark, load_log(spark, sf), target="User_Reputation")


@query("target_check", f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE User_Reputation IS NULL) AS n_null,
       count(DISTINCT User_Reputation) AS n_distinct, COALESCE(bool_and(User_Reputation = floor(User_Reputation)), TRUE) AS all_whole
  FROM {LOG_SQL} t""")
def q_target_check(spark, sf):
    return SC.target_check_frame(load_log(spark, sf), "User_Reputation")


@query("cardinality_split", """SELECT 'c_mktsegment' AS "column", count(DISTINCT c_mktsegment) AS n_distinct,
       CASE WHEN count(DISTINCT c_mktsegment) <= 15 THEN 'onehot' ELSE 'label' END AS encoding FROM customer
UNION ALL SELECT 'c_name', count(DISTINCT c_name), CASE WHEN count(DISTINCT c_name) <= 15 THEN 'onehot' ELSE 'label' END FROM customer""")
def q_cardinality_split(spark, sf):
    cust = read_table(spark, sf, "customer")
    cols = ["c_mktsegment", "c_name"]
    counts = E.distinct_counts(cust, cols)
    long = counts.unpivot([], cols, "column", "n_distinct")
    return long.withColumn("encoding", F.when(F.col("n_distinct") <= E.ONEHOT_LIMIT, "onehot").otherwise("label"))


@query("onehot", """SELECT l_orderkey, l_linenumber,
       CAST(l_returnflag = 'A' AS DOUBLE) AS l_returnflag_A, CAST(l_returnflag = 'N' AS DOUBLE) AS l_returnflag_N,
       CAST(l_returnflag = 'R' AS DOUBLE) AS l_returnflag_R, CAST(l_linestatus = 'O' AS DOUBLE) AS l_linestatus_O
  FROM lineitem""")
def q_onehot(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    out = E.onehot(li, "l_returnflag")
    return E.onehot(out, "l_linestatus", drop_first=True)  # E9: dummy coding drops the first level


@query("label_encode", """SELECT o_orderkey,
       CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority,
       CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS BIGINT) AS o_orderstatus FROM orders""")
def q_label_encode(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return E.label_encode(E.label_encode(o, "o_orderpriority"), "o_orderstatus")


_SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("standard_scale", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(COALESCE((l.{c} - s.a_{c}) / CASE WHEN s.b_{c} <> 0 THEN s.b_{c} END, {O.d(0.0)}), 6) AS {c}" for c in _SCALE_COLS)
    + " FROM lineitem l, (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS b_{c}" for c in _SCALE_COLS) + " FROM lineitem) s")
def q_standard_scale(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SCALE_COLS)
    out = E.fit_scaler(li, _SCALE_COLS, "standard").transform(li)
    return out.select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in _SCALE_COLS])


@query("minmax_scale", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(COALESCE((l.{c} - s.a_{c}) / CASE WHEN s.b_{c} - s.a_{c} <> 0 THEN s.b_{c} - s.a_{c} END, {O.d(0.0)}), 6) AS {c}" for c in _SCALE_COLS)
    + " FROM lineitem l, (SELECT " + ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in _SCALE_COLS) + " FROM lineitem) s")
def q_minmax_scale(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SCALE_COLS)
    out = E.fit_scaler(li, _SCALE_COLS, "minmax").transform(li)
    return out.select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in _SCALE_COLS])


# --------------------------------------------------------------- sampling, perturbation
@query("seeded_sample", f"SELECT row_id, User_Id FROM {LOG_SQL} t ORDER BY {seeded_order_sql()} LIMIT {P1.ground_sample_size}")
def q_seeded_sample(spark, sf):
    return S.seeded_sample(load_log(spark, sf), P1.ground_sample_size).select(ROW_ID, USER)


def _sets_sql(src: str, p) -> str:
    return f"""(SELECT *, CASE WHEN _rk < _b THEN 'both' WHEN _rk < _b + _a THEN 'A' WHEN _rk < _b + _a + _u THEN 'B' END AS sample_set
   FROM (SELECT *, CAST(floor(_c * {O.d(p.overlap_perc)}) AS BIGINT) AS _b,
                CAST(floor(_c * {O.d(p.intentional_perc)}) AS BIGINT) - CAST(floor(_c * {O.d(p.overlap_perc)}) AS BIGINT) AS _a,
                CAST(floor(_c * {O.d(p.unintentional_perc)}) AS BIGINT) - CAST(floor(_c * {O.d(p.overlap_perc)}) AS BIGINT) AS _u
           FROM (SELECT *, row_number() OVER (ORDER BY {seeded_order_sql()}) - 1 AS _rk, count(*) OVER () AS _c FROM {src} s0) s1) s2)"""


@query("disjoint_samples", f"SELECT row_id, sample_set FROM {_sets_sql(LOG_SQL, P2)} d")
def q_disjoint_samples(spark, sf):
    return S.disjoint_samples(load_log(spark, sf), P2.overlap_perc, P2.intentional_perc, P2.unintentional_perc).select(ROW_ID, "sample_set")


# Fixed values of the events mapping: what an injected outlier writes.
#   intentional: event_type becomes 'error';
#   unintentional: value becomes 150 + 350u, or k becomes floor(3u).
def _gens():
    from trustfold.functions.scalars import hashed_uniform

    return ({"event_type": F.lit("error")},
            {"value": F.lit(150.0) + F.lit(350.0) * hashed_uniform("42:v", F.col(ROW_ID)),
             "k": F.floor(F.lit(3.0) * hashed_uniform("42:k", F.col(ROW_ID)))})


@query("inject_outliers", f"""WITH s AS {_sets_sql(LOG_SQL, P2)},
  p AS (SELECT *, CAST(floor({hu_sql('42:ci', 'row_id')} * 1) AS INTEGER) AS pi,
                  CAST(floor({hu_sql('42:cu', 'row_id')} * 2) AS INTEGER) AS pu FROM s)
SELECT row_id, sample_set,
       CASE WHEN sample_set IN ('both', 'A') AND pi = 0 THEN 'error' ELSE event_type END AS event_type,
       round(CASE WHEN sample_set IN ('both', 'B') AND pu = 0 THEN {O.d(150.0)} + {O.d(350.0)} * {hu_sql('42:v', 'row_id')} ELSE value END, 6) AS value,
       CASE WHEN sample_set IN ('both', 'B') AND pu = 1 THEN CAST(floor({O.d(3.0)} * {hu_sql('42:k', 'row_id')}) AS BIGINT) ELSE k END AS k
  FROM p""")
def q_inject_outliers(spark, sf):
    gi, gu = _gens()
    out = PT.inject_outliers(load_log(spark, sf), gi, gu, P2.intentional_perc, P2.unintentional_perc, P2.overlap_perc)
    return out.select(ROW_ID, "sample_set", "event_type", r6(F.col("value")).alias("value"), "k")


_NULL_COLS = ["value", "k", "event_type"]


@query("inject_nulls", f"""WITH l AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS _pos FROM {LOG_SQL} t),
  n AS (SELECT CAST(floor(count(*) * 3 * {O.d(0.15)}) AS BIGINT) AS nd, count(*) AS nr FROM l),
  d AS (SELECT CAST(floor({hu_sql('42:r', 'id')} * nr) AS BIGINT) AS _pos, CAST(floor({hu_sql('42:c', 'id')} * 3) AS INTEGER) AS c
          FROM (SELECT range AS id, nr FROM n, range(nd)) r),
  g AS (SELECT _pos, list(DISTINCT c) AS cs FROM d GROUP BY _pos)
SELECT row_id,
       round(CASE WHEN COALESCE(list_contains(cs, 0), FALSE) THEN NULL ELSE value END, 6) AS value,
       CAST(CASE WHEN COALESCE(list_contains(cs, 1), FALSE) THEN NULL ELSE k END AS DOUBLE) AS k,
       CASE WHEN COALESCE(list_contains(cs, 2), FALSE) THEN NULL ELSE event_type END AS event_type
  FROM l LEFT JOIN g USING (_pos)""")
def q_inject_nulls(spark, sf):
    out = PT.inject_nulls(load_log(spark, sf), _NULL_COLS, 0.15)
    return out.select(ROW_ID, r6(F.col("value")).alias("value"), F.col("k").cast("double").alias("k"), "event_type")


# Road types and their draw weights in the original simulator.
ROAD_TYPES = ["1way", "2way", "4way"]
ROAD_WEIGHTS = [0.3, 0.5, 0.2]


@query("weighted_draw", f"""SELECT row_id, CASE WHEN {hu_sql('road', 'row_id')} < {O.d(0.3)} THEN '1way'
                          WHEN {hu_sql('road', 'row_id')} < {O.d(0.3 + 0.5)} THEN '2way' ELSE '4way' END AS road_type
  FROM {LOG_SQL} t""")
def q_weighted_draw(spark, sf):
    from trustfold.functions.scalars import hashed_uniform

    log = load_log(spark, sf)
    return log.select(ROW_ID, PT.weighted_draw(hashed_uniform("road", F.col(ROW_ID)), ROAD_TYPES, ROAD_WEIGHTS).alias("road_type"))


def _geo_base(df):
    return df.select(ROW_ID, (F.lit(37.0) + (F.col(USER) % 600).cast("double") / F.lit(100.0)).alias("lat"),
                     (F.lit(17.0) + (F.col(ROW_ID) % 700).cast("double") / F.lit(100.0)).alias("lon"))


@query("geo_offset", f"""WITH b AS (SELECT row_id, {O.d(37.0)} + CAST(User_Id % 600 AS DOUBLE) / {O.d(100.0)} AS lat,
                           {O.d(17.0)} + CAST(row_id % 700 AS DOUBLE) / {O.d(100.0)} AS lon FROM {LOG_SQL} t),
  p AS (SELECT row_id, radians(lat) AS p1, radians(lon) AS l1, {hu_sql('geo:d', 'row_id')} * {O.d(200.0)} / {O.d(PT.EARTH_RADIUS_M)} AS dl,
               {hu_sql('geo:b', 'row_id')} * {O.d(2 * 3.141592653589793)} AS br FROM b),
  q AS (SELECT *, asin(sin(p1) * cos(dl) + cos(p1) * sin(dl) * cos(br)) AS p2 FROM p)
SELECT row_id, round(degrees(p2), 6) AS lat, round(degrees(l1 + atan2(sin(br) * sin(dl) * cos(p1), cos(dl) - sin(p1) * sin(p2))), 6) AS lon FROM q""")
def q_geo_offset(spark, sf):
    out = PT.jitter_location(_geo_base(load_log(spark, sf)), "lat", "lon", 200.0, seed="geo")
    return out.select(ROW_ID, r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"))


# --------------------------------------------------------------- streaming T1-T3
@query("stream_reputation", _TRACE_SQL + f"""
SELECT row_id, User_Id, "Timestamp", Dataset_Source, round(list_reduce(srcs, {_fold_sql(P1)}, r0), 6) AS new_reputation,
       FALSE AS late FROM w""")
def q_stream_reputation(spark, sf):
    """The labelled events as a file stream through keyed state; must equal the batch trace."""
    from trustfold.streaming.keyed import replay_keyed

    return _rounded_trace(replay_keyed(_event_stream(spark, sf), P1))


@query("stream_reputation_split", SQL["stream_reputation"])
def q_stream_reputation_split(spark, sf):
    """T1 by the batch fold of each micro-batch, which splits a hot user's rows over tasks."""
    from trustfold.streaming.replay import replay_to_table

    return _rounded_trace(replay_to_table(spark, _event_stream(spark, sf), P1))


def _rounded_trace(trace):
    return trace.select(ROW_ID, USER, TS, "Dataset_Source", r6(F.col("new_reputation")).alias("new_reputation"), "late")


def _event_stream(spark, sf):
    """The labelled events as a stream: of the one file, or of all part files of the folder, that hold the table."""
    from trustfold.functions.rules import EVENT_RULES
    from trustfold.sources.tables import behaviour_log

    from trustfold.streaming.replay import table_stream

    src = table_stream(spark, sf, "events")
    return behaviour_log(src).withColumn("True_Class", EVENT_RULES.class_expr()).withColumn("Dataset_Source", source_from_class())


@query("stream_payload", SQL["kafka_payload"])
def q_stream_payload(spark, sf):
    """The stream's JSON messages in a topic, written by a stream writer that commits each batch."""
    from trustfold.session import scratch_path
    from trustfold.streaming import keyed, topic
    from trustfold.streaming.sink import kafka_frame

    topic.register(spark)
    path = scratch_path(spark, "topic")
    trace = keyed.stateful_trace(_event_stream(spark, sf), P1)
    keyed.drain(kafka_frame(trace.withColumn("new_reputation", r6(F.col("new_reputation")))), f"{path}/checkpoint", topic.NAME, path=f"{path}/topic")
    return topic.read_topic(spark, f"{path}/topic").select("key", "value")


# Fixed rule of the test mapping: the log's span is cut into three equal steps; every 7th event arrives a quarter step after its
# time, every 50th two steps after it. A run of the stream gets the arrivals of one step; the delay is a third of a step.
_ARRIVALS_SQL = f"""WITH l AS {O.LABELLED},
  z AS (SELECT min(epoch_us("Timestamp")) AS t0, (max(epoch_us("Timestamp")) - min(epoch_us("Timestamp"))) // 3 + 1 AS step FROM l),
  a AS (SELECT l.*, epoch_us("Timestamp") AS us, step // 3000 AS delay,
               (epoch_us("Timestamp") - t0 + CASE WHEN row_id % 50 = 0 THEN 2 * step WHEN row_id % 7 = 0 THEN step // 4 ELSE 0 END) // step AS run FROM l, z),
  m AS (SELECT run, max(mx) OVER (ORDER BY run) AS upto, max(mx) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM (SELECT run, max(us) AS mx FROM a GROUP BY run) x),
  b AS (SELECT a.*, COALESCE(us < (before // 1000 - delay) * 1000, FALSE) AS late, us < ((SELECT max(upto) FROM m) // 1000 - delay) * 1000 AS passed
          FROM a JOIN m USING (run)),
  w AS (SELECT *, first_value(User_Reputation) OVER (PARTITION BY User_Id ORDER BY us, row_id) AS r0,
               list(Dataset_Source) OVER (PARTITION BY User_Id ORDER BY us, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS srcs
          FROM b WHERE NOT late AND passed)"""


@query("stream_out_of_order", _ARRIVALS_SQL + f"""
SELECT row_id, User_Id, "Timestamp", Dataset_Source, round(list_reduce(srcs, {_fold_sql(P1)}, r0), 6) AS new_reputation, FALSE AS late FROM w
UNION ALL SELECT row_id, User_Id, "Timestamp", Dataset_Source, NULL, TRUE FROM b WHERE late""")
def q_stream_out_of_order(spark, sf):
    """Events arrive out of order; those within the delay give the result of the batch, older ones come out as late. Each
    step of arrivals is a new run of the stream, which goes on from the checkpoint of the one before."""
    from trustfold.session import scratch_path
    from trustfold.streaming.keyed import replay_keyed

    top = scratch_path(spark, "arrivals")
    us = F.unix_micros(F.col(TS).cast("timestamp"))
    log = labelled(spark, sf)
    start, end = log.agg(F.min(us), F.max(us)).first()
    step = (end - start) // 3 + 1
    shift = F.when(F.col(ROW_ID) % 50 == 0, 2 * step).when(F.col(ROW_ID) % 7 == 0, step // 4).otherwise(0)
    arrivals = log.withColumn("run", F.floor((us - start + shift) / step))
    out = None
    for run in range(5):
        arrivals.where(F.col("run") == run).drop("run").write.mode("append").parquet(f"{top}/in")
        out = replay_keyed(spark.readStream.schema(log.schema).parquet(f"{top}/in"), P1, step // 3000, f"{top}/stream")
    return _rounded_trace(out)


# --------------------------------------------------------------- model-based detectors
_detector_query("iforest", "IForest", O.iforest, DP.contamination)


@query("ocsvm")
def q_ocsvm(spark, sf):
    return D.detect(_long(spark, sf), DP, "OC-SVM")


# --------------------------------------------------------------- model jobs M1-M8 (rows-only)
_NUMERIC = ["User_Experience", "value", "k"]
_CATEGORICAL = ["event_type"]


RUNS = ("raw", "unsupervised", "supervised")


def _model_run(spark, sf, run):
    """The rows of a run type: the raw log, or the replayed rows of either labelling with their source as a feature (M8)."""
    log = capped_experience(load_log(spark, sf)).checkpoint()
    if run == "raw":
        return log, _CATEGORICAL
    sources = labelled(spark, sf) if run == "supervised" else _unsup(spark, sf)
    return log.join(sources.select(ROW_ID, "Dataset_Source"), ROW_ID).checkpoint(), [*_CATEGORICAL, "Dataset_Source"]


def _ready(spark, sf, run):
    from trustfold.plans.models import fit_features

    df, categorical = _model_run(spark, sf, run)
    return df, fit_features(df, _NUMERIC, categorical)


@query("predicted_median_by_user")
def q_predicted_median_by_user(spark, sf):
    """M4 / K2: both searches on the supervised replay, two median predictions per user."""
    from trustfold.plans.models import predict_final_reputations

    return predict_final_reputations(*_ready(spark, sf, "supervised"), "User_Reputation", P1.automl_sample_size)[0]


@query("model_r2")
def q_model_r2(spark, sf):
    from trustfold.plans.models import r2, train_and_score

    df, features = _ready(spark, sf, "raw")
    res, scored = train_and_score(df, features, "User_Reputation", P1.automl_sample_size, engine="B")
    return r2(scored).select("r2", F.lit(res.in_sample).alias("in_sample_r2"), F.lit(res.holdout).alias("holdout_r2"),
                             F.lit(res.best).alias("best_model"), F.lit(res.task).alias("task"))


@query("model_scores")
def q_model_scores(spark, sf):
    """Best score per engine and run type, each run trained on all of its rows' kinds and entered in a ledger."""
    from trustfold.plans.models import append_ledger, ledger_row, train_and_score
    from trustfold.session import scratch_path

    path, ledger = scratch_path(spark, "ledger"), None
    for run in RUNS:
        df, features = _ready(spark, sf, run)
        for engine in ("A", "B"):
            res, _ = train_and_score(df, features, "User_Reputation", P1.automl_sample_size, engine)
            ledger = append_ledger(ledger_row(spark, f"{run}_{engine}", res), path)
    run_type = F.element_at(F.split("prefix", "_"), 1).alias("run_type")
    return R.best_scores(ledger.select("*", run_type), list(RUNS))


# Coefficients (intercept, User_Experience, value, k, normal row) of two scoring models, so that SQL can check M5, M6 and K2.
_COEFFICIENTS = {"A": (0.4, 0.3, 0.0005, -0.001, 0.02), "B": (0.55, -0.1, 0.0002, 0.0004, -0.03)}


def _linear(engine: str, normal):
    a, e, v, k, n = _COEFFICIENTS[engine]
    return F.lit(a) + F.lit(e) * F.col("User_Experience") + F.lit(v) * F.col("value") + F.lit(k) * F.col("k") + F.lit(n) * normal.cast("double")


def _linear_sql(engine: str, normal: str) -> str:
    a, e, v, k, n = map(O.d, _COEFFICIENTS[engine])
    return f"({a} + {e} * User_Experience + {v} * value + {k} * k + {n} * CAST({normal} AS DOUBLE))"


@query("fixed_model_r2", f"""SELECT round(1 - sum(pow(User_Reputation - p, 2)) / sum(pow(User_Reputation - m, 2)), 6) AS r2, count(*) AS n_rows
  FROM (SELECT *, {_linear_sql("A", "Dataset_Source = 'normal'")} AS p, avg(User_Reputation) OVER () AS m FROM {O.LABELLED} l) x""")
def q_fixed_model_r2(spark, sf):
    """M5 / M6: all rows scored by fixed coefficients, r2 in one aggregate."""
    from trustfold.plans.models import r2

    rows = labelled(spark, sf).withColumn("p", _linear("A", F.col("Dataset_Source") == "normal"))
    return r2(rows, "User_Reputation", "p").select(r6(F.col("r2")).alias("r2"), "n_rows")


# Weights of a line over scaled numbers and one-hot sources, and its constant.
_WEIGHTS = {"User_Experience": 0.03, "value": -0.02, "k": 0.01, "Dataset_Source_intentional": -0.2, "Dataset_Source_normal": 0.1,
            "Dataset_Source_unintentional": -0.05}
_CONSTANT = 0.5


def _weighted_sql() -> str:
    scaled = lambda c: f"COALESCE((l.{c} - avg(l.{c}) OVER ()) / NULLIF(stddev_pop(l.{c}) OVER (), 0), 0)"
    parts = [f"{O.d(_WEIGHTS[c])} * {scaled(c)}" for c in _NUMERIC]
    parts += [f"{O.d(w)} * CAST(l.Dataset_Source = '{c[len('Dataset_Source_'):]}' AS DOUBLE)" for c, w in _WEIGHTS.items() if c.startswith("Dataset_Source_")]
    return f"(SELECT l.*, {' + '.join(parts)} + {O.d(_CONSTANT)} AS p FROM {O.LABELLED} l)"


def _fixed_line(spark, sf):
    """The labelled log, its fitted features (M8) and a line with fixed weights over them."""
    import numpy as np

    from trustfold.plans.models import fit_features
    from trustfold.plans.regressors import Line

    log = labelled(spark, sf)
    features = fit_features(log, _NUMERIC, ["Dataset_Source"])
    return log, features, Line(features.names, np.array([*[_WEIGHTS[n] for n in features.names], _CONSTANT]))


@query("reloaded_model_scores", f"SELECT row_id, User_Id, round(p, 6) AS prediction FROM {_weighted_sql()} x")
def q_reloaded_model_scores(spark, sf):
    """A saved model, its scaler and categories are loaded again and score all rows."""
    from trustfold.plans import models as M
    from trustfold.session import scratch_path

    log, features, line = _fixed_line(spark, sf)
    path = scratch_path(spark, "model")
    M.save(M.FitResult(line, "B", "regression", 0.0, None, "Line"), features, path)
    return M.load_and_predict(path, log, "User_Reputation").select(ROW_ID, USER, r6(F.col("prediction")).alias("prediction"))


@query("fixed_model_ledger", f"""WITH x AS (SELECT *, avg(User_Reputation) OVER () AS m FROM {_weighted_sql()} w),
  y AS (SELECT *, {_linear_sql("A", "Dataset_Source = 'normal'")} AS q FROM x)
SELECT prefix, engine, pipeline, task, round(score, 6) AS score FROM (
  SELECT 'line' AS prefix, 'B' AS engine, 'Line' AS pipeline, 1 - sum(pow(User_Reputation - p, 2)) / sum(pow(User_Reputation - m, 2)) AS score FROM y
  UNION ALL SELECT 'fixed', 'A', 'Fixed', 1 - sum(pow(User_Reputation - q, 2)) / sum(pow(User_Reputation - m, 2)) FROM y) s,
  (SELECT CASE WHEN count(DISTINCT User_Reputation) <= 10 AND bool_and(User_Reputation = floor(User_Reputation)) THEN 'classification' ELSE 'regression' END AS task FROM y) t""")
def q_fixed_model_ledger(spark, sf):
    """Two models' scores on all rows, appended to a ledger one after the other."""
    from trustfold.plans import models as M
    from trustfold.session import scratch_path

    log, features, line = _fixed_line(spark, sf)
    task, path, ledger = M.task_type(log, "User_Reputation"), scratch_path(spark, "ledger"), None
    lines = line.transform(features.transform(log))
    fixed = log.withColumn("prediction", _linear("A", F.col("Dataset_Source") == "normal"))
    for prefix, engine, name, scored in (("line", "B", "Line", lines), ("fixed", "A", "Fixed", fixed)):
        score = M.r2(scored, "User_Reputation").first()["r2"]
        ledger = M.append_ledger(M.ledger_row(spark, prefix, M.FitResult(None, engine, task, score, None, name)), path)
    return ledger.select("prefix", "engine", "pipeline", "task", r6(F.col("score")).alias("score"))


# Nine stages of a user's reputation: the median of the log, the two replays, and both fixed models on each run type.
_STAGES = {
    "Original_Reputation": None, "Predicted_A_Raw": ("A", "TRUE", "lg"), "Predicted_B_Raw": ("B", "TRUE", "lg"), "Feedback_Loop_Supervised": None,
    "Processed_A_Supervised": ("A", "Dataset_Source = 'normal'", "l"), "Processed_B_Supervised": ("B", "Dataset_Source = 'normal'", "l"),
    "Feedback_Loop_Unsupervised": None, "Processed_A_Unsupervised": ("A", "Dataset_Source = 'normal'", "unsup"),
    "Processed_B_Unsupervised": ("B", "Dataset_Source = 'normal'", "unsup"),
}


@query("nine_stage_comparison", _UNSUP_CTES + f""",
  l AS {O.LABELLED},
  a AS (SELECT User_Id, arg_min(User_Reputation, ("Timestamp", row_id)) AS r0, list(Dataset_Source ORDER BY "Timestamp", row_id) AS srcs FROM l GROUP BY User_Id),
  b AS (SELECT User_Id, arg_min(User_Reputation, ("Timestamp", row_id)) AS r0, list(Dataset_Source ORDER BY "Timestamp", row_id) AS srcs FROM unsup GROUP BY User_Id),
  o AS (SELECT User_Id, round(median(User_Reputation), 6) AS Original_Reputation FROM lg GROUP BY User_Id),
  """ + ",\n  ".join(f"{n} AS (SELECT User_Id, round(median({_linear_sql(s[0], s[1])}), 6) AS v FROM {s[2]} GROUP BY User_Id)" for n, s in _STAGES.items() if s) + f"""
SELECT o.User_Id, o.Original_Reputation, round(list_reduce(a.srcs, {_fold_sql(P1)}, a.r0), 6) AS Feedback_Loop_Supervised,
       round(list_reduce(b.srcs, {_fold_sql(P1)}, b.r0), 6) AS Feedback_Loop_Unsupervised, {", ".join(f"{n}.v AS {n}" for n, s in _STAGES.items() if s)}
  FROM o JOIN a USING (User_Id) JOIN b USING (User_Id) {" ".join(f"JOIN {n} USING (User_Id)" for n, s in _STAGES.items() if s)}""")
def q_nine_stage_comparison(spark, sf):
    """All nine stages per user, inner-joined."""
    from trustfold.plans.models import predicted_medians

    log, uns = load_log(spark, sf), _unsup(spark, sf).checkpoint()
    runs = {"Raw": log.withColumn("_n", F.lit(True)), "Supervised": labelled(spark, sf).withColumn("_n", F.col("Dataset_Source") == "normal"),
            "Unsupervised": uns.withColumn("_n", F.col("Dataset_Source") == "normal")}
    stages = {"Original_Reputation": _median_reputation(log)}
    for run, df in runs.items():
        med = predicted_medians(df.select(USER, *[_linear(e, F.col("_n")).alias(f"prediction_{e}") for e in "AB"])).checkpoint()
        for e in "AB":
            name = f"Predicted_{e}_Raw" if run == "Raw" else f"Processed_{e}_{run}"
            stages[name] = med.select(USER, r6(F.col(f"Predicted_Final_Reputation_{e}")).alias("v"))
    for run, df in (("Supervised", labelled(spark, sf)), ("Unsupervised", uns)):
        stages[f"Feedback_Loop_{run}"] = replay_users(df, P1).select(USER, r6(F.col("Final_Reputation")).alias("v"))
    return R.stage_comparison({n: stages[n] for n in _STAGES})


# Fixed rule of the test mapping: a result ledger with one row per event; spelling, blanks, text that is no number, and
# infinities vary with the id.
_LEDGER_FILES = [m[2] for m in R.MODEL_MAPPING]
_LEDGER_SQL = f"""(SELECT CASE WHEN event_id % 3 = 0 THEN upper(split_part(f, '_', -1)) ELSE split_part(f, '_', -1) END AS prefix,
       CASE event_id % 5 WHEN 0 THEN ' runs/' || upper(f) || '.py' WHEN 1 THEN f || '.txt' WHEN 2 THEN '' ELSE 'out/' || f || '.py ' END AS pipeline_file,
       CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 210 = 8 THEN 'Infinity' ELSE CAST(round(value / 1000, 4) AS VARCHAR) END AS score
  FROM (SELECT *, [{", ".join("'" + f[:-3] + "'" for f in _LEDGER_FILES)}][event_id % 6 + 1] AS f FROM events) e)"""


@query("model_comparison", f"""WITH l AS (SELECT DISTINCT lower(prefix) AS prefix, trim(pipeline_file) AS pipeline_file, TRY_CAST(score AS DOUBLE) AS score FROM {_LEDGER_SQL} x
              WHERE trim(pipeline_file) LIKE '%.py' AND TRY_CAST(score AS DOUBLE) IS NOT NULL),
  m AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}', '{e}')" for a, b, c, e in R.MODEL_MAPPING)}) m(prefix, run_type, file, engine))
SELECT engine || ' (' || run_type || ')' AS engine_run_type, engine, run_type, max(score) AS score
  FROM l JOIN m ON l.prefix = m.prefix AND lower(split_part(l.pipeline_file, '/', -1)) = m.file GROUP BY ALL HAVING isfinite(max(score))""")
def q_model_comparison(spark, sf):
    """R5 / W8 / B9 / B10 / S4 / S6 / S11 / U2 over a ledger with the usual blemishes."""
    files = F.array(*[F.lit(f[:-3]) for f in _LEDGER_FILES])
    e = read_table(spark, sf, "events").withColumn("f", F.element_at(files, (F.col("event_id") % 6 + 1).cast("int")))
    tail, case = F.element_at(F.split("f", "_"), -1), F.col("event_id")
    name = F.when(case % 5 == 0, F.concat(F.lit(" runs/"), F.upper("f"), F.lit(".py"))).when(case % 5 == 1, F.concat("f", F.lit(".txt"))).when(
        case % 5 == 2, F.lit("")).otherwise(F.concat(F.lit("out/"), F.col("f"), F.lit(".py ")))
    score = F.when(case % 7 == 0, F.lit("n/a")).when(case % 210 == 8, F.lit("Infinity")).otherwise(F.round(F.col("value") / 1000, 4).cast("string"))
    ledger = e.select(F.when(case % 3 == 0, F.upper(tail)).otherwise(tail).alias("prefix"), name.alias("pipeline_file"), score.alias("score"))
    return R.model_comparison(ledger).drop("pipeline_file")


# The event types of the driver's table, in sorted order: the one-hot columns that the sequential form visits.
_SEQ_COLUMNS = ["value", "k"] + [f"event_type_{c}" for c in ("click", "error", "purchase", "signup", "view")]


@query("consensus_sequential", O.sequential(P1, _SEQ_COLUMNS))
def q_consensus_sequential(spark, sf):
    """G5 as coded: rows removed on one column are gone before the next column (checkpointed loop)."""
    c = C.consensus(load_log(spark, sf), DP, methods=list(D.SQL_CHECKABLE), mode="sequential")
    return c["best"].select("chunk_id", "column", "method", "outliers_removed", "original_size")


_WIDE_SQL = f"(SELECT l.*, e.props FROM {LOG_SQL} l JOIN events e ON e.event_id = l.row_id)"


@query("consensus_all_columns", "WITH " + O.consensus_ctes(P1, _WIDE_SQL, label=("props",)) + """
SELECT chunk_id, "column", method, outliers_removed FROM bst""")
def q_consensus_all_columns(spark, sf):
    """Every column that is not excluded, the JSON text with its 100 values label-encoded."""
    log = behaviour_log(read_table(spark, sf, "events"), keep=("props",))
    c = C.consensus(log, DP, methods=list(D.SQL_CHECKABLE))
    return c["best"].select("chunk_id", "column", "method", "outliers_removed")


# --------------------------------------------------------------- sources and sinks A1-A4
@query("csv_roundtrip", f"""SELECT row_id, User_Id, "Timestamp", event_type, value FROM {LOG_SQL} t""")
def q_csv_roundtrip(spark, sf):
    """Write the log as time-sorted CSV under the shared checkpoint folder, read it back (A1-A3)."""
    from trustfold.session import scratch_path
    from trustfold.sources.io import export, load_csv

    log = load_log(spark, sf).select(ROW_ID, USER, TS, "event_type", "value")
    base = scratch_path(spark, "csv")
    export(log, f"{base}/behaviour_log.csv", fmt="csv")
    schema = "row_id long, User_Id long, Timestamp timestamp_ntz, event_type string, value double"
    return load_csv(spark, base, "behaviour_log", schema=schema)


@query("rows_by_class", f"SELECT row_id, User_Id, value, {LABEL_SQL} AS True_Class FROM {LOG_SQL} t")
def q_rows_by_class(spark, sf):
    """A4: one output per class, each read back by itself."""
    from trustfold.functions.rules import CLASSES
    from trustfold.session import scratch_path
    from trustfold.sources.io import write_by_class

    path = scratch_path(spark, "classes")
    lab = label(load_log(spark, sf)).select(ROW_ID, USER, "value", "True_Class")
    write_by_class(lab, path)
    schema = lab.drop("True_Class").schema
    found = [r["True_Class"] for r in spark.read.parquet(path).select("True_Class").distinct().collect()]
    parts = [spark.read.schema(schema).parquet(f"{path}/True_Class={c}").withColumn("True_Class", F.lit(c)) for c in CLASSES if c in found]
    return S.union_by_name(*parts)


@query("encode_all", f"""SELECT row_id, User_Id, value, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS event_type FROM {LOG_SQL} t""")
def q_encode_all(spark, sf):
    """Every text feature label-encoded, after a check that nothing is null."""
    out, _ = E.validate_target_feature(load_log(spark, sf).select(ROW_ID, USER, "event_type", "value"), "value")
    return out


# --------------------------------------------------------------- multi-column LODA over embeddings
from trustfold.operators import loda_multi as LM  # noqa: E402

EMB_DIM = 64  # width of the driver's embedding vectors


@query("loda_embeddings", LM.oracle_sql("embeddings", "vec_id", "embedding", EMB_DIM, DP.contamination))
def q_loda_embeddings(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    return LM.loda_flags(emb, "vec_id", "embedding", EMB_DIM, DP.contamination)


@query("label_count_if", f"""SELECT count(*) FILTER (WHERE c = 'Normal') AS n_normal,
       count(*) FILTER (WHERE c = 'Unintentional') AS n_unintentional,
       count(*) FILTER (WHERE c = 'Intentional') AS n_intentional, count(*) AS n_rows
  FROM (SELECT {LABEL_SQL} AS c FROM {LOG_SQL} t) x""")
def q_label_count_if(spark, sf):
    from trustfold.functions.rules import class_count_if

    return class_count_if(label(load_log(spark, sf)))


@query("final_reputation_all_methods")
def q_final_reputation_all_methods(spark, sf):
    """The unsupervised path as the original runs it: all eight detectors
    (isolation forest and one-class SVM included) in the consensus and the vote."""
    per_user = replay_users(unsupervised_sources(load_log(spark, sf), P1, methods=None), P1)
    return per_user.select(USER, r6(F.col("Original_Reputation")).alias("Original_Reputation"),
                           r6(F.col("Final_Reputation")).alias("Final_Reputation"))


# Fixed rule of the test mapping: a full 17-column log over the order lines; the expressions read the same in Spark and in the oracle.
_FULL_LOG = {
    "row_id": "l_orderkey * 10 + l_linenumber",
    "User_Activity": "CASE WHEN l_orderkey % 41 = 0 THEN 'Flying' WHEN l_orderkey % 43 = 0 THEN 'Swimming' WHEN l_orderkey % 47 = 0 THEN NULL ELSE 'Walking' END",
    "University_Area": "CASE WHEN l_partkey % 53 = 0 THEN 'Center' WHEN l_partkey % 59 = 0 THEN 'Spinari' ELSE 'Zep' END",
    "Road_Accident": "CAST(l_partkey % 97 AS INTEGER)",
    "Road_Type": "CASE WHEN l_suppkey % 61 = 0 THEN '5way' WHEN l_suppkey % 67 = 0 THEN '6way' ELSE '2way' END",
    "Speed_Limit": "CAST(10 * (1 + l_orderkey % 160) AS INTEGER)",
    "Violation_Type": "CASE WHEN l_partkey % 71 = 0 THEN 'Lane_Discards' WHEN l_partkey % 73 = 0 THEN 'Harassing_Driver' WHEN l_partkey % 79 = 0 THEN 'Illegal_Parking' ELSE 'Speeding' END",
    "Battery_Percentage": "CAST(floor(l_extendedprice / 800) AS INTEGER)",
    "Internet_Signal_Strength": "CASE WHEN l_partkey % 89 = 0 THEN 'weak' ELSE CAST(CAST(floor(-l_quantity * 2.5 - 5) AS INTEGER) AS VARCHAR(9)) END",
    "Accelerometer_Range": "CAST(l_orderkey % 36 AS INTEGER) - 18",
    "Accelerometer_Resolution": "CASE WHEN l_suppkey % 83 = 0 THEN NULL ELSE CAST(l_discount / 4.9 AS VARCHAR(30)) END",
    "Latitude": "36.5 + CAST(l_orderkey % 1000 AS DOUBLE) / 150",
    "Longitude": "16.5 + CAST(l_partkey % 1000 AS DOUBLE) / 130",
}


def _rules_sql() -> str:
    from trustfold.functions.rules import BEHAVIOUR_LOG_RULES as B

    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    sets = " OR ".join(f"COALESCE({c} IN ({', '.join(map(text, vs))}), FALSE)" for c, vs in B.intentional)
    breaches = " OR ".join(f"COALESCE(TRY_CAST({b.column} AS DOUBLE) {b.op} {O.d(float(b.bound))}, FALSE)" for b in B.unintentional)
    return f"CASE WHEN {sets} THEN 'Intentional' WHEN {breaches} THEN 'Unintentional' ELSE 'Normal' END"


@query("label_full_log", f"SELECT row_id, {_rules_sql()} AS True_Class FROM (SELECT {', '.join(f'{e} AS {c}' for c, e in _FULL_LOG.items())} FROM lineitem) l")
def q_label_full_log(spark, sf):
    """C1-C3 with all six forbidden sets and ten breaches."""
    from trustfold.functions.rules import BEHAVIOUR_LOG_RULES

    log = read_table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _FULL_LOG.items()])
    return label(log, BEHAVIOUR_LOG_RULES).select(ROW_ID, "True_Class")


@query("class_sets", f"""WITH l AS (SELECT *, {LABEL_SQL} AS True_Class FROM {LOG_SQL} t)
SELECT row_id, CASE True_Class WHEN 'Normal' THEN 'kept' ELSE 'removed' END AS Dataset_Source, k,
       CASE WHEN True_Class = 'Normal' THEN NULL WHEN k = 2 THEN NULL ELSE value END AS value FROM l""")
def q_class_sets(spark, sf):
    """Rows by class, projected, tagged, united by name; ids by set operations."""
    lab = label(load_log(spark, sf))
    removed = S.id_union(SC.where_class(lab, "Intentional"), SC.where_class(lab, "Unintentional"))
    kept = S.id_difference(lab, removed)
    infinite = SC.inf_to_null(F.when(F.col("k") == 2, F.lit(float("inf"))).otherwise(F.col("value")))
    bad = SC.project(SC.exclude(lab, [USER]).withColumn("value", infinite), [ROW_ID, "k", "value"]).join(removed, ROW_ID)
    good = SC.project(lab, [ROW_ID, "k"]).join(kept, ROW_ID)
    return S.union_by_name(SC.tag_source(bad, "removed"), SC.tag_source(good, "kept")).select(ROW_ID, "Dataset_Source", "k", "value")


@query("scalar_functions", """SELECT event_id AS row_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE CAST(user_id AS INTEGER) END AS user_number,
       CASE WHEN event_id % 6 = 0 THEN 'none' ELSE strftime(ts, '%Y/%m/%d %H:%M:%S') END AS parsed, event_type AS name, event_type AS head,
       greatest(CAST(20.0 AS DOUBLE), least(CAST(120.0 AS DOUBLE), value)) AS clamped, round_even(value, 0) AS whole,
       round(CASE WHEN user_id % 7 = 0 THEN 0.0 ELSE value / (user_id % 7) * 100 END, 6) AS share FROM events""")
def q_scalar_functions(spark, sf):
    """S1, S2, S5, S6, S9, S12 over texts made of the events' columns."""
    from trustfold.functions import scalars as SF

    e = read_table(spark, sf, "events")
    i = F.col("event_id")
    user = F.concat(F.lit("User_"), F.when(i % 5 == 0, F.lit("x")).otherwise(F.col("user_id").cast("string")))
    when = F.when(i % 6 == 0, F.lit("no time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select(
        i.alias(ROW_ID), F.coalesce(SF.user_number(user), F.lit(-1)).alias("user_number"),
        F.coalesce(F.date_format(SF.parse_ts(when), "yyyy/MM/dd HH:mm:ss"), F.lit("none")).alias("parsed"),
        SF.norm_text(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))).alias("name"),
        SF.label_head(F.concat("event_type", F.lit(" ("), F.col("user_id").cast("string"), F.lit(")"))).alias("head"),
        SF.clamp(F.col("value"), 20.0, 120.0).alias("clamped"), SF.round_half_even(F.col("value")).alias("whole"),
        r6(SF.percent_of(F.col("value"), F.col("user_id") % 7)).alias("share"))


@query("first_event_by_user", """SELECT event_id, ts, user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def q_first_event_by_user(spark, sf):
    """One row per user and event type, the first in time."""
    return S.first_per_key(read_table(spark, sf, "events").drop("props"), ["user_id", "event_type"], ["ts", "event_id"])

"""Reputation replay.

Each labelled row moves its user's reputation: a normal row adds the
increment with an upper clamp at 1, a misbehaving row subtracts its penalty
with a lower clamp at 0.  Rows are applied in (Timestamp, row_id) order, null times last; the
start value is the user's first ``User_Reputation`` or a carried-over value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustfold.params import Scenario
from trustfold.plans.ordered import fold_per_key, fold_trace, keyed_row_number
from trustfold.plans.scenarios import fold_scenarios
from trustfold.sources.tables import ROW_ID, TARGET, TS, USER

SOURCE = "Dataset_Source"
NORMAL_SRC, UNINT_SRC, INT_SRC = "normal", "unintentional", "intentional"

_INF = float("inf")


def source_from_class(col: str = "True_Class"):
    return F.lower(F.col(col))


def _step_columns(params: Scenario, source: str = SOURCE) -> tuple[Column, Column, Column]:
    """The clamp-shift step (s, lo, hi) of a row; unknown sources do not move."""
    src = F.col(source)
    s = (
        F.when(src == NORMAL_SRC, F.lit(params.normal_increment))
        .when(src == UNINT_SRC, F.lit(-params.unintentional_penalty))
        .when(src == INT_SRC, F.lit(-params.intentional_penalty))
        .otherwise(F.lit(0.0))
    )
    lo = F.when(src.isin(UNINT_SRC, INT_SRC), F.lit(0.0)).otherwise(F.lit(-_INF))
    hi = F.when(src == NORMAL_SRC, F.lit(1.0)).otherwise(F.lit(_INF))
    return s.cast("double"), lo, hi


def with_steps(df: DataFrame, params: Scenario, source: str = SOURCE) -> DataFrame:
    """Attach the clamp-shift step (_s, _lo, _hi) of each row."""
    return df.withColumns(dict(zip(("_s", "_lo", "_hi"), _step_columns(params, source))))


def _prepared(labelled: DataFrame, params: Scenario, source: str, initial: DataFrame | None):
    steps = with_steps(labelled, params, source)
    if source != SOURCE:
        steps = steps.withColumn(SOURCE, F.col(source))
    return steps, None if initial is None else initial.select(USER, F.col("Final_Reputation").alias("initial"))


def replay_users(labelled: DataFrame, params: Scenario, source: str = SOURCE, initial: DataFrame | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """User_Id, Original_Reputation, Final_Reputation.  Nothing is written per row of the log.

    ``initial`` (User_Id, Final_Reputation) carries state over from a former run.
    """
    steps, init = _prepared(labelled, params, source, initial)
    per_key = fold_per_key(steps, USER, [TS, ROW_ID], TARGET, initial=init, num_partitions=num_partitions)
    return per_key.select(USER, F.col("start_value").alias("Original_Reputation"), F.col("final_value").alias("Final_Reputation"))


def replay_trace(labelled: DataFrame, params: Scenario, source: str = SOURCE, initial: DataFrame | None = None,
                 carry_cols=(ROW_ID, SOURCE), num_partitions: int | None = None) -> DataFrame:
    """User_Id, Timestamp, row_id, Dataset_Source, new_reputation, one row per row of the log."""
    steps, init = _prepared(labelled, params, source, initial)
    trace = fold_trace(steps, USER, [TS, ROW_ID], TARGET, carry_cols=list(carry_cols), initial=init, num_partitions=num_partitions)
    return trace.withColumnRenamed("value", "new_reputation")


def replay(labelled: DataFrame, params: Scenario, source: str = SOURCE, initial: DataFrame | None = None,
           carry_cols=(ROW_ID, SOURCE), num_partitions: int | None = None):
    """W1-W3 for callers that want both: (per_user, trace)."""
    return (replay_users(labelled, params, source, initial, num_partitions),
            replay_trace(labelled, params, source, initial, carry_cols, num_partitions))


def replay_scenarios(labelled: DataFrame, scenarios: Sequence[Scenario], source: str = SOURCE, carry_cols=(ROW_ID, SOURCE),
                     num_partitions: int | None = None) -> DataFrame:
    """W1 for several scenarios in one range sort: scenario_id and the columns of ``replay_trace``, a row per row of the log
    and scenario."""
    steps = [_step_columns(p, source) for p in scenarios]
    rows = labelled if source == SOURCE else labelled.withColumn(SOURCE, F.col(source))
    trace = fold_scenarios(rows, USER, [TS, ROW_ID], TARGET, steps, carry_cols, num_partitions)
    return _by_scenario(trace, "values", scenarios, "new_reputation")


def replay_scenario_users(labelled: DataFrame, scenarios: Sequence[Scenario], source: str = SOURCE, num_partitions: int | None = None) -> DataFrame:
    """W2-W3 for several scenarios: scenario_id, User_Id, Original_Reputation, Final_Reputation."""
    steps = [_step_columns(p, source) for p in scenarios]
    trace = fold_scenarios(labelled, USER, [TS, ROW_ID], TARGET, steps, [TARGET], num_partitions)
    place = F.struct(F.col(TS).isNull(), F.col(TS), F.col(ROW_ID))
    users = trace.groupBy(USER).agg(F.min_by(F.col(TARGET).cast("double"), place).alias("Original_Reputation"), F.max_by("values", place).alias("values"))
    return _by_scenario(users, "values", scenarios, "Final_Reputation")


def _by_scenario(df: DataFrame, values: str, scenarios: Sequence[Scenario], out: str) -> DataFrame:
    """One row per row and scenario instead of an array."""
    ids = F.array(*[F.lit(p.scenario_id) for p in scenarios])
    rest = [c for c in df.columns if c != values]
    long = df.select(*rest, F.posexplode(values).alias("_at", out))
    return long.select(F.get(ids, F.col("_at")).alias("scenario_id"), *rest, out)


def first_in_time(col: str) -> Column:
    """K10, an aggregate: the value on the first row in time order, null times last (partial, so no user is one task)."""
    return F.min_by(F.col(col), F.struct(F.col(TS).isNull(), F.col(TS), F.col(ROW_ID)))


def capped_experience(log: DataFrame, step: float = 0.001, cap: float = 1.0, digits: int = 4) -> DataFrame:
    """Experience grows by ``step`` per submission in time order, capped, rounded."""
    numbered = keyed_row_number(log, USER, [TS, ROW_ID], out="_rn")
    exp = F.round(F.least(F.lit(cap), F.col("User_Experience") + F.lit(step) * F.col("_rn")), digits)
    return numbered.withColumn("User_Experience", exp).drop("_rn")

"""End-to-end run for one scenario, as one lazily built Spark job graph:

load -> impute -> (rule labels | outlier consensus -> vote split) ->
replay (fold) -> per-user tables -> reports.

Actions happen only where a size must be known (chunk and sample counts) and
at the sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustfold.functions.rules import EVENT_RULES, label
from trustfold.operators import consensus as C
from trustfold.operators import detectors as D
from trustfold.operators.reputation import SOURCE, replay, source_from_class
from trustfold.operators.votes import top_n_split, vote_counts
from trustfold.params import Scenario


def supervised_sources(log: DataFrame, rules=EVENT_RULES) -> DataFrame:
    """Rule labels as replay sources (normal / unintentional / intentional)."""
    return label(log, rules).withColumn(SOURCE, source_from_class())


def unsupervised_sources(log: DataFrame, p: Scenario, methods=None, mode: str = "independent", vote_on: str = "outlier",
                         on_error: str = "raise") -> DataFrame:
    """Consensus split, then vote split of the misbehaving rows; every row gets a source.

    A method that fails is fatal in the consensus (G3), and in the vote unless ``on_error`` is "skip" (G16).
    """
    dp = D.DetectorParams.from_scenario(p)
    c = C.consensus(log, dp, methods=methods, mode=mode)
    votes = vote_counts(c["misbehaving"], dp, vote_on=vote_on, methods=methods, on_error=on_error)
    marked, _, _ = top_n_split(c["misbehaving"], votes, p.intentional_perc)
    kind = F.when(F.col("Is_Intentional") == 1, F.lit("intentional")).otherwise(F.lit("unintentional"))
    halves = c["normal"].withColumn(SOURCE, F.lit("normal")), marked.select(*log.columns, kind.alias(SOURCE))
    return halves[0].select(*log.columns, SOURCE).unionByName(halves[1])


def run(log: DataFrame, p: Scenario, methods=None, carry_over: bool = False) -> dict:
    """Both replays of one scenario; with ``carry_over`` the supervised run
    starts where the unsupervised one ended (the original's shared state)."""
    unsup = unsupervised_sources(log, p, methods)
    sup = supervised_sources(log)
    u_user, u_trace = replay(unsup, p)
    s_user, s_trace = replay(sup, p, initial=u_user if carry_over else None)
    return {"unsupervised": unsup, "supervised": sup, "unsup_user": u_user, "unsup_trace": u_trace,
            "sup_user": s_user, "sup_trace": s_trace}

"""Rule-based labelling (declarative): Intentional > Unintentional > Normal.

Rules are data: a mapping column -> forbidden values for intentional
misbehaviour, and a list of range breaches for unintentional misbehaviour.
Every rule is null-safe (a null cell never matches).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORMAL, UNINTENTIONAL, INTENTIONAL = "Normal", "Unintentional", "Intentional"
CLASSES = (NORMAL, UNINTENTIONAL, INTENTIONAL)

_OPS = {
    ">": lambda c, b: c > b,
    ">=": lambda c, b: c >= b,
    "<": lambda c, b: c < b,
    "<=": lambda c, b: c <= b,
}


@dataclass(frozen=True)
class Breach:
    """``column op bound``; with ``numeric_only`` a cell that is not a number never breaches."""

    column: str
    op: str
    bound: float
    numeric_only: bool = False

    def expr(self) -> Column:
        c = F.expr(f"try_cast(`{self.column}` AS DOUBLE)") if self.numeric_only else F.col(self.column)
        return F.coalesce(_OPS[self.op](c, F.lit(self.bound)), F.lit(False))


@dataclass(frozen=True)
class RuleSet:
    intentional: tuple[tuple[str, tuple], ...]
    unintentional: tuple[Breach, ...]

    def intentional_expr(self) -> Column:
        parts = [F.coalesce(F.col(c).isin(list(vals)), F.lit(False)) for c, vals in self.intentional]
        return reduce(lambda a, b: a | b, parts, F.lit(False))

    def unintentional_expr(self) -> Column:
        return reduce(lambda a, b: a | b, [b.expr() for b in self.unintentional], F.lit(False))

    def class_expr(self) -> Column:
        return (
            F.when(self.intentional_expr(), F.lit(INTENTIONAL))
            .when(self.unintentional_expr(), F.lit(UNINTENTIONAL))
            .otherwise(F.lit(NORMAL))
        )


# Forbidden sets and bounds of the original behaviour log (F1).
BEHAVIOUR_LOG_RULES = RuleSet(
    intentional=(
        ("User_Activity", ("Flying", "Swimming")),
        ("University_Area", ("Center", "Spinari")),
        ("Road_Accident", (6, 7, 8, 9)),
        ("Road_Type", ("5way", "6way")),
        ("Speed_Limit", (140, 150, 160)),
        ("Violation_Type", ("Lane_Discards", "Harassing_Driver", "Illegal_Parking")),
    ),
    unintentional=(
        Breach("Battery_Percentage", ">", 100),
        Breach("Internet_Signal_Strength", "<", -120, numeric_only=True),
        Breach("Internet_Signal_Strength", ">", -10, numeric_only=True),
        Breach("Accelerometer_Range", "<", -16),
        Breach("Accelerometer_Range", ">", 16),
        Breach("Accelerometer_Resolution", ">", 0.02, numeric_only=True),
        Breach("Latitude", "<", 37),
        Breach("Latitude", ">", 43),
        Breach("Longitude", "<", 17),
        Breach("Longitude", ">", 24),
    ),
)

# Rules of the events mapping used by the tests (error events are
# intentional; value above 150 or k below 3 is an unintentional breach).
EVENT_RULES = RuleSet(
    intentional=(("event_type", ("error",)),),
    unintentional=(Breach("value", ">", 150), Breach("k", "<", 3)),
)


def label(df: DataFrame, rules: RuleSet = EVENT_RULES, out: str = "True_Class") -> DataFrame:
    """One narrow projection, no shuffle."""
    return df.withColumn(out, rules.class_expr())


def class_counts(labelled: DataFrame, sample: DataFrame | None = None, col: str = "True_Class") -> DataFrame:
    """C4: class counts of the full table and, optionally, of a sample (one pass each)."""
    full = labelled.groupBy(col).agg(F.count(F.lit(1)).alias("n_full"))
    if sample is None:
        return full
    s = sample.groupBy(col).agg(F.count(F.lit(1)).alias("n_sample"))
    return full.join(s, col, "full").fillna(0, ["n_full", "n_sample"])


def class_count_if(labelled: DataFrame, col: str = "True_Class") -> DataFrame:
    """K7: the three class counts in one pass (``count_if``), one row."""
    return labelled.agg(*[F.count_if(F.col(col) == F.lit(c)).alias(f"n_{c.lower()}") for c in CLASSES],
                        F.count(F.lit(1)).alias("n_rows"))


LABEL_SQL = """CASE WHEN COALESCE(event_type IN ('error'), FALSE) THEN 'Intentional'
     WHEN COALESCE(value > 150, FALSE) OR COALESCE(k < 3, FALSE) THEN 'Unintentional'
     ELSE 'Normal' END"""

"""Scenario parameters: one immutable object per scenario, passed to every operator."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Scenario:
    scenario_id: int
    intentional_perc: float
    unintentional_perc: float
    overlap_perc: float
    missing_perc: float
    ground_sample_size: int
    contamination_rate: float
    threshold: float
    normal_increment: float
    unintentional_penalty: float
    intentional_penalty: float
    automl_budget: int
    automl_sample_size: int
    chunk_percent: float = 0.1

    def with_(self, **kw) -> "Scenario":
        return replace(self, **kw)


# The three published scenarios.
SCENARIOS = {
    1: Scenario(
        scenario_id=1,
        intentional_perc=0.05,
        unintentional_perc=0.1,
        overlap_perc=0.0,
        missing_perc=0.0,
        ground_sample_size=500,
        contamination_rate=0.01,
        threshold=3.0,
        normal_increment=0.005,
        unintentional_penalty=0.005,
        intentional_penalty=0.015,
        automl_budget=30,
        automl_sample_size=1000,
    ),
    2: Scenario(
        scenario_id=2,
        intentional_perc=0.1,
        unintentional_perc=0.2,
        overlap_perc=0.05,
        missing_perc=0.02,
        ground_sample_size=1000,
        contamination_rate=0.02,
        threshold=2.5,
        normal_increment=0.0075,
        unintentional_penalty=0.0075,
        intentional_penalty=0.02,
        automl_budget=30,
        automl_sample_size=1200,
    ),
    3: Scenario(
        scenario_id=3,
        intentional_perc=0.25,
        unintentional_perc=0.3,
        overlap_perc=0.10,
        missing_perc=0.15,
        ground_sample_size=3000,
        contamination_rate=0.08,
        threshold=4.0,
        normal_increment=0.005,
        unintentional_penalty=0.001,
        intentional_penalty=0.03,
        automl_budget=30,
        automl_sample_size=2000,
    ),
}


def scenario(scenario_id: int = 1) -> Scenario:
    if scenario_id not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario_id!r}; known: {sorted(SCENARIOS)}")
    return SCENARIOS[scenario_id]

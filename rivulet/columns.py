"""Column names of an ensemble; jobs take them as a parameter."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Cols:
    entity: str = "hydro_id"
    scenario: str = "scenario_id"
    stage: str = "stage_id"
    node: str = "node_id"
    value: str = "incremental_inflow_m3s"
    slack: str = "inflow_nonnegativity_slack_m3s"

    @property
    def group(self) -> list[str]:
        return [self.entity, self.stage]

    @property
    def key(self) -> list[str]:
        return [self.scenario, self.stage, self.node, self.entity]


ENSEMBLE = Cols()

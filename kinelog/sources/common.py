"""What the sources share: each reads files with Spark's readers and returns canonical states and agents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.derive import by_agent, diff, drop_single_detections, velocities
from ..schema import AGENT

STATES = ("scene", "agent_id", "scene_ts", "x", "y", "z", "vx", "vy", "ax", "ay", "heading", "length", "width", "height", "agent_type")


@dataclass(frozen=True)
class Scenes:
    """States of one source: canonical columns with extents and agent_type in each row, and the timestep in seconds."""

    states: DataFrame
    dt: float

    def agents(self) -> DataFrame:
        from ..operators.derive import agents

        return agents(self.states, "agent_type", "length", "width", "height")


def mapped_type(label: Column, types: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, t in types.items():
        out = F.when(label == name, t).otherwise(out)
    return out


def canonical(states: DataFrame) -> DataFrame:
    """The canonical columns in order; extents that a source lacks are null, z is 0."""
    missing = {c: F.lit(0.0 if c == "z" else None).cast("double") for c in STATES if c not in states.columns}
    return states.withColumns(missing).select(*STATES) if missing else states.select(*STATES)


def interpolated(column: str) -> Column:
    """A column's nulls filled inside an agent, linearly by row, as its neighbours with values have it."""
    w = by_agent()
    at = F.when(F.col(column).isNotNull(), F.row_number().over(w))
    row = F.row_number().over(w)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    a, b = F.last(column, True).over(before), F.first(column, True).over(after)
    i, j = F.last(at, True).over(before), F.first(at, True).over(after)
    return F.coalesce(F.col(column), a + (b - a) * (row - i) / (j - i))


__all__ = ["AGENT", "STATES", "Scenes", "canonical", "diff", "drop_single_detections", "interpolated", "mapped_type", "velocities"]

"""Simulation: a snapshot of agents, actions step by step, and what follows from them.

The actions of a run are given, so a whole run is one fold over the table (timesteps of an agent in order), not a job
for each step; ``step`` is there for a loop that decides as it goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AGENT
from ..spec import QuerySpec
from .elements import agent_elements
from .metrics import average_error, displacement, final_error, histogram

KEPT = (*AGENT, "scene_ts", "x", "y", "vx", "vy", "ax", "ay", "heading")
#: What agents have besides, where the table has it: it goes on as it was.
CARRIED = ("z", "length", "width", "height", "agent_type")


def kept(states: DataFrame) -> list[str]:
    return [*KEPT, *(c for c in CARRIED if c in states.columns)]


def snapshot(states: DataFrame, at: int) -> DataFrame:
    """The states up to a timestep of the agents that are present then."""
    there = states.filter(F.col("scene_ts") == at).select(*AGENT)
    return states.filter(F.col("scene_ts") <= at).join(there, list(AGENT), "left_semi").select(*kept(states))


def run(start: DataFrame, actions: DataFrame, at: int, dt: float = 1.0) -> DataFrame:
    """States after ``at`` from actions (scene, agent_id, scene_ts, x, y, heading, maybe z) of the agents in ``start``.

    Extents and types go on from the start, and so does z where actions have none.
    """
    carried = [c for c in CARRIED if c in start.columns]
    seed = start.filter(F.col("scene_ts") == at).select(*AGENT, "scene_ts", "x", "y", "heading", "vx", "vy", *carried)
    moves = actions.filter(F.col("scene_ts") > at).select(*AGENT, "scene_ts", "x", "y", "heading", *(c for c in ("z",) if c in carried and c in actions.columns))
    # Both sides may come partitioned by agent, and a union that counts on it can lose that when partitions are coalesced.
    rows = seed.unionByName(moves, allowMissingColumns=True).repartition(*AGENT)
    seeded = F.max(F.when(F.col("scene_ts") == at, 1)).over(Window.partitionBy(*AGENT))
    rows = rows.withColumn("_seeded", seeded).filter("_seeded = 1").drop("_seeded")
    w = Window.partitionBy(*AGENT).orderBy("scene_ts")
    for p, v in (("x", "vx"), ("y", "vy")):
        rows = rows.withColumn(v, F.when(F.col("scene_ts") == at, F.col(v)).otherwise((F.col(p) - F.lag(p).over(w)) / dt))
    for v, a in (("vx", "ax"), ("vy", "ay")):
        rows = rows.withColumn(a, (F.col(v) - F.lag(v).over(w)) / dt)
    for c in carried:
        rows = rows.withColumn(c, F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter(F.col("scene_ts") > at).select(*kept(start))


def step(states: DataFrame, actions: DataFrame, now: int, dt: float = 1.0) -> DataFrame:
    """One step: all rows of the next timestep are dropped, those of the actions put in their place.

    A loop over steps should write its states now and then, since each step reads them twice.
    """
    after = run(states, actions.filter(F.col("scene_ts") == now + 1), now, dt)
    return states.filter(F.col("scene_ts") != now + 1).select(*kept(states)).unionByName(after)


def add_agents(states: DataFrame, added: DataFrame, dt: float = 1.0) -> DataFrame:
    """Trajectories of new agents (KEPT's keys, x, y, heading); those whose name is taken are left out."""
    from .derive import velocities

    new = added.join(states.select(*AGENT).distinct(), list(AGENT), "left_anti")
    made = velocities(new, dt)
    return states.select(*kept(states)).unionByName(made.select(*(c for c in kept(states) if c in made.columns)), allowMissingColumns=True)


def finished(states: DataFrame, now: int, scene_suffix: str) -> DataFrame:
    """The rows up to now as scenes of their own."""
    return states.filter(F.col("scene_ts") <= now).withColumn("scene", F.concat(F.col("scene").cast("string"), F.lit(scene_suffix)))


def metrics(truth: DataFrame, simulated: DataFrame, first: int, last: int) -> DataFrame:
    """ade and fde of each agent over first..last."""
    errors = displacement(truth, simulated, first, last)
    return average_error(errors).join(final_error(errors), list(AGENT))


def observations(states: DataFrame, now: int, spec: QuerySpec) -> DataFrame:
    """What each agent present at a timestep sees then: elements from the rows up to it, so their futures are empty."""
    past = states.filter(F.col("scene_ts") <= now)
    there = past.filter(F.col("scene_ts") == now).select(*AGENT, "scene_ts")
    return agent_elements(there, past, spec)


def reset(states: DataFrame, start: int, spec: QuerySpec) -> DataFrame:
    """A run taken back to its start: the observations there. What was simulated stays until it is overwritten."""
    return observations(states, start, spec)


def stats(truth: DataFrame, simulated: DataFrame, value: Column, edges: list[float], first: int, last: int, *by: str) -> DataFrame:
    """The histogram of a figure over first..last of each side by itself: side (gt or sim) and the columns of ``histogram``."""
    span = F.col("scene_ts").between(first, last)
    sides = [histogram(side.filter(span), value, edges, *by).withColumn("side", F.lit(name)) for name, side in (("gt", truth), ("sim", simulated))]
    return sides[0].unionByName(sides[1])

"""What follows from positions: differences, headings, agents, presence. One partitioning by agent serves all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import in_libm, length, wrap, wrapped_turn
from ..schema import AGENT

#: So near to half a turn a change counts as turning right back.
BACK = 1e-6


def by_agent(*more: str) -> Window:
    return Window.partitionBy(*AGENT, *more).orderBy("scene_ts")


def diff(column: str) -> Column:
    """Change since the row before of the same agent; the first row takes the change to the next one. Null for a single row."""
    w, c = by_agent(), F.col(column)
    return F.coalesce(c - F.lag(c).over(w), F.lead(c).over(w) - c)


def velocities(states: DataFrame, dt: float = 1.0) -> DataFrame:
    """Adds vx, vy, ax, ay and, if missing, heading along the velocity. A single row gets zeros."""
    out = states
    for source, target in (("x", "vx"), ("y", "vy"), ("vx", "ax"), ("vy", "ay")):
        out = out.withColumn(target, F.coalesce(diff(source) / dt, F.lit(0.0)))
    return out if "heading" in states.columns else out.withColumn("heading", F.atan2("vy", "vx"))


def drop_single_detections(states: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*AGENT))
    return states.withColumn("_n", n).filter("_n > 1").drop("_n")


def agents(states: DataFrame, *constant: str) -> DataFrame:
    """One row an agent: first and last timestep, rows, and the first non-null value of constant columns."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("scene_ts"))).alias(c) for c in constant]
    return states.groupBy(*AGENT).agg(F.min("scene_ts").alias("first_ts"), F.max("scene_ts").alias("last_ts"), F.count("*").alias("n_rows"), *first)


def missing_frames(found: DataFrame) -> DataFrame:
    """Agents with fewer rows than their span has timesteps."""
    return found.withColumn("n_missing", F.col("last_ts") - F.col("first_ts") + 1 - F.col("n_rows")).filter("n_missing > 0")


def mode_by_agent(states: DataFrame, column: str) -> DataFrame:
    """The most frequent value of each agent, the least on ties."""
    counted = states.filter(F.col(column).isNotNull()).groupBy(*AGENT, column).count()
    return counted.groupBy(*AGENT).agg(F.min_by(column, F.struct(-F.col("count"), F.col(column))).alias(column))


def presence(found: DataFrame) -> DataFrame:
    """(scene, agent_id, scene_ts) for each timestep from first to last."""
    return found.select(*AGENT, F.explode(F.sequence("first_ts", "last_ts")).alias("scene_ts"))


def unwrap(states: DataFrame, column: str = "heading", out: str = "heading_unwrapped", along: tuple[str, str] | None = None) -> DataFrame:
    """Jumps by whole turns removed along each agent.

    ``along``: the vector that the column is the direction of, if it is. Where an agent turns right back, the last bit of the arc tangent decides to
    which side; it is that of the C library then.
    """
    w = by_agent()
    change = F.col(column) - F.lag(column).over(w)
    step = wrap(change)
    if along:
        back = F.abs(F.abs(change) - F.pi()) < BACK
        ends = [c for rows in (lambda n: F.lag(n).over(w), F.col) for c in map(rows, along)]
        states = states.withColumns({"_change": step} | {f"_{k}": F.when(back, c) for k, c in enumerate(ends)})
        step = F.coalesce(in_libm(wrapped_turn, *(F.col(f"_{k}") for k in range(4))), F.col("_change"))
    rows = states.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    total = F.first(column).over(w) + F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, total).drop("_step", "_change", *(f"_{k}" for k in range(4)))


def correct_slow_yaw(states: DataFrame, threshold: float) -> DataFrame:
    """Headings whose changes at low speed are undone, summed up from the agent's first."""
    w = by_agent()
    change = F.coalesce(F.when(length(F.col("vx"), F.col("vy")) >= threshold, F.col("heading") - F.lag("heading").over(w)), F.lit(0.0))
    total = F.first("heading").over(w) + F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return states.withColumn("_step", change).withColumn("corrected", total).drop("_step")


def stationary(states: DataFrame, limit: float = 1.0) -> DataFrame:
    """Whether each agent's last place is less than ``limit`` from its first (in squared metres)."""
    ends = states.groupBy(*AGENT).agg(F.min_by(F.struct("x", "y"), "scene_ts").alias("a"), F.max_by(F.struct("x", "y"), "scene_ts").alias("b"))
    moved = F.pow(F.col("b.x") - F.col("a.x"), 2) + F.pow(F.col("b.y") - F.col("a.y"), 2)
    return ends.select(*AGENT, (moved < limit).alias("stationary"))


def arc_length(states: DataFrame) -> DataFrame:
    """Distance travelled since the agent's first row."""
    w = by_agent()
    step = F.coalesce(length(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return states.withColumn("_step", step).withColumn("travelled", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def fill_gaps(states: DataFrame, *columns: str) -> DataFrame:
    """A row for each missing timestep inside an agent, columns linear between the rows around."""
    w = by_agent()
    ahead = [F.lead(c).over(w).alias(f"_n_{c}") for c in ("scene_ts", *columns)]
    rows = states.select(*AGENT, "scene_ts", *columns, *ahead)
    steps = F.coalesce(F.col("_n_scene_ts") - F.col("scene_ts"), F.lit(1))
    rows = rows.withColumn("_steps", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_steps") - 1)))
    share = F.col("_i") / F.col("_steps")
    return rows.select(
        *AGENT, (F.col("scene_ts") + F.col("_i")).alias("scene_ts"),
        *(F.when(F.col("_i") == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"_n_{c}") - F.col(c)) * share).alias(c) for c in columns),
        (F.col("_i") > 0).alias("filled"),
    )

"""Displacement errors and histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import length
from ..schema import AGENT
from .derive import by_agent, diff


def displacement(truth: DataFrame, simulated: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Distance between both at each (scene, agent_id, scene_ts) that both have."""
    keys = [*AGENT, "scene_ts"]
    pairs = truth.select(*keys, "x", "y").join(simulated.select(*keys, F.col("x").alias("sx"), F.col("y").alias("sy")), keys)
    if first is not None:
        pairs = pairs.filter(F.col("scene_ts") >= first)
    if last is not None:
        pairs = pairs.filter(F.col("scene_ts") <= last)
    return pairs.select(*keys, length(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")).alias("error"))


def average_error(errors: DataFrame) -> DataFrame:
    return errors.groupBy(*AGENT).agg(F.avg("error").alias("ade"))


def final_error(errors: DataFrame) -> DataFrame:
    """The error at each agent's last timestep that has one."""
    return errors.filter("error IS NOT NULL").groupBy(*AGENT).agg(F.max_by("error", "scene_ts").alias("fde"))


def speed() -> Column:
    return length(F.col("vx"), F.col("vy"))


def longitudinal_acceleration() -> Column:
    """Magnitude times the cosine of the heading, as the data model defines it."""
    return length(F.col("ax"), F.col("ay")) * F.cos("heading")


def lateral_acceleration() -> Column:
    return length(F.col("ax"), F.col("ay")) * F.sin("heading")


def with_jerk(states: DataFrame, dt: float = 1.0) -> DataFrame:
    """Adds jerk: the change of the acceleration's magnitude along each agent."""
    return states.withColumn("_a", length(F.col("ax"), F.col("ay"))).withColumn("jerk", diff("_a") / dt).drop("_a")


def histogram(rows: DataFrame, value: Column, edges: list[float], *by: str) -> DataFrame:
    """(by, bin, low, high, n): bins half open, the last one closed, values outside dropped, empty bins 0.

    Values meet the edges in an expression, so counting is a partial aggregate before the shuffle.
    """
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges go up")
    n = len(edges) - 1
    bins = F.lit(None).cast("int")
    for k in range(n):
        inside = (value >= edges[k]) & ((value <= edges[k + 1]) if k == n - 1 else (value < edges[k + 1]))
        bins = F.when(inside, k).otherwise(bins)
    counted = rows.groupBy(*by, bins.alias("bin")).agg(F.count("*").alias("n")).filter("bin IS NOT NULL")
    frame = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    every = frame.withColumn("bin", F.explode(F.array(*map(F.lit, range(n)))))
    low, high = (F.element_at(F.array(*(F.lit(float(e)) for e in some)), F.col("bin") + 1) for some in (edges[:-1], edges[1:]))
    return every.join(counted, [*by, "bin"], "left").select(*by, F.col("bin").cast("long").alias("bin"), low.alias("low"), high.alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def even_edges(low: float, high: float, bins: int) -> list[float]:
    return [low + (high - low) * k / bins for k in range(bins + 1)] if math.isfinite(low + high) else []


def per_agent_extremes(states: DataFrame) -> DataFrame:
    """Greatest speed and its timestep for each agent, and the distance it covered."""
    step = length(F.col("x") - F.lag("x").over(by_agent()), F.col("y") - F.lag("y").over(by_agent()))
    return states.withColumn("_d", F.coalesce(step, F.lit(0.0))).groupBy(*AGENT).agg(F.max(speed()).alias("top_speed"), F.sum("_d").alias("covered"))

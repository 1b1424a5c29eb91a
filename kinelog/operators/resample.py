"""Resampling of the time axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import wrap
from ..schema import AGENT
from .derive import by_agent


def upsample(states: DataFrame, factor: int, columns: tuple[str, ...], angle: str | None = None, constant: tuple[str, ...] = ()) -> DataFrame:
    """Each sample at ``factor`` times its timestep and linear ones between two. The last sample adds none.

    An angle goes the short way round and comes out wrapped. Constant columns go on from the sample before.
    """
    w = by_agent()
    every = (*columns, *([angle] if angle else []))
    rows = states.select(*AGENT, "scene_ts", *every, *constant, F.lead("scene_ts").over(w).alias("_n"), *(F.lead(c).over(w).alias(f"_n_{c}") for c in every))
    steps = F.coalesce((F.col("_n") - F.col("scene_ts")) * factor, F.lit(1))
    rows = rows.withColumn("_steps", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_steps") - 1)))
    share = F.col("_i") / F.col("_steps")

    def between(c: str):
        move = F.col(f"_n_{c}") - F.col(c)
        if c == angle:
            return wrap(F.col(c) + F.coalesce(wrap(move) * share, F.lit(0.0))).alias(c)
        return F.when(F.col("_i") == 0, F.col(c)).otherwise(F.col(c) + move * share).alias(c)

    return rows.select(*AGENT, (F.col("scene_ts") * factor + F.col("_i")).alias("scene_ts"), *map(between, every), *constant)


def downsample(states: DataFrame, factor: int) -> DataFrame:
    """Rows at multiples of ``factor``, renumbered. A filter and a projection: nothing is shuffled."""
    return states.filter(F.col("scene_ts") % factor == 0).withColumn("scene_ts", (F.col("scene_ts") / factor).cast("long"))


def upsample_status(lights: DataFrame, factor: int) -> DataFrame:
    """Status at every new timestep from the nearer sample, the earlier one on ties."""
    w = Window.partitionBy("scene", "lane_id").orderBy("scene_ts")
    rows = lights.withColumns({"_n": F.lead("scene_ts").over(w), "_s": F.lead("status").over(w)})
    rows = rows.withColumn("_steps", F.coalesce((F.col("_n") - F.col("scene_ts")) * factor, F.lit(1))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_steps") - 1)))
    return rows.select("scene", "lane_id", (F.col("scene_ts") * factor + F.col("_i")).alias("scene_ts"), F.when(F.col("_i") * 2 > F.col("_steps"), F.col("_s")).otherwise(F.col("status")).alias("status"))


def downsample_status(lights: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th row of a lane by position, as the data model has it, renumbered."""
    w = Window.partitionBy("scene", "lane_id").orderBy("scene_ts")
    return lights.withColumn("_r", F.row_number().over(w) - 1).filter(F.col("_r") % factor == 0).withColumn("scene_ts", F.floor(F.col("scene_ts") / factor)).drop("_r")


def resample_agents(found: DataFrame, factor: int) -> DataFrame:
    """First and last timestep after upsampling by ``factor``, or downsampling by its negative."""
    if factor > 0:
        return found.withColumns({"first_ts": F.col("first_ts") * factor, "last_ts": F.col("last_ts") * factor})
    n = -factor
    return found.withColumns({"first_ts": F.ceil(F.col("first_ts") / n), "last_ts": F.floor(F.col("last_ts") / n)}).filter("first_ts <= last_ts")


def resample_scenes(scenes: DataFrame, factor: int) -> DataFrame:
    """Scenes (length_timesteps, dt and more) after upsampling by ``factor``, or downsampling by its negative. The first timestep stays, so a scene of n has n - 1 steps between."""
    steps = F.col("length_timesteps") - 1
    length, dt = (steps * factor, F.col("dt") / factor) if factor > 0 else (F.floor(steps / -factor), F.col("dt") * -factor)
    return scenes.withColumns({"length_timesteps": (length + 1).cast("long"), "dt": dt})

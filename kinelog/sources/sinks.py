"""Canonical tables on disk: parquet by env and timestep, written over a partition at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import downsample, upsample
from ..schema import AGENT
from ..spec import ratio


def save_states(states: DataFrame, path: str, env: str, dt: float) -> None:
    """States under env and dt. Only that partition is replaced, so a rerun does no harm; rows of an agent lie together."""
    out = states.withColumns({"env": F.lit(env), "dt": F.lit(f"{dt:.2f}")})
    out.repartition("scene").sortWithinPartitions("scene", "agent_id", "scene_ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("env", "dt").parquet(path)


def read_states(spark: SparkSession, path: str, env: str, dt: float) -> DataFrame:
    """States of one env and timestep; other partitions are pruned."""
    return spark.read.parquet(path).filter((F.col("env") == env) & (F.col("dt").cast("double") == round(dt, 2)))


def states_at(spark: SparkSession, path: str, env: str, native_dt: float, dt: float) -> DataFrame:
    """States at a timestep, resampled from the native ones (and saved) where they aren't there yet."""
    found = read_states(spark, path, env, dt)
    if not found.isEmpty():
        return found
    native, factor = read_states(spark, path, env, native_dt).drop("env", "dt"), ratio(native_dt, dt)
    moving = [c for c in ("x", "y", "z", "vx", "vy", "ax", "ay", "length", "width", "height") if c in native.columns]
    constant = [c for c in native.columns if c not in (*AGENT, "scene_ts", "heading", *moving)]
    made = upsample(native, factor, tuple(moving), "heading", tuple(constant)) if factor > 0 else downsample(native, -factor)
    save_states(made.select(*native.columns), path, env, dt)
    return read_states(spark, path, env, dt)

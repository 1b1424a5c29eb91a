"""Trajectories out of the event table, and the same in SQL.

A user is an agent, a scene takes every fourth user, a timestep is an event in order; value and props.k are the place.
An agent's type follows from its most frequent event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import derive

TYPE_OF_EVENT = {"click": 1, "view": 2, "purchase": 3, "signup": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("agent_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("agent_id"), "ts", "event_id", F.col("value").alias("x"), k.alias("y"), "event_type")
    return rows.select((F.col("agent_id") % 4).alias("scene"), "agent_id", (F.row_number().over(w) - 1).cast("long").alias("scene_ts"), "x", "y", "event_type", "ts")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.velocities(positions(spark, sf_dir))


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(0)
    for name, t in TYPE_OF_EVENT.items():
        kind = F.when(F.col("event_type") == name, t).otherwise(kind)
    return derive.mode_by_agent(positions(spark, sf_dir), "event_type").select("scene", "agent_id", kind.alias("agent_type"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.agents(positions(spark, sf_dir)).join(types(spark, sf_dir), ["scene", "agent_id"])


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).join(types(spark, sf_dir), ["scene", "agent_id"])


def create_views(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views traj, states, types and agents for ``spark.sql``: the tables of this module by name."""
    for name, make in (("traj", positions), ("states", states), ("types", types), ("agents", agents)):
        make(spark, sf_dir).createOrReplaceTempView(name)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean place of each agent in each hour that has an event: timesteps are missing."""
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("scene"), F.col("user_id").alias("agent_id"), hour.alias("scene_ts"), "value")
    return rows.groupBy("scene", "agent_id", "scene_ts").agg(F.avg("value").alias("x"), F.max("value").alias("y"))


BY = "(PARTITION BY scene, agent_id ORDER BY scene_ts)"
TRAJ = """traj AS (
  SELECT user_id % 4 AS scene, user_id AS agent_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS scene_ts,
    value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type, ts FROM events)"""
STATES = TRAJ + f""", v1 AS (
  SELECT *, coalesce(x - lag(x) OVER w, lead(x) OVER w - x, 0.0) AS vx, coalesce(y - lag(y) OVER w, lead(y) OVER w - y, 0.0) AS vy FROM traj WINDOW w AS {BY}
), states AS (
  SELECT *, coalesce(vx - lag(vx) OVER w, lead(vx) OVER w - vx, 0.0) AS ax, coalesce(vy - lag(vy) OVER w, lead(vy) OVER w - vy, 0.0) AS ay,
    atan2(vy, vx) AS heading FROM v1 WINDOW w AS {BY})"""
_KINDS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_OF_EVENT.items())
TYPES = f"""types AS (
  SELECT scene, agent_id, CASE event_type {_KINDS} ELSE 0 END AS agent_type
  FROM (SELECT *, row_number() OVER (PARTITION BY scene, agent_id ORDER BY n DESC, event_type) AS r
        FROM (SELECT scene, agent_id, event_type, count(*) AS n FROM traj GROUP BY ALL)) WHERE r = 1
), agents AS (
  SELECT scene, agent_id, min(scene_ts) AS first_ts, max(scene_ts) AS last_ts, count(*) AS n_rows, any_value(agent_type) AS agent_type
  FROM traj JOIN types USING (scene, agent_id) GROUP BY scene, agent_id)"""
HOURLY = """hourly AS (
  SELECT user_id % 4 AS scene, user_id AS agent_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS scene_ts, avg(value) AS x, max(value) AS y
  FROM events GROUP BY ALL)"""

"""Which (scene, agent, timestep) a query answers for: filters by tag, type and time, ordinals, batches."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AGENT
from ..scratch import written
from ..spec import QuerySpec
from .ordered import asof


def tag_matches(tags: Column, wanted: str) -> Column:
    """Whether an array of tags holds every part of ``a-b-c``."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted.split("-"))), tags)) == 0


def matching(scenes: DataFrame, wanted: list[str], descriptions: list[str] | None = None) -> DataFrame:
    """Scenes of each wanted tag, one row for each that fits; with descriptions, only those that hold one of them."""
    found = reduce(DataFrame.unionByName, (scenes.filter(tag_matches(F.col("tags"), w)).withColumn("wanted", F.lit(w)) for w in wanted))
    if descriptions:
        low = F.lower("description")
        found = found.filter(reduce(Column.__or__, (low.contains(d.lower()) for d in descriptions)))
    return found


def of_types(found: DataFrame, only: frozenset[int] | None, without: frozenset[int]) -> DataFrame:
    if without:
        found = found.filter(~F.col("agent_type").isin(*sorted(without)))
    return found if only is None else found.filter(F.col("agent_type").isin(*sorted(only)))


def valid_range(found: DataFrame, spec: QuerySpec) -> DataFrame:
    """Agents with lo_ts and hi_ts, between which history and future are long enough; others go."""
    return found.withColumns({"lo_ts": F.col("first_ts") + spec.least("history"), "hi_ts": F.col("last_ts") - spec.least("future")}).filter("lo_ts <= hi_ts")


def predicted(found: DataFrame, spec: QuerySpec) -> DataFrame:
    """The agents that a query answers for, with lo_ts and hi_ts. The ego is left out where its future is given."""
    some = of_types(found, spec.only_predict if spec.only_predict is not None else spec.only_types, spec.no_types)
    if spec.with_ego_future:
        some = some.filter(F.col("agent_id").cast("string") != "ego")
    if spec.ego_only:
        some = some.filter(F.col("agent_id").cast("string") == "ego")
    return valid_range(some, spec)


def agent_index(found: DataFrame, spec: QuerySpec) -> DataFrame:
    """(scene, agent_id, scene_ts) of every answer of an agent-centric query. Range arithmetic; no state is read."""
    return predicted(found, spec).select(*AGENT, F.explode(F.sequence("lo_ts", "hi_ts")).alias("scene_ts"))


def index_sizes(found: DataFrame, spec: QuerySpec) -> DataFrame:
    """Answers of each scene, without listing them."""
    return predicted(found, spec).groupBy("scene").agg(F.sum(F.col("hi_ts") - F.col("lo_ts") + 1).alias("n"))


def timely(spec: QuerySpec) -> Column:
    """Whether history and future are long enough at a row with scene_ts, first_ts and last_ts."""
    return (F.col("scene_ts") >= F.col("first_ts") + spec.least("history")) & (F.col("scene_ts") <= F.col("last_ts") - spec.least("future"))


def scene_index(found: DataFrame, spec: QuerySpec) -> DataFrame:
    """(scene, scene_ts) at which an agent of the wanted types is present and some present agent has the time."""
    everyone = found.select("scene", F.explode(F.sequence("first_ts", "last_ts")).alias("scene_ts"), "agent_type", "first_ts", "last_ts")
    wanted = F.lit(True) if spec.only_types is None else F.col("agent_type").isin(*sorted(spec.only_types))
    kept = ~F.col("agent_type").isin(*sorted(spec.no_types)) if spec.no_types else F.lit(True)
    held = everyone.groupBy("scene", "scene_ts").agg(F.bool_or(wanted).alias("a"), F.bool_or(kept).alias("b"), F.bool_or(timely(spec)).alias("c"))
    return held.filter("a AND b AND c").select("scene", "scene_ts")


def ordinals(found: DataFrame, spec: QuerySpec) -> DataFrame:
    """Agents with the ordinal of their first answer, counted over scenes and agents in order.

    Sums run inside a scene and over scenes: a task sees the agents of a scene, or a row for each scene.
    """
    some = predicted(found, spec).withColumn("n", F.col("hi_ts") - F.col("lo_ts") + 1)
    inside = Window.partitionBy("scene").orderBy("agent_id").rowsBetween(Window.unboundedPreceding, -1)
    scenes = some.groupBy("scene").agg(F.sum("n").alias("total"))
    before = scenes.withColumn("offset", F.coalesce(F.sum("total").over(Window.orderBy("scene").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return some.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "scene").select(
        *AGENT, "lo_ts", "hi_ts", (F.col("offset") + F.col("_in")).alias("first_ordinal")
    )


def lookup(found: DataFrame, wanted: list[int]) -> DataFrame:
    """The (scene, agent_id, scene_ts) of given ordinals, from what ``ordinals`` returns: of each, the last agent that begins up to it."""
    asked = found.sparkSession.createDataFrame([(0, int(i)) for i in wanted], "_all int, ordinal long")
    agents = written(found.withColumn("_all", F.lit(0)))
    hit = asof(asked, agents, ("_all",), "ordinal", (*AGENT, "lo_ts", "hi_ts", "first_ordinal"), right_at="first_ordinal", into="_a")
    at = F.col("_a.lo_ts") + F.col("ordinal") - F.col("_a.first_ordinal")
    return hit.filter(at <= F.col("_a.hi_ts")).select(*(F.col(f"_a.{c}") for c in AGENT), at.alias("scene_ts"), "ordinal")


def time_batches(index: DataFrame, k: int = 0) -> DataFrame:
    """Answers grouped by (scene, scene_ts), for the timesteps of each scene's k-th agent."""
    ranked = index.select(*AGENT).distinct().withColumn("_k", F.row_number().over(Window.partitionBy("scene").orderBy("agent_id")) - 1)
    lead = ranked.filter(F.col("_k") == k).select(*AGENT)
    when = index.join(lead, list(AGENT), "left_semi").select("scene", "scene_ts")
    return index.join(when, ["scene", "scene_ts"], "left_semi").groupBy("scene", "scene_ts").agg(F.sort_array(F.collect_list("agent_id")).alias("agents"), F.count("*").alias("n"))


# Scenes.


def long_enough(scenes: DataFrame, least: int = 2) -> DataFrame:
    """Scenes (length_timesteps) of some timesteps at least."""
    return scenes.filter(F.col("length_timesteps") >= least)


def tagged(scenes: DataFrame, by_prefix: bool = False) -> DataFrame:
    """Scenes with their tags: env, split and location (``by_prefix``: what of it comes before the first dash)."""
    location = F.substring_index("location", "-", 1) if by_prefix else F.col("location")
    return scenes.withColumn("tags", F.array_compact(F.array("env", "data_split", location)))


def of_source(scenes: DataFrame, env: str, wanted: list[str], descriptions: list[str] | None = None, by_prefix: bool = False) -> DataFrame:
    """The scenes of one source that fit any of the wanted tags and descriptions, each once, too short ones left out."""
    found = matching(tagged(long_enough(scenes.filter(F.col("env") == env)), by_prefix), wanted, descriptions)
    return found.drop("wanted", "tags").distinct()


def shuffled_split(names: list[str], shares: dict[str, float], seed: int = 0) -> dict[str, str]:
    """Name -> part: names in a seeded shuffle, dealt by shares; the last part takes the rest. A few hundred names, on the driver."""
    order = list(names)
    random.Random(seed).shuffle(order)
    out, at, parts = {}, 0, list(shares)
    for k, part in enumerate(parts):
        end = len(order) if k == len(parts) - 1 else at + int(len(order) * shares[part])
        out |= dict.fromkeys(order[at:end], part)
        at = end
    return out


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows in an order that a seed fixes: by a hash of their keys."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)

"""Elements: what a query returns for each (scene, agent, timestep), and their padding to batches.

Windows are gathered once for each state, before the neighbour join; frames differ for each target, so everything is
turned into the target's frame after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import frame_matrix
from ..schema import AGENT
from ..spec import QuerySpec
from .neighbors import nearest, radius_of, ranked, within
from .windows import with_windows

STATE = ("x", "y", "vx", "vy", "ax", "ay", "heading")


def state_columns(spec: QuerySpec) -> tuple[str, ...]:
    return (*STATE, "z") if spec.with_z else STATE


def seen_from(state: Column, frame: Column, with_z: bool = False) -> Column:
    """A state (struct of STATE) from the frame of another: all elements less the frame's, then the pairs turned. The heading isn't wrapped,
    heights stay those above the ground.

    The frame holds cosine and sine of its heading, so they are worked out once for all states seen from it.
    """
    out, c, s = [], frame["c"], frame["s"]
    for a, b in (("x", "y"), ("vx", "vy"), ("ax", "ay")):
        u, v = state[a] - frame[a], state[b] - frame[b]
        out += [(u * c + v * s).alias(a), (v * c - u * s).alias(b)]
    return F.struct(*([state["scene_ts"].alias("scene_ts")]), *out, (state["heading"] - frame["heading"]).alias("heading"), *([state["z"].alias("z")] if with_z else []))


def frame_of(still: bool = False) -> Column:
    """The current state as a frame; of a stationary one the velocity and acceleration count as zero."""
    moving = (F.lit(0.0).alias(c) if still else F.col(c) for c in ("vx", "vy", "ax", "ay"))
    return F.struct("x", "y", "heading", *moving, F.cos("heading").alias("c"), F.sin("heading").alias("s"))


def agent_elements(index: DataFrame, states: DataFrame, spec: QuerySpec) -> DataFrame:
    """One row for each answer: current state, history and future in its own frame, neighbours with theirs, the frame's matrix.

    ``states``: the canonical columns and agent_type. Answers without a neighbour stay.
    """
    columns, still = state_columns(spec), not spec.relative_derivatives
    full = with_windows(states.select(*AGENT, "scene_ts", "agent_type", *columns), spec, *columns)
    targets = full.join(index, [*AGENT, "scene_ts"], "left_semi")
    limit = max([r for r in (spec.default_radius, *spec.radii.values()) if r is not None], default=None)
    turn = lambda array: F.transform(array, lambda s: seen_from(s, F.col("frame"), spec.with_z))
    own = targets.withColumn("frame", frame_of(still)).select(
        *AGENT, "scene_ts", "agent_type", "frame",
        seen_from(F.struct("scene_ts", *columns), F.col("frame"), spec.with_z).alias("current"), turn(F.col("history")).alias("history"), turn(F.col("future")).alias("future"),
        frame_matrix(F.col("x"), F.col("y"), F.col("heading")).alias("frame_from_world"),
    )
    if limit is None:
        return own.withColumn("neighbors", F.lit(None))
    reach = (lambda n, t: radius_of(spec.radii, spec.default_radius, n, t)) if spec.radii else None
    if spec.max_neighbors is not None:
        pairs = nearest(targets, states, spec.max_neighbors, limit, "agent_type", reach=reach)
    else:
        pairs = within(targets, states, limit, "agent_type")
        pairs = ranked(pairs.filter(F.col("distance") <= reach(F.col("n_agent_type"), F.col("t_agent_type"))) if reach else pairs)
    theirs = full.select("scene", F.col("agent_id").alias("n_agent_id"), "scene_ts", F.col("history").alias("n_history"), F.col("future").alias("n_future"))
    frames = targets.select("scene", F.col("agent_id").alias("t_agent_id"), "scene_ts", frame_of(still).alias("frame"))
    joined = pairs.join(theirs, ["scene", "n_agent_id", "scene_ts"]).join(frames, ["scene", "t_agent_id", "scene_ts"])
    neighbor = F.struct("rank", F.col("n_agent_id").alias("agent_id"), F.col("n_agent_type").alias("agent_type"), "distance", turn(F.col("n_history")).alias("history"), turn(F.col("n_future")).alias("future"))
    gathered = joined.groupBy("scene", F.col("t_agent_id").alias("agent_id"), "scene_ts").agg(F.array_sort(F.collect_list(neighbor)).alias("neighbors"))
    return own.join(gathered, [*AGENT, "scene_ts"], "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast(gathered.schema["neighbors"].dataType)))


def flat_elements(elements: DataFrame) -> DataFrame:
    """The figures of each element: window lengths, neighbours, nearest distance and place, where history begins and future ends."""
    first, last = F.col("history")[0], F.element_at("future", -1)
    return elements.select(
        *AGENT, "scene_ts", F.size("history").cast("long").alias("history_len"), F.size("future").cast("long").alias("future_len"),
        first["x"].alias("start_x"), first["y"].alias("start_y"), F.when(F.size("future") > 0, last["x"]).alias("end_x"), F.when(F.size("future") > 0, last["y"]).alias("end_y"),
        F.size("neighbors").cast("long").alias("n_neighbors"), F.when(F.size("neighbors") > 0, F.col("neighbors")[0]["agent_id"]).alias("nearest"),
        F.when(F.size("neighbors") > 0, F.col("neighbors")[0]["distance"]).alias("nearest_distance"),
        F.when(F.size("neighbors") > 0, F.element_at(F.col("neighbors")[0]["history"], -1)["x"]).alias("nearest_x"),
    )


def padded(array: Column, size: Column, before: bool = False) -> Column:
    """An array brought to a length with nulls after it, or before it."""
    none = F.array_repeat(F.lit(None), F.greatest(size - F.size(array), F.lit(0)))
    return F.concat(none, array) if before else F.concat(array, none)


def collate(elements: DataFrame, ordinal: str, batch_size: int, spec: QuerySpec) -> DataFrame:
    """Elements with batch number, windows padded to the longest of their batch (and the least length asked for)."""
    batch = F.floor(F.col(ordinal) / batch_size)
    w = Window.partitionBy("batch")
    sized = elements.withColumn("batch", batch)
    h = F.greatest(F.max(F.size("history")).over(w), F.lit(spec.least("history") + 1))
    f = F.greatest(F.max(F.size("future")).over(w), F.lit(spec.least("future")))
    sized = sized.withColumns({"history_len": F.size("history"), "future_len": F.size("future"), "_h": h, "_f": f})
    return sized.withColumns({"history": padded(F.col("history"), F.col("_h"), spec.pad == "outside"), "future": padded(F.col("future"), F.col("_f"))}).drop("_h", "_f")


def with_extras(elements: DataFrame, **extras) -> DataFrame:
    """Further columns by functions of the element (DataFrame -> Column), each of which may read those before it."""
    for name, make in extras.items():
        elements = elements.withColumn(name, make(elements))
    return elements


def noisy_histories(elements: DataFrame, deviation: float, seed: int) -> DataFrame:
    """Positions of the history, but for the current one, moved at random; a seed gives the same rows the same noise."""
    def moved(s: Column, i: Column) -> Column:
        def noise(k: int) -> Column:
            u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * k + j), "scene", "agent_id", s["scene_ts"], "scene_ts"), F.lit(1 << 30)) + 1) / float((1 << 30) + 1) for j in (0, 1)]
            return deviation * F.sqrt(-2 * F.log(u[0])) * F.cos(2 * F.pi() * u[1])

        last = i == F.size("history") - 1
        return s.withField("x", F.when(last, s["x"]).otherwise(s["x"] + noise(0))).withField("y", F.when(last, s["y"]).otherwise(s["y"] + noise(1)))

    return elements.withColumn("history", F.transform("history", moved))

"""States asked for by agent and timestep, whole states turned between frames, and columns put into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import rotate, wrap
from ..functions.formats import STORED
from ..schema import AGENT

PAIRS = (("x", "y"), ("vx", "vy"), ("ax", "ay"))


def state_of(states: DataFrame, scene, agent_id, scene_ts: int) -> DataFrame:
    """The row of one agent at one timestep; none if it isn't there. The filter reaches the scan."""
    return states.filter((F.col("scene") == scene) & (F.col("agent_id") == agent_id) & (F.col("scene_ts") == scene_ts))


def states_of(states: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of many (scene, agent_id, scene_ts) at once."""
    return states.join(asked.select(*AGENT, "scene_ts").distinct(), [*AGENT, "scene_ts"], "left_semi")


def value_of(states: DataFrame, asked: DataFrame, column: str, frame: DataFrame | None = None) -> DataFrame:
    """One column of the rows asked for; with a frame (scene, x, y, heading, vx, vy, ax, ay) as it is seen from there."""
    rows = states_of(states, asked)
    if frame is not None:
        rows = observed(rows, frame)
    return rows.select(*AGENT, "scene_ts", F.col(column).alias("value"))


def _framed(states: DataFrame, frames: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    names = ("heading", *(c for pair in PAIRS for c in pair))
    return states.join(frames.select(*keys, *(F.col(c).alias(f"_f_{c}") for c in names)), list(keys))


def observed(states: DataFrame, frames: DataFrame, keys: tuple[str, ...] = ("scene",), moved_after: bool = False) -> DataFrame:
    """Whole states seen from a frame for each ``keys``: places, velocities and accelerations less the frame's, then turned; headings wrapped.

    ``moved_after``: turned first and then moved by the frame's unturned values, as one form of the data model has it.
    """
    rows = _framed(states, frames, keys)
    new = {}
    for a, b in PAIRS:
        p, q = F.col(a), F.col(b)
        fa, fb = F.col(f"_f_{a}"), F.col(f"_f_{b}")
        u, v = rotate(p, q, -F.col("_f_heading")) if moved_after else rotate(p - fa, q - fb, -F.col("_f_heading"))
        new |= {a: u - fa, b: v - fb} if moved_after else {a: u, b: v}
    return rows.withColumns(new | {"heading": wrap(F.col("heading") - F.col("_f_heading"))}).select(*states.columns)


def restored(states: DataFrame, frames: DataFrame, keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """The inverse of ``observed``: turned by the frame's heading, then its values added."""
    rows = _framed(states, frames, keys)
    new = {}
    for a, b in PAIRS:
        u, v = rotate(F.col(a), F.col(b), F.col("_f_heading"))
        new |= {a: u + F.col(f"_f_{a}"), b: v + F.col(f"_f_{b}")}
    return rows.withColumns(new | {"heading": wrap(F.col("heading") + F.col("_f_heading"))}).select(*states.columns)


def with_elements(states: DataFrame, **values: Column) -> DataFrame:
    """States with elements (``x``, ``xd``, ``h`` ...) set anew. Only what the table stores can be set."""
    for element in values:
        if element not in STORED or STORED[element] not in states.columns:
            raise ValueError(f"{element} is not stored in {states.columns}")
    return states.withColumns({STORED[element]: value for element, value in values.items()})


def rotation(angle: Column) -> Column:
    """The 2 x 2 matrix of a turn."""
    return F.array(F.array(F.cos(angle), -F.sin(angle)), F.array(F.sin(angle), F.cos(angle)))


def world_from_frame(x: Column, y: Column, h: Column) -> Column:
    """The pose as rows of a 3 x 3 matrix."""
    c, s = F.cos(h), F.sin(h)
    return F.array(F.array(c, -s, x), F.array(s, c, y), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def transform_points(point: list[Column], matrix: list[list[float]]) -> list[Column]:
    """A point as a row times the upper left of a matrix, plus its last column."""
    n = len(point)
    return [sum((point[i] * float(matrix[i][j]) for i in range(n)), F.lit(float(matrix[j][n]))) for j in range(n)]

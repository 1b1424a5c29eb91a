"""Past and future of each state as arrays, by timestep rather than by row, so missing frames don't shift them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AGENT
from ..spec import QuerySpec


def _range(low: int | None, high: int | None) -> Window:
    w = Window.partitionBy(*AGENT).orderBy("scene_ts")
    return w.rangeBetween(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)


def history(spec: QuerySpec, *columns: str) -> Column:
    """Rows up to and with the current one."""
    most = spec.most("history")
    return F.collect_list(F.struct("scene_ts", *columns)).over(_range(None if most is None else -most, 0))


def future(spec: QuerySpec, *columns: str) -> Column:
    """Rows after the current one; none at an agent's last."""
    return F.collect_list(F.struct("scene_ts", *columns)).over(_range(1, spec.most("future")))


def lengths(states: DataFrame, spec: QuerySpec) -> DataFrame:
    """Rows of each window, without gathering them."""
    h, f = spec.most("history"), spec.most("future")
    return states.select(
        *AGENT, "scene_ts",
        F.count("*").over(_range(None if h is None else -h, 0)).alias("history_len"),
        F.count("*").over(_range(1, f)).alias("future_len"),
    )


def with_windows(states: DataFrame, spec: QuerySpec, *columns: str) -> DataFrame:
    """States with history and future; both windows share one sort."""
    return states.withColumns({"history": history(spec, *columns), "future": future(spec, *columns)})

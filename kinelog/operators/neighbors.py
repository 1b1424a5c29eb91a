"""Neighbours by distance.

A join on (scene, scene_ts) alone compares all agents of a moment. Where a radius bounds the search, places are put in
cells of that size and a place is joined with the nine cells around it, so work follows the neighbours there are. Where only
the nearest few are wanted, a few beside a place on a curve bound how far they can be, and the search goes no farther.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import length
from .nearest import BITS, curve_key

MOMENT = ("scene", "scene_ts")
#: Sizes of cells in ``closest``, each a quarter of the one before, the largest the radius.
SIZES = 5


def _named(states: DataFrame, prefix: str, *more: str) -> DataFrame:
    return states.select(*MOMENT, *(F.col(c).alias(prefix + c) for c in ("agent_id", "x", "y", *more)))


def radius_of(radii: dict[tuple[int, int], float], default: float | None, neighbor: Column, target: Column) -> Column:
    """The radius of a pair of types (neighbour, target); null: no limit."""
    out = F.lit(default).cast("double")
    for (a, b), r in radii.items():
        out = F.when((neighbor == a) & (target == b), F.lit(float(r))).otherwise(out)
    return out


def within(targets: DataFrame, states: DataFrame, radius: float, *more: str) -> DataFrame:
    """Pairs of a target and another agent at most ``radius`` away at the same moment, with their distance.

    Columns of the target have the prefix t_, of the neighbour n_; ``more`` names further columns of both.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    t = _named(targets, "t_", *more).withColumns({"cx": cell("t_x"), "cy": cell("t_y")})
    near = F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1))))
    n = _named(states, "n_", *more).withColumn("_i", near).withColumn("_j", near)
    n = n.withColumns({"cx": cell("n_x") + F.col("_i"), "cy": cell("n_y") + F.col("_j")}).drop("_i", "_j")
    pairs = t.join(n, [*MOMENT, "cx", "cy"]).filter("t_agent_id <> n_agent_id").drop("cx", "cy")
    return pairs.withColumn("distance", length(F.col("n_x") - F.col("t_x"), F.col("n_y") - F.col("t_y"))).filter(F.col("distance") <= radius)


def within_typed(targets: DataFrame, states: DataFrame, radii: dict[tuple[int, int], float], default: float, *more: str) -> DataFrame:
    """As ``within``, each pair by the radius of its types (column agent_type on both sides)."""
    pairs = within(targets, states, max([default, *radii.values()]), "agent_type", *more)
    return pairs.filter(F.col("distance") <= radius_of(radii, default, F.col("n_agent_type"), F.col("t_agent_type")))


def ranked(pairs: DataFrame) -> DataFrame:
    """Pairs with the rank of the neighbour by distance, then by agent_id."""
    w = Window.partitionBy(*MOMENT, "t_agent_id").orderBy("distance", "n_agent_id")
    return pairs.withColumn("rank", F.row_number().over(w))


def closest(targets: DataFrame, states: DataFrame, k: int, radius: float, *more: str, reach: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Of the pairs of ``within`` those that the ``k`` nearest of each target are among (by distance, then agent_id), and few others.

    The k-th distance of some neighbours bounds the search, and those beside a target on a curve through its cell are near. Cells come in SIZES, and a
    target looks into those of about its bound's size that it reaches. Of agents in one place only the first k and one more count, so that crowds make no
    pairs. Work follows the rows, not the pairs within the radius. ``reach``: the radius of a pair of types (neighbour, target; ``more`` has agent_type).
    """
    here = lambda p: F.expr(" AND ".join(f"{p}{c} IS NOT NULL AND NOT isnan({p}{c})" for c in ("x", "y")))
    t, s = _named(targets, "t_", *more).filter(here("t_")), _named(states, "n_", *more).filter(here("n_"))
    within_reach = lambda d, n: F.lit(True) if reach is None else d <= reach(n, F.col("t_agent_type"))

    # The bound of each target.
    cell, part = lambda c: F.floor(F.col(c) / radius), lambda c: F.least(F.floor((F.col(c) / radius - F.floor(F.col(c) / radius)) * 2**BITS), F.lit(2**BITS - 1)).cast("long")
    of = F.struct(*(F.col(c) for c in s.columns if c not in MOMENT))
    rows = t.withColumns({"_x": F.col("t_x"), "_y": F.col("t_y"), "_n": F.lit(None).cast(s.select(of.alias("n")).schema["n"].dataType)})
    rows = rows.unionByName(s.select(*MOMENT, F.col("n_x").alias("_x"), F.col("n_y").alias("_y"), of.alias("_n")), allowMissingColumns=True)
    rows = rows.withColumns({"_cx": cell("_x"), "_cy": cell("_y"), "_key": curve_key(part("_x"), part("_y"))})
    beside = Window.partitionBy(*MOMENT, "_cx", "_cy").orderBy("_key", F.coalesce("t_agent_id", "_n.n_agent_id")).rowsBetween(-2 * k, 2 * k)
    rows = rows.withColumn("_near", F.collect_list("_n").over(beside)).filter("_n IS NULL")
    far = lambda n: length(n["n_x"] - F.col("t_x"), n["n_y"] - F.col("t_y"))
    others = F.filter("_near", lambda n: (n["n_agent_id"] != F.col("t_agent_id")) & within_reach(far(n), n["n_agent_type"] if reach else None))
    bound = F.least(F.coalesce(F.get(F.sort_array(F.transform(others, far)), F.lit(k - 1)), F.lit(float(radius))), F.lit(float(radius)))
    rows = rows.select(*t.columns, bound.alias("_bound"))

    side = F.lit(float(radius)) / F.pow(F.lit(4.0), F.col("_size"))
    size = F.floor(F.log(F.try_divide(F.lit(float(radius)), F.col("_bound"))) / math.log(4))
    rows = rows.withColumn("_size", F.greatest(F.least(F.coalesce(size, F.lit(SIZES - 1)), F.lit(SIZES - 1)), F.lit(0)).cast("int"))
    for c in ("x", "y"):
        slack = F.col("_bound") * (1 + 1e-9) + F.abs(F.col(f"t_{c}")) * 1e-14
        rows = rows.withColumn(f"_c{c}", F.explode(F.sequence(F.floor((F.col(f"t_{c}") - slack) / side), F.floor((F.col(f"t_{c}") + slack) / side))))
    crowd = Window.partitionBy(*MOMENT, "n_x", "n_y", *(["n_agent_type"] if reach else [])).orderBy("n_agent_id")
    found = s.withColumn("_k", F.dense_rank().over(crowd)).filter(F.col("_k") <= k + 1).drop("_k")
    found = found.withColumn("_size", F.explode(F.array(*map(F.lit, range(SIZES))))).withColumns({"_cx": F.floor(F.col("n_x") / side), "_cy": F.floor(F.col("n_y") / side)})
    pairs = rows.join(found, [*MOMENT, "_size", "_cx", "_cy"]).filter("t_agent_id <> n_agent_id").withColumn("distance", length(F.col("n_x") - F.col("t_x"), F.col("n_y") - F.col("t_y")))
    pairs = pairs.filter((F.col("distance") <= F.col("_bound")) & within_reach(F.col("distance"), F.col("n_agent_type") if reach else None))
    return pairs.drop("_size", "_cx", "_cy", "_bound")


def nearest(targets: DataFrame, states: DataFrame, k: int, radius: float | None = None, *more: str, reach: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The k nearest neighbours of each target at its moment. Without a radius every agent of the moment is compared. ``reach`` as in ``closest``."""
    if radius is not None:
        pairs = closest(targets, states, k, radius, *more, reach=reach)
    else:
        pairs = _named(targets, "t_", *more).join(_named(states, "n_", *more), list(MOMENT)).filter("t_agent_id <> n_agent_id")
        pairs = pairs.withColumn("distance", length(F.col("n_x") - F.col("t_x"), F.col("n_y") - F.col("t_y")))
    return ranked(pairs).filter(F.col("rank") <= k)


def around_center(states: DataFrame, centers: DataFrame, radii: dict[tuple[int, int], float], default: float) -> DataFrame:
    """Agents around one centre for each moment, the centre included.

    As many of the nearest as lie within their own radius are taken, in order of distance, whether or not those
    very agents do; this is how the data model counts them.
    """
    c = _named(centers, "t_", "agent_type")
    pairs = c.join(_named(states, "n_", "agent_type"), list(MOMENT))
    pairs = pairs.withColumn("distance", length(F.col("n_x") - F.col("t_x"), F.col("n_y") - F.col("t_y")))
    inside = F.col("distance") <= radius_of(radii, default, F.col("n_agent_type"), F.col("t_agent_type"))
    moment = Window.partitionBy(*MOMENT)
    return (
        pairs.withColumn("_n", F.sum(inside.cast("int")).over(moment))
        .withColumn("rank", F.row_number().over(moment.orderBy("distance", "n_agent_id")))
        .filter(F.col("rank") <= F.col("_n")).drop("_n")
    )

"""The nearest point to each place, by cells whose size follows from the points' density and a descent through coarser ones for places far from all.

First each place meets the points of its own cell and the eight around it, a few points each; what it finds nearer than a cell's side is the
nearest of all. Those without one look once more in wider cells. Other places enter a pyramid of cells (each four of the one below, with the bounds of its points) at the level whose nine cells must hold
their nearest point, and go down it: of the cells that a place holds, those farther than the farthest place of another cell's bounds are dropped
at each level, so that a place carries a few cells whatever the map's size, and meets points only at the bottom.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import discard, written

#: Points in a cell that has any, about; levels above the cells at most; levels up that the second search looks; levels between
#: those at which far places look for any cell.
TARGET, LEVELS, WIDER, STEP = 2, 60, 2, 3
AXES = ("x", "y", "z")
#: Bits of a cell number in a curve's key.
BITS = 24


def curve_key(cx: Column, cy: Column) -> Column:
    """The bits of two cell numbers (from 0, under 2 ** BITS) taken in turn: near cells have near keys."""
    spread = F.lit(0).cast("long")
    for k in range(BITS):
        bit = lambda c: F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long"))  # noqa: B023, E731
        spread = spread.bitwiseOR(F.shiftleft(bit(cx), 2 * k)).bitwiseOR(F.shiftleft(bit(cy), 2 * k + 1))
    return spread


def cell_size(points: DataFrame) -> float:
    """The side of cells of which those with points hold about TARGET."""
    boxes = points.groupBy("map_id").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    n, area, side = boxes.agg(F.sum("n"), F.sum(F.col("w") * F.col("h")), F.sum(F.greatest("w", "h"))).first()
    if not n or not side:
        return 1.0
    first = math.sqrt(TARGET * area / n) if area else TARGET * side / n
    held = points.agg(F.approx_count_distinct(F.struct("map_id", F.floor(F.col("x") / first), F.floor(F.col("y") / first)))).first()[0]
    return first * min(1.0, math.sqrt(TARGET * held / n))


def with_cell(rows: DataFrame, cell: float) -> DataFrame:
    return rows.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})


def around(rows: DataFrame) -> DataFrame:
    """Each row in its cell (cx, cy) and in the eight around it."""
    step = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    return rows.withColumn("_i", step).withColumn("_j", step).withColumns({"cx": F.col("cx") + F.col("_i"), "cy": F.col("cy") + F.col("_j")}).drop("_i", "_j")


def least(pairs: DataFrame, below: float | None = None) -> DataFrame:
    """(place_id, distance, elem_id) of the nearest of the points (px, py, pz) that each place met, the least elem_id on ties; only of those nearer than ``below``."""
    distance = F.sqrt(reduce(Column.__add__, (F.pow(F.col(c) - F.col(f"p{c}"), 2) for c in AXES)))
    pairs = pairs.select("place_id", distance.alias("distance"), "elem_id")
    pairs = pairs.filter(F.col("distance") < below) if below is not None else pairs
    return pairs.groupBy("place_id").agg(F.min(F.struct("distance", "elem_id")).alias("b")).select("place_id", "b.distance", "b.elem_id")


def level_of(cells: DataFrame, level: int) -> DataFrame:
    """The cells ``level`` halvings up, with the bounds of their points."""
    up = cells.withColumns({"cx": F.shiftright("cx", level), "cy": F.shiftright("cy", level)})
    return up.groupBy("map_id", "cx", "cy").agg(*(f(f"{c}{k}").alias(f"{c}{k}") for c in AXES for f, k in ((F.min, 0), (F.max, 1))))


def nearest(places: DataFrame, points: DataFrame, cell: float | None = None, within: float | None = None) -> DataFrame:
    """(place_id, elem_id, distance) of the nearest of ``points`` (map_id, elem_id, x, y, z) to each of ``places`` (place_id, map_id, x, y, z), the least elem_id on ties.

    ``within``: only of those nearer than that. Places without a point that fits have no row; neither have places, nor points, without coordinates.
    """
    here = F.expr(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in AXES) + " AND map_id IS NOT NULL")
    points = points.filter(here).select("map_id", "elem_id", *AXES)
    if cell is None:
        points = written(points)
        cell = cell_size(points)
    index = written(with_cell(points, cell).select("map_id", "elem_id", "cx", "cy", *(F.col(c).alias(f"p{c}") for c in AXES)))
    asked = written(places.filter(here).select("place_id", "map_id", *AXES).join(index.select("map_id").distinct(), "map_id", "left_semi"))
    out, rest, steps = None, asked, [asked]
    for up in (0, WIDER):  # the second time few are left, so cells of more points are cheap
        mine = with_cell(rest, cell * 2**up)
        theirs = index.withColumns({"cx": F.shiftright("cx", up), "cy": F.shiftright("cy", up)})
        if up or asked.count() <= index.count():  # the smaller side is dealt to nine cells
            mine = around(mine)
        else:
            theirs = around(theirs)
        found = written(least(mine.join(theirs, ["map_id", "cx", "cy"]), cell * 2**up * (1 - 1e-9)))
        rest = written(rest.join(found.select("place_id"), "place_id", "left_anti"))
        steps += [found, rest]
        out = found if out is None else out.unionByName(found)
        if rest.isEmpty():
            break
    if not rest.isEmpty():
        out = out.unionByName(far(rest, index, cell, within))
    out = out.filter(F.col("distance") < within) if within is not None else out
    out = written(out.select("place_id", "elem_id", "distance"))
    discard(index, *steps)
    return out


def far(rest: DataFrame, index: DataFrame, cell: float, within: float | None) -> DataFrame:
    """``least`` of places with no point nearer than ``cell``."""
    cells = written(index.groupBy("map_id", "cx", "cy").agg(*(f(f"p{c}").alias(f"{c}{k}") for c in AXES for f, k in ((F.min, 0), (F.max, 1)))))
    # A place enters two levels above the first looked at whose nine cells around it hold any point: nine cells there hold all that is as near as that.
    entries, waiting, k = [], rest, 0
    while k < LEVELS and not waiting.isEmpty():
        k += STEP
        up = level_of(cells, k).select("map_id", "cx", "cy")
        hit = around(with_cell(waiting, cell * 2**k)).join(up, ["map_id", "cx", "cy"], "left_semi").select("place_id").distinct()
        entries.append(written(waiting.join(hit, "place_id", "left_semi").withColumn("level", F.lit(k + 2))))
        waiting = written(waiting.join(entries[-1], "place_id", "left_anti"))
        if within is not None and cell * 2**k > within:
            break
    entered = reduce(DataFrame.unionByName, entries)
    top = entered.agg(F.max("level")).first()[0] or 0
    held = None
    gap = {c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0)) for c in AXES}
    reach = {c: F.greatest(F.abs(F.col(c) - F.col(f"{c}0")), F.abs(F.col(c) - F.col(f"{c}1"))) for c in AXES}
    size = lambda d: F.sqrt(reduce(Column.__add__, (F.pow(v, 2) for v in d.values())))
    for k in range(top, -1, -1):
        up = level_of(cells, k)
        now = around(with_cell(entered.filter(F.col("level") == k).drop("level"), cell * 2**k)).join(up, ["map_id", "cx", "cy"])
        if held is not None:
            kids = up.withColumns({"ux": F.shiftright("cx", 1), "uy": F.shiftright("cy", 1)})
            now = now.unionByName(held.join(kids, ["map_id", "ux", "uy"]).drop("ux", "uy"))
        best = F.min(size(reach)).over(Window.partitionBy("place_id"))
        now = now.withColumn("_best", best).filter(size(gap) <= F.col("_best") * (1 + 1e-9)).select("place_id", "map_id", *AXES, F.col("cx").alias("ux"), F.col("cy").alias("uy"))
        before, held = held, written(now)
        if before is not None:
            discard(before)
    met = held.withColumnsRenamed({"ux": "cx", "uy": "cy"}).join(index, ["map_id", "cx", "cy"])
    return least(met)

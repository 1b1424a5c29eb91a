"""Vector maps as tables: points in cells, lanes as graphs, polygons.

``points`` below: map_id, elem_id, seq, x, y, z, h. Radius searches join cells of the radius's size with the cells
around a place; nothing compares every place with every point. Geometry that Spark lacks runs in numpy on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..functions.angles import in_libm, mean_direction, wrap
from ..schema import MAP_ELEMENTS
from ..scratch import discard, written
from . import meeting, nearest, segments

#: Sine and cosine of two directions add up to less than this where a line turns right back.
BACK = 1e-3


def points_of(elements: DataFrame, line: str = "center") -> DataFrame:
    """The points of a polyline column, one row each."""
    return elements.select("map_id", "elem_id", "elem_type", F.posexplode(line).alias("seq", "p")).select("map_id", "elem_id", "elem_type", "seq", "p.*")


def near_points(places: DataFrame, points: DataFrame, radius: float, flat: bool = False) -> DataFrame:
    """Pairs of a place (place_id, map_id, x, y, z) and a point at most ``radius`` away."""
    cell = lambda c: F.floor(F.col(c) / radius)
    step = F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1))))
    p = places.withColumn("_i", step).withColumn("_j", step).withColumns({"cx": cell("x") + F.col("_i"), "cy": cell("y") + F.col("_j")}).drop("_i", "_j")
    q = points.withColumns({"cx": cell("x"), "cy": cell("y")}).select("map_id", "elem_id", "seq", "cx", "cy", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("h").alias("ph"))
    square = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)
    if not flat:
        square = square + F.pow(F.col("z") - F.col("pz"), 2)
    return p.join(q, ["map_id", "cx", "cy"]).drop("cx", "cy").withColumn("distance", F.sqrt(square)).filter(F.col("distance") <= radius)


def by_place(places: DataFrame, points: DataFrame, radius: float, fold, slow, **more: str) -> DataFrame:
    """``meeting.met`` of the places whose place_id is in one row, and ``slow`` of the others."""
    columns = places.select("place_id", "map_id", "x", "y", "z", "h" if "h" in places.columns else F.lit(None).cast("double").alias("h"))
    kind = StructType([StructField("place_id", places.schema["place_id"].dataType), StructField("elem_id", points.schema["elem_id"].dataType), *(StructField(c, DataType.fromDDL(k)) for c, k in more.items())])
    again = columns.groupBy("place_id").count().filter("count > 1").select(F.col("place_id").alias("_again"))
    if again.isEmpty():
        return meeting.met(columns, points, radius, fold, kind)
    same = F.col("place_id").eqNullSafe(F.col("_again"))
    return meeting.met(columns.join(again, same, "left_anti"), points, radius, fold, kind).unionByName(slow(columns.join(again, same, "left_semi")).select(*(F.col(f.name).cast(f.dataType) for f in kind)))


def lanes_within(places: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """The different elements with a point within a radius of each place."""
    return by_place(places, points, radius, meeting.there, lambda some: near_points(some, points, radius).select("place_id", "elem_id").distinct())


def lanes_counted(places: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(place_id, elem_id, n, distance): the elements with points within a radius of each place, how many and the least distance."""
    slow = lambda some: near_points(some, points, radius).groupBy("place_id", "elem_id").agg(F.count("*").alias("n"), F.min("distance").alias("distance"))
    return by_place(places, points, radius, meeting.counted, slow, n="bigint", distance="double")


def found_place(*columns: str) -> Column:
    """Whether none of the coordinates is null or NaN."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return ok


def nearest_lane(places: DataFrame, points: DataFrame, cell: float | None = None, within: float | None = None) -> DataFrame:
    """(place_id, elem_id, distance) of the nearest point's element, the least elem_id on ties; ``within``: only if it is nearer than that.

    Places without coordinates, or of a map without points, stay out. See ``nearest`` for the search; ``cell`` is the size of its cells, by default from the points' density.
    """
    return nearest.nearest(places, points, cell, within)


def by_doubling(rest: DataFrame, search, first_radius: float, rounds: int) -> DataFrame:
    """The nearest hit of each place (``rest``, written); what has none is written down and searched again with twice the radius. Tables of open places are deleted on the way."""
    found, radius = None, first_radius
    for _ in range(rounds):
        best = search(rest, radius).groupBy("place_id").agg(F.min(F.struct("distance", "elem_id")).alias("b"))
        best = written(best.select("place_id", "b.elem_id", "b.distance"))
        found = best if found is None else found.unionByName(best)
        before, rest = rest, written(rest.join(best, "place_id", "left_anti"))
        discard(before)
        if rest.isEmpty():
            discard(rest)
            return found
        radius *= 2
    raise ValueError(f"places farther than {radius} from everything")


def current_lane(places: DataFrame, points: DataFrame, max_distance: float = 2.0, max_turn: float = np.pi / 8) -> DataFrame:
    """Lanes a pose (with h) may be on, by cost: near enough, heading alike, cost = distance + 0.1 * turn, the least for each lane."""
    def slow(some: DataFrame) -> DataFrame:
        pairs = near_points(some, points, max_distance).withColumn("turn", F.abs(wrap(F.col("h") - F.col("ph"))))
        costs = pairs.filter(F.col("turn") < max_turn).groupBy("place_id", "elem_id").agg(F.min(F.col("distance") + 0.1 * F.col("turn")).alias("cost"))
        return costs.withColumn("rank", F.row_number().over(Window.partitionBy("place_id").orderBy("cost", "elem_id")))

    return by_place(places, points, max_distance, meeting.costs(max_turn), slow, cost="double", rank="int")


def reachable(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, hop): nodes of a directed graph (src, dst) within some hops of each start, with the fewest hops. Each hop is written down."""
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        nxt = front.select("start", "node").join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = written(nxt.join(seen, ["start", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def adjacent_by_border(borders: DataFrame) -> DataFrame:
    """(elem_id, other): elements (elem_id, border_id) that share a border."""
    a, b = borders.alias("a"), borders.alias("b")
    return a.join(b, (F.col("a.border_id") == F.col("b.border_id")) & (F.col("a.elem_id") != F.col("b.elem_id"))).select(F.col("a.elem_id"), F.col("b.elem_id").alias("other")).distinct()


def light_status(asked: DataFrame, lights: DataFrame) -> DataFrame:
    """The status of a lane at a timestep, -1 where there is none."""
    return asked.join(lights.select("scene", "lane_id", "scene_ts", "status"), ["scene", "lane_id", "scene_ts"], "left").withColumn("status", F.coalesce("status", F.lit(-1)))


# Polylines.


def encode(points: DataFrame) -> DataFrame:
    """Millimetre differences along each element, cut to whole numbers."""
    w = Window.partitionBy("map_id", "elem_id").orderBy("seq")
    return points.select("map_id", "elem_id", "seq", *(((F.col(c) - F.lag(c, 1, 0.0).over(w)) * 1000).cast("int").alias(f"d{c}_mm") for c in ("x", "y", "z")), "h")


def decode(deltas: DataFrame) -> DataFrame:
    w = Window.partitionBy("map_id", "elem_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("map_id", "elem_id", "seq", *((F.sum(f"d{c}_mm").over(w) / 1000).alias(c) for c in ("x", "y", "z")), "h")


def with_headings(points: DataFrame) -> DataFrame:
    """Headings along each element: the first point has that of the segment after it, the last that of the one before, all others the
    circular mean of both. A single point has 0."""
    w = Window.partitionBy("map_id", "elem_id").orderBy("seq")
    rows = points.withColumns({f"_a{c}": F.lead(c).over(w) - F.col(c) for c in ("x", "y")}).withColumn("_after", F.atan2("_ay", "_ax"))
    rows = rows.withColumns({f"_b{c}": F.lag(f"_a{c}").over(w) for c in ("x", "y")}).withColumn("_before", F.lag("_after").over(w))
    sine, cosine = F.sin("_before") + F.sin("_after"), F.cos("_before") + F.cos("_after")
    # Where a line turns right back, last bits decide the mean.
    back = (F.abs(sine) < BACK) & (F.abs(cosine) < BACK)
    rows = rows.withColumns({"_mean": F.atan2(sine, cosine)} | {f"_{k}": F.when(back, F.col(f"_{k}")) for k in ("bx", "by", "ax", "ay")})
    mean = F.coalesce(in_libm(mean_direction, *(F.col(f"_{k}") for k in ("bx", "by", "ax", "ay"))), F.col("_mean"))
    return rows.withColumn("h", F.coalesce(mean, F.col("_after"), F.col("_before"), F.lit(0.0))).select(*points.columns, *(["h"] if "h" not in points.columns else []))


def ends_of(points: DataFrame) -> DataFrame:
    """(map_id, elem_id, first, last): the places where each line begins and ends."""
    place = F.struct("x", "y")
    return points.groupBy("map_id", "elem_id").agg(F.min_by(place, "seq").alias("first"), F.max_by(place, "seq").alias("last"))


def runs_along(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """(map_id, elem_id, same_way): whether each line begins nearer to where its reference line begins than it ends."""
    pairs = ends_of(lines).join(ends_of(refs).select("map_id", "elem_id", F.col("first").alias("r")), ["map_id", "elem_id"])
    far = lambda p: F.hypot(F.col(p)["x"] - F.col("r.x"), F.col(p)["y"] - F.col("r.y"))
    return pairs.select("map_id", "elem_id", (far("first") <= far("last")).alias("same_way"))


def ends_cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """(map_id, elem_id, cross): whether the segment that joins the last points of two edges meets the one that joins their first points, by ``segments.meet``."""
    ends = ends_of(left).select("map_id", "elem_id", F.col("first").alias("l0"), F.col("last").alias("l1"))
    ends = ends.join(ends_of(right).select("map_id", "elem_id", F.col("first").alias("r0"), F.col("last").alias("r1")), ["map_id", "elem_id"])
    between = lambda p, q: tuple(F.col(f"{n}.{c}") for n in (p, q) for c in ("x", "y"))
    return ends.select("map_id", "elem_id", segments.meet(between("l0", "r0"), between("l1", "r1")).alias("cross"))


def densify(points: DataFrame, max_distance: float) -> DataFrame:
    """Even further points in each segment, so that no two are farther apart than ``max_distance`` or so."""
    w = Window.partitionBy("map_id", "elem_id").orderBy("seq")
    rows = points.withColumns({f"_{c}": F.lead(c).over(w) for c in ("x", "y", "z")})
    gap = F.sqrt(F.pow(F.col("_x") - F.col("x"), 2) + F.pow(F.col("_y") - F.col("y"), 2) + F.pow(F.col("_z") - F.col("z"), 2))
    rows = rows.withColumn("_n", F.coalesce(F.floor(gap / max_distance), F.lit(0))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    share = F.col("part") / (F.col("_n") + 1)
    return rows.select("map_id", "elem_id", "seq", "part", *(F.when(F.col("part") == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}") - F.col(c)) * share).alias(c) for c in ("x", "y", "z")), "h")


def interpolate(elements: DataFrame, n: int, line: str = "center") -> DataFrame:
    """Polylines brought to n points at even arc lengths; headings are unwrapped on the way and wrapped after."""
    kind = elements.schema[line].dataType

    @F.pandas_udf(kind)
    def even(lines: pd.Series) -> pd.Series:
        def one(points) -> list[dict] | None:
            if points is None or not len(points):
                return None
            p = np.array([[q["x"], q["y"], q["z"], q["h"]] for q in points], float)
            if len(p) == n:
                return list(points)
            at = np.append(0, np.cumsum(np.linalg.norm(np.diff(p[:, :3], axis=0), axis=1)))
            to = np.linspace(0, at[-1], n)
            p[:, 3] = np.unwrap(p[:, 3])
            out = np.stack([np.interp(to, at, p[:, k]) for k in range(4)], 1)
            out[:, 3] = (out[:, 3] + np.pi) % (2 * np.pi) - np.pi
            return [dict(zip("xyzh", row)) for row in out.tolist()]

        return lines.map(one)

    return elements.withColumn(line, even(line))


def even_points(points: DataFrame, counts: DataFrame, *keys: str) -> DataFrame:
    """Lines (``keys``, seq, x, y, z) brought to as many points at even arc lengths as ``counts`` (``keys``, n) asks for."""
    w = Window.partitionBy(*keys).orderBy("seq")
    whole = Window.partitionBy(*keys)
    step = F.sqrt(sum(F.pow(F.col(c) - F.lag(c).over(w), 2) for c in ("x", "y", "z")))
    rows = points.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("_s", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # A line without a length is dealt with by the number of its points.
    rows = rows.withColumns({"_row": F.row_number().over(w) - 1, "_rows": F.count("*").over(whole), "_l": F.sum("_d").over(whole)})
    share = F.when(F.col("_l") > 0, F.col("_s") / F.col("_l")).otherwise(F.col("_row") / F.greatest(F.col("_rows") - 1, F.lit(1)))
    rows = rows.withColumn("_share", share).withColumns({f"_{c}": F.lead(c).over(w) for c in ("x", "y", "z")}).withColumn("_next", F.lead("_share").over(w))
    rows = rows.join(counts.select(*keys, "n"), list(keys))
    first = lambda c: F.ceil(F.col(c) * (F.col("n") - 1) - 1e-9).cast("int")
    last = F.when(F.col("_row") >= F.col("_rows") - 2, F.col("n") - 1).otherwise(first("_next") - 1)
    rows = rows.filter((F.col("_row") < F.col("_rows") - 1) | (F.col("_rows") == 1)).withColumns({"_a": F.when(F.col("_rows") == 1, 0).otherwise(first("_share")), "_b": last})
    rows = rows.filter("_a <= _b").withColumn("k", F.explode(F.sequence("_a", "_b")))
    at = F.when(F.col("n") > 1, F.col("k") / (F.col("n") - 1)).otherwise(0.0)
    gap = F.col("_next") - F.col("_share")
    t = F.when(gap > 0, F.least(F.greatest((at - F.col("_share")) / gap, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return rows.select(*keys, F.col("k").alias("seq"), *(F.coalesce(F.col(c) + (F.col(f"_{c}") - F.col(c)) * t, F.col(c)).alias(c) for c in ("x", "y", "z")))


def relative_to_line(places: DataFrame, points: DataFrame) -> DataFrame:
    """(place_id, seq, along, across, turn) for each point of the line of each place (place_id, map_id, elem_id, x, y, h): the place seen from
    the point in the direction of the line at its nearest point, and the wrapped turn against that direction. The first of equally near points counts."""
    line = points.select("map_id", "elem_id", "seq", F.col("x").alias("px"), F.col("y").alias("py"), F.col("h").alias("ph"))
    pairs = places.select("place_id", "map_id", "elem_id", "x", "y", "h").join(line, ["map_id", "elem_id"])
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    w = Window.partitionBy("place_id")
    pairs = pairs.withColumn("_h", F.min(F.struct(F.hypot(dx, dy).alias("d"), "seq", "ph")).over(w)["ph"])
    c, s = F.cos("_h"), F.sin("_h")
    return pairs.select("place_id", "seq", (dx * c + dy * s).alias("along"), (dy * c - dx * s).alias("across"), wrap(F.col("h") - F.col("_h")).alias("turn"))


def midpoints(points: DataFrame) -> DataFrame:
    """The point in the middle of each line: of n points the one at n // 2."""
    n = points.groupBy("map_id", "elem_id").agg(F.count("*").alias("_n"))
    row = F.row_number().over(Window.partitionBy("map_id", "elem_id").orderBy("seq")) - 1
    return points.withColumn("_row", row).join(n, ["map_id", "elem_id"]).filter(F.col("_row") == F.floor(F.col("_n") / 2)).drop("_row", "_n")


# Maps as sets of elements.


def layers_of(elements: DataFrame, layers: tuple[str, ...] | None = None) -> DataFrame:
    """The elements of some layers (names of ``schema.MAP_ELEMENTS``); all of them by default."""
    return elements if layers is None else elements.filter(F.col("elem_type").isin(*(MAP_ELEMENTS[x] for x in layers)))


def differing_elements(a: DataFrame, b: DataFrame) -> DataFrame:
    """(map_id, elem_id, only_in) of elements that one of two maps has and the other lacks; none: they are equal."""
    left, right = (m.select("map_id", "elem_id").distinct() for m in (a, b))
    return left.subtract(right).withColumn("only_in", F.lit("first")).unionByName(right.subtract(left).withColumn("only_in", F.lit("second")))


def remapped_lanes(links: DataFrame, pieces: DataFrame) -> DataFrame:
    """Links (elem_id, kind, other) between lanes that were cut into ``pieces`` (elem_id, chunk, piece_id), as links between pieces.

    An adjacent lane stands for all its pieces, next to every piece; the lane before for its last piece, before the
    first one; the lane after for its first piece, after the last one. Pieces of a lane follow each other.
    """
    ends = pieces.groupBy("elem_id").agg(F.min_by("piece_id", "chunk").alias("first"), F.max_by("piece_id", "chunk").alias("last"))
    mine, theirs = ends.select("elem_id", F.col("first").alias("m_first"), F.col("last").alias("m_last")), ends.select(F.col("elem_id").alias("other"), F.col("first").alias("o_first"), F.col("last").alias("o_last"))
    both = links.join(mine, "elem_id").join(theirs, "other")
    before = both.filter("kind = 'previous'").select(F.col("m_first").alias("piece_id"), "kind", F.col("o_last").alias("other_id"))
    after = both.filter("kind = 'next'").select(F.col("m_last").alias("piece_id"), "kind", F.col("o_first").alias("other_id"))
    beside = links.filter("kind NOT IN ('previous', 'next')").join(pieces.select("elem_id", "piece_id"), "elem_id").join(pieces.select(F.col("elem_id").alias("other"), F.col("piece_id").alias("other_id")), "other").select("piece_id", "kind", "other_id")
    follow = F.lead("piece_id").over(Window.partitionBy("elem_id").orderBy("chunk"))
    inner = pieces.withColumn("_next", follow).filter("_next IS NOT NULL")
    inside = inner.select("piece_id", F.lit("next").alias("kind"), F.col("_next").alias("other_id")).unionByName(inner.select(F.col("_next").alias("piece_id"), F.lit("previous").alias("kind"), F.col("piece_id").alias("other_id")))
    return before.unionByName(after).unionByName(beside).unionByName(inside).distinct()


def project(places: DataFrame, points: DataFrame) -> DataFrame:
    """The nearest place on a given element's line (places: place_id, map_id, elem_id, x, y): px, py, heading of the segment, distance."""
    w = Window.partitionBy("map_id", "elem_id").orderBy("seq")
    segments = points.select("map_id", "elem_id", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), "h", F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).filter("bx IS NOT NULL")
    pairs = places.join(segments, ["map_id", "elem_id"])
    ux, uy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    square = ux * ux + uy * uy
    t = F.when(square > 0, ((F.col("x") - F.col("ax")) * ux + (F.col("y") - F.col("ay")) * uy) / square).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    pairs = pairs.withColumns({"px": F.col("ax") + t * ux, "py": F.col("ay") + t * uy})
    pairs = pairs.withColumn("distance", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")))
    best = pairs.groupBy("place_id").agg(F.min(F.struct("distance", "seq", "px", "py", "h")).alias("b"))
    return best.select("place_id", "b.px", "b.py", "b.h", "b.distance")


# Polygons.


def edges_of(areas: DataFrame) -> DataFrame:
    """(map_id, elem_id, edges, ax, ay, bx, by): the edges of the outlines and holes of areas, each ring closed, and how many the area has."""
    every = areas.withColumn("_rings", F.concat(F.array("polygon"), F.coalesce("holes", F.array().cast(areas.schema["holes"].dataType))))
    rings = every.select("map_id", "elem_id", F.size(F.flatten("_rings")).alias("edges"), F.explode("_rings").alias("ring"))
    after = lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.get("ring", (i + 1) % F.size("ring"))["x"].alias("bx"), F.get("ring", (i + 1) % F.size("ring"))["y"].alias("by"))
    return rings.select("map_id", "elem_id", "edges", F.inline(F.transform("ring", after)))


def with_bounds(areas: DataFrame) -> DataFrame:
    """Areas (map_id, elem_id, polygon, holes) with their bounding box."""
    x, y = F.transform("polygon", lambda p: p["x"]), F.transform("polygon", lambda p: p["y"])
    return areas.select("map_id", "elem_id", "polygon", "holes", F.array_min(x).alias("x0"), F.array_max(x).alias("x1"), F.array_min(y).alias("y0"), F.array_max(y).alias("y1"))


def areas_within(places: DataFrame, areas: DataFrame, radius: float, cell: float) -> DataFrame:
    """(place_id, elem_id, distance) of the areas at most ``radius`` from each place, 0 inside one. Boxes are put into cells, then the edges of those that come near are measured.

    Places and areas repeated count once; places without coordinates and areas without an outline stay out.
    """
    boxes = with_bounds(areas)
    span = lambda a, b: F.sequence(F.floor((F.col(a) - radius) / cell), F.floor((F.col(b) + radius) / cell))
    keys = boxes.select("map_id", "elem_id", "x0", "x1", "y0", "y1", F.explode(span("x0", "x1")).alias("cx")).withColumn("cy", F.explode(span("y0", "y1")))
    spots = places.filter(found_place("x", "y")).select("place_id", "map_id", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    close = spots.join(keys, ["map_id", "cx", "cy"]).filter(F.col("x").between(F.col("x0") - radius, F.col("x1") + radius) & F.col("y").between(F.col("y0") - radius, F.col("y1") + radius))
    # A place is inside if a ray to the right crosses an odd number of edges. Rows that are there several times count each edge as often, so crossings are divided by that.
    far_x, far_y, ux, uy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    square = ux * ux + uy * uy
    along = F.when(square > 0, F.least(F.greatest((far_x * ux + far_y * uy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    crosses = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") < F.col("ax") + F.try_divide(far_y, uy) * ux)
    measured = close.select("place_id", "map_id", "elem_id", "x", "y").join(edges_of(areas), ["map_id", "elem_id"]).select("place_id", "map_id", "elem_id", "x", "y", "edges", F.hypot(far_x - along * ux, far_y - along * uy).alias("d"), crosses.alias("over"))
    found = measured.groupBy("place_id", "map_id", "elem_id", "x", "y").agg(F.min("d").alias("d"), (F.count_if("over") * F.max("edges") / F.count("*") % 2 == 1).alias("inside"))
    return found.select("place_id", "elem_id", F.when(F.col("inside"), 0.0).otherwise(F.col("d")).alias("distance")).filter(F.col("distance") <= radius)


def nearest_area(places: DataFrame, areas: DataFrame, first_radius: float, rounds: int = 30) -> DataFrame:
    """(place_id, elem_id, distance) of the nearest area, by doubled radii."""
    rest = written(places.filter(found_place("x", "y")).join(areas.filter(F.size("polygon") > 0).select("map_id").distinct(), "map_id", "left_semi"))
    return by_doubling(rest, lambda some, radius: areas_within(some, areas, radius, radius), first_radius, rounds)


def extent(points: DataFrame) -> DataFrame:
    """Least and greatest coordinates of each map; NaN counts as missing."""
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y", "z")}
    return points.groupBy("map_id").agg(*(f(v).alias(f"{name}_{c}") for c, v in clean.items() for name, f in (("min", F.min), ("max", F.max))))


def circular_mean(angle: Column) -> Column:
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))

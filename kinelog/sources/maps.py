"""Sources of maps: Lanelet2 files and JSON outlines, as points and borders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.angles import enu
from ..operators.maps import even_points, with_headings
from ..operators.segments import hulls


def lanelet_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes (id, lat, lon), way_nodes (way, seq, node), lanelets (id, left_way, right_way, subtype, name) of OSM files."""
    def rows(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    tags = "tag array<struct<_k: string, _v: string>>"
    nodes = rows("node", "_id long, _lat double, _lon double").select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    ways = rows("way", f"_id long, nd array<struct<_ref: long>>, {tags}")
    relations = rows("relation", f"_id long, member array<struct<_ref: long, _role: string, _type: string>>, {tags}")
    value = lambda k: F.element_at(F.map_from_entries(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"]))), k)
    way_of = lambda role: F.get(F.filter("member", lambda m: m["_role"] == role), F.lit(0))["_ref"]
    return {
        "nodes": nodes,
        "way_nodes": ways.select(F.col("_id").alias("way"), F.posexplode("nd").alias("seq", "n")).select("way", "seq", F.col("n._ref").alias("node")),
        "lanelets": relations.filter(value("type") == "lanelet").select(F.col("_id").alias("id"), way_of("left").alias("left_way"), way_of("right").alias("right_way"), F.coalesce(value("subtype"), F.lit("road")).alias("subtype"), value("name").alias("name")),
    }


def lanelet_points(tables: dict[str, DataFrame], map_id: str, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Border points of each lanelet in metres east and north of an origin: map_id, elem_id, side, seq, x, y, z."""
    east, north, _ = enu(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(origin[0]), F.lit(origin[1]), F.lit(0.0))
    places = tables["way_nodes"].join(tables["nodes"], F.col("node") == F.col("id")).select("way", "seq", east.alias("x"), north.alias("y"), F.lit(0.0).alias("z"))
    sides = tables["lanelets"].select(F.col("id").alias("elem_id"), "subtype", F.explode(F.create_map(F.lit("left"), F.col("left_way"), F.lit("right"), F.col("right_way"))).alias("side", "way")).filter("way IS NOT NULL")
    return sides.join(places, "way").select(F.lit(map_id).alias("map_id"), "elem_id", "subtype", "side", "seq", "x", "y", "z")


def lanelet_centers(points: DataFrame) -> DataFrame:
    """Center lines: both borders brought to as many points as the longer one has, then their means, with headings. A lanelet with one border has none."""
    sizes = points.groupBy("map_id", "elem_id", "side").agg(F.count("*").alias("n"))
    n = sizes.groupBy("map_id", "elem_id").agg(F.max("n").alias("n"), F.count("*").alias("sides")).filter("sides = 2")
    even = even_points(points, sizes.drop("n").join(n.drop("sides"), ["map_id", "elem_id"]), "map_id", "elem_id", "side")
    return with_headings(even.groupBy("map_id", "elem_id", "seq").agg(*(F.avg(c).alias(c) for c in ("x", "y", "z"))))


def lanelet_crosswalks(tables: dict[str, DataFrame], map_id: str, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Crosswalks as closed areas, the hull of both borders: map_id, elem_id (the name, or the number without one), elem_type, seq, x, y, z, h, for ``rings``.

    Borders may run either way. One with a border missing, or without breadth, has no area; of several of one name the greatest number counts.
    """
    points = lanelet_points(tables, map_id, origin).filter("subtype = 'crosswalk'")
    both = points.groupBy("elem_id").agg(F.count_distinct("side").alias("sides")).filter("sides = 2")
    areas = hulls(points.join(both, "elem_id", "left_semi"), ("map_id", "elem_id")).filter(F.size("ring") > 2)
    named = areas.join(tables["lanelets"].select(F.col("id").alias("elem_id"), "name"), "elem_id").groupBy("map_id", F.coalesce("name", F.col("elem_id").cast("string")).alias("_name")).agg(F.max_by("ring", "elem_id").alias("ring"))
    corners = named.select("map_id", F.col("_name").alias("elem_id"), F.lit(3).alias("elem_type"), F.posexplode(F.concat("ring", F.slice("ring", 1, 1))).alias("seq", "p"))
    return with_headings(corners.select("map_id", "elem_id", "elem_type", "seq", "p.x", "p.y", F.lit(0.0).alias("z")))


def lanelet_borders(tables: dict[str, DataFrame]) -> DataFrame:
    """(elem_id, border_id), for adjacency by a shared border."""
    return tables["lanelets"].filter("subtype <> 'crosswalk'").select(F.col("id").alias("elem_id"), F.explode(F.array_compact(F.array("left_way", "right_way"))).alias("border_id"))


def outlines(spark: SparkSession, path: str, map_id: str) -> DataFrame:
    """JSON with drivable_area, pedestrian_area (rings, closed here) and road_divider, lane_divider (lines): points with headings."""
    kinds = {"drivable_area": 2, "pedestrian_area": 4, "road_divider": 1, "lane_divider": 1}
    schema = ", ".join(f"{k} array<array<array<double>>>" for k in kinds)
    raw = spark.read.schema(schema).json(path, multiLine=True)
    found = None
    for kind, code in kinds.items():
        line = raw.select(F.posexplode(kind).alias("n", "line"))
        if code in (2, 4):
            closed = F.when(F.element_at("line", 1) != F.element_at("line", -1), F.concat("line", F.slice("line", 1, 1))).otherwise(F.col("line"))
            line = line.withColumn("line", closed)
        points = line.select(F.lit(map_id).alias("map_id"), F.concat(F.lit(f"{kind}_"), "n").alias("elem_id"), F.lit(code).alias("elem_type"), F.posexplode("line").alias("seq", "p"))
        points = points.select("map_id", "elem_id", "elem_type", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.coalesce(F.get("p", F.lit(2)), F.lit(0.0)).alias("z"))
        found = points if found is None else found.unionByName(points)
    return with_headings(found)


def rings(points: DataFrame) -> DataFrame:
    """Areas (map_id, elem_id, polygon, holes) from points of rings."""
    p = F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z", "h")))
    made = points.filter("elem_type IN (2, 3, 4)").groupBy("map_id", "elem_id").agg(p.alias("p"))
    point = "struct<x:double,y:double,z:double,h:double>"
    return made.select("map_id", "elem_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z"), q["h"].alias("h"))).alias("polygon"), F.array().cast(f"array<array<{point}>>").alias("holes"))


def edges_from_polygons(outlines: DataFrame, centers: DataFrame) -> DataFrame:
    """Left and right edges of lanes out of their outlines: outlines and centers (map_id, elem_id, seq, x, y, z) -> the same with side.

    A vertex lies on the side that the direction of the center line at its nearest point says; along the center line
    gives the order, so both edges run as the lane does. Repeated points of the center line count once, and both
    edges get as many points as the longer one.
    """
    keys = ["map_id", "elem_id"]
    w = Window.partitionBy(*keys).orderBy("seq")
    lines = centers.withColumns({"_dx": F.col("x") - F.lag("x").over(w), "_dy": F.col("y") - F.lag("y").over(w)})
    lines = lines.filter("_dx IS NULL OR abs(_dx) + abs(_dy) >= 1e-10")
    ahead = {c: F.coalesce(F.lead(v).over(w) - F.col(v), F.col(v) - F.lag(v).over(w)) for c, v in (("dx", "x"), ("dy", "y"))}
    lines = lines.withColumns(ahead).select(*keys, F.col("seq").alias("at"), F.col("x").alias("cx"), F.col("y").alias("cy"), "dx", "dy")
    u, v = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    pairs = outlines.join(lines, keys).withColumn("near", F.struct((u * u + v * v).alias("d"), "at", (F.col("dx") * v - F.col("dy") * u).alias("cross"), ((F.col("dx") * u + F.col("dy") * v) / F.hypot("dx", "dy")).alias("along")))
    best = pairs.groupBy(*keys, "seq").agg(F.min("near").alias("n"), *(F.first(c).alias(c) for c in ("x", "y", "z")))
    side = F.when(F.col("n.cross") < 0, "right").otherwise("left")
    order = Window.partitionBy(*keys, "side").orderBy("n.at", "n.along", "seq")
    sided = best.withColumn("side", side).withColumn("k", F.row_number().over(order) - 1).select(*keys, "side", F.col("k").alias("seq"), "x", "y", "z")
    counts = sided.groupBy(*keys, "side").agg(F.count("*").alias("n"))
    most = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    return even_points(sided, counts.drop("n").join(most, keys), *keys, "side")


def assembled(points: DataFrame) -> DataFrame:
    """Map elements in the canonical form out of a converted map's points (map_id, elem_id, elem_type, line, ring, seq, x, y, z), line one of
    center, left_edge, right_edge, polygon (ring 0 its outline, further rings its holes). Headings follow from the points."""
    lines = Window.partitionBy("map_id", "elem_id", "line", "ring").orderBy("seq")
    after = F.atan2(F.lead("y").over(lines) - F.col("y"), F.lead("x").over(lines) - F.col("x"))
    rows = points.withColumn("_after", after).withColumn("_before", F.lag("_after").over(lines))
    mean = F.atan2(F.sin("_before") + F.sin("_after"), F.cos("_before") + F.cos("_after"))
    rows = rows.withColumn("h", F.coalesce(mean, F.col("_after"), F.col("_before"), F.lit(0.0)))
    one = rows.groupBy("map_id", "elem_id", "elem_type", "line", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z", "h"))).alias("p"))
    one = one.withColumn("p", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z"), q["h"].alias("h"))))
    first = lambda name: F.max_by("p", F.when((F.col("line") == name) & (F.col("ring") == 0), 1)).alias(name)
    holes = F.array_sort(F.collect_list(F.when((F.col("line") == "polygon") & (F.col("ring") > 0), F.struct("ring", "p"))))
    return one.groupBy("map_id", "elem_id", "elem_type").agg(*map(first, ("center", "left_edge", "right_edge", "polygon")), holes.alias("_h")).withColumn("holes", F.col("_h.p")).drop("_h")

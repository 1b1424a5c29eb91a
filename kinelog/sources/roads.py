"""Road networks given as reference lines with lanes beside them (an XML file with a ``road`` element for each road), as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CUBIC = "_a double, _b double, _c double, _d double"
_BESIDE = "struct<_id: int, _direction: string>"
_LINK = f"struct<successor: struct<_id: int>, predecessor: struct<_id: int>, left: {_BESIDE}, right: {_BESIDE}>"
_SIDE = f"struct<lane: array<struct<_id: int, _type: string, _direction: string, link: {_LINK}, width: array<struct<_sOffset: double, {_CUBIC.replace(' double', ': double')}>>>>>"
_ROAD = "struct<_elementType: string, _elementId: string>"
SCHEMA = (
    f"_id string, _junction string, link struct<successor: {_ROAD}, predecessor: {_ROAD}>, "
    "planView struct<geometry: array<struct<_x: double, _y: double, _hdg: double, _length: double, arc: struct<_curvature: double>, spiral: struct<_curvStart: double>, poly3: struct<_a: double>, paramPoly3: struct<_aU: double>>>>, "
    f"elevationProfile struct<elevation: array<struct<_s: double, {_CUBIC.replace(' double', ': double')}>>>, "
    f"lanes struct<laneOffset: array<struct<_s: double, {_CUBIC.replace(' double', ': double')}>>, laneSection: array<struct<_s: double, left: {_SIDE}, right: {_SIDE}>>>, "
    "signals struct<signal: array<struct<_id: string, _s: double, _t: double, _type: string, _subtype: string, _name: string>>>"
)
JUNCTIONS = "_id string, connection array<struct<_incomingRoad: string, _connectingRoad: string, _contactPoint: string, laneLink: array<struct<_from: int, _to: int>>>>"


def road_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of road files:

    roads (road, junction: whether it belongs to one), geometry (road, seq, x, y, heading, length, curvature: 0 for a line; spirals and polynomials are left out),
    elevation and offsets (road, s, a, b, c, d), lanes (road, lane, section, lane_type, direction: of the first section that has it),
    widths (road, lane, s, a, b, c, d; s from the road's beginning), signals (road, signal, s, t, kind),
    road_links (road, end: successor or predecessor, to_road; links to junctions are left out), lane_links (road, lane, end, to_lane),
    neighbours (road, lane, side: left or right, to_lane, way: forward or backward) and connections of junctions (road, lane, to_road, to_lane, contact).
    """
    rows = spark.read.format("xml").option("rowTag", "road").schema(SCHEMA).load(path).withColumnRenamed("_id", "road")
    cubic = lambda p: [F.col(f"{p}._{c}").alias(c) for c in "abcd"]
    g = rows.select("road", F.posexplode("planView.geometry").alias("seq", "g")).filter("g.spiral IS NULL AND g.poly3 IS NULL AND g.paramPoly3 IS NULL")
    section = rows.select("road", F.posexplode("lanes.laneSection").alias("section", "e"))
    both = F.concat(F.coalesce("e.left.lane", F.array()), F.coalesce("e.right.lane", F.array()))
    lane = section.select("road", "section", F.coalesce("e._s", F.lit(0.0)).alias("s0"), F.explode(both).alias("l")).filter("l._id IS NOT NULL")
    pairs = lambda name, *fields: F.explode(F.array(*(F.struct(F.lit(f).alias(name), F.col(f"link.{f}").alias("to")) for f in fields)))
    linked = lane.select("road", F.col("l._id").alias("lane"), F.col("l.link").alias("link"))
    junction = spark.read.format("xml").option("rowTag", "junction").schema(JUNCTIONS).load(path).select(F.explode("connection").alias("c")).select("c", F.explode("c.laneLink").alias("k"))
    kind = F.struct("section", F.lower(F.coalesce("l._type", F.lit("none"))).alias("lane_type"), F.coalesce("l._direction", F.lit("standard")).alias("direction"))
    return {
        "roads": rows.select("road", (F.coalesce("_junction", F.lit("-1")) != "-1").alias("junction")),
        "geometry": g.select("road", "seq", F.col("g._x").alias("x"), F.col("g._y").alias("y"), F.col("g._hdg").alias("heading"), F.col("g._length").alias("length"), F.coalesce("g.arc._curvature", F.lit(0.0)).alias("curvature")),
        "elevation": rows.select("road", F.explode("elevationProfile.elevation").alias("e")).select("road", F.col("e._s").alias("s"), *cubic("e")),
        "offsets": rows.select("road", F.explode("lanes.laneOffset").alias("e")).select("road", F.col("e._s").alias("s"), *cubic("e")),
        "lanes": lane.groupBy("road", F.col("l._id").alias("lane")).agg(F.min(kind).alias("k")).select("road", "lane", "k.*"),
        "widths": lane.select("road", F.col("l._id").alias("lane"), "s0", F.explode("l.width").alias("w")).select("road", "lane", (F.col("s0") + F.col("w._sOffset")).alias("s"), *cubic("w")),
        "signals": rows.select("road", F.explode("signals.signal").alias("x")).select("road", F.col("x._id").alias("signal"), F.col("x._s").alias("s"), F.coalesce("x._t", F.lit(0.0)).alias("t"), F.concat_ws(":", F.coalesce("x._type", F.lit("unknown")), F.nullif("x._subtype", F.lit("")), F.nullif("x._name", F.lit(""))).alias("kind")),
        "road_links": rows.select("road", pairs("end", "successor", "predecessor").alias("p")).filter("p.to._elementType = 'road'").select("road", "p.end", F.col("p.to._elementId").alias("to_road")),
        "lane_links": linked.select("road", "lane", pairs("end", "successor", "predecessor").alias("p")).filter("p.to._id IS NOT NULL").select("road", "lane", "p.end", F.col("p.to._id").alias("to_lane")),
        "neighbours": linked.select("road", "lane", pairs("side", "left", "right").alias("p")).filter("p.to._id IS NOT NULL").select("road", "lane", "p.side", F.col("p.to._id").alias("to_lane"), F.coalesce("p.to._direction", F.lit("forward")).alias("way")),
        "connections": junction.select(F.col("c._incomingRoad").alias("road"), F.col("k._from").alias("lane"), F.col("c._connectingRoad").alias("to_road"), F.col("k._to").alias("to_lane"), F.coalesce("c._contactPoint", F.lit("start")).alias("contact")),
    }

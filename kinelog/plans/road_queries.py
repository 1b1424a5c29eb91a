"""Queries over roads, each beside its SQL: an order is a road, its items the pieces of its line and its lanes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curves, links
from . import trajectories as t
from .queries import query, r

_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey"


def pieces(spark, d):
    i = t.table(spark, d, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    bend = F.when(F.col("l_returnflag") == "A", 0.0).otherwise(F.col("l_discount") - 0.05)
    return i.select(F.col("l_orderkey").alias("road"), seq.alias("seq"), (F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 50).cast("double").alias("y"), (F.col("l_tax") * 20).alias("heading"), (F.col("l_quantity") / 4).alias("length"), bend.alias("curvature"))


@query(f"""WITH g AS (SELECT l_orderkey AS road, row_number() OVER w AS seq, CAST(l_partkey % 100 AS DOUBLE) AS x, CAST(l_suppkey % 50 AS DOUBLE) AS y, l_tax * 20 AS h, l_quantity / 4 AS len,
  CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE l_discount - 0.05 END AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey {_ORDER})),
n AS (SELECT *, CAST(greatest(2, ceil(len / 2.0)) AS BIGINT) AS n FROM g),
b AS (SELECT *, coalesce(sum(len) OVER p, 0.0) AS s0, coalesce(sum(n) OVER p, 0) AS i0 FROM n WINDOW p AS (PARTITION BY road ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, unnest(range(n)) AS k FROM b), l AS (SELECT *, len * k / (n - 1) AS t FROM k)
SELECT road, CAST(i0 + k AS BIGINT) AS index, round(s0 + t, 6) AS s, round(x + CASE WHEN abs(c) >= 1e-6 THEN (sin(h + c * t) - sin(h)) / c ELSE cos(h) * t END, 6) AS x,
  round(y + CASE WHEN abs(c) >= 1e-6 THEN (cos(h) - cos(h + c * t)) / c ELSE sin(h) * t END, 6) AS y, round(h + CASE WHEN abs(c) >= 1e-6 THEN c * t ELSE 0.0 END, 6) AS heading FROM l""")
def road_curves(spark, d):
    found = curves.sampled(pieces(spark, d), 2.0)
    return found.select("road", "index", *(r(c).alias(c) for c in ("s", "x", "y", "heading")))


@query("""WITH w AS (SELECT l_suppkey AS road, CAST(l_linenumber * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS INTEGER) AS lane, min(l_quantity) / 8 AS width FROM lineitem GROUP BY ALL),
o AS (SELECT *, sign(lane) * sum(width) OVER (PARTITION BY road, sign(lane) ORDER BY abs(lane) ROWS UNBOUNDED PRECEDING) AS o FROM w)
SELECT road, lane, round(o - sign(lane) * width, 6) AS "inner", round(o, 6) AS "outer" FROM o""")
def lanes_chained(spark, d):
    """Each supplier is a road, its line numbers are lanes, returned ones on the right."""
    lane = (F.col("l_linenumber") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).cast("int")
    widths = t.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("road"), lane.alias("lane")).agg((F.min("l_quantity") / 8).alias("width"))
    return curves.chained(widths, "road").select("road", "lane", r("inner").alias("inner"), r("outer").alias("outer"))


def signed_lanes(spark, d, *more):
    """Line items as lanes of their supplier's road, returned ones on the right."""
    lane = (F.col("l_linenumber") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).cast("int")
    return t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("road"), lane.alias("lane"), *more)


_LANES = """l AS (SELECT l_suppkey AS road, CAST(l_linenumber * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS INTEGER) AS lane, * FROM lineitem)"""


@query(f"""WITH {_LANES}, ids AS (SELECT DISTINCT road, lane FROM l), links AS (SELECT s_suppkey AS road, 'successor' AS e, s_nationkey + 1 AS to_road FROM supplier UNION ALL SELECT s_suppkey, 'predecessor', s_suppkey + 1 FROM supplier),
a AS (SELECT l.road, l.lane, k.to_road, CAST(round(l_tax * 100) AS INTEGER) - 4 AS to_lane, (k.e = 'successor') = (l.lane <= 0) AS out FROM l JOIN links k ON k.road = l.road AND k.e = CASE WHEN l_linestatus = 'O' THEN 'successor' ELSE 'predecessor' END
  UNION ALL SELECT road, lane, l_partkey % 50, CAST(round(l_discount * 100) AS INTEGER) - 5, l_quantity >= 10 FROM l),
p AS (SELECT CASE WHEN out THEN road ELSE to_road END AS road, CASE WHEN out THEN lane ELSE to_lane END AS lane, CASE WHEN out THEN to_road ELSE road END AS to_road, CASE WHEN out THEN to_lane ELSE lane END AS to_lane FROM a)
SELECT DISTINCT p.road, p.lane, to_road, to_lane FROM p JOIN ids USING (road, lane) JOIN ids j ON j.road = to_road AND j.lane = to_lane""")
def lanes_followed(spark, d):
    """A supplier's road goes on into that of its nation's number and comes from the next supplier's; parts stand for junctions' connecting roads."""
    s = t.table(spark, d, "supplier")
    roads = s.select(F.col("s_suppkey").alias("road"), F.lit("successor").alias("end"), (F.col("s_nationkey") + 1).alias("to_road"))
    roads = roads.unionByName(s.select(F.col("s_suppkey").alias("road"), F.lit("predecessor").alias("end"), (F.col("s_suppkey") + 1).alias("to_road")))
    to = lambda c, by: (F.round(F.col(c) * 100).cast("int") - by).alias("to_lane")
    lane_links = signed_lanes(spark, d, F.when(F.col("l_linestatus") == "O", "successor").otherwise("predecessor").alias("end"), to("l_tax", 4))
    ways = signed_lanes(spark, d, (F.col("l_partkey") % 50).alias("to_road"), to("l_discount", 5), F.when(F.col("l_quantity") < 10, "end").otherwise("start").alias("contact"))
    return links.followed(signed_lanes(spark, d), roads, lane_links, ways)


@query(f"""WITH {_LANES}, ids AS (SELECT DISTINCT road, lane, CASE WHEN lane % 3 = 0 THEN 'sidewalk' ELSE 'driving' END AS kind, lane % 2 = 0 AS two FROM l),
said AS (SELECT road, lane, lane + CAST(round(l_discount * 100) AS INTEGER) % 3 - 1 AS to_lane, CASE WHEN l_linestatus = 'O' THEN l_returnflag = 'A' ELSE l_returnflag <> 'A' END AS lefty, l_linestatus = 'O' AS ahead FROM l),
near AS (SELECT a.road, a.lane, a.two, b.lane AS to_lane, b.lane = a.lane + 1 AS lefty FROM ids a JOIN ids b ON a.road = b.road AND b.kind = 'driving' AND (b.lane = a.lane + 1 OR b.lane = a.lane - 1))
SELECT road, lane, CASE WHEN n.lefty THEN 'left' ELSE 'right' END AS side, to_lane, EXISTS (SELECT 1 FROM said s WHERE s.road = n.road AND s.lane = n.lane AND s.to_lane = n.to_lane AND s.lefty = n.lefty AND (s.ahead OR n.two)) AS legal FROM near n""")
def lanes_beside(spark, d):
    lanes = signed_lanes(spark, d).withColumns({"lane_type": F.when(F.col("lane") % 3 == 0, "sidewalk").otherwise("driving"), "direction": F.when(F.col("lane") % 2 == 0, "both").otherwise("standard")})
    said = signed_lanes(
        spark, d, F.when(F.col("l_returnflag") == "A", "left").otherwise("right").alias("side"), (F.round(F.col("l_discount") * 100).cast("int") % 3).alias("_step"),
        F.when(F.col("l_linestatus") == "O", "forward").otherwise("backward").alias("way"),
    ).withColumn("to_lane", (F.col("lane") + F.col("_step") - 1).cast("int"))
    return links.beside(lanes, said)

"""Roads as rows: reference lines sampled at even stations, lanes chained beside them, places given along and across a road."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import cubic_sections

#: A curvature under this is a straight line.
STRAIGHT = 1e-6


def sampled(geometry: DataFrame, resolution: float, by: str = "road") -> DataFrame:
    """(road, index, s, x, y, heading) of lines and arcs (road, seq, x, y, heading, length, curvature): each at even stations at most ``resolution`` apart or so,
    its first and last point included; s runs on from piece to piece, index counts from 0. A piece without a length, or with a null, gives none."""
    rows = geometry.filter("length > 0 AND x IS NOT NULL AND y IS NOT NULL AND heading IS NOT NULL")
    along = Window.partitionBy(by).orderBy("seq")
    n = F.greatest(F.lit(2), F.ceil(F.col("length") / resolution)).cast("long")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_n", n).withColumns({"_s0": F.coalesce(F.sum("length").over(before), F.lit(0.0)), "_i0": F.coalesce(F.sum("_n").over(before), F.lit(0))})
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    t, h, c = F.col("length") * F.col("_k") / (F.col("_n") - 1), F.col("heading"), F.coalesce("curvature", F.lit(0.0))
    turned = h + c * t
    bent = F.abs(c) >= STRAIGHT
    dx = F.when(bent, (F.sin(turned) - F.sin(h)) / c).otherwise(F.cos(h) * t)
    dy = F.when(bent, (F.cos(h) - F.cos(turned)) / c).otherwise(F.sin(h) * t)
    return rows.select(by, (F.col("_i0") + F.col("_k")).alias("index"), (F.col("_s0") + t).alias("s"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.when(bent, turned).otherwise(h).alias("heading"))


def beside(x: Column, y: Column, heading: Column, t: Column) -> tuple[Column, Column]:
    """The place ``t`` to the left of a line's place."""
    return x - t * F.sin(heading), y + t * F.cos(heading)


def reference_lines(tables: dict[str, DataFrame], resolution: float) -> DataFrame:
    """``sampled`` lines with z from the elevation and moved sideways by the roads' lane offsets, which are read at index times ``resolution``."""
    rows = cubic_sections(sampled(tables["geometry"], resolution), tables["elevation"], ("road",)).withColumnRenamed("value", "z")
    rows = cubic_sections(rows.withColumn("_at", F.col("index") * resolution), tables["offsets"], ("road",), s="_at")
    x, y = beside(F.col("x"), F.col("y"), F.col("heading"), F.col("value"))
    return rows.select("road", "index", "s", x.alias("x"), y.alias("y"), "z", "heading")


def chained(widths: DataFrame, *keys: str) -> DataFrame:
    """``widths`` (``keys``, lane, width) with inner and outer: how far to the left of the reference line each lane begins and ends, counted from the inside out;
    lanes with ids under 0 lie to the right. There is no lane 0. A null width counts as 0."""
    sign = F.when(F.col("lane") > 0, 1).otherwise(-1)
    out = Window.partitionBy(*keys, sign).orderBy(F.abs("lane")).rowsBetween(Window.unboundedPreceding, 0)
    width = F.coalesce("width", F.lit(0.0))
    rows = widths.filter("lane <> 0").withColumn("outer", sign * F.sum(width).over(out))
    return rows.withColumn("inner", F.col("outer") - sign * width)


def lane_lines(tables: dict[str, DataFrame], resolution: float) -> DataFrame:
    """(road, lane, seq, side, x, y, z): border and center points of all lanes, ``side`` inner, center or outer. Lanes on the left run against the road.

    Widths are read at index times ``resolution``, of all lanes of a road on its one grid of stations; a lane without a width has the width 0.
    """
    line = reference_lines(tables, resolution)
    grid = line.join(tables["lanes"].select("road", "lane"), "road").withColumn("at", F.col("index") * resolution)
    wide = cubic_sections(grid, tables["widths"], ("road", "lane"), s="at").withColumnRenamed("value", "width")
    rows = chained(wide, "road", "index")
    last = F.max("index").over(Window.partitionBy("road", "lane"))
    rows = rows.withColumn("seq", F.when(F.col("lane") > 0, last - F.col("index")).otherwise(F.col("index")))
    sides = {"inner": F.col("inner"), "center": (F.col("inner") + F.col("outer")) / 2, "outer": F.col("outer")}
    rows = rows.withColumn("_o", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), v.alias("t")) for k, v in sides.items()))))
    x, y = beside(F.col("x"), F.col("y"), F.col("heading"), F.col("_o.t"))
    return rows.select("road", "lane", "seq", F.col("_o.side").alias("side"), x.alias("x"), y.alias("y"), "z")


def placed_along(marks: DataFrame, line: DataFrame, resolution: float) -> DataFrame:
    """``marks`` (road, s, t and more) with x, y, z: the place at s on their road's line, straight between its stations at multiples of ``resolution`` by index, and t to the left of it.

    Beyond the last station the last one counts; marks before 0, or of a road without a line, get null.
    """
    last = line.groupBy("road").agg(F.max("index").alias("_last"))
    rows = marks.join(last, "road", "left").withColumn("_f", F.when(F.col("s").isNotNull(), F.least(F.col("s") / resolution, F.col("_last").cast("double"))))
    rows = rows.withColumn("_low", F.floor("_f")).withColumn("_high", F.least(F.col("_low") + 1, F.col("_last")))
    end = lambda n: line.select("road", F.col("index").alias(f"_{n}"), F.struct("x", "y", "z", "heading").alias(f"_p{n}"))
    rows = rows.join(end("low"), ["road", "_low"], "left").join(end("high"), ["road", "_high"], "left")
    share = F.col("_f") - F.col("_low")
    mix = lambda c: F.col(f"_plow.{c}") + share * (F.col(f"_phigh.{c}") - F.col(f"_plow.{c}"))
    x, y = beside(mix("x"), mix("y"), F.col("_plow.heading"), F.col("t"))
    return rows.select(*marks.columns, x.alias("x"), y.alias("y"), mix("z").alias("z"))

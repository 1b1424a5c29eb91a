"""Which lane follows which along roads and through junctions, and which lanes lie beside each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lane types that vehicles drive on. Fixed values; types come in lower case, and ramps' own types are not among them.
DRIVING = ("driving", "exit", "entry", "parking")
LANE, TO = ("road", "lane"), ("to_road", "to_lane")


def _known(pairs: DataFrame, lanes: DataFrame) -> DataFrame:
    """Pairs of which both lanes exist, each once."""
    ids = lanes.select(*LANE).distinct()
    pairs = pairs.join(ids, list(LANE), "left_semi")
    return pairs.join(ids.toDF(*TO), list(TO), "left_semi").select(*LANE, *TO).distinct()


def followed(lanes: DataFrame, road_links: DataFrame, lane_links: DataFrame, connections: DataFrame) -> DataFrame:
    """(road, lane, to_road, to_lane): traffic leaves the first lane into the second; each pair once, however many links say so.

    A lane's link names a lane of the road that its own road is linked with at that end. Traffic on lanes with ids over 0 runs against their road, so it leaves at the
    predecessor's end. At a junction's connection it leaves the incoming lane where the contact is the connecting road's start, and enters it elsewhere. Links of roads without a
    link at that end, links with nulls, and links of lanes that don't exist give none; a lane may follow itself.
    """
    ends = road_links.select("road", "end", "to_road").distinct()
    linked = lane_links.select(*LANE, "end", "to_lane").join(ends, ["road", "end"])
    runs_on = (F.col("end") == "successor") == (F.col("lane") <= 0)
    joined = connections.select(*LANE, *TO, (F.col("contact") == "start").alias("out"))
    both = linked.select(*LANE, *TO, runs_on.alias("out")).unionByName(joined).filter(F.col("out").isNotNull())
    turn = lambda a, b: F.when(F.col("out"), F.col(a)).otherwise(F.col(b))
    return _known(both.select(*(turn(a, b).alias(a) for a, b in (*zip(LANE, TO), *zip(TO, LANE)))), lanes)


def beside(lanes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(road, lane, side, to_lane, legal): the driving lane next to each of ``lanes`` (road, lane, lane_type, direction) on each side, and whether changing there is allowed.

    The lane to the left has the next greater id; lane 0 is the line between the directions and is never crossed. A change is legal where ``neighbours`` (road, lane, side,
    to_lane, way) name that lane on that side in forward way, and on lanes for both directions also on the other side in backward way. Repeated lanes count once, by their least type and
    direction.
    """
    one = lanes.filter("road IS NOT NULL AND lane IS NOT NULL").groupBy(*LANE).agg(F.min(F.struct("lane_type", "direction")).alias("k")).select(*LANE, "k.*")
    step = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.lit(1).alias("by")), F.struct(F.lit("right").alias("side"), F.lit(-1).alias("by"))))
    near = one.select(*LANE, "direction", step.alias("s")).select(*LANE, "direction", "s.side", (F.col("lane") + F.col("s.by")).cast("int").alias("to_lane")).filter("to_lane <> 0")
    near = near.join(one.filter(F.col("lane_type").isin(*DRIVING)).select("road", F.col("lane").alias("to_lane")), ["road", "to_lane"], "left_semi")
    other = F.when(F.col("side") == "left", "right").when(F.col("side") == "right", "left")
    said = neighbours.select(*LANE, "to_lane", "way", F.when(F.col("way") == "forward", F.col("side")).when(F.col("way") == "backward", other).alias("side"))
    said = said.groupBy(*LANE, "to_lane", "side").agg(F.max(F.col("way") == "forward").alias("_ahead"), F.max(F.col("way") == "backward").alias("_behind"))
    legal = F.coalesce("_ahead", F.lit(False)) | (F.coalesce(F.col("direction") == "both", F.lit(False)) & F.coalesce("_behind", F.lit(False)))
    return near.join(said, [*LANE, "to_lane", "side"], "left").select(*LANE, "side", "to_lane", legal.alias("legal"))

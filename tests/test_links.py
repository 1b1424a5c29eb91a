"""Links of roads and junctions out of a small file of our own, and against plain loops."""

import random

from kinelog.operators import links
from kinelog.sources import roads

FILE = """<?xml version="1.0"?>
<OpenDRIVE>
  <road id="1" junction="-1">
    <link><successor elementType="junction" elementId="9"/><predecessor elementType="road" elementId="2" contactPoint="end"/></link>
    <lanes><laneSection s="0">
      <left><lane id="1" type="driving"><link><predecessor id="1"/><successor id="5"/></link></lane></left>
      <right>
        <lane id="-1" type="driving" direction="both"><link><predecessor id="-1"/><right id="-2"/><left id="1" direction="backward"/></link></lane>
        <lane id="-2" type="Entry"><link><predecessor id="-7"/><left id="-1" direction="backward"/></link></lane>
        <lane id="-3" type="sidewalk"/>
      </right>
    </laneSection></lanes>
  </road>
  <road id="2" junction="-1">
    <link><successor elementType="road" elementId="1" contactPoint="start"/></link>
    <lanes><laneSection s="0">
      <left><lane id="1" type="driving"><link><successor id="1"/></link></lane></left>
      <right><lane id="-1" type="driving"><link><successor id="-1"/></link></lane></right>
    </laneSection></lanes>
  </road>
  <road id="3" junction="9"><lanes><laneSection s="0"><right><lane id="-1" type="driving"/></right></laneSection></lanes></road>
  <junction id="9" name="j">
    <connection id="0" incomingRoad="1" connectingRoad="3" contactPoint="start"><laneLink from="-1" to="-1"/><laneLink from="-9" to="-1"/></connection>
    <connection id="1" incomingRoad="1" connectingRoad="3" contactPoint="end"><laneLink from="1" to="-1"/></connection>
  </junction>
</OpenDRIVE>
"""


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_file_of_roads(spark, tmp_path):
    (tmp_path / "net.xml").write_text(FILE)
    t = roads.road_tables(spark, str(tmp_path / "net.xml"))
    got = rows(links.followed(t["lanes"], t["road_links"], t["lane_links"], t["connections"]))
    # Both roads name the links between them; a lane on the left comes the other way; the junction's end contact turns the pair.
    assert got == sorted([("2", -1, "1", -1), ("1", 1, "2", 1), ("1", -1, "3", -1), ("3", -1, "1", 1)], key=str)
    # Lane -2 names -1 in backward way, which counts for lanes of both directions only; the sidewalk is nobody's neighbour but has one.
    assert rows(links.beside(t["lanes"], t["neighbours"])) == sorted([("1", -1, "right", -2, True), ("1", -2, "left", -1, False), ("1", -3, "left", -2, False)], key=str)


def test_drawn_links_equal_plain_loops(spark):
    rng = random.Random(8)
    some = lambda *v: rng.choice((*v, None)) if rng.random() < 0.1 else rng.choice(v)
    ids = range(-3, 4)
    lanes = [(some(*range(6)), some(*(i for i in ids if i)), some("driving", "parking", "none"), some("both", "standard")) for _ in range(40)]
    lanes = list({l[:2]: l for l in lanes}.values())
    road_links = [(some(*range(6)), some("successor", "predecessor"), some(*range(6))) for _ in range(12)]
    lane_links = [(some(*range(6)), some(*ids), some("successor", "predecessor"), some(*ids)) for _ in range(60)]
    ways = [(some(*range(6)), some(*ids), some(*range(6)), some(*ids), some("start", "end")) for _ in range(40)]
    said = [(some(*range(6)), some(*ids), some("left", "right"), some(*ids), some("forward", "backward", "odd")) for _ in range(150)]
    known = {l[:2] for l in lanes if None not in l[:2]}
    want = {((r, l), (to, m)) if (e == "successor") == (l <= 0) else ((to, m), (r, l)) for r, l, e, m in lane_links for r2, e2, to in road_links if None not in (r, l, e, m, to) and (r, e) == (r2, e2)}
    want |= {((r, l), (to, m)) if c == "start" else ((to, m), (r, l)) for r, l, to, m, c in ways if c}
    want = {(*a, *b) for a, b in want if a in known and b in known}
    frame = lambda r, kind: spark.createDataFrame(r, kind)
    of = frame(lanes, "road long, lane int, lane_type string, direction string")
    args = (frame(road_links, "road long, end string, to_road long"), frame(lane_links, "road long, lane int, end string, to_lane int"), frame(ways, "road long, lane int, to_road long, to_lane int, contact string"))
    assert want and rows(links.followed(of, *args)) == sorted(want, key=str)
    kinds = {l[:2]: l[2] for l in lanes if None not in l[:2]}
    beside = []
    for road, lane, _, way in lanes:
        for side, to in (("left", (lane or 0) + 1), ("right", (lane or 0) - 1)):
            if (road, lane) in known and to and kinds.get((road, to)) in links.DRIVING:
                back = "right" if side == "left" else "left"
                legal = (road, lane, side, to, "forward") in said or (way == "both" and (road, lane, back, to, "backward") in said)
                beside.append((road, lane, side, to, legal))
    assert beside and rows(links.beside(of, frame(said, "road long, lane int, side string, to_lane int, way string"))) == sorted(beside, key=str)
    assert not links.followed(of.limit(0), *args).count() and not links.beside(of.limit(0), frame([], "road long, lane int, side string, to_lane int, way string")).count()

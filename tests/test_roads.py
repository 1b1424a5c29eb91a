"""Roads out of a small file of our own against plain loops over the same numbers."""

import math

import pytest

from kinelog.operators import curves
from kinelog.sources import roads

FILE = """<?xml version="1.0"?>
<OpenDRIVE>
  <road id="1" length="30" junction="-1">
    <planView>
      <geometry s="0" x="1" y="2" hdg="0.5" length="10"><line/></geometry>
      <geometry s="10" x="9.776" y="6.794" hdg="0.5" length="12.5"><arc curvature="0.08"/></geometry>
      <geometry s="22" x="0" y="0" hdg="0" length="5"><spiral curvStart="0" curvEnd="0.1"/></geometry>
      <geometry s="22.5" x="15" y="15" hdg="1.5" length="1"><arc curvature="-0.2"/></geometry>
    </planView>
    <elevationProfile><elevation s="0" a="1" b="0.1" c="0" d="0"/><elevation s="8" a="2" b="0" c="0.01" d="0.001"/></elevationProfile>
    <lanes>
      <laneOffset s="0" a="0.5" b="0" c="0" d="0"/><laneOffset s="6" a="0" b="0.1" c="0" d="0"/>
      <laneSection s="0">
        <left><lane id="1" type="Driving"><width sOffset="0" a="3" b="0" c="0" d="0"/></lane><lane id="2" type="sidewalk"><width sOffset="0" a="1.5" b="0.1" c="0" d="0"/></lane></left>
        <center><lane id="0" type="none"/></center>
        <right><lane id="-1" type="driving" direction="reversed"><width sOffset="0" a="3.5" b="0" c="0" d="0"/></lane></right>
      </laneSection>
      <laneSection s="12">
        <right><lane id="-1" type="shoulder"><width sOffset="1" a="2" b="0.5" c="0" d="0"/></lane></right>
      </laneSection>
    </lanes>
    <signals><signal id="a" s="7" t="-2" type="274" subtype="50" name="limit"/><signal id="b" s="999" type="206"/></signals>
  </road>
  <road id="2" length="4" junction="7"><planView><geometry s="0" x="0" y="0" hdg="0" length="4"><line/></geometry></planView></road>
</OpenDRIVE>
"""
STEP = 2.0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("roads") / "net.xml"
    path.write_text(FILE)
    return roads.road_tables(spark, str(path))


def cubic(sections, s):
    fit = [x for x in sections if x[0] <= s] or sections[:1]
    if not fit:
        return 0.0
    s0, a, b, c, d = fit[-1]
    return a + b * (s - s0) + c * (s - s0) ** 2 + d * (s - s0) ** 3


def plain_line():
    """Stepping along each piece in small steps of its heading."""
    out, s0 = [], 0.0
    for x, y, h, size, bend in ((1, 2, 0.5, 10, 0.0), (9.776, 6.794, 0.5, 12.5, 0.08), (15, 15, 1.5, 1, -0.2)):
        n = max(2, math.ceil(size / STEP))
        for k in range(n):
            t, steps = size * k / (n - 1), 4000
            px = x + sum(math.cos(h + bend * t * (i + 0.5) / steps) for i in range(steps)) * t / steps
            py = y + sum(math.sin(h + bend * t * (i + 0.5) / steps) for i in range(steps)) * t / steps
            out.append((s0 + t, px, py, h + bend * t))
        s0 += size
    return out


def test_tables_of_a_file(tables):
    got = {k: sorted(map(tuple, v.collect()), key=str) for k, v in tables.items()}
    assert got["roads"] == [("1", False), ("2", True)]
    assert [r[:2] + r[-1:] for r in got["geometry"]] == [("1", 0, 0.0), ("1", 1, 0.08), ("1", 3, -0.2), ("2", 0, 0.0)]
    assert got["lanes"] == [("1", -1, 0, "driving", "reversed"), ("1", 1, 0, "driving", "standard"), ("1", 2, 0, "sidewalk", "standard")]
    assert ("1", -1, 13.0, 2.0, 0.5, 0.0, 0.0) in got["widths"] and len(got["widths"]) == 4
    assert got["signals"] == [("1", "a", 7.0, -2.0, "274:50:limit"), ("1", "b", 999.0, 0.0, "206")]


def test_lines_and_lanes_equal_plain_loops(tables):
    line = plain_line()
    got = {r["index"]: r for r in curves.reference_lines(tables, STEP).filter("road = '1'").collect()}
    assert sorted(got) == list(range(len(line)))
    centre = []
    for i, (s, x, y, h) in enumerate(line):
        off, z = cubic([(0, 0.5, 0, 0, 0), (6, 0, 0.1, 0, 0)], i * STEP), cubic([(0, 1, 0.1, 0, 0), (8, 2, 0, 0.01, 0.001)], s)
        centre.append((x - off * math.sin(h), y + off * math.cos(h), z, h))
        assert (got[i].s, got[i].x, got[i].y, got[i].z, got[i].heading) == pytest.approx((s, *centre[-1]), abs=1e-6)
    widths = {1: [(0, 3, 0, 0, 0)], 2: [(0, 1.5, 0.1, 0, 0)], -1: [(0, 3.5, 0, 0, 0), (13, 2, 0.5, 0, 0)]}
    lanes = {(r.lane, r.seq, r.side): (r.x, r.y, r.z) for r in curves.lane_lines(tables, STEP).collect()}
    assert len(lanes) == 3 * 3 * len(line)
    for i, (x, y, z, h) in enumerate(centre):
        w = {k: cubic(v, i * STEP) for k, v in widths.items()}
        want = {1: (0, w[1]), 2: (w[1], w[1] + w[2]), -1: (0, -w[-1])}
        for lane, (a, b) in want.items():
            seq = len(centre) - 1 - i if lane > 0 else i
            for side, t in (("inner", a), ("center", (a + b) / 2), ("outer", b)):
                assert lanes[lane, seq, side] == pytest.approx((x - t * math.sin(h), y + t * math.cos(h), z), abs=1e-6)


def test_marks_along_a_road(spark, tables):
    line = curves.reference_lines(tables, STEP)
    at = {r["index"]: r for r in line.filter("road = '1'").collect()}
    got = {r.signal: r for r in curves.placed_along(tables["signals"], line, STEP).collect()}
    a, b = at[3], at[4]
    x, y = (a.x + b.x) / 2, (a.y + b.y) / 2
    assert (got["a"].x, got["a"].y, got["a"].z) == pytest.approx((x + 2 * math.sin(a.heading), y - 2 * math.cos(a.heading), (a.z + b.z) / 2))
    assert (got["b"].x, got["b"].y) == pytest.approx((at[max(at)].x, at[max(at)].y))
    odd = spark.createDataFrame([("gone", 1.0, 0.0), ("2", -1.0, 0.0), ("2", None, 0.0), ("2", 4.0, 1.0)], "road string, s double, t double")
    got = {(r.road, r.s): (r.x, r.y) for r in curves.placed_along(odd, line, STEP).collect()}
    none = (None, None)
    assert got == {("gone", 1.0): none, ("2", -1.0): none, ("2", None): none, ("2", 4.0): (4.0, 1.0)}
    assert curves.lane_lines({k: v.limit(0) for k, v in tables.items()}, STEP).count() == 0

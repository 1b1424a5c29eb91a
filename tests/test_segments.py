"""Segments, edges and hulls against plain loops in whole numbers or fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelog.operators import maps
from kinelog.operators import segments as S

POINTS = "map_id string, elem_id long, seq int, x double, y double"


def plain_meet(a, b, c, d):
    """By exact areas: the ends of each segment are not strictly on one side of the other; on one line the boxes meet."""
    area = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    boxes = all(min(a[i], b[i]) <= max(c[i], d[i]) and min(c[i], d[i]) <= max(a[i], b[i]) for i in (0, 1))
    return boxes and area(a, b, c) * area(a, b, d) <= 0 and area(c, d, a) * area(c, d, b) <= 0


def test_meeting_of_segments(spark):
    rng = random.Random(4)
    place = lambda: (rng.randrange(4), rng.randrange(4))
    rows = [(*place(), *place(), *place(), *place()) for _ in range(800)]
    rows += [(0, 0, 4, 0, 2, 0, 6, 0), (0, 0, 2, 0, 2, 0, 6, 0), (0, 0, 1, 0, 2, 0, 6, 0), (1, 1, 1, 1, 0, 0, 2, 2), (1, 1, 1, 1, 1, 1, 1, 1), (1, 2, 1, 2, 0, 0, 2, 2), (0, 0, 0, 4, 0, 5, 0, 9)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double, d double, e double, f double, g double, h double")
    p, q = tuple(map(F.col, "abcd")), tuple(map(F.col, "efgh"))
    got = [(r.m, r.g) for r in df.select(S.meet(p, q).alias("m"), S.gap(p, q).alias("g")).collect()]
    for r, (m, g) in zip(rows, got):
        want = plain_meet(r[:2], r[2:4], r[4:6], r[6:])
        assert m == want and (g == 0) == want, r
    touching = {(0, 0, 4, 0, 2, 0, 6, 0): True, (0, 0, 2, 0, 2, 0, 6, 0): True, (0, 0, 1, 0, 2, 0, 6, 0): False}
    assert all(got[rows.index(r)][0] == v for r, v in touching.items())


def test_ends_that_touch_or_lie_on_one_line_cross(spark):
    line = lambda e, *pts: [("m", e, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    left = line(1, (0, 1), (9, 9), (6, 1)) + line(2, (0, 1), (6, 1)) + line(3, (0, 0), (6, 0)) + line(4, (0, 0), (2, 0)) + line(5, (0, 1), (6, 1)) + line(6, (0, 0), (5, 0))
    right = line(1, (0, -1), (6, -1)) + line(2, (6, -1), (0, -1)) + line(3, (6, 0), (0, 0)) + line(4, (1, 0), (3, 0)) + line(5, (3, 1), (6, 0)) + line(6, (9, 0), (6, 0))
    got = {r.elem_id: r.cross for r in maps.ends_cross(spark.createDataFrame(left, POINTS), spark.createDataFrame(right, POINTS)).collect()}
    # 3 and 6: the connecting segments lie on one line and share a stretch; 4: they share none; 5: one touches the other with an end.
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True}


def lines_of(rng, n, size=30.0, step=4.0, points=4):
    rows = []
    for e in range(n):
        x, y = rng.uniform(0, size), rng.uniform(0, size)
        for k in range(rng.randrange(1, points + 1)):
            rows.append(("m" if e % 5 else "n", e, k, x, y))
            x, y = x + rng.uniform(-step, step), y + rng.uniform(-step, step)
    return rows


def by_line(rows):
    out = {}
    for m, e, _, x, y in rows:
        if x is not None and not math.isnan(x):
            out.setdefault((m, e), []).append((x, y))
    return out


def plain_gap(a, b, c, d):
    def off(p, q, r):
        u = (r[0] - q[0], r[1] - q[1])
        square = u[0] ** 2 + u[1] ** 2
        t = max(0.0, min(1.0, ((p[0] - q[0]) * u[0] + (p[1] - q[1]) * u[1]) / square)) if square else 0.0
        return math.hypot(p[0] - q[0] - t * u[0], p[1] - q[1] - t * u[1])

    exact = [tuple(map(Fraction, p)) for p in (a, b, c, d)]
    return 0.0 if plain_meet(*exact) else min(off(a, c, d), off(b, c, d), off(c, a, b), off(d, a, b))


@pytest.mark.parametrize("cell", [0.7, 4.0, 100.0])
def test_crossing_edges_equal_all_pairs(spark, cell):
    rng = random.Random(8)
    edges, lanes = lines_of(rng, 60), lines_of(rng, 25)
    edges += [("m", 900, 0, 1.0, 1.0), ("m", 900, 1, None, 2.0), ("m", 900, 2, 2.0, 2.0), ("z", 901, 0, 0.0, 0.0), ("z", 901, 1, 9.0, 9.0)]
    lanes += [("m", 902, 0, 1.0, 1.0), ("m", 902, 1, 2.0, 2.0)]
    want, box = set(), lambda pts: (min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts))
    for (m, e), pts in by_line(edges).items():
        for (o, _), other in by_line(lanes).items():
            for c, d in zip(other, other[1:]):
                p, q = box(pts), box((c, d))
                if m == o and len(pts) > 1 and p != q and p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3] and any(plain_gap(a, b, c, d) < 0.2 for a, b in zip(pts, pts[1:])):
                    want.add((m, e))
    got = S.crossing_edges(spark.createDataFrame(edges, POINTS), spark.createDataFrame(lanes, POINTS), cell=cell)
    assert {tuple(r) for r in got.collect()} == want and 5 < len(want) < 60


def plain_kept(lines):
    """One after the other, each with all later ones."""
    about = {}
    for key, pts in lines.items():
        parts = [(math.hypot(b[0] - a[0], b[1] - a[1]), (a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(pts, pts[1:])]
        size = sum(p[0] for p in parts)
        if parts:
            size_or = size or 1.0
            about[key] = (size, sum(p[0] * p[1] for p in parts) / size_or, sum(p[0] * p[2] for p in parts) / size_or, math.atan2(pts[-1][1] - pts[0][1], pts[-1][0] - pts[0][0]))
    keys, out = sorted(about, key=lambda k: k[1]), set()
    for i, a in enumerate(keys):
        if a in out or about[a][0] < S.SHORT:
            continue
        for b in keys[i + 1 :]:
            if b in out or about[b][0] < S.SHORT or a[0] != b[0]:
                continue
            off = math.hypot(about[a][1] - about[b][1], about[a][2] - about[b][2])
            turn = abs((about[a][3] - about[b][3] + math.pi) % (2 * math.pi) - math.pi)
            if off <= S.NEAR and (turn <= S.TURN or off <= S.NEAR / 2):
                out.add(b if about[a][0] >= about[b][0] else a)
    return set(about) - out


@pytest.mark.parametrize("size", [8.0, 20.0, 60.0])
def test_duplicates_equal_taking_lines_in_order(spark, size):
    rng = random.Random(int(size))
    rows = lines_of(rng, 150, size, 2.0)
    rows += [(m, e + 1000 + 1000 * k, s, x, y) for m, e, s, x, y in rows[:80] for k in range(3)]
    rows += [("m", 9000, k, 1.0, 1.0) for k in range(2)]
    rng.shuffle(rows)
    got = S.kept_edges(spark.createDataFrame(rows, POINTS))
    lines = by_line(sorted(rows, key=lambda r: r[2]))
    assert {tuple(r) for r in got.collect()} == plain_kept(lines)
    assert S.kept_edges(spark.createDataFrame([], POINTS)).count() == 0


def test_many_copies_make_no_pairs(spark):
    rows = spark.range(3000).selectExpr("'m' AS map_id", "id AS elem_id", "explode(array(struct(0 AS seq, 0.0D AS x, 0.0D AS y), struct(1 AS seq, 5.0D AS x, 1.0D AS y))) AS p").select("map_id", "elem_id", "p.*")
    assert [tuple(r) for r in S.kept_edges(rows).collect()] == [("m", 0)]


def test_hulls_equal_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 60)
    rng = random.Random(2)
    sets = {k: [(rng.randrange(12), rng.randrange(12)) for _ in range(n)] for k, n in enumerate((1, 2, 3, 5, 20, 200, 400))}
    sets[7], sets[8] = [(i, 2 * i) for i in range(9)] * 2, [(3, 3)] * 5
    sets[9] = [(round(1000 * math.cos(a / 50)), round(1000 * math.sin(a / 50))) for a in range(314)]
    rows = [(k, float(x), float(y)) for k, pts in sets.items() for x, y in pts] + [(None, 0.0, 0.0), (0, None, 1.0), (0, math.nan, 1.0)]
    got = {r.k: [(p.x, p.y) for p in r.ring] for r in S.hulls(spark.createDataFrame(rows, "k int, x double, y double"), ("k",)).collect()}
    assert got.keys() == sets.keys()
    for k, pts in sets.items():
        pts = set(pts)
        area = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        dot = lambda a, b, c: (c[0] - a[0]) * (b[0] - a[0]) + (c[1] - a[1]) * (b[1] - a[1])
        corners = {a for a in pts for b in pts if a != b and all(area(a, b, c) > 0 or area(a, b, c) == 0 and dot(a, b, c) >= 0 and dot(b, a, c) >= 0 for c in pts)} or pts
        assert set(got[k]) == corners and got[k][0] == min(corners)
        turns = [area(got[k][i - 2], got[k][i - 1], got[k][i]) for i in range(len(got[k]) if len(got[k]) > 2 else 0)]
        assert min(turns, default=1) > 0
    assert S.hulls(spark.createDataFrame([], "k int, x double, y double"), ("k",)).count() == 0
    assert np.array_equal(S.convex_ring(np.zeros((4, 2))), np.zeros((1, 2)))


def test_edges_of_junctions(spark):
    line = lambda e, *pts: [("m", e, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    lanes = line(1, *((x, 0) for x in range(31))) + line(2, *((x, 20) for x in range(31)))
    edges = line(10, (0, 5), (30, 5)) + line(11, (3, -2), (3, 2)) + line(12, (0, 5.1), (29, 5.1)) + line(13, (0, 10), (30, 10)) + line(14, (0, 15), (30, 15)) + line(15, (0, 17))
    about = spark.createDataFrame([("m", 10, False, False), ("m", 11, False, False), ("m", 12, False, False), ("m", 13, True, False), ("m", 14, True, True), ("m", 15, False, False)], "map_id string, elem_id long, junction boolean, outer boolean")
    e, ls = spark.createDataFrame(edges, POINTS), spark.createDataFrame(lanes, POINTS)
    assert {r.elem_id for r in S.filtered_edges(e, about, ls).collect()} == {10, 14}
    assert {r.elem_id for r in S.filtered_edges(e, about, ls.limit(0)).collect()} == {10, 11, 13, 14}
    hull = S.hulls(ls, ("map_id",))
    assert {r.elem_id for r in S.inside_hull(e, hull).collect()} == {10, 12, 13, 14}
    assert S.inside_hull(spark.createDataFrame(line(20, (0, 0), (30, 0)) + line(21, (0, 0), (30, 20)) + line(22, (5, 5), (40, 5)), POINTS), hull).select("elem_id").collect() == [(21,)]


@pytest.mark.parametrize(("cell", "within"), [(None, None), (50.0, None), (1.0, 40.0)])
def test_nearest_equals_all_pairs(spark, cell, within):
    rng = random.Random(6)
    spot = lambda s: (round(rng.uniform(-s, s), 1), round(rng.uniform(-s, s), 1), float(rng.randrange(2)))
    points = [(rng.choice("mn"), rng.randrange(30), *spot(40)) for _ in range(250)] + [("m", 77, 500.0, -900.0, 0.0), ("m", 78, None, 0.0, 0.0), ("lone", 1, 0.0, 0.0, 0.0), (None, 5, 0.0, 0.0, 0.0)]
    places = [(k, rng.choice(["m", "n", "lone", "none"]), *spot(60)) for k in range(150)] + [(900, "m", 400.0, -800.0, 0.0), (901, "m", 900.0, 900.0, 0.0), (902, "lone", -700.0, 3.0, 1.0), (903, "m", math.nan, 0.0, 0.0), (904, None, 0.0, 0.0, 0.0)]
    want = []
    for k, m, *at in places:
        near = [(math.dist(at, p[2:]), p[1]) for p in points if m is not None and p[0] == m and None not in p and not math.isnan(at[0])]
        if near and (within is None or min(near)[0] < within):
            want.append((k, min(near)[1], round(min(near)[0], 6)))
    df = maps.nearest_lane(spark.createDataFrame(places, "place_id long, map_id string, x double, y double, z double"), spark.createDataFrame(points, "map_id string, elem_id long, x double, y double, z double"), cell, within)
    assert sorted((r.place_id, r.elem_id, round(r.distance, 6)) for r in df.collect()) == want


def test_nearest_on_empty_tables(spark):
    places, points = spark.createDataFrame([(1, "m", 0.0, 0.0, 0.0)], "place_id long, map_id string, x double, y double, z double"), spark.createDataFrame([("m", 1, 0.0, 0.0, 0.0)], "map_id string, elem_id long, x double, y double, z double")
    assert maps.nearest_lane(places, points.limit(0)).count() == 0 and maps.nearest_lane(places.limit(0), points).count() == 0 and maps.nearest_lane(places, points).count() == 1

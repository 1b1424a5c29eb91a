"""Places that meet elements tile by tile: equal to all pairs, and no pair of a place and a point is dealt out."""

import math
import random

import pytest

from kinelog.operators import maps, meeting
from kinelog.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def small(monkeypatch):
    """Parts and blocks that a few rows fill."""
    monkeypatch.setattr(meeting, "PART", 5)


def table(spark, n, seed, points):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.choice((rng.uniform(-40, 40), rng.uniform(-3, 3), 2.0 * rng.randint(-20, 20))), rng.uniform(-20, 20)
        x, y = (None, y) if i % 37 == 0 else (x, math.nan) if i % 31 == 0 else (9e5, -9e5) if i % 29 == 0 else (x, y)
        name = None if i % 11 == 0 else f"é{i % 7}"
        rows.append((name if points else (i // 2 if i % 5 == 0 else 1000 + i) + 2**60, i % 2, x, y, rng.choice((0.0, 0.5)), rng.uniform(-3.2, 3.2)))
    out = spark.createDataFrame(rows, f"{'elem_id string' if points else 'place_id long'}, map_id int, x double, y double, z double, h double")
    return out.selectExpr("*", "monotonically_increasing_id() AS seq") if points else out


def pairs(places, points, radius):
    """(place, point, distance) of all pairs at most the radius apart."""
    for p in places:
        for q in points:
            if p.map_id == q.map_id and None not in (p.x, q.x):
                d = math.sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)
                if d <= radius:
                    yield p, q, d


@pytest.mark.parametrize("radius", [0.7, 4.0])
def test_equal_to_all_pairs(spark, radius):
    """Repeated places, elements without an id, places far off."""
    places, points = table(spark, 260, 1, False), table(spark, 300, 2, True)
    n, least, cost = {}, {}, {}
    for p, q, d in pairs(places.collect(), points.collect(), radius):
        key = (p.place_id, q.elem_id)
        n[key], least[key] = n.get(key, 0) + 1, min(d, least.get(key, math.inf))
        turn = abs((p.h - q.h + math.pi) % (2 * math.pi) - math.pi)
        if turn < math.pi / 8:
            cost[key] = min(round(d + 0.1 * turn, 9), cost.get(key, math.inf))
    assert len(n) > 50 and (radius < 1 or any(e is None for _, e in n))
    assert sorted(map(str, map(tuple, maps.lanes_within(places, points, radius).collect()))) == sorted(map(str, n))
    assert {(r.place_id, r.elem_id): (r.n, round(r.distance, 9)) for r in maps.lanes_counted(places, points, radius).collect()} == {k: (n[k], round(least[k], 9)) for k in n}
    ranks = {}
    for r in maps.current_lane(places, points, radius).collect():
        ranks.setdefault(r.place_id, []).append((r["rank"], round(r.cost, 9), r.elem_id))
    assert {(p, e): c for p, rows in ranks.items() for _, c, e in rows} == cost
    for rows in ranks.values():
        assert [k for k, _, _ in sorted(rows)] == list(range(1, len(rows) + 1)) and [c for _, c, _ in sorted(rows)] == sorted(c for _, c, _ in rows)


@pytest.mark.parametrize("name", ["current_lane", "lanes_within_all", "map_long_table", "current_lane_all", "lanes_within", "stored_near"])
def test_no_pairs_are_dealt_out(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    above, below = plan.split("MapInArrow", 1)
    assert not any(word in above for word in ("Join", "Aggregate", "Exchange", "Window", "Sort"))
    assert "elem_id" in below

"""The nearest few by a bound: equal to all pairs, without making them."""

import math
import random

from pyspark.sql import functions as F

from kinelog.operators import elements, neighbors
from kinelog.spec import QuerySpec


def crowd(spark, n, seed, wide=60.0):
    """Agents at two moments: a dense middle, some far out, many in one place, some without one."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = (rng.expovariate(1 / 5), rng.choice((-3.0, 0.0, 2.0))) if i % 3 else (rng.uniform(-wide, wide), rng.uniform(-wide, wide))
        if i % 5 == 0:
            x, y = 1.5, 0.25
        rows.append((i % 2, i, 7, x if i % 41 else None, y if i % 43 else float("nan"), 1 + i % 3))
    return spark.createDataFrame(rows, "scene int, agent_id long, scene_ts long, x double, y double, agent_type int")


def all_pairs(rows, k, radius):
    out = set()
    for a in rows:
        near = []
        for b in rows:
            if a.scene == b.scene and a.agent_id != b.agent_id and None not in (a.x, b.x) and not math.isnan(a.y + b.y):
                d = math.sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))
                if d <= radius(b.agent_type, a.agent_type):
                    near.append((d, b.agent_id))
        out |= {(a.agent_id, b, r + 1, d) for r, (d, b) in enumerate(sorted(near)[:k])}
    return out


def test_nearest_few_equal_all_pairs(spark):
    s = crowd(spark, 420, 1)
    rows = s.collect()
    found = lambda df: {(r.t_agent_id, r.n_agent_id, r["rank"], r.distance) for r in df.collect()}
    for k, radius in ((1, 9.0), (3, 25.0), (4, 0.5)):
        assert found(neighbors.nearest(s, s, k, radius)) == all_pairs(rows, k, lambda n, t: radius)  # noqa: B023
    radii = {(1, 1): 2.0, (2, 1): 12.0, (3, 2): 0.0}
    by_type = lambda n, t: radii.get((n, t), 6.0)
    reach = lambda n, t: neighbors.radius_of(radii, 6.0, n, t)
    assert found(neighbors.nearest(s, s, 3, 12.0, "agent_type", reach=reach)) == all_pairs(rows, 3, by_type)


def test_a_crowd_makes_few_pairs(spark):
    """All within the radius of each other: 1,000,000 pairs a moment, of which a few for each are looked at."""
    s = crowd(spark, 2000, 2, 10.0)
    assert neighbors.closest(s, s, 3, 50.0).count() < 40 * 2000


def test_elements_with_a_limit_make_no_pairs_within_the_radius(spark, monkeypatch):
    s = crowd(spark, 300, 3).withColumns({c: F.lit(0.0) for c in ("vx", "vy", "ax", "ay", "heading")})
    spec = QuerySpec(dt=1.0, history=(0.0, 1.0), future=(0.0, 1.0), default_radius=8.0)
    ids = lambda e: {(r.agent_id, tuple(r.ids)) for r in e.select("agent_id", F.slice("neighbors.agent_id", 1, 4).alias("ids")).collect()}
    index = s.select("scene", "agent_id", "scene_ts")
    whole = ids(elements.agent_elements(index, s, spec))

    def refuse(*_):
        raise AssertionError("all pairs within the radius")

    monkeypatch.setattr(elements, "within", refuse)
    spec = QuerySpec(dt=1.0, history=(0.0, 1.0), future=(0.0, 1.0), default_radius=8.0, max_neighbors=4)
    assert ids(elements.agent_elements(index, s, spec)) == whole

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelog.functions import angles, formats
from kinelog.operators import derive, elements, index, lookup, maps, metrics, neighbors, resample, scenes, simulation, vectors, windows
from kinelog.spec import QuerySpec, ratio, steps

KIND = "scene long, agent_id long, scene_ts long, x double, y double"


def tracks(rng, agents=6, length=12, gaps=False):
    rows = []
    for a in range(agents):
        first = rng.randrange(4)
        for ts in range(first, first + rng.randint(1, length)):
            if not gaps or ts == first or rng.random() < 0.7:
                rows.append((a % 2, a, ts, round(rng.uniform(-9, 9), 2), round(rng.uniform(-9, 9), 2)))
    return rows


def collect(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_window_lengths_are_decimal():
    assert steps(0.3, 0.1) == 3 and steps(2.3, 0.1) == 23 and steps(0.25, 0.1, up=True) == 3 and steps(0.25, 0.1) == 2
    assert ratio(0.3, 0.1) == 3 and ratio(0.1, 0.5) == -5
    with pytest.raises(ValueError):
        ratio(0.3, 0.2)
    for bad in ({"dt": 0}, {"dt": 1, "centric": "x"}, {"dt": 1, "pad": "x"}, {"dt": 1, "history": (2, 1)}, {"dt": 1, "max_neighbors": -1}):
        with pytest.raises(ValueError):
            QuerySpec(**bad)


def test_window_law(spark):
    rows = [(0, 0, ts, float(ts), 0.0) for ts in range(100)]
    states = spark.createDataFrame(rows, KIND)
    spec = QuerySpec(dt=0.1, history=(2.3, 2.3), future=(2.4, 2.4))
    found = index.agent_index(derive.agents(states).withColumn("agent_type", F.lit(1)), spec)
    got = windows.with_windows(states, spec, "x").join(found, ["scene", "agent_id", "scene_ts"], "left_semi").select("scene_ts", F.size("history"), F.size("future")).collect()
    assert {(r[1], r[2]) for r in got} == {(24, 24)} and min(r[0] for r in got) == 23 and max(r[0] for r in got) == 75


def test_differences_equal_numpy(spark):
    rng = random.Random(1)
    rows = tracks(rng)
    got = {(r.agent_id, r.scene_ts): (r.vx, r.vy, r.ax) for r in derive.velocities(spark.createDataFrame(rows, KIND), 0.5).collect()}
    for a in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == a]
        x = np.array([r[3] for r in own])
        d = np.diff(x, prepend=np.nan)
        d[0] = d[1] if len(x) > 1 else 0.0
        v = d / 0.5
        e = np.diff(v, prepend=np.nan)
        e[0] = e[1] if len(v) > 1 else 0.0
        for r, vx, ax in zip(own, v, e / 0.5):
            assert got[a, r[2]][0] == pytest.approx(vx) and got[a, r[2]][2] == pytest.approx(ax)


def test_angles_and_formats(spark):
    rows = [(i, *np.random.default_rng(i).normal(0, 4, 8)) for i in range(30)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "scene double, x double, y double, vx double, vy double, ax double, ay double, heading double, h0 double").withColumns({"agent_id": F.lit(0), "scene_ts": F.lit(0)})
    u, v = angles.to_frame(F.col("x"), F.col("y"), F.col("vx"), F.col("vy"), F.col("h0"))
    a, b = angles.from_frame(F.col("u"), F.col("v"), F.col("vx"), F.col("vy"), F.col("h0"))
    df = df.withColumns({"u": u, "v": v}).withColumns({"a": a, "b": b, "w": angles.wrap(F.col("heading")), "m": angles.frame_matrix(F.col("vx"), F.col("vy"), F.col("h0"))})
    for r in df.collect():
        assert (r.a, r.b) == (pytest.approx(r.x), pytest.approx(r.y))
        assert -math.pi <= r.w < math.pi and math.isclose(math.cos(r.w), math.cos(r.heading), abs_tol=1e-9)
        c, s = math.cos(r.h0), math.sin(r.h0)
        assert np.allclose(np.array(r.m) @ [[c, -s, r.vx], [s, c, r.vy], [0, 0, 1]], np.eye(3))
        assert np.allclose((np.array(r.m) @ [r.x, r.y, 1])[:2], [r.u, r.v])
    back = formats.as_format(formats.as_format(df, "x,y,v_lon,v_lat,s,c").withColumnsRenamed({"s": "sin_heading", "c": "cos_heading"}), "x,y,xd,yd,h")
    for r, o in zip(back.orderBy("scene").collect(), df.orderBy("scene").collect()):
        assert (r.xd, r.yd) == (pytest.approx(o.vx), pytest.approx(o.vy)) and math.isclose(math.cos(r.h), math.cos(o.heading), abs_tol=1e-9)
    for bad in ("nonsense", "zdd"):
        with pytest.raises(ValueError):
            formats.as_format(df, bad)


def test_gaps_and_resampling_equal_numpy(spark):
    rows = tracks(random.Random(4), gaps=True)
    states = spark.createDataFrame(rows, KIND)
    filled, up = collect(derive.fill_gaps(states, "x"), "agent_id", "scene_ts", "x"), collect(resample.upsample(states, 3, ("x",)), "agent_id", "scene_ts", "x")
    for a in {r[1] for r in rows}:
        ts, x = zip(*sorted((r[2], r[3]) for r in rows if r[1] == a))
        for got, f in ((filled, 1), (up, 3)):
            to = np.arange(ts[0] * f, ts[-1] * f + 1)
            own = [(t, v) for k, t, v in got if k == a]
            assert [t for t, _ in own] == to.tolist()
            assert np.allclose([v for _, v in own], np.interp(to, np.array(ts) * f, x))
    back = collect(resample.downsample(resample.upsample(states, 3, ("x",)), 3), "agent_id", "scene_ts", "x")
    assert [r[:2] for r in back] == [r[:2] for r in filled] and np.allclose([r[2] for r in back], [r[2] for r in filled])
    turning = spark.createDataFrame([(0, 0, 0, 3.0), (0, 0, 1, -3.0)], "scene long, agent_id long, scene_ts long, heading double")
    middle = resample.upsample(turning, 2, (), "heading").filter("scene_ts = 1").first().heading
    assert abs(abs(middle) - math.pi) < 1e-9


def test_status_resampling(spark):
    lights = spark.createDataFrame([(0, "l", t, s) for t, s in ((0, 1), (1, 2), (4, 0))], "scene long, lane_id string, scene_ts long, status int")
    assert [r[1] for r in collect(resample.upsample_status(lights, 2), "scene_ts", "status")] == [1, 1, 2, 2, 2, 2, 0, 0, 0]
    assert collect(resample.downsample_status(lights, 2), "scene_ts", "status") == [(0, 1), (2, 0)]
    asked = spark.createDataFrame([(0, "l", 4), (0, "l", 5)], "scene long, lane_id string, scene_ts long")
    assert collect(maps.light_status(asked, lights), "scene_ts", "status") == [(4, 0), (5, -1)]


def test_neighbors_equal_all_pairs(spark):
    rows = tracks(random.Random(6), agents=14)
    states = spark.createDataFrame(rows, KIND)
    far = {(p[0], p[2], p[1], q[1]): math.hypot(p[3] - q[3], p[4] - q[4]) for p in rows for q in rows if p[0] == q[0] and p[2] == q[2] and p[1] != q[1]}
    got = {(r.scene, r.scene_ts, r.t_agent_id, r.n_agent_id): r.distance for r in neighbors.within(states, states, 4.0).collect()}
    assert got.keys() == {k for k, d in far.items() if d <= 4.0}
    top = neighbors.nearest(states, states, 2).collect()
    for r in top:
        better = [d for k, d in far.items() if k[:3] == (r.scene, r.scene_ts, r.t_agent_id) and d < r.distance - 1e-9]
        assert len(better) == r["rank"] - 1


def test_scene_centric_seen_from_an_agent_is_agent_centric(spark):
    rows = tracks(random.Random(8), agents=10)
    states = derive.velocities(spark.createDataFrame(rows, KIND)).withColumn("agent_type", F.lit(1))
    spec = QuerySpec(dt=1.0, history=(None, 2.0), future=(None, 2.0), default_radius=5.0)
    every = index.agent_index(derive.agents(states).withColumn("agent_type", F.lit(1)), spec)
    got = {(r.agent_id, r.scene_ts): r for r in elements.agent_elements(every, states, spec).collect()}
    assert len(got) == len(rows)
    plain = {(r.agent_id, r.scene_ts): r for r in states.collect()}
    for (a, ts), r in got.items():
        me = plain[a, ts]
        c, s = math.cos(-me.heading), math.sin(-me.heading)
        for n in r.neighbors:
            them = plain[n.agent_id, ts]
            dx, dy = them.x - me.x, them.y - me.y
            assert n.history[-1].x == pytest.approx(dx * c - dy * s) and n.history[-1].heading == pytest.approx(them.heading - me.heading)
            assert [h.scene_ts for h in n.history] == [t for t in range(ts - 2, ts + 1) if (n.agent_id, t) in plain]
            assert [f.scene_ts for f in n.future] == [t for t in range(ts + 1, ts + 3) if (n.agent_id, t) in plain]
        assert r.current.x == r.current.y == 0 and len(r.history) == len([t for t in range(ts - 2, ts + 1) if (a, t) in plain])


def test_padding_and_extras(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([],), ([1.0, 2.0, 3.0],)], "v array<double>")
    got = df.select(elements.padded(F.col("v"), F.lit(3)).alias("after"), elements.padded(F.col("v"), F.lit(3), True).alias("before")).collect()
    assert got[0].after == [1.0, 2.0, None] and got[0].before == [None, 1.0, 2.0] and got[1].after == [None] * 3 and got[2].before == [1.0, 2.0, 3.0]
    more = elements.with_extras(df, n=lambda e: F.size("v"), twice=lambda e: e["n"] * 2).collect()
    assert [r.twice for r in more] == [4, 0, 6]
    h = spark.createDataFrame([(0, 0, 5, [(4, 1.0, 1.0), (5, 2.0, 2.0)])], "scene long, agent_id long, scene_ts long, history array<struct<scene_ts:long,x:double,y:double>>")
    a, b = (elements.noisy_histories(h, 0.1, seed).first().history for seed in (1, 1))
    assert a == b and a[1].x == 2.0 and a[0].x != 1.0 and abs(a[0].x - 1) < 1


def test_histogram_equals_numpy(spark):
    values = [0.0, 1.0, 1.5, 2.0, 3.0, 3.0001, -0.1, 2.9999]
    edges = [0.0, 1.0, 2.0, 2.5, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.n for r in metrics.histogram(df, F.col("v"), edges).orderBy("bin").collect()] == np.histogram(values, edges)[0].tolist()
    with pytest.raises(ValueError):
        metrics.histogram(df, F.col("v"), [1.0, 1.0])


def test_simulation_in_one_fold_equals_steps(spark):
    states = derive.velocities(spark.createDataFrame([(0, a, ts, a + ts * 1.5, ts * 0.5) for a in range(3) for ts in range(6)], KIND))
    actions = states.select("scene", "agent_id", "scene_ts", (F.col("x") * 2).alias("x"), "y", "heading").filter("agent_id < 2 AND scene_ts < 5").persist()
    start = simulation.snapshot(states, 2)
    whole = simulation.run(start.filter("agent_id < 2"), actions, 2)
    now = start
    for ts in (2, 3):
        now = simulation.step(now, actions, ts)
        now = spark.createDataFrame(now.collect(), now.schema)
    after = [tuple(r) for r in now.filter("scene_ts > 2").orderBy("agent_id", "scene_ts").select(*whole.columns).collect()]
    assert after == [tuple(r) for r in whole.orderBy("agent_id", "scene_ts").collect()]
    assert {r.agent_id for r in now.filter("scene_ts > 2").collect()} == {0, 1}
    added = spark.createDataFrame([(0, 0, 9, 0.0, 0.0, 0.0), (0, 77, 1, 0.0, 0.0, 0.0), (0, 77, 2, 1.0, 0.0, 0.0)], "scene long, agent_id long, scene_ts long, x double, y double, heading double")
    more = simulation.add_agents(states, added)
    assert more.count() == states.count() + 2 and more.filter("agent_id = 77 AND scene_ts = 1").first().vx == 1.0
    m = simulation.metrics(states, states, 1, 4).collect()
    assert all(r.ade == r.fde == 0 for r in m)
    assert {r.scene for r in simulation.finished(states, 3, "_sim").collect()} == {"0_sim"}


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]


def test_polygons(spark):
    point = "struct<x:double,y:double,z:double,h:double>"
    make = lambda ring: [(float(a), float(b), 0.0, 0.0) for a, b in ring]
    areas = spark.createDataFrame([("m", "a", make(square(0, 0, 10)), [make(square(4, 4, 2))]), ("m", "b", make(square(20, 0, 5)), [])], f"map_id string, elem_id string, polygon array<{point}>, holes array<array<{point}>>")
    places = spark.createDataFrame([(1, "m", 1.0, 1.0), (2, "m", 5.0, 5.0), (3, "m", 13.0, 5.0), (4, "m", 200.0, 0.0)], "place_id long, map_id string, x double, y double")
    got = {(r.place_id, r.elem_id): r.distance for r in maps.areas_within(places, areas, 7.0, 5.0).collect()}
    assert got == {(1, "a"): 0.0, (2, "a"): pytest.approx(1.0), (3, "a"): pytest.approx(3.0), (3, "b"): pytest.approx(7.0)}
    assert collect(maps.nearest_area(places, areas, 100.0), "place_id", "elem_id", "distance") == [(1, "a", 0.0), (2, "a", 1.0), (3, "a", 3.0), (4, "b", 175.0)]
    twice = maps.areas_within(places.union(places), areas.union(areas), 7.0, 5.0).collect()
    assert {(r.place_id, r.elem_id): r.distance for r in twice} == got and len(twice) == len(got)


def test_areas_equal_measuring_each_pair(spark):
    rng = random.Random(5)
    point = "struct<x:double,y:double,z:double,h:double>"

    def star(x, y, size):
        return [(x + size * rng.uniform(0.3, 1) * math.cos(t), y + size * rng.uniform(0.3, 1) * math.sin(t), 0.0, 0.0) for t in sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(1, 9)))]

    def shrunk(ring):  # a hole lies within its outline's bounds
        mean = [sum(p[c] for p in ring) / len(ring) for c in (0, 1)]
        return [(mean[0] + 0.3 * (p[0] - mean[0]), mean[1] + 0.3 * (p[1] - mean[1]), 0.0, 0.0) for p in ring]

    outlines = {k: star(rng.uniform(0, 40), rng.uniform(0, 40), 8) for k in range(12)}
    made = {k: (p, [shrunk(p)] if k % 2 else None) for k, p in outlines.items()}
    areas = spark.createDataFrame([("m", k, p, h) for k, (p, h) in made.items()] + [("m", 90, [], []), ("m", 91, None, None)], f"map_id string, elem_id long, polygon array<{point}>, holes array<array<{point}>>")
    spots = {i: (rng.uniform(-5, 45), rng.uniform(-5, 45)) for i in range(150)}
    rows = [(i, "m", x, y) for i, (x, y) in spots.items()] + [(900, "m", None, 1.0), (901, "m", math.nan, 1.0), (902, "other", 1.0, 1.0)]
    places = spark.createDataFrame(rows, "place_id long, map_id string, x double, y double")
    want = {}
    for i, (x, y) in spots.items():
        for k, (outline, holes) in made.items():
            edges = [(ring[j], ring[(j + 1) % len(ring)]) for ring in [outline, *(holes or [])] for j in range(len(ring))]
            odd = sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in edges) % 2
            d = 0.0 if odd else min(to_edge(x, y, a, b) for a, b in edges)
            if d <= 6:
                want[i, k] = d
    got = {(r.place_id, r.elem_id): r.distance for r in maps.areas_within(places, areas, 6.0, 6.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert maps.areas_within(places, areas.limit(0), 6.0, 6.0).count() == 0 == maps.areas_within(places.limit(0), areas, 6.0, 6.0).count()


def to_edge(x, y, a, b):
    ux, uy = b[0] - a[0], b[1] - a[1]
    square = ux * ux + uy * uy
    t = max(0.0, min(1.0, ((x - a[0]) * ux + (y - a[1]) * uy) / square)) if square else 0.0
    return math.hypot(x - a[0] - t * ux, y - a[1] - t * uy)


def test_lines(spark):
    rng = random.Random(2)
    rows = [("m", e, i, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(-2, 2), rng.uniform(-3, 3)) for e in ("a", "b") for i in range(9)]
    points = spark.createDataFrame(rows, "map_id string, elem_id string, seq int, x double, y double, z double, h double")
    for p, q in zip(points.orderBy("elem_id", "seq").collect(), maps.decode(maps.encode(points)).orderBy("elem_id", "seq").collect()):
        assert abs(p.x - q.x) <= 0.001 * 9 and abs(p.z - q.z) <= 0.001 * 9
    dense = maps.densify(points, 2.0).orderBy("elem_id", "seq", "part").collect()
    for a, b in zip(dense, dense[1:]):
        if a.elem_id == b.elem_id:
            assert math.dist((a.x, a.y, a.z), (b.x, b.y, b.z)) <= 2.0 + 1e-9
    line = points.groupBy("map_id", "elem_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z", "h"))), lambda q: q.dropFields("seq")).alias("center"))
    even = maps.interpolate(line, 40).first().center
    assert len(even) == 40 and all(-math.pi <= q.h < math.pi for q in even)
    places = spark.createDataFrame([(1, "m", "a", 3.0, 4.0), (2, "m", "b", -30.0, 9.0)], "place_id long, map_id string, elem_id string, x double, y double")
    for r in maps.project(places, points).collect():
        at = {1: (3.0, 4.0, "a"), 2: (-30.0, 9.0, "b")}[r.place_id]
        own = [(p[3], p[4]) for p in rows if p[1] == at[2]]
        best = min(math.dist(at[:2], (a[0] + t / 500 * (b[0] - a[0]), a[1] + t / 500 * (b[1] - a[1]))) for a, b in zip(own, own[1:]) for t in range(501))
        assert r.distance <= best + 1e-9 and r.distance == pytest.approx(best, abs=0.3) and math.dist(at[:2], (r.px, r.py)) == pytest.approx(r.distance)
    loop = spark.createDataFrame([("m", "p", i, 0.0, 0.0, 0.0, 0.0) for i in range(3)], points.schema)
    assert maps.project(spark.createDataFrame([(1, "m", "p", 3.0, 4.0)], places.schema), loop).first().distance == 5.0


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, (60, 3)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(4)
    got = collect(vectors.nearest(rows, rows.filter("vec_id % 3 = 0"), 4), "query_id", "rank", "vec_id")
    want = []
    for q in range(0, 60, 3):
        d = np.sqrt(((data - data[q]) ** 2).sum(1))
        order = [i for i in sorted(range(60), key=lambda i: (d[i], i)) if i != q][:4]
        want += [(q, k + 1, i) for k, i in enumerate(order)]
    assert got == sorted(want)
    odd = rows.unionByName(spark.createDataFrame([(None, [0.0, 0.0, 0.0]), (99, None)], rows.schema))
    again = rows.filter("vec_id % 3 = 0")
    assert collect(vectors.nearest(odd, again.unionByName(again).unionByName(odd.filter("vec_id IS NULL OR vec_id = 99")), 4), "query_id", "rank", "vec_id") == got


def test_empty_tables(spark):
    none = derive.velocities(spark.createDataFrame([], KIND)).withColumn("agent_type", F.lit(1))
    spec = QuerySpec(dt=1.0, default_radius=3.0)
    found = derive.agents(none).withColumn("agent_type", F.lit(1))
    assert elements.agent_elements(index.agent_index(found, spec), none, spec).count() == 0
    assert index.scene_index(found, spec).count() == 0 and index.ordinals(found, spec).count() == 0
    assert resample.upsample(none, 2, ("x",)).count() == 0 and derive.fill_gaps(none, "x").count() == 0


def test_places_without_coordinates_have_no_lane(spark):
    points = spark.createDataFrame([("m", 1, 0, 0.0, 0.0, 0.0, 0.0), ("m", 2, 0, 300.0, 0.0, 0.0, 0.0), ("m", 3, 0, math.nan, 0.0, 0.0, 0.0)], "map_id string, elem_id long, seq long, x double, y double, z double, h double")
    places = spark.createDataFrame([(1, "m", 100.0, 0.0, 0.0), (2, "m", None, 0.0, 0.0), (3, "m", math.nan, 0.0, 0.0), (4, "other", 0.0, 0.0, 0.0), (5, "m", 160.0, 0.0, 0.0)], "place_id long, map_id string, x double, y double, z double")
    assert collect(maps.nearest_lane(places, points, 1.0), "place_id", "elem_id") == [(1, 1), (5, 2)]
    ring = [{"x": a, "y": b, "z": 0.0, "h": 0.0} for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))]
    areas = spark.createDataFrame([("m", 7, ring, [])], "map_id string, elem_id long, polygon array<struct<x:double,y:double,z:double,h:double>>, holes array<array<struct<x:double,y:double,z:double,h:double>>>")
    assert collect(maps.nearest_area(places, areas, 1.0), "place_id", "elem_id") == [(1, 7), (5, 7)]


def test_index_sizes_and_ordinals_follow_the_same_agents(spark):
    found = spark.createDataFrame([("s", "ego", 0, 9, 1), ("s", "a", 0, 4, 2), ("s", "b", 2, 8, 1)], "scene string, agent_id string, first_ts long, last_ts long, agent_type int")
    for spec, names in (
        (QuerySpec(dt=1.0), {"ego", "a", "b"}), (QuerySpec(dt=1.0, ego_only=True), {"ego"}), (QuerySpec(dt=1.0, with_ego_future=True), {"a", "b"}),
        (QuerySpec(dt=1.0, only_types=frozenset((1, 2)), only_predict=frozenset((2,))), {"a"}),
    ):
        listed = index.agent_index(found, spec)
        assert {r.agent_id for r in listed.collect()} == names
        assert index.index_sizes(found, spec).first().n == listed.count()
        ends = [(r.first_ordinal, r.first_ordinal + r.hi_ts - r.lo_ts + 1) for r in index.ordinals(found, spec).orderBy("agent_id").collect()]
        assert [a for a, _ in ends] == [0, *(b for _, b in ends[:-1])] and ends[-1][1] == listed.count()
    with pytest.raises(ValueError):
        QuerySpec(dt=1.0, ego_only=True, with_ego_future=True)


def test_scenes_by_tag_and_seeded_orders(spark):
    listed = spark.createDataFrame(
        [("e", "a", "boston-port", "train", 5, "Rain"), ("e", "b", "boston-hill", "val", 5, "sun"), ("e", "c", "boston-port", "train", 1, "rain"), ("f", "d", "boston-port", "train", 5, "rain")],
        "env string, name string, location string, data_split string, length_timesteps int, description string",
    )
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(index.of_source(listed, "e", ["train-boston", "val"], by_prefix=True)) == ["a", "b"]
    assert names(index.of_source(listed, "e", ["train-boston"])) == [] and names(index.of_source(listed, "e", ["e", "train"], ["RAIN"])) == ["a"]
    split = index.shuffled_split([f"n{i}" for i in range(10)], {"train": 0.7, "val": 0.2, "test": 0.1})
    assert split == index.shuffled_split([f"n{i}" for i in range(10)], {"train": 0.7, "val": 0.2, "test": 0.1})
    assert sorted(split.values()) == ["test"] + ["train"] * 7 + ["val"] * 2
    order = [r.name for r in index.shuffled(listed, 3, "name").collect()]
    assert order == [r.name for r in index.shuffled(listed.repartition(3), 3, "name").collect()] and sorted(order) == ["a", "b", "c", "d"]


def test_scene_elements_with_an_ego(spark):
    rows = [("s", a, ts, i * 2.0, ts * 1.0, 1) for i, a in enumerate(("a", "ego", "z")) for ts in range(3) if a != "z" or ts < 2]
    states = derive.velocities(spark.createDataFrame(rows, "scene string, agent_id string, scene_ts long, x double, y double, agent_type int"))
    moments = states.select("scene", "scene_ts").distinct()
    spec = QuerySpec(dt=1.0, history=(None, 1.0), future=(None, 1.0))
    got = {r.scene_ts: r for r in scenes.scene_elements(moments, states, spec).collect()}
    assert {t: (r.center_id, [a.agent_id for a in r.agents]) for t, r in got.items()} == {0: ("ego", ["ego", "a", "z"]), 1: ("ego", ["ego", "a", "z"]), 2: ("ego", ["ego", "a"])}
    assert [len(r.robot) for _, r in sorted(got.items())] == [2, 2, 1] and got[1].agents[1].history[-1].x == pytest.approx(0.0, abs=1e-9) and got[1].agents[1].history[-1].y == pytest.approx(2.0)
    cut = scenes.scene_elements(moments, states, spec, max_agents=1).collect()
    assert {r.center_id for r in cut} == {"a"} and {r.num_agents for r in cut} == {1}
    elements_ = scenes.scene_elements(moments, states, spec)
    batch = scenes.scene_collate(elements_, "scene_ts", 8, spec).collect()
    assert {len(r.agents) for r in batch} == {3} and all(len(a.history) == 2 and len(a.future) == 1 for r in batch for a in r.agents if a)
    picked = {r.scene_ts: r for r in scenes.to_agent_batch(elements_, F.lit(1)).collect()}
    assert picked[0].agent_id == "a" and [n.agent_id for n in picked[0].neighbors] == ["ego", "z"] and picked[2].num_neighbors == 1
    with pytest.raises(Exception, match="no such agent"):
        scenes.to_agent_batch(elements_, F.lit(2)).collect()
    assert scenes.scene_elements(moments, states.limit(0), spec).count() == 0


def test_elements_filtered_by_mask_and_changed(spark):
    e = spark.createDataFrame([("s", "a", 0, 1), ("s", "a", 1, 1), ("s", "b", 0, 2)], "scene string, agent_id string, scene_ts long, agent_type int")
    mask = spark.createDataFrame([("s", "a", 0, True), ("s", "b", 0, False)], "scene string, agent_id string, scene_ts long, keep boolean")
    assert collect(scenes.masked(e, mask, "scene", "agent_id", "scene_ts"), "agent_id", "scene_ts") == [("a", 0)]
    assert collect(scenes.agent_types(e), "agent_type") == [(1,), (2,)] and scenes.of_agent_type(e, 2).count() == 1
    assert collect(scenes.augmented(e, lambda d: d.filter("scene_ts = 0"), lambda d: d.withColumn("agent_type", F.lit(9))), "agent_type") == [(9,), (9,)]
    assert collect(scenes.kept_by(e, F.col("scene_ts") >= 0, 2, ("scene_ts", "agent_id")), "agent_id", "scene_ts") == [("a", 0), ("b", 0)]


def test_lookups_and_setters(spark):
    rng = random.Random(4)
    states = derive.velocities(spark.createDataFrame(tracks(rng), KIND))
    frames = states.filter("scene_ts = 4").groupBy("scene").agg(F.min_by(F.struct("x", "y", "vx", "vy", "ax", "ay", "heading"), "agent_id").alias("f")).select("scene", "f.*")
    seen = lookup.observed(states, frames)
    for got, want in ((lookup.restored(seen, frames), states),):
        pairs = {tuple(r)[:3]: r for r in got.collect()}
        for r in want.join(frames.select("scene"), "scene", "left_semi").collect():
            g = pairs[tuple(r)[:3]]
            assert [g.x, g.vy, g.ax, math.cos(g.heading)] == pytest.approx([r.x, r.vy, r.ax, math.cos(r.heading)], abs=1e-9)
    one = states.first()
    assert lookup.state_of(states, one.scene, one.agent_id, one.scene_ts).first() == one
    assert lookup.states_of(states, states.unionByName(states).limit(3)).count() <= 3
    with pytest.raises(ValueError):
        lookup.with_elements(states, v_lon=F.lit(0.0))
    assert lookup.value_of(states, states, "x", frames).count() == seen.count()


def test_simulation_carries_extents_and_height(spark):
    states = derive.velocities(spark.createDataFrame(tracks(random.Random(5)), KIND)).withColumns({"z": F.lit(2.0), "length": F.col("agent_id") + 0.5, "agent_type": F.lit(1)})
    start = simulation.snapshot(states, 3)
    moves = start.filter("scene_ts = 3").select("scene", "agent_id", (F.col("scene_ts") + 1).alias("scene_ts"), "x", "y", "heading")
    after = simulation.step(start, moves, 3)
    assert all(r.z == 2.0 and r.length == r.agent_id + 0.5 and r.agent_type == 1 for r in after.collect())
    raised = simulation.run(start, moves.withColumn("z", F.lit(7.0)), 3).collect()
    assert raised and all(r.z == 7.0 for r in raised)
    added = simulation.add_agents(after, moves.withColumn("agent_id", F.col("agent_id") + 100)).filter("agent_id >= 100")
    assert added.count() == moves.count() and added.filter("length IS NOT NULL").count() == 0


def test_ends_of_edges(spark):
    kind = "map_id string, elem_id long, seq int, x double, y double"
    line = lambda e, y, way: [("m", e, i, float(x), y) for i, x in enumerate((0, 3, 6)[::way])]
    left, right = spark.createDataFrame(line(1, 1.0, 1) + line(2, 1.0, 1), kind), spark.createDataFrame(line(1, -1.0, 1) + line(2, -1.0, -1), kind)
    assert collect(maps.ends_cross(left, right), "elem_id", "cross") == [(1, False), (2, True)]
    assert collect(maps.runs_along(right, left), "elem_id", "same_way") == [(1, True), (2, False)]
    h = [r.h for r in maps.with_headings(spark.createDataFrame([("m", 1, 0, 0.0, 0.0), ("m", 1, 1, 1.0, 0.0), ("m", 1, 2, 1.0, 1.0), ("m", 2, 0, 5.0, 5.0)], kind)).orderBy("elem_id", "seq").collect()]
    assert h == pytest.approx([0.0, math.pi / 4, math.pi / 2, 0.0])


@pytest.mark.parametrize("relative", [True, False])
def test_derivatives_of_neighbors_in_still_and_moving_frames(spark, relative):
    rows = [("s", a, ts, 3.0 * ts, float(k), 5.0 + k, 3.0, k + 1.0, 0.5, -0.5, math.pi / 2) for k, a in enumerate("ab") for ts in range(3)]
    states = spark.createDataFrame(rows, "scene string, agent_id string, scene_ts long, x double, y double, z double, vx double, vy double, ax double, ay double, heading double").withColumn("agent_type", F.lit(1))
    spec = QuerySpec(dt=1.0, history=(0.0, 1.0), future=(0.0, 1.0), default_radius=5.0, relative_derivatives=relative, with_z=True)
    at = states.filter("scene_ts = 1").select("scene", "scene_ts", "agent_id")
    own = {r.agent_id: r for r in elements.agent_elements(at, states, spec).collect()}
    [other] = own["a"].neighbors
    seen = other.history[-1]
    vx, vy, ax, ay = (0.0, 1.0, 0.0, 0.0) if relative else (3.0, 2.0, 0.5, -0.5)  # turned by a quarter: (x, y) is seen as (y, -x)
    assert (seen.vx, seen.vy, seen.ax, seen.ay) == pytest.approx((vy, -vx, ay, -ax))
    assert (seen.x, seen.y, seen.z) == pytest.approx((1.0, 0.0, 6.0)) and own["a"].current.z == 5.0
    [scene] = scenes.scene_elements(at.select("scene", "scene_ts").distinct(), states, spec).collect()
    [again] = [a for a in scene.agents if a.agent_id == "b"]
    assert (again.history[-1].vx, again.history[-1].vy, again.history[-1].z) == pytest.approx((vy, -vx, 6.0))

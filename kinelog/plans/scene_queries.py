"""Further registered queries: scene-centric elements, whole elements, stored tables, lookups, and maps as sets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.angles import frame_matrix
from ..functions.formats import as_format, named
from ..operators import elements, index, lookup, maps, metrics, scenes, simulation
from ..scratch import new_path
from ..sources import metadata, sinks, spatial, store
from ..spec import QuerySpec
from . import trajectories as t
from .queries import _MAP, _RADIUS_SQL, EDGES, ELEMENT, KEYS, RADII, RADIUS, back, bins_sql, built, dist, lights, map_places, map_points, query, r

# Scene-centric elements.

SCENE = QuerySpec(dt=1.0, history=(1.0, 3.0), future=(1.0, 3.0), radii=RADII, default_radius=5.0)
_AROUND = f"""WITH {t.STATES}, {t.TYPES}, s AS (SELECT * FROM states JOIN types USING (scene, agent_id)),
c AS (SELECT scene, scene_ts, min(agent_id) AS agent_id FROM s GROUP BY scene, scene_ts),
m AS (SELECT s.* FROM s JOIN c USING (scene, scene_ts, agent_id)),
p AS (SELECT m.scene, m.scene_ts, m.agent_id AS center_id, n.agent_id, {dist('m', 'n')} AS distance, n.agent_type AS nt, m.agent_type AS mt FROM m JOIN s n ON m.scene = n.scene AND m.scene_ts = n.scene_ts),
q AS (SELECT *, row_number() OVER (PARTITION BY scene, scene_ts ORDER BY distance, agent_id) AS rank, sum(CASE WHEN distance <= {_RADIUS_SQL.format(n="nt", t="mt")} THEN 1 ELSE 0 END) OVER (PARTITION BY scene, scene_ts) AS n FROM p),
around AS (SELECT q.*, q.scene_ts - greatest(first_ts, q.scene_ts - 3) + 1 AS history_len, least(last_ts, q.scene_ts + 3) - q.scene_ts AS future_len,
  greatest(first_ts, q.scene_ts - 3) AS ts0, least(last_ts, q.scene_ts + 3) AS ts1 FROM q JOIN agents USING (scene, agent_id) WHERE rank <= n)"""
_SX, _SY = back("a.x - m.x", "a.y - m.y", "m.heading")
_EX, _EY = back("b.x - m.x", "b.y - m.y", "m.heading")


def moments(spark, d):
    return t.positions(spark, d).select("scene", "scene_ts").distinct()


def built_scenes(spark, d, **more):
    return scenes.scene_elements(moments(spark, d), t.typed(spark, d), SCENE, **more)


@query(_AROUND + f""" SELECT q.scene, q.scene_ts, q.center_id, q.agent_id, q.rank, q.history_len, q.future_len, round({_SX}, 6) AS start_x, round({_SY}, 6) AS start_y, round({_EX}, 6) AS end_x, round({_EY}, 6) AS end_y
FROM around q JOIN m USING (scene, scene_ts) JOIN states a ON a.scene = q.scene AND a.agent_id = q.agent_id AND a.scene_ts = q.ts0 JOIN states b ON b.scene = q.scene AND b.agent_id = q.agent_id AND b.scene_ts = q.ts1""")
def scene_elements(spark, d):
    e = built_scenes(spark, d).select("scene", "scene_ts", "center_id", F.explode("agents").alias("a"))
    windows = F.concat("a.history", "a.future")
    first, last = F.get(windows, F.lit(0)), F.element_at(windows, -1)
    return e.select(
        "scene", "scene_ts", "center_id", "a.agent_id", F.col("a.rank").cast("long").alias("rank"), F.size("a.history").cast("long").alias("history_len"), F.size("a.future").cast("long").alias("future_len"),
        r(first["x"]).alias("start_x"), r(first["y"]).alias("start_y"), r(last["x"]).alias("end_x"), r(last["y"]).alias("end_y"),
    )


@query(_AROUND + """, e AS (SELECT scene, scene_ts, count(*) AS num_agents, max(history_len) AS h, max(future_len) AS f, CAST(floor((scene_ts * 4 + scene) / 16) AS BIGINT) AS batch FROM around GROUP BY scene, scene_ts)
SELECT scene, scene_ts, batch, num_agents, max(num_agents) OVER w AS padded_agents, greatest(max(h) OVER w, 2) AS padded_history, greatest(max(f) OVER w, 1) AS padded_future FROM e WINDOW w AS (PARTITION BY batch)""")
def scene_collated(spark, d):
    e = scenes.scene_collate(built_scenes(spark, d).withColumn("o", F.col("scene_ts") * 4 + F.col("scene")), "o", 16, SCENE)
    size = lambda part: F.size(F.get(F.col("agents"), F.lit(0))[part]).cast("long")
    return e.select("scene", "scene_ts", "batch", "num_agents", F.size("agents").cast("long").alias("padded_agents"), size("history").alias("padded_history"), size("future").alias("padded_future"))


@query(_AROUND + """ SELECT scene, scene_ts, arg_max(agent_id, rank) AS agent_id, arg_max(history_len, rank) AS history_len, count(*) - 1 AS num_neighbors, CASE WHEN count(*) > 1 THEN arg_min(agent_id, rank) END AS first_neighbor FROM around GROUP BY scene, scene_ts""")
def scene_to_agent(spark, d):
    e = scenes.to_agent_batch(built_scenes(spark, d), F.col("num_agents") - 1)
    return e.select("scene", "scene_ts", "agent_id", F.size("history").cast("long").alias("history_len"), "num_neighbors", F.get("neighbors", F.lit(0))["agent_id"].alias("first_neighbor"))


@query(_AROUND + f""", k AS (SELECT q.scene, q.scene_ts, q.agent_id, count(*) AS n FROM around q JOIN states a USING (scene, scene_ts, agent_id) JOIN states b ON b.scene = q.scene AND b.scene_ts = q.scene_ts AND b.agent_id <> q.agent_id AND {dist('a', 'b')} <= {RADIUS} GROUP BY ALL)
SELECT q.scene, q.agent_id, q.scene_ts, q.history_len, q.future_len, least(coalesce(k.n, 0), 5) AS n_neighbors FROM around q LEFT JOIN k USING (scene, scene_ts, agent_id)""")
def scene_to_agent_elements(spark, d):
    e = scenes.to_agent_elements(built_scenes(spark, d), t.typed(spark, d), ELEMENT)
    return elements.flat_elements(e).select(*KEYS, "history_len", "future_len", "n_neighbors")


_RX, _RY = back("b.x - m.x", "b.y - m.y", "m.heading")


@query(f"""WITH {t.STATES}, c AS (SELECT scene, scene_ts, min(agent_id) AS agent_id FROM states GROUP BY scene, scene_ts), m AS (SELECT s.* FROM states s JOIN c USING (scene, scene_ts, agent_id))
SELECT m.scene, m.scene_ts, count(*) AS robot_len, round(arg_max({_RX}, b.scene_ts), 6) AS last_x, round(arg_max({_RY}, b.scene_ts), 6) AS last_y FROM m JOIN states b ON b.scene = m.scene AND b.agent_id = m.agent_id AND b.scene_ts BETWEEN m.scene_ts AND m.scene_ts + 3 GROUP BY m.scene, m.scene_ts""")
def scene_robot(spark, d):
    e = built_scenes(spark, d)
    last = F.element_at("robot", -1)
    return e.select("scene", "scene_ts", F.size("robot").cast("long").alias("robot_len"), r(last["x"]).alias("last_x"), r(last["y"]).alias("last_y"))


@query(f"WITH {t.TRAJ} SELECT scene, scene_ts, agent_id FROM (SELECT *, row_number() OVER (PARTITION BY scene, scene_ts ORDER BY agent_id) AS k FROM traj) WHERE k <= 3")
def scene_agent_limit(spark, d):
    return scenes.first_agents(t.positions(spark, d), 3).select("scene", "scene_ts", "agent_id")


# Whole elements.

_I = f"""WITH {t.STATES}, {t.TYPES}, i AS (SELECT scene, agent_id, unnest(generate_series(first_ts + 1, last_ts - 1)) AS scene_ts FROM agents WHERE agent_type IN (1, 2) AND first_ts + 1 <= last_ts - 1)"""
_HX, _HY = back("h.x - s.x", "h.y - s.y", "s.heading")
_HVX, _HVY = back("h.vx - s.vx", "h.vy - s.vy", "s.heading")


@query(_I + f""" SELECT s.scene, s.agent_id, s.scene_ts, h.scene_ts AS ts, round({_HX}, 6) AS x, round({_HY}, 6) AS y, round({_HVX}, 6) AS vx, round({_HVY}, 6) AS vy, round(h.heading - s.heading, 6) AS heading
FROM i JOIN states s USING (scene, agent_id, scene_ts) JOIN states h ON h.scene = s.scene AND h.agent_id = s.agent_id AND h.scene_ts BETWEEN s.scene_ts - 3 AND s.scene_ts + 3""")
def element_states(spark, d):
    e = built(spark, d).select(*KEYS, F.explode(F.concat("history", "future")).alias("s"))
    return e.select(*KEYS, F.col("s.scene_ts").alias("ts"), *(r(F.col(f"s.{c}")).alias(c) for c in ("x", "y", "vx", "vy", "heading")))


_TVX, _TVY = back("h.vx", "h.vy", "s.heading")
_TAX, _TAY = back("h.ax", "h.ay", "s.heading")


@query(_I + f""" SELECT s.scene, s.agent_id, s.scene_ts, h.scene_ts AS ts, round({_HX}, 6) AS x, round({_TVX}, 6) AS vx, round({_TVY}, 6) AS vy, round({_TAX}, 6) AS ax, round({_TAY}, 6) AS ay, round(h.y / 2, 6) AS z
FROM i JOIN states s USING (scene, agent_id, scene_ts) JOIN states h ON h.scene = s.scene AND h.agent_id = s.agent_id AND h.scene_ts BETWEEN s.scene_ts - 3 AND s.scene_ts + 3""")
def element_turned(spark, d):
    spec = replace(ELEMENT, relative_derivatives=False, with_z=True)
    e = elements.agent_elements(index.agent_index(t.agents(spark, d), spec), t.typed(spark, d).withColumn("z", F.col("y") / 2), spec)
    e = e.select(*KEYS, F.explode(F.concat("history", "future")).alias("s"))
    return e.select(*KEYS, F.col("s.scene_ts").alias("ts"), *(r(F.col(f"s.{c}")).alias(c) for c in ("x", "vx", "vy", "ax", "ay", "z")))


@query(_I + f""", p AS (SELECT s.scene, s.agent_id, s.scene_ts, s.x, s.y, s.heading, n.agent_id AS neighbor, {dist('n', 's')} AS distance FROM states s JOIN i USING (scene, agent_id, scene_ts) JOIN states n ON n.scene = s.scene AND n.scene_ts = s.scene_ts AND n.agent_id <> s.agent_id),
s AS (SELECT *, row_number() OVER (PARTITION BY scene, agent_id, scene_ts ORDER BY distance, neighbor) AS rank FROM p WHERE distance <= {RADIUS})
SELECT s.scene, s.agent_id, s.scene_ts, s.neighbor, s.rank, h.scene_ts AS ts, round({_HX}, 6) AS x, round({_HY}, 6) AS y FROM s JOIN states h ON h.scene = s.scene AND h.agent_id = s.neighbor AND h.scene_ts BETWEEN s.scene_ts - 3 AND s.scene_ts + 3 WHERE rank <= 5""")
def element_neighbors(spark, d):
    e = built(spark, d).select(*KEYS, F.explode("neighbors").alias("n"))
    e = e.select(*KEYS, F.col("n.agent_id").alias("neighbor"), F.col("n.rank").cast("long").alias("rank"), F.explode(F.concat("n.history", "n.future")).alias("s"))
    return e.select(*KEYS, "neighbor", "rank", F.col("s.scene_ts").alias("ts"), r(F.col("s.x")).alias("x"), r(F.col("s.y")).alias("y"))


@query(_I + """ SELECT s.scene, s.agent_id, CASE WHEN h.scene_ts <= s.scene_ts THEN 'history' ELSE 'future' END AS part, count(*) AS n, round(max(3.6 * sqrt((h.vx - s.vx) * (h.vx - s.vx) + (h.vy - s.vy) * (h.vy - s.vy))), 6) AS top_kmh
FROM i JOIN states s USING (scene, agent_id, scene_ts) JOIN states h ON h.scene = s.scene AND h.agent_id = s.agent_id AND h.scene_ts BETWEEN s.scene_ts - 3 AND s.scene_ts + 3 GROUP BY ALL""")
def element_long_table(spark, d):
    rows = scenes.long_table(built(spark, d)).filter("part IN ('history', 'future')")
    return rows.groupBy("scene", "agent_id", "part").agg(F.count("*").alias("n"), r(F.max("speed_kmh")).alias("top_kmh"))


_NEAR = _I + f""", n AS (SELECT s.scene, s.agent_id, s.scene_ts, count(*) AS n FROM states s JOIN i USING (scene, agent_id, scene_ts) JOIN states n ON n.scene = s.scene AND n.scene_ts = s.scene_ts AND n.agent_id <> s.agent_id AND {dist('n', 's')} <= {RADIUS} GROUP BY ALL)"""


@query(_NEAR + " SELECT scene, agent_id, scene_ts, least(n, 5) AS n_neighbors FROM n WHERE n >= 2")
def elements_filtered(spark, d):
    flat = elements.flat_elements(scenes.kept_by(built(spark, d), F.size("neighbors") >= 2))
    return flat.select(*KEYS, "n_neighbors")


@query(_NEAR + " SELECT scene, agent_id, scene_ts FROM n WHERE n >= 2 ORDER BY scene, agent_id, scene_ts LIMIT 40")
def elements_first(spark, d):
    """The early stop of a filter: its limit is what it is for."""
    return scenes.kept_by(built(spark, d), F.size("neighbors") >= 2, 40, KEYS).select(*KEYS)


@query(_I + " SELECT scene, agent_id, scene_ts FROM i JOIN types USING (scene, agent_id) WHERE agent_type = 2")
def elements_of_type(spark, d):
    e = elements.agent_elements(index.agent_index(t.agents(spark, d), ELEMENT), t.typed(spark, d), ELEMENT)
    return scenes.kept_ids(scenes.of_agent_type(e, 2), index.agent_index(t.agents(spark, d), ELEMENT), *KEYS).select(*KEYS)


@query(_I + " SELECT CAST(floor(agent_id / 8) AS BIGINT) AS batch, count(*) AS n, max(scene_ts) AS latest FROM i GROUP BY ALL")
def custom_collated(spark, d):
    e = index.agent_index(t.agents(spark, d), ELEMENT)
    return scenes.custom_collate(e, "agent_id", 8, n=F.count("*"), latest=F.max("scene_ts"))


PREDICT = QuerySpec(dt=1.0, history=(1.0, 3.0), future=(1.0, 3.0), only_types=frozenset((1, 2)), only_predict=frozenset((2,)))


@query(f"""WITH {t.TRAJ}, {t.TYPES}, k AS (SELECT scene, agent_id, first_ts + 1 AS lo_ts, last_ts - 1 AS hi_ts FROM agents WHERE agent_type = 2 AND first_ts + 1 <= last_ts - 1)
SELECT *, CAST(coalesce(sum(hi_ts - lo_ts + 1) OVER (ORDER BY scene, agent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_ordinal FROM k""")
def ordinals_predicted(spark, d):
    return index.ordinals(t.agents(spark, d), PREDICT)


@query(f"WITH {t.TRAJ}, {t.TYPES} SELECT scene, agent_id, scene_ts FROM traj JOIN agents USING (scene, agent_id) WHERE scene_ts >= first_ts + 1 AND scene_ts <= last_ts - 1")
def rows_with_time(spark, d):
    rows = t.positions(spark, d).join(t.agents(spark, d).select("scene", "agent_id", "first_ts", "last_ts"), ["scene", "agent_id"])
    return rows.filter(index.timely(PREDICT)).select(*KEYS)


# States asked for, and turned as a whole.


@query(f"WITH {t.STATES}, a AS (SELECT scene, agent_id, min(scene_ts) + 2 AS scene_ts FROM states GROUP BY ALL) SELECT scene, agent_id, scene_ts, vx AS value FROM states JOIN a USING (scene, agent_id, scene_ts)")
def value_lookup(spark, d):
    s = t.states(spark, d)
    asked = s.groupBy("scene", "agent_id").agg((F.min("scene_ts") + 2).alias("scene_ts"))
    return lookup.value_of(s, asked, "vx")


_FRAMES = f"WITH {t.STATES}, f AS (SELECT s.* FROM states s JOIN (SELECT scene, min(agent_id) AS agent_id FROM states GROUP BY scene) USING (scene, agent_id) WHERE scene_ts = 5)"


def frames(spark, d):
    s = t.states(spark, d)
    return s.filter("scene_ts = 5").join(s.groupBy("scene").agg(F.min("agent_id").alias("agent_id")), ["scene", "agent_id"], "left_semi")


def _turned(s):
    return s.select(*KEYS, *(r(c).alias(c) for c in ("x", "y", "vx", "ay")), r(F.cos("heading")).alias("c"), r(F.sin("heading")).alias("s"))


_OX, _OY = back("s.x - f.x", "s.y - f.y", "f.heading")
_OVX, _ = back("s.vx - f.vx", "s.vy - f.vy", "f.heading")
_, _OAY = back("s.ax - f.ax", "s.ay - f.ay", "f.heading")
_OH = "round(cos(s.heading - f.heading), 6) AS c, round(sin(s.heading - f.heading), 6) AS s"


@query(_FRAMES + f" SELECT s.scene, s.agent_id, s.scene_ts, round({_OX}, 6) AS x, round({_OY}, 6) AS y, round({_OVX}, 6) AS vx, round({_OAY}, 6) AS ay, {_OH} FROM states s JOIN f USING (scene)")
def states_observed(spark, d):
    return _turned(lookup.observed(t.states(spark, d), frames(spark, d)))


_PX, _PY = back("s.x", "s.y", "f.heading")
_PVX, _ = back("s.vx", "s.vy", "f.heading")
_, _PAY = back("s.ax", "s.ay", "f.heading")


@query(_FRAMES + f" SELECT s.scene, s.agent_id, s.scene_ts, round({_PX} - f.x, 6) AS x, round({_PY} - f.y, 6) AS y, round({_PVX} - f.vx, 6) AS vx, round({_PAY} - f.ay, 6) AS ay, {_OH} FROM states s JOIN f USING (scene)")
def states_turned_first(spark, d):
    return _turned(lookup.observed(t.states(spark, d), frames(spark, d), moved_after=True))


@query(f"WITH {t.STATES} SELECT scene, agent_id, scene_ts, round(x, 6) AS x, round(y, 6) AS y, round(vx, 6) AS vx, round(ay, 6) AS ay, round(cos(heading), 6) AS c, round(sin(heading), 6) AS s FROM states")
def states_restored(spark, d):
    f = frames(spark, d)
    return _turned(lookup.restored(lookup.observed(t.states(spark, d), f), f))


@query(f"WITH {t.STATES} SELECT scene, agent_id, scene_ts, round(x * 2, 6) AS x, round(vx * cos(heading + 0.5) + vy * sin(heading + 0.5), 6) AS v_lon FROM states")
def elements_set(spark, d):
    s = lookup.with_elements(t.states(spark, d), x=F.col("x") * 2, h=F.col("heading") + 0.5)
    return as_format(s, "x,v_lon").select(*KEYS, r("x").alias("x"), r("v_lon").alias("v_lon"))


@query(f"WITH {t.STATES} SELECT scene, agent_id, scene_ts, round(0.5 * x + 2 * y + 3, 6) AS u, round(2 * x - y + 4, 6) AS v, round(sin(heading), 6) AS turn, round(x, 6) AS back_x FROM states")
def points_transformed(spark, d):
    s = t.states(spark, d)
    u, v = lookup.transform_points([F.col("x"), F.col("y")], [[0.5, 2.0, 3.0], [2.0, -1.0, 4.0], [0.0, 0.0, 1.0]])
    pose = [F.col(c) for c in ("x", "y", "heading")]
    there, home = lookup.world_from_frame(*pose), frame_matrix(*pose)
    # The place of the pose, into its frame and out of it again.
    seen = [home[i][0] * F.col("x") + home[i][1] * F.col("y") + home[i][2] for i in (0, 1)]
    return s.select(*KEYS, r(u).alias("u"), r(v).alias("v"), r(lookup.rotation(F.col("heading"))[1][0]).alias("turn"), r(there[0][0] * seen[0] + there[0][1] * seen[1] + there[0][2]).alias("back_x"))


@query(f"WITH {t.STATES} SELECT scene, agent_id, scene_ts, x AS px, y AS py, 1.5::DOUBLE AS pz, round(cos(heading), 6) AS hc, round(ax, 6) AS aax FROM states")
def named_properties(spark, d):
    s = named(t.states(spark, d).withColumn("z", F.lit(1.5)), "position3d", "heading_vector", "acceleration")
    place = F.col("position3d")
    return s.select(*KEYS, place[0].alias("px"), place[1].alias("py"), place[2].alias("pz"), r(F.col("heading_vector")[0]).alias("hc"), r(F.col("acceleration")[0]).alias("aax"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'test_condition' WHEN 1 THEN 'train' ELSE 'val' END AS split, CASE p_partkey % 2 WHEN 0 THEN 'usa' ELSE 'bulgaria' END AS country,
CASE p_partkey % 2 WHEN 0 THEN 'USA_Roundabout_FT' ELSE 'TestScenario_SR' END AS place, 'DR' AS first_part FROM part""")
def names_parsed(spark, d):
    k = F.col("p_partkey")
    split = F.when(k % 3 == 0, "test_condition").when(k % 3 == 1, "train").otherwise("val")
    place = F.when(k % 2 == 0, "DR_USA_Roundabout_FT").otherwise("DR_TestScenario_SR")
    rows = t.table(spark, d, "part").select(k.alias("id"), F.concat_ws("_", place, split, k.cast("string")).alias("name"))
    name = F.col("name")
    country, where = metadata.junction_place(name)
    return rows.select("id", metadata.junction_split(name).alias("split"), country.alias("country"), where.alias("place"), metadata.packed(name)[0].alias("first_part"))


# Stored tables.


@query(f"WITH {t.TRAJ} SELECT scene, agent_id AS lane_id, scene_ts * 2 AS scene_ts, CAST(y AS INTEGER) % 3 AS status FROM traj")
def lights_roundtrip(spark, d):
    path = new_path(spark)
    store.save_lights(lights(spark, d), path, "events", 0.5)
    store.save_lights(lights(spark, d).withColumn("status", F.lit(-1)), path, "events", 0.1)
    return store.read_lights(spark, path, "events", 0.5).select("scene", "lane_id", "scene_ts", "status")


@query("""SELECT c_name AS name, 'N-' || c_nationkey AS location, CASE c_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS data_split, CAST(c_custkey % 7 AS BIGINT) AS length_timesteps
FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 7 >= 2 AND c_custkey % 3 <> 2 AND (contains(lower(c_name), '1') OR contains(lower(c_name), '7'))""")
def scenes_roundtrip(spark, d):
    c = t.table(spark, d, "customer")
    split = F.when(F.col("c_custkey") % 3 == 0, "train").when(F.col("c_custkey") % 3 == 1, "val").otherwise("test")
    listed = c.select(F.col("c_mktsegment").alias("env"), F.col("c_name").alias("name"), F.concat(F.lit("N-"), F.col("c_nationkey").cast("string")).alias("location"), split.alias("data_split"), (F.col("c_custkey") % 7).cast("long").alias("length_timesteps"), F.col("c_name").alias("description"))
    path = new_path(spark)
    store.save_scenes(listed, path)
    return store.read_scenes(spark, path, "BUILDING", ["train-N", "val"], ["1", "7"], by_prefix=True).select("name", "location", "data_split", "length_timesteps")


@query(f"WITH {t.TRAJ} SELECT agent_id AS elem_id, count(*) AS n, sum(x) > 0 AS right_side FROM traj WHERE scene = 1 AND agent_id % 8 < 4 GROUP BY agent_id")
def map_roundtrip(spark, d):
    point = F.struct("seq", "x", "y", "z", "h")
    lanes = map_points(spark, d).groupBy("map_id", "elem_id").agg(F.array_sort(F.collect_list(point)).alias("center"))
    lanes = lanes.withColumn("elem_type", F.when(F.col("elem_id") % 8 < 4, 1).otherwise(2))
    path = new_path(spark)
    store.save_maps(lanes, path)
    total = F.aggregate("center", F.lit(0.0), lambda a, p: a + p["x"])
    return store.read_map(spark, path, 1, ("road_lane",)).select("elem_id", F.size("center").cast("long").alias("n"), (total > 0).alias("right_side"))


@query(_MAP + " SELECT place_id, elem_id, count(*) AS n, round(min(distance), 6) AS distance FROM pairs WHERE distance <= 0.4 GROUP BY ALL")
def stored_near(spark, d):
    path = new_path(spark)
    spatial.save_points(map_points(spark, d), path, file_points=2000)
    places = map_places(spark, d)
    return maps.lanes_counted(places, spatial.points_near(spark, path, places, 0.4), 0.4).withColumn("distance", r("distance"))


@query(_I + " SELECT scene, agent_id, scene_ts FROM i")
def index_stored(spark, d):
    path, asked = new_path(spark), {"history": 1, "future": 1, "types": [1, 2]}
    make = lambda: index.agent_index(t.agents(spark, d), ELEMENT)
    store.stored(spark, path, asked, make)
    return store.stored_elements(spark, path, asked, make, make(), KEYS)


@query(f"""WITH {t.TRAJ}, {t.TYPES}, n AS (SELECT *, lead(x) OVER w AS nx, lead(scene_ts) OVER w AS nt FROM traj WINDOW w AS {t.BY}),
e AS (SELECT *, unnest(generate_series(0, CASE WHEN nt IS NULL THEN 0 ELSE (nt - scene_ts) * 2 - 1 END)) AS i FROM n)
SELECT scene, agent_id, scene_ts * 2 + i AS scene_ts, round(CASE WHEN i = 0 THEN x ELSE x + (nx - x) * 0.5 END, 6) AS x, CAST(agent_type AS INTEGER) AS agent_type FROM e JOIN types USING (scene, agent_id)""")
def states_stored_resampled(spark, d):
    path = new_path(spark)
    sinks.save_states(t.typed(spark, d).drop("ts", "event_type"), path, "events", 1.0)
    return sinks.states_at(spark, path, "events", 1.0, 0.5).select(*KEYS, r("x").alias("x"), "agent_type")


# Simulation.

_STEP = f"""WITH {t.STATES}, {t.TYPES}, there AS (SELECT scene, agent_id FROM states WHERE scene_ts = 10),
past AS (SELECT s.* FROM states s JOIN there USING (scene, agent_id) WHERE scene_ts <= 10),
new AS (SELECT s.scene, s.agent_id, s.scene_ts, s.x + 1 AS x, s.x + 1 - p.x AS vx, s.x + 1 - p.x - p.vx AS ax FROM states s JOIN past p ON p.scene = s.scene AND p.agent_id = s.agent_id AND p.scene_ts = 10 WHERE s.scene_ts = 11),
run AS (SELECT scene, agent_id, scene_ts, x, vx, ax FROM past UNION ALL SELECT * FROM new)"""


def stepped(spark, d):
    s = t.typed(spark, d).withColumn("length", F.col("agent_id") * 0.5)
    actions = s.select(*KEYS, (F.col("x") + 1).alias("x"), "y", "heading")
    return simulation.step(simulation.snapshot(s, 10), actions, 10)


@query(_STEP + " SELECT scene, agent_id, scene_ts, round(x, 6) AS x, round(vx, 6) AS vx, round(ax, 6) AS ax, CAST(agent_type AS INTEGER) AS agent_type, agent_id * 0.5::DOUBLE AS length FROM run JOIN types USING (scene, agent_id)")
def simulation_step(spark, d):
    return stepped(spark, d).select(*KEYS, *(r(c).alias(c) for c in ("x", "vx", "ax")), "agent_type", "length")


@query(_STEP + """ SELECT scene, agent_id, scene_ts, least(4, (SELECT count(*) FROM run h WHERE h.scene = r.scene AND h.agent_id = r.agent_id)) AS history_len, CAST(0 AS BIGINT) AS future_len FROM run r WHERE scene_ts = 11""")
def simulation_observations(spark, d):
    return elements.flat_elements(simulation.observations(stepped(spark, d), 11, ELEMENT)).select(*KEYS, "history_len", "future_len")


def _side(side: str, rows: str) -> str:
    sql = bins_sql("sqrt(vx * vx + vy * vy)", EDGES).replace("FROM states", f"FROM {rows}").replace(", b AS (", "WITH b AS (", 1)
    return f"SELECT '{side}' AS side, q.* FROM ({sql}) q"


@query(f"WITH {t.STATES}, gt AS (SELECT * FROM states WHERE scene_ts BETWEEN 5 AND 40), sim AS (SELECT scene, vx * 2 AS vx, vy FROM gt WHERE scene_ts % 5 <> 4) {_side('gt', 'gt')} UNION ALL {_side('sim', 'sim')}")
def simulation_stats(spark, d):
    s = t.states(spark, d)
    sim = s.filter("scene_ts % 5 <> 4").withColumn("vx", F.col("vx") * 2)
    return simulation.stats(s, sim, metrics.speed(), EDGES, 5, 40, "scene")


_CENSUS = """SELECT a.scene, a.agent_type, count(DISTINCT s.agent_id) AS n_agents, count(*) AS n_rows, round(max(sqrt(s.vx * s.vx + s.vy * s.vy)), 6) AS top_speed
FROM states s JOIN agents a ON s.scene = a.scene AND s.agent_id = a.agent_id WHERE s.scene_ts BETWEEN 2 AND 30 GROUP BY a.scene, a.agent_type"""


@query(f"WITH {t.STATES}, {t.TYPES} SELECT scene, CAST(agent_type AS INTEGER) AS agent_type, n_agents, n_rows, top_speed FROM ({_CENSUS})")
def sql_census(spark, d):
    """The SQL surface: the same text runs here over the views and in the engine that it is compared with."""
    t.create_views(spark, d)
    return spark.sql(_CENSUS)


# Maps.


@query(f"""WITH {t.STATES}, p AS (SELECT s.scene, s.agent_id, s.x + 1.25 AS x, s.y - 0.75 AS y, s.heading AS h FROM states s JOIN (SELECT scene, agent_id, max(scene_ts) AS scene_ts FROM states GROUP BY ALL) USING (scene, agent_id, scene_ts)),
l AS (SELECT p.agent_id AS place_id, q.scene_ts AS seq, p.x - q.x AS dx, p.y - q.y AS dy, p.h, q.heading AS ph, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM p JOIN states q USING (scene, agent_id)),
n AS (SELECT place_id, arg_min(ph, (d, seq)) AS ph FROM l GROUP BY place_id)
SELECT place_id, seq, round(dx * cos(n.ph) + dy * sin(n.ph), 6) AS along, round(dy * cos(n.ph) - dx * sin(n.ph), 6) AS across, round(cos(l.h - n.ph), 6) AS turn_cos, round(sin(l.h - n.ph), 6) AS turn_sin FROM l JOIN n USING (place_id)""")
def relative_to_line(spark, d):
    s = t.states(spark, d)
    last = s.groupBy("scene", "agent_id").agg(F.max("scene_ts").alias("scene_ts"))
    places = s.join(last, list(KEYS), "left_semi").select(F.col("agent_id").alias("place_id"), F.col("scene").alias("map_id"), F.col("agent_id").alias("elem_id"), (F.col("x") + 1.25).alias("x"), (F.col("y") - 0.75).alias("y"), F.col("heading").alias("h"))
    out = maps.relative_to_line(places, map_points(spark, d))
    return out.select("place_id", "seq", r("along").alias("along"), r("across").alias("across"), r(F.cos("turn")).alias("turn_cos"), r(F.sin("turn")).alias("turn_sin"))


@query(f"""WITH {t.TRAJ}, s AS (SELECT *, sum(coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0)) OVER w AS s FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM traj WINDOW w AS {t.BY}) WINDOW w AS {t.BY}),
sh AS (SELECT scene, agent_id, scene_ts, x, y, s / max(s) OVER (PARTITION BY scene, agent_id) AS share, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM s WINDOW w AS {t.BY}),
g AS (SELECT *, lead(share) OVER w AS nshare FROM sh WINDOW w AS {t.BY}),
k AS (SELECT DISTINCT scene, agent_id, k, k / 15.0::DOUBLE AS place FROM traj, (SELECT unnest(generate_series(0, 15)) AS k)),
j AS (SELECT k.scene, k.agent_id, k.k, k.place, g.* EXCLUDE (scene, agent_id) FROM k ASOF JOIN g ON k.scene = g.scene AND k.agent_id = g.agent_id AND k.place >= g.share)
SELECT scene AS map_id, agent_id AS elem_id, CAST(k AS BIGINT) AS seq, round(CASE WHEN nshare > share THEN x + (nx - x) * (place - share) / (nshare - share) ELSE x END + 1e-9, 5) AS x, round(CASE WHEN nshare > share THEN y + (ny - y) * (place - share) / (nshare - share) ELSE y END + 1e-9, 5) AS y FROM j""")
def even_lines(spark, d):
    points = map_points(spark, d)
    counts = points.select("map_id", "elem_id").distinct().withColumn("n", F.lit(16))
    out = maps.even_points(points, counts, "map_id", "elem_id")
    return out.select("map_id", "elem_id", F.col("seq").cast("long").alias("seq"), F.round(F.col("x") + 1e-9, 5).alias("x"), F.round(F.col("y") + 1e-9, 5).alias("y"))


@query(f"""WITH {t.TRAJ}, a AS (SELECT *, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS after FROM traj WINDOW w AS {t.BY}), b AS (SELECT *, lag(after) OVER w AS before FROM a WINDOW w AS {t.BY}),
h AS (SELECT *, coalesce(atan2(sin(before) + sin(after), cos(before) + cos(after)), after, before, 0.0) AS h FROM b)
SELECT scene AS map_id, agent_id AS elem_id, scene_ts AS seq, round(cos(h), 5) + 0.0 AS c, round(abs(sin(h)), 5) + 0.0 AS s FROM h""")
def line_headings(spark, d):
    p = maps.with_headings(map_points(spark, d).drop("h"))
    return p.select("map_id", "elem_id", "seq", F.round(F.cos("h"), 5).alias("c"), F.round(F.abs(F.sin("h")), 5).alias("s"))


@query(f"""WITH {t.TRAJ}, e AS (SELECT scene, agent_id, arg_min(x, scene_ts) AS fx, arg_min(y, scene_ts) AS fy, arg_max(x, scene_ts) AS lx, arg_max(y, scene_ts) AS ly FROM traj GROUP BY scene, agent_id)
SELECT scene AS map_id, agent_id AS elem_id, sqrt(100 * 100 + (fy - 60) * (fy - 60)) <= sqrt((lx - fx + 100) * (lx - fx + 100) + (ly - 60) * (ly - 60)) AS same_way FROM e""")
def line_directions(spark, d):
    p = map_points(spark, d)
    first = maps.ends_of(p).select("map_id", "elem_id", F.lit(0).alias("seq"), (F.col("first.x") - 100).alias("x"), F.lit(60.0).alias("y"))
    return maps.runs_along(p, first)


@query(f"WITH {t.TRAJ} SELECT scene AS map_id, agent_id AS elem_id, scene_ts AS seq, x FROM (SELECT *, count(*) OVER (PARTITION BY scene, agent_id) AS n FROM traj) WHERE scene_ts = CAST(floor(n / 2) AS BIGINT)")
def line_midpoints(spark, d):
    return maps.midpoints(map_points(spark, d)).select("map_id", "elem_id", "seq", "x")


@query(f"""WITH {t.TRAJ}, a AS (SELECT DISTINCT scene AS map_id, agent_id AS elem_id FROM traj WHERE x > 50), b AS (SELECT DISTINCT scene AS map_id, agent_id AS elem_id FROM traj WHERE y > 90)
SELECT *, 'first' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'second' AS only_in FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def map_differences(spark, d):
    p = map_points(spark, d)
    return maps.differing_elements(p.filter("x > 50"), p.filter("y > 90"))


_LINKS = "links AS (SELECT r_regionkey AS elem_id, 'previous' AS kind, r_regionkey - 1 AS other FROM region WHERE r_regionkey > 0 UNION ALL SELECT r_regionkey, 'next', r_regionkey + 1 FROM region WHERE r_regionkey < 4 UNION ALL SELECT r_regionkey, 'left', (r_regionkey + 2) % 5 FROM region)"


@query(f"""WITH {_LINKS}, p AS (SELECT n_regionkey AS elem_id, n_nationkey AS piece_id FROM nation), e AS (SELECT elem_id, min(piece_id) AS f, max(piece_id) AS l FROM p GROUP BY elem_id)
SELECT m.f AS piece_id, kind, o.l AS other_id FROM links JOIN e m USING (elem_id) JOIN e o ON o.elem_id = other WHERE kind = 'previous'
UNION SELECT m.l, kind, o.f FROM links JOIN e m USING (elem_id) JOIN e o ON o.elem_id = other WHERE kind = 'next'
UNION SELECT p.piece_id, kind, q.piece_id FROM links JOIN p USING (elem_id) JOIN p q ON q.elem_id = other WHERE kind = 'left'
UNION SELECT piece_id, 'next', n FROM (SELECT piece_id, lead(piece_id) OVER (PARTITION BY elem_id ORDER BY piece_id) AS n FROM p) WHERE n IS NOT NULL
UNION SELECT n, 'previous', piece_id FROM (SELECT piece_id, lead(piece_id) OVER (PARTITION BY elem_id ORDER BY piece_id) AS n FROM p) WHERE n IS NOT NULL""")
def lanes_remapped(spark, d):
    g, n = t.table(spark, d, "region"), t.table(spark, d, "nation")
    link = lambda rows, kind, other: rows.select(F.col("r_regionkey").alias("elem_id"), F.lit(kind).alias("kind"), other.alias("other"))
    k = F.col("r_regionkey")
    links = link(g.filter("r_regionkey > 0"), "previous", k - 1).unionByName(link(g.filter("r_regionkey < 4"), "next", k + 1)).unionByName(link(g, "left", (k + 2) % 5))
    pieces = n.select(F.col("n_regionkey").alias("elem_id"), F.col("n_nationkey").alias("chunk"), F.col("n_nationkey").alias("piece_id"))
    return maps.remapped_lanes(links, pieces)


_FX, _FY = back("px - x", "py - y", "h")


@query(_MAP.replace("SELECT place_id, elem_id, seq, h, ph,", "SELECT place_id, elem_id, seq, h, ph, x, y, px, py,") + f" SELECT place_id, elem_id, seq, round({_FX}, 6) AS fx, round({_FY}, 6) AS fy FROM pairs WHERE {_FX} BETWEEN -1 AND 4 AND {_FY} BETWEEN -2 AND 2")
def map_long_table(spark, d):
    poses = map_places(spark, d).withColumnRenamed("h", "heading").drop("z")
    return scenes.map_long_table(map_points(spark, d), poses, (-1.0, 4.0, -2.0, 2.0)).select("place_id", "elem_id", "seq", r("fx").alias("fx"), r("fy").alias("fy"))

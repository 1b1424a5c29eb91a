"""The registered queries over trajectories, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import angles, formats
from ..operators import derive, elements, index, maps, metrics, neighbors, resample, simulation, vectors, windows
from ..scratch import new_path
from ..spec import QuerySpec
from ..streaming import events as event_windows
from . import trajectories as t
from .registry import ORACLES, QUERIES

KEYS = ("scene", "agent_id", "scene_ts")
DIGITS = 6


def query(sql: str, name: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = sql.replace(", 6) AS", ", 6) + 0.0 AS")  # Spark's round has no negative zero
        return f

    return register


def r(column: Column | str) -> Column:
    return F.round(column, DIGITS)


def dist(a: str, b: str) -> str:
    return f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


def back(x: str, y: str, h: str) -> tuple[str, str]:
    """SQL of a vector turned back by a heading."""
    return f"(({x}) * cos(-{h}) - ({y}) * sin(-{h}))", f"(({x}) * sin(-{h}) + ({y}) * cos(-{h}))"


# Agents and filters.


@query(f"WITH {t.TRAJ} SELECT scene, agent_id, min(scene_ts) AS first_ts, max(scene_ts) AS last_ts, count(*) AS n_rows FROM traj GROUP BY scene, agent_id")
def agent_span(spark, d):
    return derive.agents(t.positions(spark, d))


@query(f"WITH {t.TRAJ} SELECT scene, agent_id, arg_min(event_type, scene_ts) AS event_type FROM traj GROUP BY scene, agent_id")
def agent_first_class(spark, d):
    return derive.agents(t.positions(spark, d), "event_type").select("scene", "agent_id", "event_type")


@query(f"WITH {t.TRAJ}, {t.TYPES} SELECT scene, agent_id, CAST(agent_type AS INTEGER) AS agent_type FROM types")
def agent_mode_type(spark, d):
    return t.types(spark, d)


@query(f"WITH {t.HOURLY} SELECT scene, agent_id, count(*) AS n, max(scene_ts) - min(scene_ts) + 1 - count(*) AS n_missing FROM hourly GROUP BY scene, agent_id HAVING count(*) < max(scene_ts) - min(scene_ts) + 1")
def missing_frames(spark, d):
    return derive.missing_frames(derive.agents(t.hourly(spark, d))).select("scene", "agent_id", F.col("n_rows").alias("n"), "n_missing")


@query("WITH o AS (SELECT o_custkey % 4 AS scene, o_custkey AS agent_id, o_orderkey AS scene_ts, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT scene, agent_id, scene_ts FROM o WHERE n > 1")
def drop_single_detection(spark, d):
    rows = t.table(spark, d, "orders").select((F.col("o_custkey") % 4).alias("scene"), F.col("o_custkey").alias("agent_id"), F.col("o_orderkey").alias("scene_ts"))
    return derive.drop_single_detections(rows)


@query(f"WITH {t.TRAJ}, {t.TYPES} SELECT scene, scene_ts, count(*) AS n_agents FROM (SELECT scene, unnest(generate_series(first_ts, last_ts)) AS scene_ts FROM agents) GROUP BY scene, scene_ts")
def presence(spark, d):
    return derive.presence(t.agents(spark, d)).groupBy("scene", "scene_ts").agg(F.count("*").alias("n_agents"))


@query(f"WITH {t.TRAJ}, {t.TYPES} SELECT scene, agent_id, CAST(agent_type AS INTEGER) AS agent_type FROM agents WHERE agent_type IN (1, 2, 3) AND agent_type NOT IN (3)")
def type_filter(spark, d):
    return index.of_types(t.agents(spark, d), frozenset((1, 2, 3)), frozenset((3,))).select("scene", "agent_id", "agent_type")


INDEX = QuerySpec(dt=0.1, history=(0.3, 0.5), future=(0.2, 0.8), only_types=frozenset((1, 2)))
_INDEX_SQL = "SELECT scene, agent_id, unnest(generate_series(first_ts + 3, last_ts - 2)) AS scene_ts FROM agents WHERE agent_type IN (1, 2) AND first_ts + 3 <= last_ts - 2"


@query(f"WITH {t.TRAJ}, {t.TYPES} {_INDEX_SQL}")
def agent_index(spark, d):
    return index.agent_index(t.agents(spark, d), INDEX)


@query(f"WITH {t.TRAJ}, {t.TYPES} SELECT scene, count(*) AS n FROM ({_INDEX_SQL}) GROUP BY scene")
def agent_index_sizes(spark, d):
    return index.index_sizes(t.agents(spark, d), INDEX)


@query(f"""WITH {t.TRAJ}, {t.TYPES}, p AS (SELECT *, unnest(generate_series(first_ts, last_ts)) AS scene_ts FROM agents)
SELECT scene, scene_ts FROM p GROUP BY scene, scene_ts HAVING bool_or(agent_type IN (1, 2)) AND bool_or(agent_type <> 3) AND bool_or(scene_ts >= first_ts + 3 AND scene_ts <= last_ts - 2)""")
def scene_index(spark, d):
    return index.scene_index(t.agents(spark, d), QuerySpec(dt=0.1, history=(0.3, None), future=(0.2, None), only_types=frozenset((1, 2)), no_types=frozenset((3,))))


_WANTED = [0, 1, 17, 60, 61, 333, 700]


@query(f"""WITH {t.TRAJ}, {t.TYPES}, i AS (SELECT *, row_number() OVER (ORDER BY scene, agent_id, scene_ts) - 1 AS ordinal FROM ({_INDEX_SQL}))
SELECT scene, agent_id, scene_ts, ordinal FROM i WHERE ordinal IN ({", ".join(map(str, _WANTED))})""")
def ordinal_lookup(spark, d):
    return index.lookup(index.ordinals(t.agents(spark, d), INDEX), _WANTED)


@query(f"""WITH {t.TRAJ}, {t.TYPES}, i AS ({_INDEX_SQL}), lead AS (SELECT scene, min(agent_id) AS agent_id FROM i GROUP BY scene)
SELECT scene, scene_ts, count(*) AS n, min(agent_id) AS first_agent FROM i WHERE (scene, scene_ts) IN (SELECT (scene, scene_ts) FROM i JOIN lead USING (scene, agent_id)) GROUP BY scene, scene_ts""")
def time_batches(spark, d):
    return index.time_batches(index.agent_index(t.agents(spark, d), INDEX)).select("scene", "scene_ts", "n", F.col("agents")[0].alias("first_agent"))


_TAGS = "SELECT c_custkey AS scene, list_distinct(['env', lower(c_mktsegment), CASE WHEN c_nationkey % 2 = 0 THEN 'train' ELSE 'val' END]) AS tags, c_name AS description FROM customer"


@query(f"""WITH s AS ({_TAGS}) SELECT scene, 'env-train' AS wanted FROM s WHERE list_has_all(tags, ['env', 'train']) AND (contains(lower(description), '00') OR contains(lower(description), '7'))
UNION ALL SELECT scene, 'building' FROM s WHERE list_contains(tags, 'building') AND (contains(lower(description), '00') OR contains(lower(description), '7'))""")
def tag_match(spark, d):
    c = t.table(spark, d, "customer")
    tags = F.array(F.lit("env"), F.lower("c_mktsegment"), F.when(F.col("c_nationkey") % 2 == 0, "train").otherwise("val"))
    scenes = c.select(F.col("c_custkey").alias("scene"), tags.alias("tags"), F.col("c_name").alias("description"))
    return index.matching(scenes, ["env-train", "building"], ["00", "7"]).select("scene", "wanted")


# States.


@query(f"WITH {t.STATES} SELECT scene, agent_id, scene_ts, round(vx, 6) AS vx, round(vy, 6) AS vy, round(ax, 6) AS ax, round(ay, 6) AS ay, round(heading, 6) AS heading FROM states")
def velocities(spark, d):
    return t.states(spark, d).select(*KEYS, *(r(c).alias(c) for c in ("vx", "vy", "ax", "ay", "heading")))


@query(f"""WITH {t.STATES} SELECT scene, agent_id, scene_ts, round(x, 6) AS x, round(y, 6) AS y, round(vx * cos(heading) + vy * sin(heading), 6) AS v_lon,
round(cos(heading), 6) AS c, round(sin(heading), 6) AS s FROM states""")
def state_format(spark, d):
    return formats.as_format(t.states(spark, d), "x,y,v_lon,c,s").select(*KEYS, *(r(c).alias(c) for c in ("x", "y", "v_lon", "c", "s")))


@query("SELECT event_id, round(value + pi() - 2 * pi() * floor((value + pi()) / (2 * pi())) - pi(), 6) AS wrapped FROM events")
def angle_wrap(spark, d):
    return t.table(spark, d, "events").select("event_id", r(angles.wrap(F.col("value"))).alias("wrapped"))


_STEP = "heading - lag(heading) OVER w"
_WRAPPED = f"({_STEP} + pi() - 2 * pi() * floor(({_STEP} + pi()) / (2 * pi())) - pi())"


@query(f"""WITH {t.STATES}, s AS (SELECT *, coalesce({_WRAPPED}, 0.0) AS step FROM states WINDOW w AS {t.BY})
SELECT scene, agent_id, scene_ts, round(first_value(heading) OVER w + sum(step) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS heading_unwrapped FROM s WINDOW w AS {t.BY}""")
def heading_unwrap(spark, d):
    return derive.unwrap(t.states(spark, d), along=("vx", "vy")).select(*KEYS, r("heading_unwrapped").alias("heading_unwrapped"))


@query(f"""WITH {t.STATES}, s AS (SELECT *, coalesce(CASE WHEN sqrt(vx * vx + vy * vy) >= 20 THEN {_STEP} END, 0.0) AS step FROM states WINDOW w AS {t.BY})
SELECT scene, agent_id, scene_ts, round(first_value(heading) OVER w + sum(step) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS corrected FROM s WINDOW w AS {t.BY}""")
def yaw_correction(spark, d):
    return derive.correct_slow_yaw(t.states(spark, d), 20.0).select(*KEYS, r("corrected").alias("corrected"))


@query(f"""WITH {t.TRAJ}, e AS (SELECT scene, agent_id, arg_min(x, scene_ts) AS x0, arg_min(y, scene_ts) AS y0, arg_max(x, scene_ts) AS x1, arg_max(y, scene_ts) AS y1 FROM traj GROUP BY scene, agent_id)
SELECT scene, agent_id, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) < 900.0 AS stationary FROM e""")
def stationary(spark, d):
    return derive.stationary(t.positions(spark, d), 900.0)


@query(f"""WITH {t.TRAJ}, s AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0.0) AS step FROM traj WINDOW w AS {t.BY})
SELECT scene, agent_id, scene_ts, round(sum(step) OVER (PARTITION BY scene, agent_id ORDER BY scene_ts ROWS UNBOUNDED PRECEDING), 6) AS travelled FROM s""")
def arc_length(spark, d):
    return derive.arc_length(t.positions(spark, d)).select(*KEYS, r("travelled").alias("travelled"))


_FU, _FV = back("n.x - s.x", "n.y - s.y", "s.heading")


@query(f"""WITH {t.STATES} SELECT s.scene, s.agent_id, s.scene_ts, round({_FU}, 6) AS fx, round({_FV}, 6) AS fy, round(n.heading - s.heading, 6) AS fh
FROM states s JOIN states n ON s.scene = n.scene AND s.agent_id = n.agent_id AND n.scene_ts = s.scene_ts + 1""")
def frame_transform(spark, d):
    s = t.states(spark, d)
    n = s.select("scene", "agent_id", (F.col("scene_ts") - 1).alias("scene_ts"), *(F.col(c).alias(f"n_{c}") for c in ("x", "y", "heading")))
    u, v = angles.to_frame(F.col("n_x"), F.col("n_y"), F.col("x"), F.col("y"), F.col("heading"))
    return s.join(n, list(KEYS)).select(*KEYS, r(u).alias("fx"), r(v).alias("fy"), r(F.col("n_heading") - F.col("heading")).alias("fh"))


@query(f"""WITH {t.STATES} SELECT scene, agent_id, scene_ts, round(x + 2.15 * cos(heading) - 0.9 * sin(heading), 6) AS front_left_x, round(y + 2.15 * sin(heading) + 0.9 * cos(heading), 6) AS front_left_y FROM states""")
def box_corners(spark, d):
    s = t.states(spark, d)
    length, width = angles.drawn(F.lit(1), F.lit(None).cast("double"), F.lit(None).cast("double"))
    box = angles.corners(F.col("x"), F.col("y"), F.col("heading"), length, width)[0]
    return s.select(*KEYS, r(box["x"]).alias("front_left_x"), r(box["y"]).alias("front_left_y"))


# Windows.

WINDOWS = QuerySpec(dt=0.1, history=(None, 0.3), future=(None, 0.4))


@query(f"""WITH {t.TRAJ} SELECT scene, agent_id, scene_ts, count(*) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS history_len,
count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS future_len FROM traj WINDOW w AS {t.BY}""")
def window_lengths(spark, d):
    return windows.lengths(t.positions(spark, d), WINDOWS)


@query(f"""WITH {t.HOURLY} SELECT scene, agent_id, scene_ts, count(*) OVER (w RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS history_len,
count(*) OVER (w RANGE BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS future_len FROM hourly WINDOW w AS {t.BY}""")
def window_lengths_with_gaps(spark, d):
    return windows.lengths(t.hourly(spark, d), WINDOWS)


@query(f"""WITH {t.TRAJ} SELECT scene, agent_id, scene_ts, round(first_value(x) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS oldest_x,
round(last_value(x) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 6) AS latest_x, round(sum(x) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS history_sum FROM traj WINDOW w AS {t.BY}""")
def window_values(spark, d):
    s = windows.with_windows(t.positions(spark, d), WINDOWS, "x")
    total = F.aggregate("history", F.lit(0.0), lambda a, p: a + p["x"])
    return s.select(*KEYS, r(F.col("history")[0]["x"]).alias("oldest_x"), r(F.when(F.size("future") > 0, F.element_at("future", -1)["x"])).alias("latest_x"), r(total).alias("history_sum"))


# Neighbours.

RADIUS = 8.0
_PAIRS = f"SELECT a.scene, a.scene_ts, a.agent_id, b.agent_id AS neighbor, {dist('a', 'b')} AS distance FROM traj a JOIN traj b ON a.scene = b.scene AND a.scene_ts = b.scene_ts AND a.agent_id <> b.agent_id"


@query(f"WITH {t.TRAJ} SELECT scene, agent_id, scene_ts, count(*) AS n, round(min(distance), 6) AS nearest FROM ({_PAIRS}) WHERE distance <= {RADIUS} GROUP BY scene, agent_id, scene_ts")
def neighbors_radius(spark, d):
    s = t.positions(spark, d)
    pairs = neighbors.within(s, s, RADIUS)
    return pairs.groupBy("scene", F.col("t_agent_id").alias("agent_id"), "scene_ts").agg(F.count("*").alias("n"), r(F.min("distance")).alias("nearest"))


@query(f"""WITH {t.TRAJ}, k AS (SELECT *, row_number() OVER (PARTITION BY scene, agent_id, scene_ts ORDER BY distance, neighbor) AS rank FROM ({_PAIRS}) WHERE distance <= 25)
SELECT scene, agent_id, scene_ts, neighbor, rank, round(distance, 6) AS distance FROM k WHERE rank <= 3""")
def neighbors_topk(spark, d):
    s = t.positions(spark, d)
    return neighbors.nearest(s, s, 3, 25.0).select("scene", F.col("t_agent_id").alias("agent_id"), "scene_ts", F.col("n_agent_id").alias("neighbor"), F.col("rank").cast("long").alias("rank"), r("distance").alias("distance"))


RADII = {(2, 2): 3.0, (2, 1): 6.0, (1, 2): 6.0, (1, 1): 9.0}
_RADIUS_SQL = "CASE " + " ".join(f"WHEN {{n}} = {a} AND {{t}} = {b} THEN {x}" for (a, b), x in RADII.items()) + " ELSE 5.0 END"


@query(f"""WITH {t.TRAJ}, {t.TYPES}, p AS (SELECT q.*, ta.agent_type AS t, tb.agent_type AS n FROM ({_PAIRS}) q JOIN types ta ON q.scene = ta.scene AND q.agent_id = ta.agent_id JOIN types tb ON q.scene = tb.scene AND q.neighbor = tb.agent_id)
SELECT scene, agent_id, scene_ts, count(*) AS n FROM p WHERE distance <= {_RADIUS_SQL.format(n="n", t="t")} GROUP BY scene, agent_id, scene_ts""")
def neighbors_typed_radius(spark, d):
    s = t.typed(spark, d)
    pairs = neighbors.within_typed(s, s, RADII, 5.0)
    return pairs.groupBy("scene", F.col("t_agent_id").alias("agent_id"), "scene_ts").agg(F.count("*").alias("n"))


@query(f"""WITH {t.TRAJ}, {t.TYPES}, s AS (SELECT * FROM traj JOIN types USING (scene, agent_id)), c AS (SELECT scene, scene_ts, min(agent_id) AS agent_id FROM s GROUP BY scene, scene_ts),
m AS (SELECT s.* FROM s JOIN c USING (scene, scene_ts, agent_id)),
p AS (SELECT m.scene, m.scene_ts, n.agent_id, {dist('m', 'n')} AS distance, n.agent_type AS nt, m.agent_type AS mt FROM m JOIN s n ON m.scene = n.scene AND m.scene_ts = n.scene_ts),
q AS (SELECT *, row_number() OVER (PARTITION BY scene, scene_ts ORDER BY distance, agent_id) AS rank, sum(CASE WHEN distance <= {_RADIUS_SQL.format(n="nt", t="mt")} THEN 1 ELSE 0 END) OVER (PARTITION BY scene, scene_ts) AS n FROM p)
SELECT scene, scene_ts, agent_id, rank FROM q WHERE rank <= n""")
def neighbors_scene_centric(spark, d):
    s = t.typed(spark, d)
    centers = s.join(s.groupBy("scene", "scene_ts").agg(F.min("agent_id").alias("agent_id")), list(KEYS), "left_semi")
    return neighbors.around_center(s, centers, RADII, 5.0).select("scene", "scene_ts", F.col("n_agent_id").alias("agent_id"), F.col("rank").cast("long").alias("rank"))


# Elements.

ELEMENT = QuerySpec(dt=1.0, history=(1.0, 3.0), future=(1.0, 3.0), only_types=frozenset((1, 2)), default_radius=RADIUS, max_neighbors=5)
_SX, _SY = back("a.x - s.x", "a.y - s.y", "s.heading")
_EX, _EY = back("b.x - s.x", "b.y - s.y", "s.heading")
_NX, _ = back("n.x - s.x", "n.y - s.y", "s.heading")
_ELEMENT_SQL = f"""WITH {t.STATES}, {t.TYPES},
i AS (SELECT scene, agent_id, unnest(generate_series(first_ts + 1, last_ts - 1)) AS scene_ts, first_ts, last_ts FROM agents WHERE agent_type IN (1, 2) AND first_ts + 1 <= last_ts - 1),
own AS (SELECT s.scene, s.agent_id, s.scene_ts, s.scene_ts - greatest(first_ts, s.scene_ts - 3) + 1 AS history_len, least(last_ts, s.scene_ts + 3) - s.scene_ts AS future_len,
  round({_SX}, 6) AS start_x, round({_SY}, 6) AS start_y, round({_EX}, 6) AS end_x, round({_EY}, 6) AS end_y
  FROM states s JOIN i USING (scene, agent_id, scene_ts)
  JOIN states a ON a.scene = s.scene AND a.agent_id = s.agent_id AND a.scene_ts = greatest(first_ts, s.scene_ts - 3)
  JOIN states b ON b.scene = s.scene AND b.agent_id = s.agent_id AND b.scene_ts = least(last_ts, s.scene_ts + 3)),
p AS (SELECT s.scene, s.agent_id, s.scene_ts, n.agent_id AS neighbor, {dist('n', 's')} AS distance, {_NX} AS nx
  FROM states s JOIN i USING (scene, agent_id, scene_ts) JOIN states n ON n.scene = s.scene AND n.scene_ts = s.scene_ts AND n.agent_id <> s.agent_id),
k AS (SELECT *, row_number() OVER (PARTITION BY scene, agent_id, scene_ts ORDER BY distance, neighbor) AS rank FROM p WHERE distance <= {RADIUS}),
g AS (SELECT scene, agent_id, scene_ts, count(*) AS n, arg_min(neighbor, rank) AS nearest, round(min(distance), 6) AS nearest_distance, round(arg_min(nx, rank), 6) AS nearest_x FROM k WHERE rank <= 5 GROUP BY ALL)
SELECT own.*, coalesce(n, 0) AS n_neighbors, nearest, nearest_distance, nearest_x FROM own LEFT JOIN g USING (scene, agent_id, scene_ts)"""


def built(spark: SparkSession, d: str) -> DataFrame:
    return elements.agent_elements(index.agent_index(t.agents(spark, d), ELEMENT), t.typed(spark, d), ELEMENT)


@query(_ELEMENT_SQL)
def element_flat(spark, d):
    flat = elements.flat_elements(built(spark, d))
    return flat.select(*(r(c).alias(c) if k == "double" else c for c, k in flat.dtypes))


@query(f"""WITH {t.TRAJ}, {t.TYPES}, i AS (SELECT scene, agent_id, unnest(generate_series(first_ts + 1, last_ts - 1)) AS scene_ts, first_ts, last_ts FROM agents WHERE agent_type IN (1, 2) AND first_ts + 1 <= last_ts - 1),
l AS (SELECT *, agent_id * 4 AS o, scene_ts - greatest(first_ts, scene_ts - 3) + 1 AS h, least(last_ts, scene_ts + 3) - scene_ts AS f FROM i)
SELECT scene, agent_id, scene_ts, CAST(floor(o / 64) AS BIGINT) AS batch, h AS history_len, f AS future_len, greatest(max(h) OVER (PARTITION BY floor(o / 64)), 2) AS padded_history, greatest(max(f) OVER (PARTITION BY floor(o / 64)), 1) AS padded_future FROM l""")
def collated(spark, d):
    spec = QuerySpec(dt=1.0, history=(1.0, 3.0), future=(1.0, 3.0), only_types=frozenset((1, 2)))
    s = windows.with_windows(t.positions(spark, d), spec, "x").join(index.agent_index(t.agents(spark, d), spec), list(KEYS), "left_semi")
    out = elements.collate(s.withColumn("o", F.col("agent_id") * 4), "o", 64, spec)
    return out.select(*KEYS, "batch", *(F.col(c).cast("long").alias(c) for c in ("history_len", "future_len")), F.size("history").cast("long").alias("padded_history"), F.size("future").cast("long").alias("padded_future"))


# Resampling.


@query(f"""WITH {t.TRAJ}, n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(scene_ts) OVER w AS nt FROM traj WINDOW w AS {t.BY}),
e AS (SELECT *, unnest(generate_series(0, CASE WHEN nt IS NULL THEN 0 ELSE (nt - scene_ts) * 3 - 1 END)) AS i FROM n)
SELECT scene, agent_id, scene_ts * 3 + i AS scene_ts, round(CASE WHEN i = 0 THEN x ELSE x + (nx - x) * (i / 3.0::DOUBLE) END, 6) AS x, round(CASE WHEN i = 0 THEN y ELSE y + (ny - y) * (i / 3.0::DOUBLE) END, 6) AS y FROM e""")
def upsample(spark, d):
    return resample.upsample(t.positions(spark, d), 3, ("x", "y")).select(*KEYS, r("x").alias("x"), r("y").alias("y"))


@query(f"WITH {t.TRAJ} SELECT scene, agent_id, CAST(scene_ts / 4 AS BIGINT) AS scene_ts, x FROM traj WHERE scene_ts % 4 = 0")
def downsample(spark, d):
    return resample.downsample(t.positions(spark, d), 4).select(*KEYS, "x")


@query(f"""WITH {t.HOURLY}, n AS (SELECT *, lead(x) OVER w AS nx, lead(scene_ts) OVER w AS nt FROM hourly WINDOW w AS {t.BY}),
e AS (SELECT *, unnest(generate_series(0, coalesce(nt - scene_ts, 1) - 1)) AS i FROM n)
SELECT scene, agent_id, scene_ts + i AS scene_ts, round(CASE WHEN i = 0 THEN x ELSE x + (nx - x) * (CAST(i AS DOUBLE) / (nt - scene_ts)) END + 1e-9, 6) AS x, i > 0 AS filled FROM e""")
def gap_fill(spark, d):
    # Shares of an hour often end in a 5 at the seventh digit; a little more keeps both engines on one side of it.
    return derive.fill_gaps(t.hourly(spark, d), "x").select(*KEYS, r(F.col("x") + 1e-9).alias("x"), "filled")


_LIGHTS = f"WITH {t.TRAJ}, lights AS (SELECT scene, agent_id AS lane_id, scene_ts * 2 AS scene_ts, CAST(y AS INTEGER) % 3 AS status FROM traj)"


def lights(spark, d):
    return t.positions(spark, d).select("scene", F.col("agent_id").alias("lane_id"), (F.col("scene_ts") * 2).alias("scene_ts"), (F.col("y").cast("int") % 3).alias("status"))


@query(_LIGHTS + """, n AS (SELECT *, lead(status) OVER w AS ns, lead(scene_ts) OVER w AS nt FROM lights WINDOW w AS (PARTITION BY scene, lane_id ORDER BY scene_ts)),
e AS (SELECT *, unnest(generate_series(0, coalesce((nt - scene_ts) * 2, 1) - 1)) AS i FROM n)
SELECT scene, lane_id, scene_ts * 2 + i AS scene_ts, CASE WHEN i > nt - scene_ts THEN ns ELSE status END AS status FROM e""")
def status_upsample(spark, d):
    return resample.upsample_status(lights(spark, d), 2)


@query(_LIGHTS + """, k AS (SELECT *, row_number() OVER (PARTITION BY scene, lane_id ORDER BY scene_ts) - 1 AS i FROM lights)
SELECT scene, lane_id, CAST(floor(scene_ts / 3) AS BIGINT) AS scene_ts, status FROM k WHERE i % 3 = 0""")
def status_downsample(spark, d):
    return resample.downsample_status(lights(spark, d), 3)


@query(_LIGHTS + """ SELECT t.scene, t.agent_id AS lane_id, t.scene_ts, coalesce(l.status, -1) AS status FROM traj t LEFT JOIN lights l ON t.scene = l.scene AND t.agent_id = l.lane_id AND t.scene_ts = l.scene_ts""")
def status_default(spark, d):
    asked = t.positions(spark, d).select("scene", F.col("agent_id").alias("lane_id"), "scene_ts")
    return maps.light_status(asked, lights(spark, d)).select("scene", "lane_id", "scene_ts", "status")


@query(f"WITH {t.TRAJ}, {t.TYPES} SELECT scene, agent_id, CAST(ceil(first_ts / 3.0) AS BIGINT) AS first_ts, CAST(floor(last_ts / 3.0) AS BIGINT) AS last_ts FROM agents WHERE ceil(first_ts / 3.0) <= floor(last_ts / 3.0)")
def resampled_agents(spark, d):
    return resample.resample_agents(t.agents(spark, d), -3).select("scene", "agent_id", "first_ts", "last_ts")


@query(f"WITH {t.TRAJ} SELECT scene, max(scene_ts) // 3 + 1 AS length_timesteps, 3.0::DOUBLE AS dt FROM traj GROUP BY scene")
def resampled_scenes(spark, d):
    scenes = t.positions(spark, d).groupBy("scene").agg((F.max("scene_ts") + 1).alias("length_timesteps"), F.lit(1.0).alias("dt"))
    return resample.resample_scenes(scenes, -3)


# Metrics and simulation.

_SIM = "sim AS (SELECT scene, agent_id, scene_ts, x + scene_ts * 0.25 AS x, y - 1.5 AS y FROM traj WHERE scene_ts % 5 <> 4)"
_ERRORS = f"errors AS (SELECT t.scene, t.agent_id, t.scene_ts, {dist('t', 's')} AS error FROM traj t JOIN sim s ON t.scene = s.scene AND t.agent_id = s.agent_id AND t.scene_ts = s.scene_ts WHERE t.scene_ts BETWEEN 5 AND 40)"


def simulated(spark, d):
    return t.positions(spark, d).filter("scene_ts % 5 <> 4").select(*KEYS, (F.col("x") + F.col("scene_ts") * 0.25).alias("x"), (F.col("y") - 1.5).alias("y"))


@query(f"WITH {t.TRAJ}, {_SIM}, {_ERRORS} SELECT scene, agent_id, round(avg(error), 6) AS ade, round(arg_max(error, scene_ts), 6) AS fde FROM errors GROUP BY scene, agent_id")
def displacement_errors(spark, d):
    return simulation.metrics(t.positions(spark, d), simulated(spark, d), 5, 40).select("scene", "agent_id", r("ade").alias("ade"), r("fde").alias("fde"))


EDGES = [0.0, 5.0, 10.0, 25.0, 50.0, 100.0, 400.0]
SIGNED = [-400.0, -50.0, -10.0, 0.0, 10.0, 50.0, 400.0]


def bins_sql(value: str, edges: list[float]) -> str:
    n = len(edges) - 1
    cases = " ".join(f"WHEN v >= {edges[k]} AND v {'<=' if k == n - 1 else '<'} {edges[k + 1]} THEN {k}" for k in range(n))
    rows = ", ".join(f"({k}::BIGINT, {edges[k]}::DOUBLE, {edges[k + 1]}::DOUBLE)" for k in range(n))
    return f""", b AS (SELECT scene, CASE {cases} END AS bin, count(*) AS n FROM (SELECT scene, {value} AS v FROM states) GROUP BY ALL)
SELECT s.scene, e.bin, e.low, e.high, coalesce(b.n, 0) AS n FROM (SELECT DISTINCT scene FROM states) s CROSS JOIN (VALUES {rows}) e(bin, low, high) LEFT JOIN b ON b.scene = s.scene AND b.bin = e.bin"""


@query(f"WITH {t.STATES} {bins_sql('sqrt(vx * vx + vy * vy)', EDGES)}")
def histogram_speed(spark, d):
    return metrics.histogram(t.states(spark, d), metrics.speed(), EDGES, "scene")


@query(f"WITH {t.STATES} {bins_sql('sqrt(ax * ax + ay * ay) * cos(heading)', SIGNED)}")
def histogram_longitudinal(spark, d):
    return metrics.histogram(t.states(spark, d), metrics.longitudinal_acceleration(), SIGNED, "scene")


@query(f"WITH {t.STATES} {bins_sql('sqrt(ax * ax + ay * ay) * sin(heading)', SIGNED)}")
def histogram_lateral(spark, d):
    return metrics.histogram(t.states(spark, d), metrics.lateral_acceleration(), SIGNED, "scene")


@query(f"""WITH {t.STATES.replace('states AS (', 'base AS (')}, states AS (SELECT scene, coalesce(a - lag(a) OVER w, lead(a) OVER w - a) AS jerk FROM (SELECT *, sqrt(ax * ax + ay * ay) AS a FROM base) WINDOW w AS {t.BY}) {bins_sql('jerk', SIGNED)}""")
def histogram_jerk(spark, d):
    return metrics.histogram(metrics.with_jerk(t.states(spark, d)), F.col("jerk"), SIGNED, "scene")


@query(f"""WITH {t.STATES}, there AS (SELECT scene, agent_id FROM states WHERE scene_ts = 10),
m AS (SELECT scene, agent_id, scene_ts, x + 1 AS x, y * 2 AS y, heading FROM states WHERE scene_ts > 10 AND (scene, agent_id) IN (SELECT (scene, agent_id) FROM there)),
rows_ AS (SELECT scene, agent_id, scene_ts, x, y, heading, vx, vy FROM states WHERE scene_ts = 10 UNION ALL SELECT scene, agent_id, scene_ts, x, y, heading, NULL, NULL FROM m),
v AS (SELECT * EXCLUDE (vx, vy), CASE WHEN scene_ts = 10 THEN vx ELSE x - lag(x) OVER w END AS vx, CASE WHEN scene_ts = 10 THEN vy ELSE y - lag(y) OVER w END AS vy FROM rows_ WINDOW w AS {t.BY}),
a AS (SELECT *, vx - lag(vx) OVER w AS ax, vy - lag(vy) OVER w AS ay FROM v WINDOW w AS {t.BY})
SELECT scene, agent_id, scene_ts, round(x, 6) AS x, round(y, 6) AS y, round(vx, 6) AS vx, round(vy, 6) AS vy, round(ax, 6) AS ax, round(ay, 6) AS ay FROM a WHERE scene_ts > 10""")
def simulation_run(spark, d):
    s = t.states(spark, d)
    actions = s.select(*KEYS, (F.col("x") + 1).alias("x"), (F.col("y") * 2).alias("y"), "heading")
    return simulation.run(simulation.snapshot(s, 10), actions, 10).select(*KEYS, *(r(c).alias(c) for c in ("x", "y", "vx", "vy", "ax", "ay")))


# Maps. A scene is a map, its tracks stand for lanes, and every state asks from a place beside its own.

_MAP = f"""WITH {t.STATES}, points AS (SELECT scene, agent_id AS elem_id, scene_ts AS seq, x AS px, y AS py, heading AS ph FROM states),
places AS (SELECT scene, agent_id * 4294967296 + scene_ts AS place_id, x + 1.25 AS x, y - 0.75 AS y, heading AS h FROM states),
pairs AS (SELECT place_id, elem_id, seq, h, ph, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS distance FROM places JOIN points USING (scene))"""


def map_points(spark, d):
    p = t.states(spark, d)
    return p.select(F.col("scene").alias("map_id"), F.col("agent_id").alias("elem_id"), F.col("scene_ts").alias("seq"), "x", "y", F.lit(0.0).alias("z"), F.col("heading").alias("h"))


def map_places(spark, d, x="x + 1.25D"):
    p = t.states(spark, d)
    return p.select((F.col("agent_id") * 4294967296 + F.col("scene_ts")).alias("place_id"), F.col("scene").alias("map_id"), F.expr(x).alias("x"), (F.col("y") - 0.75).alias("y"), F.lit(0.0).alias("z"), F.col("heading").alias("h"))


@query(_MAP + " SELECT DISTINCT place_id, elem_id FROM pairs WHERE distance <= 1.5")
def lanes_within(spark, d):
    return maps.lanes_within(map_places(spark, d), map_points(spark, d), 1.5)


@query(_MAP + " SELECT place_id, m.elem_id, round(m.distance, 6) AS distance FROM (SELECT place_id, min({'distance': distance, 'elem_id': elem_id}) AS m FROM pairs GROUP BY place_id)")
def nearest_lane(spark, d):
    return maps.nearest_lane(map_places(spark, d), map_points(spark, d)).select("place_id", "elem_id", r("distance").alias("distance"))


@query(_MAP.replace("x + 1.25 AS x", "x * 1.5 AS x") + """ SELECT place_id, m.elem_id, round(m.distance, 6) AS distance
FROM (SELECT place_id, min({'distance': distance, 'elem_id': elem_id}) AS m FROM pairs GROUP BY place_id) WHERE m.distance < 20""")
def nearest_lane_within(spark, d):
    """Signs stand half as far out again as the map; each belongs to the nearest lane if that is nearer than 20."""
    signs = map_places(spark, d, "x * 1.5D")
    return maps.nearest_lane(signs, map_points(spark, d), within=20.0).select("place_id", "elem_id", r("distance").alias("distance"))


_TURN = "abs((h - ph + pi()) - floor((h - ph + pi()) / (2 * pi())) * 2 * pi() - pi())"


@query(_MAP + f""", k AS (SELECT place_id, elem_id, distance, {_TURN} AS turn FROM pairs WHERE distance <= 6.0),
c AS (SELECT place_id, elem_id, min(distance + 0.1 * turn) AS cost FROM k WHERE turn < pi() / 8 GROUP BY ALL)
SELECT place_id, elem_id, round(cost, 6) AS cost, row_number() OVER (PARTITION BY place_id ORDER BY cost, elem_id) AS rank FROM c""")
def current_lane(spark, d):
    return maps.current_lane(map_places(spark, d), map_points(spark, d), 6.0).select("place_id", "elem_id", r("cost").alias("cost"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {t.TRAJ}, e AS (SELECT agent_id AS elem_id, scene_ts AS seq, CAST(trunc((x - lag(x, 1, 0.0) OVER w) * 1000) AS INTEGER) AS dx, CAST(trunc((y - lag(y, 1, 0.0) OVER w) * 1000) AS INTEGER) AS dy FROM traj WINDOW w AS {t.BY})
SELECT elem_id, seq, CAST(sum(dx) OVER w AS DOUBLE) / 1000 AS x, CAST(sum(dy) OVER w AS DOUBLE) / 1000 AS y FROM e WINDOW w AS (PARTITION BY elem_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def delta_codec(spark, d):
    return maps.decode(maps.encode(map_points(spark, d))).select("elem_id", "seq", "x", "y")


_EDGES_SQL = "edges AS (SELECT DISTINCT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT DISTINCT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def lane_edges(spark, d):
    n, s = t.table(spark, d, "nation"), t.table(spark, d, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    up = n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    return up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(s.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))).distinct()


@query(f"""WITH RECURSIVE {_EDGES_SQL}, w AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS node, 0 AS hop FROM supplier
UNION SELECT w.start, edges.dst, w.hop + 1 FROM w JOIN edges ON w.node = edges.src WHERE w.hop < 3)
SELECT start, node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY start, node""")
def lane_graph(spark, d):
    s = t.table(spark, d, "supplier")
    return maps.reachable(lane_edges(spark, d), s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node")), 3)


@query("""SELECT DISTINCT a.l_partkey AS elem_id, b.l_partkey AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey""")
def shared_borders(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_partkey").alias("elem_id"), F.col("l_orderkey").alias("border_id"))
    return maps.adjacent_by_border(rows)


# The same with one map for all scenes, where every state asks from its own place.

_MAP_ALL = f"""WITH {t.TRAJ}, points AS (SELECT agent_id AS elem_id, scene_ts AS seq, x AS px, y AS py FROM traj),
places AS (SELECT agent_id * 4294967296 + scene_ts AS place_id, x, y FROM traj),
pairs AS (SELECT place_id, elem_id, seq, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS distance FROM places CROSS JOIN points)"""


def all_points(spark, d):
    p = t.positions(spark, d)
    return p.select(F.lit("m").alias("map_id"), F.col("agent_id").alias("elem_id"), F.col("scene_ts").alias("seq"), "x", "y", F.lit(0.0).alias("z"), F.lit(0.0).alias("h"))


def all_places(spark, d):
    p = t.positions(spark, d)
    return p.select((F.col("agent_id") * 4294967296 + F.col("scene_ts")).alias("place_id"), F.lit("m").alias("map_id"), "x", "y", F.lit(0.0).alias("z"), F.lit(0.0).alias("h"))


@query(_MAP_ALL + " SELECT DISTINCT place_id, elem_id FROM pairs WHERE distance <= 1.5")
def lanes_within_all(spark, d):
    return maps.lanes_within(all_places(spark, d), all_points(spark, d), 1.5)


@query(_MAP_ALL + " SELECT place_id, m.elem_id, round(m.distance, 6) AS distance FROM (SELECT place_id, min({'distance': distance, 'elem_id': elem_id}) AS m FROM pairs GROUP BY place_id)")
def nearest_lane_all(spark, d):
    return maps.nearest_lane(all_places(spark, d), all_points(spark, d)).select("place_id", "elem_id", r("distance").alias("distance"))


@query(_MAP_ALL + """, c AS (SELECT place_id, elem_id, min(distance) AS cost FROM pairs WHERE distance <= 2.0 GROUP BY ALL)
SELECT place_id, elem_id, round(cost, 6) AS cost, row_number() OVER (PARTITION BY place_id ORDER BY cost, elem_id) AS rank FROM c""")
def current_lane_all(spark, d):
    return maps.current_lane(all_places(spark, d), all_points(spark, d)).select("place_id", "elem_id", r("cost").alias("cost"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {t.TRAJ}, e AS (SELECT agent_id AS elem_id, scene_ts AS seq, CAST(trunc((x - lag(x, 1, 0.0) OVER w) * 1000) AS INTEGER) AS dx, CAST(trunc((y - lag(y, 1, 0.0) OVER w) * 1000) AS INTEGER) AS dy FROM traj WINDOW w AS {t.BY})
SELECT elem_id, seq, CAST(sum(dx) OVER w AS DOUBLE) / 1000 AS x, CAST(sum(dy) OVER w AS DOUBLE) / 1000 AS y FROM e WINDOW w AS (PARTITION BY elem_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def delta_codec_all(spark, d):
    return maps.decode(maps.encode(all_points(spark, d))).select("elem_id", "seq", "x", "y")


@query(f"""WITH RECURSIVE {_EDGES_SQL}, w AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS node, 0 AS hop FROM supplier
UNION SELECT w.start, edges.dst, w.hop + 1 FROM w JOIN edges ON w.node = edges.src WHERE w.hop < 3)
SELECT start, node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY start, node""")
def lane_graph_all(spark, d):
    starts = t.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return maps.reachable(lane_edges(spark, d), starts, 3)


@query("""SELECT DISTINCT a.l_partkey AS elem_id, b.l_partkey AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey""")
def shared_borders_all(spark, d):
    return maps.adjacent_by_border(t.table(spark, d, "lineitem").select(F.col("l_partkey").alias("elem_id"), F.col("l_orderkey").alias("border_id")))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT query_id, vec_id, list_distance(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS distance FROM q CROSS JOIN embeddings WHERE vec_id <> query_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM k WHERE rank <= 5""")
def knn_embeddings(spark, d):
    e = t.table(spark, d, "embeddings")
    return vectors.nearest(e, e.filter("vec_id % 100 = 0"), 5).select("query_id", "vec_id", r("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


# Set operations, aggregates, event-time windows.


@query(f"WITH {t.TRAJ} SELECT scene, agent_id FROM traj WHERE scene_ts = 3 INTERSECT SELECT scene, agent_id FROM traj WHERE x > 100")
def index_intersect(spark, d):
    p = t.positions(spark, d)
    return p.filter("scene_ts = 3").select("scene", "agent_id").intersect(p.filter("x > 100").select("scene", "agent_id"))


@query(f"WITH {t.TRAJ} SELECT scene, agent_id FROM traj EXCEPT SELECT scene, agent_id FROM traj WHERE x > 200")
def index_except(spark, d):
    p = t.positions(spark, d)
    return p.select("scene", "agent_id").subtract(p.filter("x > 200").select("scene", "agent_id"))


@query(f"""WITH {t.TRAJ} SELECT scene, agent_id, scene_ts, x FROM traj WHERE scene_ts <> 7 UNION ALL SELECT scene, agent_id, scene_ts, x + 1 FROM traj WHERE scene_ts = 7 AND agent_id % 2 = 0""")
def replace_timestep(spark, d):
    p = t.positions(spark, d).select(*KEYS, "x")
    return p.filter("scene_ts <> 7").unionByName(p.filter("scene_ts = 7 AND agent_id % 2 = 0").withColumn("x", F.col("x") + 1))


@query(f"WITH {t.TRAJ}, {t.TYPES} SELECT scene, CAST(agent_type AS INTEGER) AS agent_type, count(*) AS n, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM agents GROUP BY ROLLUP (scene, agent_type)")
def rollup_sizes(spark, d):
    return t.agents(spark, d).rollup("scene", "agent_type").agg(F.count("*").alias("n"), F.sum("n_rows").alias("n_rows"))


@query(f"WITH {t.TRAJ}, {t.TYPES} SELECT CAST(agent_type AS INTEGER) AS agent_type, count(*) AS n, min(agent_id) AS example FROM agents GROUP BY agent_type")
def type_census(spark, d):
    return t.agents(spark, d).groupBy("agent_type").agg(F.count("*").alias("n"), F.min("agent_id").alias("example"))


@query(f"WITH {t.TRAJ} SELECT scene, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM traj GROUP BY scene")
def scene_extent(spark, d):
    p = t.positions(spark, d).select(F.col("scene").alias("map_id"), "x", "y", F.lit(0.0).alias("z"))
    return maps.extent(p).select(F.col("map_id").alias("scene"), "min_x", "max_x", "min_y", "max_y")


@query("""SELECT user_id, CAST(epoch(time_bucket(INTERVAL 6 HOURS, ts)) AS BIGINT) AS start_s, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark, d):
    e = t.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return event_windows.counted(e, "6 hours", by=("user_id",)).select("user_id", F.unix_timestamp("start").alias("start_s"), "n", r("total").alias("total"))


@query("""WITH e AS (SELECT *, CAST(epoch(time_bucket(INTERVAL 1 HOURS, ts)) AS BIGINT) AS h FROM events)
SELECT start_s, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT value, unnest([h - 7200, h - 3600, h]) AS start_s FROM e) GROUP BY start_s""")
def sliding_windows(spark, d):
    e = t.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return event_windows.counted(e, "3 hours", "1 hour").select(F.unix_timestamp("start").alias("start_s"), "n", r("total").alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 4 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    e = t.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return event_windows.sessions(e, "4 hours").select("user_id", F.unix_timestamp("start").alias("start_s"), "n")


@query("""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL), m AS (SELECT max(us) // 1000 * 1000 - 3600000000 AS mark FROM e),
f AS (SELECT e.*, coalesce(lag(event_type) OVER w = 'purchase', false) OR coalesce(us - lag(us) OVER w > 14400000000, true) AS fresh FROM e, m WHERE us <= mark WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
k AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f),
g AS (SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n, sum(coalesce(value, 0.0)) AS total, bool_or(coalesce(event_type = 'purchase', false)) AS closed FROM k GROUP BY user_id, k)
SELECT user_id, start_us, end_us, n, round(total, 6) AS total, CASE WHEN closed THEN 'closed' ELSE 'expired' END AS outcome FROM g, m WHERE closed OR mark - end_us > 14400000000""")
def episodes_streamed(spark, d):
    """What users do up to a purchase or a pause of four hours, out of a stream of the whole table."""
    stream = event_windows.source(spark, f"{d}/events.parque[t]")  # a stream reads a single file by a pattern only
    return event_windows.run(event_windows.episodes(stream, "purchase", "4 hours", "1 hour"), new_path(spark)).withColumn("total", r("total"))

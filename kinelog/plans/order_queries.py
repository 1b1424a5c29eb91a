"""Queries along an order, each beside its SQL: as-of lookups, cubics, pieces of intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chains, ordered, sketches
from . import trajectories as t
from .queries import query, r

KINDS = tuple(t.TYPE_OF_EVENT)


@query(f"""WITH asked AS (SELECT event_id, user_id, event_type, ts FROM events),
answers AS (SELECT user_id, asked, ts AS at, max(event_id) AS id FROM (SELECT *, unnest({list(KINDS)}) AS asked FROM events) WHERE asked <> event_type GROUP BY user_id, asked, ts)
SELECT a.event_id, a.event_type, e.event_id AS earlier, e.event_type AS earlier_type, round(e.value, 6) AS earlier_value
FROM (SELECT asked.*, answers.id FROM asked ASOF LEFT JOIN answers ON asked.user_id = answers.user_id AND asked.event_type = answers.asked AND asked.ts > answers.at) a LEFT JOIN events e ON e.event_id = a.id""")
def asof_lookup(spark, d):
    """For each event the latest earlier event of another type of its user."""
    e = t.table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    answers = e.withColumn("asked", F.explode(F.array(*map(F.lit, KINDS)))).filter("asked <> event_type").withColumnRenamed("event_type", "kind").withColumnRenamed("asked", "event_type")
    found = ordered.asof(e, answers, ("user_id", "event_type"), "ts", ("event_id", "kind", "value"), exact=False, tie="event_id")
    return found.select("event_id", "event_type", F.col("found.event_id").alias("earlier"), F.col("found.kind").alias("earlier_type"), r("found.value").alias("earlier_value"))


_HOURS = "epoch(ts) / 3600.0 - 473352.0"


@query(f"""WITH e AS (SELECT event_id, user_id % 16 AS road, event_type, {_HOURS} AS s, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
c AS (SELECT road, s, value AS a, k / 100 AS b, -value / 1e5 AS c, k / 1e8 AS d FROM e WHERE event_type = 'purchase'),
u AS (SELECT *, row_number() OVER (PARTITION BY road, s ORDER BY a DESC, b DESC, c DESC, d DESC) AS n FROM c),
f AS (SELECT road, min(s) AS s0 FROM c GROUP BY road),
m AS (SELECT e.event_id, e.road, e.s, u.s AS s1 FROM e ASOF LEFT JOIN (SELECT * FROM u WHERE n = 1) u ON e.road = u.road AND e.s >= u.s),
g AS (SELECT m.event_id, m.road, m.s, coalesce(s1, s0) AS s1 FROM m LEFT JOIN f ON m.road = f.road)
SELECT g.event_id, g.road, CASE WHEN u.s IS NULL THEN 0.0 ELSE round(a + b * (g.s - u.s) + c * (g.s - u.s) * (g.s - u.s) + d * (g.s - u.s) * (g.s - u.s) * (g.s - u.s), 6) AS value_ END AS value
FROM g LEFT JOIN u ON u.road = g.road AND u.s = g.s1 AND u.n = 1""".replace(", 6) AS value_ END", ", 6) + 0.0 END"))
def cubic_sections(spark, d):
    """16 roads, whose purchases are sections of a cubic, read at every event."""
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600.0 - 473352.0
    e = t.table(spark, d, "events").select("event_id", (F.col("user_id") % 16).alias("road"), "event_type", s.alias("s"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    sections = e.filter("event_type = 'purchase'").select("road", "s", F.col("value").alias("a"), (F.col("k") / 100).alias("b"), (-F.col("value") / 1e5).alias("c"), (F.col("k") / 1e8).alias("d"))
    return ordered.cubic_sections(e.select("event_id", "road", "s"), sections, ("road",)).select("event_id", "road", r("value").alias("value"))


FLAGS = ("A", "N", "R")
_PIECES = """points AS (SELECT key, p, sum(d) FILTER (WHERE label = 'A') AS a, sum(d) FILTER (WHERE label = 'N') AS n, sum(d) FILTER (WHERE label = 'R') AS r
FROM (SELECT key, a AS p, 1 AS d, label FROM iv WHERE a < b UNION ALL SELECT key, b, -1, label FROM iv WHERE a < b) GROUP BY key, p),
sums AS (SELECT key, p, coalesce(sum(a) OVER w, 0) > 0 AS a, coalesce(sum(n) OVER w, 0) > 0 AS n, coalesce(sum(r) OVER w, 0) > 0 AS r FROM points WINDOW w AS (PARTITION BY key ORDER BY p ROWS UNBOUNDED PRECEDING)),
named AS (SELECT key, p, concat_ws('+', CASE WHEN a THEN 'A' END, CASE WHEN n THEN 'N' END, CASE WHEN r THEN 'R' END) AS labels FROM sums),
changed AS (SELECT * FROM (SELECT *, lag(labels, 1, '') OVER (PARTITION BY key ORDER BY p) AS was FROM named) WHERE was <> labels),
pieces AS (SELECT * FROM (SELECT key, p AS begin, lead(p) OVER (PARTITION BY key ORDER BY p) AS e, labels FROM changed) WHERE labels <> '')"""


@query(f"""WITH iv AS (SELECT l_suppkey AS key, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS a, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) + CAST(floor(l_quantity / 5) AS BIGINT) AS b, l_returnflag AS label FROM lineitem), {_PIECES}
SELECT key AS l_suppkey, begin, e AS "end", labels FROM pieces""")
def interval_pieces(spark, d):
    """Items on their way from each supplier, a day for every five pieces: spans of days with the same return flags on the way."""
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86_400_000_000)
    rows = t.table(spark, d, "lineitem").select("l_suppkey", day.alias("begin"), (day + F.floor(F.col("l_quantity") / 5)).alias("end"), F.col("l_returnflag").alias("label"))
    return ordered.interval_pieces(rows, ("l_suppkey",), FLAGS).select("l_suppkey", "begin", "end", F.array_join("labels", "+").alias("labels"))


@query(f"""WITH iv AS (SELECT l_orderkey AS key, 4 * l_linenumber AS a, CAST(4 * l_linenumber + l_quantity % 9 AS BIGINT) AS b, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'N' END AS label FROM lineitem
UNION ALL SELECT DISTINCT l_orderkey, 4, 40, 'R' FROM lineitem), {_PIECES},
lists AS (SELECT key, list([{{'b': begin, 'e': e, 'l': labels}}] ORDER BY begin) AS p FROM pieces GROUP BY key),
folded AS (SELECT key, list_reduce(p, lambda acc, y: CASE WHEN acc[-1].e = y[1].b AND (acc[-1].l = y[1].l OR acc[-1].e - acc[-1].b <= 1 OR y[1].e - y[1].b <= 1)
  THEN list_concat(acc[1:-2], [{{'b': acc[-1].b, 'e': y[1].e, 'l': CASE WHEN y[1].e - y[1].b > acc[-1].e - acc[-1].b THEN y[1].l ELSE acc[-1].l END}}]) ELSE list_concat(acc, y) END) AS p FROM lists)
SELECT key AS lane, x.b AS begin, x.e AS "end", x.l AS labels FROM (SELECT key, unnest(p) AS x FROM folded)""")
def lane_chunks(spark, d):
    """Each order is a lane from 4 to 40 (R), its items stretches of its left (A) and right (N) border: chunks with the same borders, the shortest joined."""
    items, n = t.table(spark, d, "lineitem"), F.col("l_linenumber").cast("long")
    borders = items.select(F.col("l_orderkey").alias("lane"), (4 * n).alias("begin"), (4 * n + F.col("l_quantity") % 9).cast("long").alias("end"), F.when(n % 2 == 0, "A").otherwise("N").alias("label"))
    lanes = items.select(F.col("l_orderkey").alias("lane"), F.lit(4).cast("long").alias("begin"), F.lit(40).cast("long").alias("end"), F.lit("R").alias("label")).distinct()
    pieces = ordered.interval_pieces(borders.unionByName(lanes), ("lane",), FLAGS)
    return ordered.short_pieces_joined(pieces, ("lane",)).select("lane", "begin", "end", F.array_join("labels", "+").alias("labels"))


@query("""WITH e AS (SELECT event_id, first_value(event_id) OVER w AS head, row_number() OVER w - 1 AS rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, head, rank FROM e""")
def list_ranked(spark, d):
    """Each event names the next one of its user; its place in that list is found from these names alone."""
    e = t.table(spark, d, "events")
    linked = e.select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next"))
    return chains.ranked(linked, "event_id")


@query("""SELECT l_returnflag, CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(2 - grouping(l_returnflag) - grouping(l_linenumber) AS INTEGER) AS level, count(*) AS n, count(DISTINCT l_partkey) AS exact, true AS near
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linenumber)""")
def sketched_distincts(spark, d):
    """Different parts by return flag and line number out of stored sketches, near to the exact counts (within three percent, over four times the standard error)."""
    by, rows = ("l_returnflag", "l_linenumber"), t.table(spark, d, "lineitem")
    found = sketches.rolled_up(sketches.distinct_sketches(rows, by, "l_partkey"), by)
    exact = rows.rollup(*by).agg(F.countDistinct("l_partkey").alias("exact"))
    same = [found[c].eqNullSafe(exact[c]) for c in by]
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.03 * F.col("exact")
    return found.join(exact, same).select(found["l_returnflag"], found["l_linenumber"].cast("int").alias("l_linenumber"), "level", "n", "exact", near.alias("near"))

"""Queries against their SQL on tables made for what random ones seldom hold."""

import datetime as dt
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kinelog.plans import queries  # noqa: F401
from kinelog.plans.registry import ORACLES, QUERIES


def save_events(path, users, values, ks):
    """An event table: places (value, k) of users in the order of the rows."""
    n = len(users)
    start = dt.datetime(2024, 1, 1)
    kinds = ("click", "view", "purchase", "signup", "error")
    pq.write_table(pa.table({
        "event_id": pa.array(range(n), pa.int64()), "ts": pa.array([start + dt.timedelta(seconds=i) for i in range(n)], pa.timestamp("us")), "user_id": pa.array(users, pa.int64()),
        "event_type": pa.array([kinds[i % 5] for i in range(n)]), "value": pa.array(values, pa.float64()), "props": pa.array([f'{{"k": {k}}}' for k in ks]),
    }), f"{path}/events.parquet")
    return str(path)


def differences(spark, d, name):
    """Rows that only the query has, and rows that only its SQL has."""
    df = QUERIES[name](spark, d)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for table in os.listdir(d):
        con.execute(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{d}/{table}'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    got, want = (sorted(tuple(map(str, x)) for x in rows) for rows in (df.select(*columns).collect(), want))
    return sorted(set(got) - set(want)), sorted(set(want) - set(got)), len(got) - len(want)


@pytest.mark.parametrize("name", ["heading_unwrap", "line_headings"])
def test_tracks_that_turn_right_back(spark, tmp_path, name):
    """The sign of half a turn, and the mean of two opposite directions, hang on last bits."""
    rng = np.random.default_rng(5)
    users, xs, ys = [], [], []
    for u in range(2000):
        k, step = int(rng.integers(1, 4)), rng.integers(-1000, 1001, 2)
        at = np.array([int(rng.integers(0, 50000)), int(rng.integers(0, 100))])
        for move in (np.zeros(2, int), step * (1, k), -k * step * (1, k), 2 * step * (1, k)):
            at = at + move
            users.append(u)
            xs.append(float(f"{at[0] / 100:.2f}"))
            ys.append(int(at[1]))
    assert differences(spark, save_events(tmp_path, users, xs, ys), name) == ([], [], 0)


def test_hull_of_points_in_a_line_but_for_rounding(spark, tmp_path):
    """Places along the sides of triangles, in decimals: which of them are corners hangs on last bits."""
    rng = np.random.default_rng(6)
    users, xs, ys = [], [], []
    for u in range(300):
        ends = np.stack((rng.integers(0, 50000, 3), rng.integers(0, 100, 3)), 1)
        step = rng.integers(-700, 700)
        inner = [(ends[0, 0] + i * step, ends[0, 1] + i) for i in range(8)] + [tuple(e) for e in ends[1:]] + [tuple(e) for e in rng.integers(0, 100, (5, 2)) * (100, 1)]
        for a, b in inner:
            users.append(u)
            xs.append(float(f"{a / 100:.2f}"))
            ys.append(int(b))
    for u in range(300, 304):  # all in a line, level and upright and slanting, and all in one place
        for i in range(20):
            users.append(u)
            xs.append((0.1 * i, 7.3, 0.1 * i, 5.0)[u - 300])
            ys.append((3, i, 3 * i, 5)[u - 300])
    assert differences(spark, save_events(tmp_path, users, xs, ys), "hulls") == ([], [], 0)


@pytest.mark.parametrize("name", ["edges_without_duplicates", "edges_clear_of_lanes"])
def test_items_of_large_orders(spark, tmp_path, name):
    """Orders from 2 ** 24 on, where ids fit no long: the same edges as under small numbers."""
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows.withColumn("l_orderkey", rows.l_orderkey + 54_000_000).write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = lambda d: {(e.map_id, int(e.elem_id)) for e in QUERIES[name](spark, d).collect()}
    assert edges(str(tmp_path)) == {(m, e + (54_000_000 << 39)) for m, e in edges("/root/testdata/sf0.001")}

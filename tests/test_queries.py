"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from kinelog.plans import queries  # noqa: F401
from kinelog.plans.registry import FLAGSHIP, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_each_has_sql_and_the_flagship_is_there():
    assert set(QUERIES) == set(ORACLES) and FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_compares_everything(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_whole_tables_are_answered_for(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    states, items = read("events").count(), read("lineitem").select("l_orderkey", "l_partkey")
    for name in ("lanes_within_all", "nearest_lane_all", "current_lane_all"):
        assert QUERIES[name](spark, SF).select("place_id").distinct().count() == states, name
    assert QUERIES["delta_codec_all"](spark, SF).count() == states
    assert QUERIES["lane_graph_all"](spark, SF).select("start").distinct().count() == read("supplier").count()
    orders = {}
    for o, p in items.collect():
        orders.setdefault(o, set()).add(p)
    want = {(a, b) for ps in orders.values() for a in ps for b in ps if a != b}
    assert {tuple(x) for x in QUERIES["shared_borders_all"](spark, SF).select("elem_id", "other").collect()} == want

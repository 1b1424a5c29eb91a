"""Stored points: what is found, and which files are read."""

import math
import random

import pytest

from kinelog.sources import spatial

KIND = "map_id long, elem_id long, seq long, x double, y double, z double, h double"
PLACES = "place_id long, map_id long, x double, y double, z double"


def drawn(seed, n):
    rng = random.Random(seed)
    rows = [(rng.randrange(2), rng.randrange(50), k, rng.uniform(-1000, 1000), rng.uniform(0, 300), rng.choice((0.0, 0.5)), 0.0) for k in range(n)]
    return rows + rows[:20] + [(0, 1, n, None, 3.0, 0.0, 0.0), (None, 1, n, 1.0, 3.0, 0.0, 0.0), (1, 1, n, math.nan, 3.0, 0.0, 0.0)]


def plain(rows, places, radius):
    out = []
    for p, m, x, y, z in places:
        for pm, e, s, a, b, c, _ in rows:
            if None not in (m, x, pm, a) and m == pm and math.sqrt((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2) <= radius:
                out.append((p, e, s))
    return sorted(out)


@pytest.mark.parametrize("radius", [0.5, 12.0, 3000.0])
def test_pairs_equal_a_plain_search(spark, tmp_path, radius):
    rows, rng = drawn(3, 600), random.Random(9)
    places = [(k, rng.randrange(3), rng.uniform(-1100, 1100), rng.uniform(-50, 350), 0.0) for k in range(30)] + [(90, 0, rows[0][3], rows[0][4], 0.0), (91, 0, None, 1.0, 0.0), (92, None, 1.0, 1.0, 0.0)]
    spatial.save_points(spark.createDataFrame(rows, KIND), str(tmp_path), 50)
    got = spatial.stored_within(spark, str(tmp_path), spark.createDataFrame(places, PLACES), radius)
    assert sorted((r.place_id, r.elem_id, r.seq) for r in got.collect()) == plain(rows, places, radius)


def test_only_files_near_the_places_are_read(spark, tmp_path):
    rows = drawn(5, 4000)
    spatial.save_points(spark.createDataFrame(rows, KIND), str(tmp_path), 100)
    stored = spark.read.parquet(f"{tmp_path}/points")
    assert stored.count() == len(rows) - 3 and len(stored.inputFiles()) >= 35
    one = spark.createDataFrame([(1, 0, 0.0, 100.0, 0.0)], PLACES)
    read = spatial.points_near(spark, str(tmp_path), one, 10.0)
    assert 1 <= len(read.inputFiles()) <= 4
    assert not spatial.points_near(spark, str(tmp_path), spark.createDataFrame([(1, 7, 0.0, 0.0, 0.0)], PLACES), 10.0).inputFiles()


def test_no_points_one_point_and_equal_points(spark, tmp_path):
    places = spark.createDataFrame([(1, 0, 1.0, 1.0, 0.0)], PLACES)
    for name, rows, n in (("none", [], 0), ("one", [(0, 1, 0, 1.0, 1.5, 0.0, 0.0)], 1), ("equal", [(0, 1, k, 1.0, 1.0, 0.0, 0.0) for k in range(300)], 300)):
        spatial.save_points(spark.createDataFrame(rows, KIND), f"{tmp_path}/{name}", 20)
        assert spatial.stored_within(spark, f"{tmp_path}/{name}", places, 1.0).count() == n

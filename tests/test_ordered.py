"""As-of lookups and interval pieces against plain loops, with a key that holds most rows cut into stretches."""

import random

import pytest

from kinelog.operators import chains
from kinelog.operators import ordered as O
from kinelog.operators import sketches


@pytest.fixture(params=[2, 64])
def slices(request, monkeypatch):
    monkeypatch.setattr(O, "SLICES", request.param)
    return request.param


def plain_asof(left, right, exact):
    out = []
    for key, at, name in left:
        fit = [(t, tie, v) for k, t, tie, v in right if key is not None and k == key and at is not None and t is not None and (t < at or exact and t == at)]
        out.append((key, at, name, max(fit)[2] if fit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("exact", [True, False])
def test_asof_equals_a_plain_search(spark, slices, exact):
    rng = random.Random(slices)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    at = lambda: rng.choice([*range(40), None])
    left = [(key(), at(), f"l{i}") for i in range(300)] + [(1, 7, "twice"), (1, 7, "twice"), (9, 5, "alone")]
    right = [(key(), at(), i, f"r{i}") for i in range(90)]
    got = O.asof(spark.createDataFrame(left, "k int, at int, name string"), spark.createDataFrame(right, "k int, at int, tie int, name string"), ("k",), "at", ("name",), exact=exact, tie="tie", into="was")
    assert sorted(((r.k, r.at, r.name, r.was and r.was.name) for r in got.collect()), key=str) == plain_asof(left, right, exact)


def test_asof_on_empty_tables_and_by_two_keys(spark):
    left = spark.createDataFrame([(1, "a", 5.0)], "k int, j string, at double")
    right = spark.createDataFrame([(1, "b", 1.0, 7), (1, "a", 2.0, 8)], "k int, j string, at double, v int")
    rows = lambda a, b: [r.found and r.found.v for r in O.asof(a, b, ("k", "j"), "at", ("v",)).collect()]
    assert rows(left, right) == [8] and rows(left, right.limit(0)) == [None] and rows(left.limit(0), right) == []


def test_one_key_is_dealt_over_many_groups(spark):
    """A key with all rows is cut into stretches of about as many rows."""
    rows = spark.range(20_000).selectExpr("1 AS k", "CAST(id * id AS DOUBLE) AS at")
    bounds = O.key_bounds(rows, ("k",), "at")
    sizes = [r["count"] for r in O.sliced(rows, bounds, ("k",), "at").groupBy("k", "_slice").count().collect()]
    assert len(sizes) == O.SLICES and max(sizes) < 2 * 20_000 / O.SLICES


def test_cubics_before_at_and_without_sections(spark):
    places = spark.createDataFrame([("r", 0.0), ("r", 2.0), ("r", 5.0), ("r", None), ("x", 1.0)], "road string, s double")
    sections = spark.createDataFrame([("r", 2.0, 1.0, 2.0, 0.0, 0.0), ("r", 4.0, 0.0, 0.0, 3.0, 1.0), ("r", 4.0, -1.0, 9.0, 9.0, 9.0), ("r", None, 5.0, 0.0, 0.0, 0.0)], "road string, s double, a double, b double, c double, d double")
    got = {(r.road, r.s): r.value for r in O.cubic_sections(places, sections, ("road",)).collect()}
    assert got == {("r", 0.0): -3.0, ("r", 2.0): 1.0, ("r", 5.0): 4.0, ("r", None): None, ("x", 1.0): 0.0}


def plain_pieces(intervals, labels):
    out = []
    for key in {k for k, *_ in intervals if k is not None}:
        own = [(a, b, x) for k, a, b, x in intervals if k == key and a is not None and b is not None and a < b and x in labels]
        last = None
        for p in range(min((a for a, _, _ in own), default=0), max((b for _, b, _ in own), default=0)):
            now = [x for x in labels if any(a <= p < b and y == x for a, b, y in own)]
            if now and last and last[2] == p and last[3] == now:
                last[2] = p + 1
            elif now:
                last = [key, p, p + 1, now]
                out.append(last)
    return sorted(map(tuple, out), key=str)


def test_pieces_equal_a_plain_sweep(spark, slices):
    rng = random.Random(slices)
    rows = []
    for _ in range(250):
        a = rng.randrange(400)
        rows.append((rng.choice([1, 1, 1, 2, 3, None]), rng.choice([a, a, a, None]), a + rng.choice([0, 1, 2, 5, 60, -3]), rng.choice(["left", "right", "other", None])))
    rows += [(4, 0, 9, "left"), (4, 0, 9, "left"), (4, 9, 12, "left"), (4, 20, 21, "right"), (5, 3, 3, "left")]
    got = O.interval_pieces(spark.createDataFrame(rows, "k int, begin int, end int, label string"), ("k",), ("left", "right"))
    assert sorted(((r.k, r.begin, r.end, r.labels) for r in got.collect()), key=str) == plain_pieces(rows, ["left", "right"])
    assert O.interval_pieces(spark.createDataFrame([], "k int, begin int, end int, label string"), ("k",), ("left",)).count() == 0


def test_short_pieces_go_to_their_neighbours(spark):
    rows = [(1, 0, 5, ["a"]), (1, 5, 6, ["b"]), (1, 6, 7, ["c"]), (1, 7, 20, ["d"]), (1, 25, 26, ["d"]), (2, 0, 1, ["a"]), (2, 1, 4, ["b"]), (2, 4, 8, ["b"]), (3, 0, 1, ["a"]), (3, 1, 2, ["b"])]
    got = O.short_pieces_joined(spark.createDataFrame(rows, "k int, begin int, end int, labels array<string>"), ("k",)).collect()
    assert sorted((r.k, r.begin, r.end, r.labels) for r in got) == [(1, 0, 7, ["a"]), (1, 7, 20, ["d"]), (1, 25, 26, ["d"]), (2, 0, 8, ["b"]), (3, 0, 2, ["a"])]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 300])
def test_lists_equal_following_the_links(spark, size):
    rng = random.Random(size)
    names = [f"n{i}" for i in range(size)]
    rng.shuffle(names)
    cuts = set(rng.sample(range(size), size // 10))
    rows = [(a, None if i in cuts else b) for i, (a, b) in enumerate(zip(names, [*names[1:], None]))]
    want, head, rank = {}, None, 0
    for name, after in rows:
        head, rank = (name, 0) if head is None else (head, rank + 1)
        want[name] = (head, rank)
        head = head if after else None
    got = chains.ranked(spark.createDataFrame(rng.sample(rows, size), "token string, next string").repartition(3))
    assert {r.token: (r.head, r["rank"]) for r in got.collect()} == want


def test_odd_lists(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("s", "s"), ("x", ""), ("y", "gone"), ("p", "r"), ("q", "r"), ("r", None), ("r", None), (None, "x"), ("u", "v"), ("v", "w"), ("w", "u2")]
    got = {r.token: (r.head, r["rank"]) for r in chains.ranked(spark.createDataFrame(rows, "token string, next string")).collect()}
    ring = (None, None)
    assert got == {"a": ring, "b": ring, "c": ring, "s": ring, "x": ("x", 0), "y": ("y", 0), "p": ("p", 0), "q": ("q", 0), "r": ("p", 1), "u": ("u", 0), "v": ("u", 1), "w": ("u", 2)}
    assert chains.ranked(spark.createDataFrame([], "token string, next string")).count() == 0


def test_sketches_merge_without_the_rows(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("id % 3 AS a", "id % 7 AS b", "IF(id % 10 = 0, NULL, id % 20000) AS v")
    sketches.distinct_sketches(rows, ("a", "b"), "v").write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    got = {(r.a, r.b, r.level): (r.n, r.n_distinct) for r in sketches.rolled_up(stored, ("a", "b")).collect()}
    assert len(got) == 1 + 3 + 21 and got[None, None, 0][0] == 60_000
    for (a, b, level), (n, distinct) in got.items():
        own = rows.filter(("true" if a is None else f"a = {a}") + ("" if b is None else f" AND b = {b}"))
        exact = own.filter("v IS NOT NULL").select("v").distinct().count()
        assert level == (a is not None) + (b is not None) and n == own.count() and abs(distinct - exact) <= 0.03 * exact
    assert sketches.rolled_up(stored.limit(0), ("a",)).filter("level > 0").count() == 0

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelog.llm import jaccard as J
from kinelog.llm.graph import components
from kinelog.llm.shingles import words


def sets_of(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> (copy_of, class_id, n_links)."""
    sets = {d: sets_of(t) for d, t in rows}
    texts = {}
    for d, t in sorted(rows):
        texts.setdefault(t, d)
    full = [d for d, _ in rows if sets[d]]
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    by_set = {}
    for d in sorted(full):
        by_set.setdefault(frozenset(sets[d]), []).append(d)
    count = {}
    text_of = dict(rows)
    for s, ds in by_set.items():
        count[s] = len({text_of[d] for d in ds}) - 1
        for d in ds:
            root[top(d)] = min(top(d), top(ds[0]))
    for s, t in itertools.combinations(by_set, 2):
        if 5 * len(s & t) >= 4 * len(s | t):
            count[s] += len({text_of[d] for d in by_set[t]})
            count[t] += len({text_of[d] for d in by_set[s]})
            x, y = top(by_set[s][0]), top(by_set[t][0])
            root[max(x, y)] = min(x, y)
    return {d: (by_set[frozenset(sets[d])][0], top(d), count[frozenset(sets[d])]) if sets[d] else (d, d, 0) for d, _ in rows}


def corpus(rng, n_groups=12, size=9, far=120):
    """Groups of near copies around the least similarity, and texts of their own."""
    rows, vocabulary = [], [f"w{i}" for i in range(3000)]
    for _ in range(n_groups):
        base = rng.choices(vocabulary, k=rng.randint(30, 200))
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 30))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append(" ".join(t))
    rows += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(far)]
    rows += [rows[0], rows[0].replace(" ", "\n", 1), rows[20], "", " ", None, None, "one two", "one\ttwo", "one  two three"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("leaf,block", [(64, 512), (3, 4)])
def test_links_equal_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(J, "LEAF", leaf)
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus(random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_links", F.lit(0))
    got = {r.doc_id: (r.copy_of, r.class_id, r.n_links) for r in J.near_duplicates(docs).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    missed = sum(max(0, want[d][2] - got[d][2]) for d in want)
    assert all(got[d][2] <= want[d][2] for d in want)
    assert missed <= 0.002 * sum(w[2] for w in want.values())
    if not missed:
        assert got == want


def test_small_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.copy_of, r.class_id, r.n_links) for r in J.op3_chosen_path_join(spark, sf).collect()} == brute(rows)


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, J.near_duplicates(docs).collect()), key=str) == [(4, 4, 4, 0), (None, None, None, 0)]
    assert J.near_duplicates(docs.limit(0)).count() == 0


def test_rows_repeated_under_one_doc_id(spark):
    """Rows 1, 1 and the near copy 3; two further texts of doc_id 5, of which one is near 6 and the other near 7."""
    rng = random.Random(11)
    a, b, c = (rng.choices([f"w{i}" for i in range(3000)], k=120) for _ in range(3))
    near = lambda t: " ".join([*t[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(a)), (1, "  ".join(a)), (3, near(a)), (5, " ".join(b)), (5, " ".join(c)), (6, near(b)), (7, near(c))]
    got = sorted(map(tuple, J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 1, 1, 2), (1, 1, 1, 2), (1, 1, 1, 2), (3, 3, 1, 2), (5, 5, 5, 1), (5, 5, 5, 1), (6, 6, 5, 1), (7, 7, 5, 1)]


def test_recall_where_buckets_go_deep(spark, monkeypatch):
    """800 pairs that agree in 51 or 52 of 64 tokens, about 0.8, all of them of frequent passages, so that buckets are split to the last levels."""
    monkeypatch.setattr(J, "LEAF", 8)
    rng, n = np.random.default_rng(3), 800
    frequent, rows = rng.integers(1, 2**32, (2, J.SIZE), np.uint32), []
    for k in range(n):
        own = frequent[rng.integers(0, 2, J.SIZE), np.arange(J.SIZE)]
        own[[0, -1]] = rng.integers(1, 2**32, 2, np.uint32)  # not dense
        other = own.copy()
        at = rng.choice(np.arange(1, J.SIZE - 1), rng.choice([10, 11], p=[0.2, 0.8]), replace=False)
        other[at] = np.where(own[at] == frequent[0, at], frequent[1, at], frequent[0, at])
        other[[0, -1]] = rng.integers(1, 2**32, 2, np.uint32)
        rows += [(2 * k, bytearray(own.tobytes())), (2 * k + 1, bytearray(other.tobytes()))]
    found = J.leaves(spark.createDataFrame(rows, "rep long, tokens binary"))
    met = found.groupBy("path", F.floor(F.col("rep") / 2).alias("pair")).count().filter("count = 2").select("pair").distinct().count()
    assert n - met <= 1


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 540)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = list(range(600))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: top(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

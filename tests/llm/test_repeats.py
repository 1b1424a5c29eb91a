import hashlib
import random

import numpy as np
import pytest

from kinelog.llm import lempel_ziv, repeats, suffixes
from kinelog.llm.shingles import words


def brute(rows):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    split = {d: words(t) for d, t in rows}
    low = {}
    for d in sorted(split):
        for i in range(len(split[d]) - 49):
            low.setdefault(tuple(split[d][i : i + 50]), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - 49):
            if low[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus(rng):
    vocabulary = [f"ü{i}" for i in range(50)]
    passages = [rng.choices(vocabulary, k=rng.randint(40, 90)) for _ in range(8)]
    rows = []
    for d in range(70):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choices(vocabulary, k=rng.randint(0, 60))
            if rng.random() < 0.7:
                p = rng.choice(passages)
                parts += p[rng.randint(0, 6) :] if rng.random() < 0.5 else p
        rows.append((d * 3, " ".join(parts)))
    rows += [(1, rows[5][1]), (2, rows[5][1].replace(" ", "\n")), (400, "a " * 200), (401, "a " * 120), (402, "b " * 300), (403, ""), (404, None), (405, "x y z"), (406, "a" * 300_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("operator", [suffixes.substring_duplicates, lempel_ziv.factors])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, operator, seed):
    rows = corpus(random.Random(seed))
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, pos int, anchors string").repartition(5)
    got = {r.doc_id: r for r in operator(docs).collect()}
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in got.items()} == brute(rows)
    texts = dict(rows)
    for d, r in got.items():
        for a, b, ref in zip(r.starts or [], r.ends or [], r.refs or []):
            assert ref < d and b"\0".join(words(texts[d])[a:b]) in b"\0".join(words(texts[ref]))


@pytest.mark.parametrize("operator", [suffixes.substring_duplicates, lempel_ziv.factors])
def test_a_run_over_many_partitions(spark, operator):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(d, f"a{d} {passage} z{d}") for d in range(300)]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in operator(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


@pytest.mark.parametrize("query", [suffixes.op2_sparse_suffixes, lempel_ziv.op9_relative_lempel_ziv])
def test_small_table_equals_brute_force(spark, query):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in query(spark, sf).collect()} == brute(rows)


@pytest.mark.parametrize("operator", [suffixes.substring_duplicates, lempel_ziv.factors])
def test_nulls_and_empty_table(spark, operator):
    text = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (6, text)], "doc_id long, text string")
    got = sorted([(r.doc_id, r.n_removed) for r in operator(docs).collect()], key=str)
    assert got == [(5, 0), (5, 0), (6, 60), (None, 0)]
    assert operator(docs.limit(0)).count() == 0


@pytest.mark.parametrize("operator", [suffixes.substring_duplicates, lempel_ziv.factors])
@pytest.mark.parametrize("large", [0, 3])
def test_groups_too_large_for_a_task_equal_brute_force(spark, operator, large):
    rows = corpus(random.Random(3))
    got = operator(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), large).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(rows)


@pytest.mark.parametrize("operator", [suffixes.substring_duplicates, lempel_ziv.factors])
def test_unlike_and_equal_texts_under_one_doc_id(spark, operator):
    p, q, own = (" ".join(f"{c}{i}" for i in range(70)) for c in "pqx")
    rows = [(1, p), (2, p + " " + own), (2, q), (2, q), (3, q + " end"), (2, "short"), (1, q + " " + own)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in operator(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # Under id 1 both texts stay whole; under 2 what 1 has goes, in each of its texts.
    assert got == [(1, 70, 0), (1, 140, 0), (2, 1, 0), (2, 70, 70), (2, 70, 70), (2, 140, 140), (3, 71, 70)]


def test_suffix_order_gives_the_common_prefixes():
    rng = np.random.default_rng(5)
    right, left = rng.integers(1, 2**64, (2, repeats.RIGHT), np.uint64), rng.integers(1, 2**64, (2, repeats.LEFT), np.uint64)
    right[1, :20] = right[0, :20]
    some = np.concatenate([right[rng.integers(0, 2, 40)], left[rng.integers(0, 2, 40)]], 1)
    for row in some:  # words of its own from somewhere on, or the end of the text
        row[rng.integers(20, 51) : repeats.RIGHT] = 0 if rng.random() < 0.3 else rng.integers(1, 2**63)
        row[repeats.RIGHT + rng.integers(0, 35) :] = 0 if rng.random() < 0.3 else rng.integers(1, 2**63)

    def agree(a, b):
        return next((k for k in range(len(a)) if a[k] != b[k] or not a[k]), len(a))

    order = sorted(range(40), key=lambda k: some[k].tobytes())
    want = {}
    for a in range(40):
        for b in range(a):
            x, y = agree(some[a][repeats.RIGHT :], some[b][repeats.RIGHT :]), agree(some[a][: repeats.RIGHT], some[b][: repeats.RIGHT])
            if x + y >= 50:
                want[a, b] = (x, y)

    def found(order):
        doc = np.array(order)
        return {(int(doc[a]), int(doc[b])): (int(x), int(y)) for a, b, x, y in zip(*suffixes.matches(some[order], doc))}

    assert found(order) == want and len(want) > 20
    # Out of that order the least of the prefixes between two suffixes says nothing.
    assert len(found(sorted(order))) < len(want) and len(found(order[::2] + order[1::2])) < len(want)


def test_factors_are_the_greedy_parse(spark):
    """Each factor goes on as far as any stretch at its start does, and none overlaps another."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(4000)]
    long = [rng.choices(vocabulary, k=400) for _ in range(3)]
    rows = [(d, " ".join(p)) for d, p in enumerate(long)]
    for d in range(10, 30):
        parts = []
        for _ in range(3):
            p, a = rng.choice(long), rng.randrange(250)
            parts += p[a : a + rng.randrange(40, 150)]
        rows.append((d, " ".join(parts)))
    split = {d: t.split() for d, t in rows}

    def longest(d, i):
        best = 0
        for o in split:
            if o < d:
                for k in range(len(split[o]) - 49):
                    if split[o][k : k + 50] == split[d][i : i + 50]:
                        n = 50
                        while k + n < len(split[o]) and i + n < len(split[d]) and split[o][k + n] == split[d][i + n]:
                            n += 1
                        best = max(best, n)
        return best

    for r in lempel_ziv.factors(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.doc_id < 10:
            continue
        reach = [longest(r.doc_id, i) for i in range(r.n_words)]
        want, at = [], 0
        while at < r.n_words:
            # What begins here or before and reaches beyond, the boundary check included.
            far = max((i + n for i, n in enumerate(reach[: at + 1]) if n), default=0)
            if far > at:
                want.append((at, far))
                at = far
            else:
                at += 1
        assert list(zip(r.starts or [], r.ends or [])) == want
    assert lempel_ziv.parse([(0, 60, 1), (5, 90, 2), (40, 95, 3)]) == [(0, 60, 1), (60, 95, 3)]


def test_ladder_covers_every_window():
    for before in range(repeats.LEFT + 1):
        assert any(a <= before and a + 50 - lempel_ziv.STEM >= before for a in lempel_ziv.STEMS)
        assert all(before - a <= 4 for a in lempel_ziv.STEMS if a <= before <= a + 4)

import random

import numpy as np
import pytest

from kinelog.llm import decontamination as D


def slow_tiles(doc, item, least):
    """Greedy string tiling as first described: the longest unmarked matches, by comparing every pair of places."""
    taken_doc, taken_item, covered = set(), set(), 0
    while True:
        best, found = least - 1, []
        for a in range(len(doc)):
            for b in range(len(item)):
                k = 0
                while a + k < len(doc) and b + k < len(item) and doc[a + k] == item[b + k] and a + k not in taken_doc and b + k not in taken_item:
                    k += 1
                if k > best:
                    best, found = k, [(a, b)]
                elif k == best and k >= least:
                    found.append((a, b))
        if best < least or not found:
            return covered
        for a, b in found:
            if not taken_doc & set(range(a, a + best)) and not taken_item & set(range(b, b + best)):
                taken_doc |= set(range(a, a + best))
                taken_item |= set(range(b, b + best))
                covered += best


def test_tiles_equal_pairwise_tiling():
    rng = random.Random(2)
    for _ in range(300):
        letters = rng.choice([2, 4, 9])
        item = np.array([rng.randrange(letters) for _ in range(rng.randint(1, 25))])
        doc = np.array([rng.randrange(-1, letters) for _ in range(rng.randint(0, 40))], np.int64)
        least = min(3, len(item))
        assert sum(t[2] for t in D.tile(doc, item, least)) == slow_tiles([x if x >= 0 else f"-{i}" for i, x in enumerate(doc.tolist())], item.tolist(), least)


def brute(docs, benchmark):
    out = {}
    for d, t in docs:
        doc, items, best = D.tokens(t), [], 0.0
        for i, b in benchmark:
            own = D.tokens(b)
            if own:
                n = slow_tiles(doc, own, min(D.LEAST, len(own)))
                best = max(best, n / len(own))
                if n >= D.COVERAGE * len(own):
                    items.append(i)
        out[d] = (len(doc), sorted(items), best)
    return out


@pytest.mark.parametrize("size", [10**6, 40])
def test_reordered_passages_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(D, "SLICE", size)
    rng = random.Random(4)
    vocabulary = [f"W{i}" for i in range(60)]
    benchmark = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for i in range(12)] + [(50, ""), (51, None), (52, "W1, w1! W1 w1. W1 w1")]
    docs = []
    for d in range(60):
        parts = [rng.choices(vocabulary, k=rng.randint(0, 20))]
        if d % 2:
            own = rng.choice(benchmark)[1] or ""
            cut = len(own.split()) // 2
            parts += [[w.lower() + "," for w in own.split()[cut:]], rng.choices(vocabulary, k=3), own.split()[:cut]]
        docs.append((d, " ".join(w for p in parts for w in p)))
    docs += [(100, None), (101, ""), (102, "w1 " * 50)]
    b = spark.createDataFrame(benchmark, "item_id long, text string")
    got = D.contaminated(spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, items string"), b).collect()
    assert {r.doc_id: (r.n_tokens, r["items"], r.max_coverage) for r in got} == brute(docs, benchmark)
    assert all(r.contaminated == bool(r["items"]) for r in got)
    verdicts = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), b, shares=False).collect()
    assert {r.doc_id: (r.n_tokens, r["items"], r.max_coverage) for r in verdicts} == {r.doc_id: (r.n_tokens, r["items"], None) for r in got}


def test_bytes_bound_the_broadcast_and_hot_seeds_are_dealt(spark, monkeypatch):
    benchmark = [(1, "a b c d e f"), (2, "x" * 5000 + " b c d e f"), (3, "!" * 9000)]
    b = spark.createDataFrame(benchmark, "item_id long, text string")
    assert sorted(r.item_id for r in D.with_tokens(b).collect()) == [1, 2]
    docs = spark.createDataFrame([(i, "a b c d e f" if i % 2 else f"b c d e {i}") for i in range(300)], "doc_id long, text string")
    want = sorted(map(tuple, D.contaminated(docs, b).select("doc_id", "contaminated", "max_coverage").collect()))
    monkeypatch.setattr(D, "BYTES", 1000)
    monkeypatch.setattr(D, "looked_up", None)
    got = sorted(map(tuple, D.contaminated(docs, b).select("doc_id", "contaminated", "max_coverage").collect()))
    assert got == want == [(i, i % 2 == 1, 1.0 if i % 2 else 0.0) for i in range(300)]


def test_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "A b c d e f"), (3, "a b c d e f")], "item_id long, text string")
    assert sorted([(r.doc_id, r["items"]) for r in D.contaminated(docs, b).collect()], key=str) == [(1, [3, None])] * 2 + [(None, [3, None])]
    assert [r.contaminated for r in D.contaminated(docs, b.limit(0)).collect()] == [False] * 3
    assert D.contaminated(docs.limit(0), b).count() == 0


def test_planted_passages_of_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: set(r["items"]) for r in D.op5_string_tiling(spark, sf).collect()}
    for d, t in docs.items():
        whole = {i for i, b in benchmark if len(b.split()) >= 5 and b in t}
        assert whole <= got[d]
    assert sum(map(bool, got.values())) < 0.2 * len(got)

import hashlib
import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import count

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinelog.llm import periods as P
from kinelog.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """All runs by trying every period at every place."""
    found, n = {}, len(words)
    for q in range(1, n // P.MIN_EXPONENT + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(P.MIN_WORDS, P.MIN_EXPONENT * q) and (start, end) not in found:
                found[start, end] = q
            start = max(start + 1, end - q + 1) if end > start + q else start + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def row_of(text, runs):
    words = text.encode().split()
    keep = [True] * len(words)
    for start, size, period in runs:
        keep[start + period : start + size] = [False] * (size - period)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for w, k in zip(words, keep) if k)).hexdigest(), len(words),
    )


def changed(doc_id, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len((text or "").encode().split())
    if h % 10 or not n:
        return text or ""
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n)).decode()


def found(text):
    return P.text_runs(text.encode().split(), defaultdict(count().__next__))


pieces = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 14)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(pieces)
def test_runs_equal_a_plain_search(parts):
    words = [w for part, times in parts for w in part * times]
    assert found(" ".join(words)) == plain_runs(words)


def test_runs_of_long_periods_and_runs_in_runs():
    rng = np.random.default_rng(5)
    for size in (8, 9, 40, 170):
        part = [f"w{x}" for x in rng.integers(0, 30, size)]
        part = part[: size // 2] + ["x", "y"] * 13 + part[size // 2 :]
        for cut in (0, 1, 3):
            words = ["head"] + part * 4 + part[:cut] + ["tail"] + part * 2 + ["a"] * 24 + ["b"] * 23
            assert found(" ".join(words)) == plain_runs(words)


def test_every_document_equals_a_plain_search(spark):
    docs = table(spark, SF, "documents")
    got = {r[0]: tuple(r)[1:] for r in P.op11_suffix_automaton(spark, SF).collect()}
    texts = {r.doc_id: changed(r.doc_id, r.text) for r in docs.collect()}
    assert got.keys() == texts.keys()
    with_runs = 0
    for doc_id, text in texts.items():
        words = text.split()
        if len(words) < 1500 or zlib.crc32(str(doc_id).encode()) % 10 == 0:  # a plain search is quadratic
            runs = plain_runs(words) if len(words) < 1500 else found(text)
            assert got[doc_id] == row_of(text, runs), doc_id
            with_runs += bool(runs)
    assert with_runs > 10


def test_odd_rows(spark):
    loop = "一 二 " * 30
    rows = [(1, None, 0), (None, loop, 1), (2, "", 2), (3, " \n\t", 3), (4, loop, 4), (4, loop, 5), (5, "w " * 200_000, 6), (6, "a\x1cb a\x85b " * 12, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in P.periodic_runs(docs).collect()]
    two = (60, [(0, 60, 2)], "一 二")
    want = [(1, 0, [], ""), (None, *two), (2, 0, [], ""), (3, 0, [], ""), (4, *two), (4, *two), (5, 200_000, [(0, 200_000, 1)], "w"), (6, 24, [(0, 24, 2)], "a\x1cb a\x85b")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert P.periodic_runs(docs.limit(0)).count() == 0
    assert sorted(map(tuple, P.looped(docs).collect()), key=str)[0][0] == 1
    assert {r.doc_id: r.text for r in P.looped(docs.filter("doc_id IS NULL")).collect()} == {None: loop}

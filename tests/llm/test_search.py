import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from kinelog.llm import search as S
from kinelog.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_terms(text):
    return re.findall(S.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items):
    rows = [(doc_id, plain_terms(text)) for doc_id, text in docs]
    rows = [(i, t, Counter(t)) for i, t in rows if t]
    n_docs, n_terms = len(rows), sum(len(t) for _, t, _ in rows)
    df = Counter(t for _, _, c in rows for t in c)
    out = []
    for item_id, text in set(items):
        found = []
        for doc_id, terms, counts in rows:
            m = 100 - 75 + (75 * len(terms) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in plain_terms(text) if counts[t])
            if s > 0:
                found.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[: S.TOP])]
    return sorted(out, key=str)


def searched(spark, docs, items):
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, score int")
    i = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in S.search(d.repartition(3), i).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture
def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i, text(int(rng.integers(1, 80)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [docs[9], docs[9], (None, docs[7][1]), (None, docs[11][1])]
    docs += [(2000, None), (2001, ""), (2002, " ,. "), (2003, "W1 w1-W2 É é über"), (2004, "w3 " * 90_000)]
    items = [(k, text(12)) for k in range(20)] + [(50, docs[7][1]), (50, docs[7][1]), (51, "É"), (51, "w59 w59 w59"), (52, None), (53, "nowhere"), (54, "..."), (None, "w5 w6")]
    return docs, items


@pytest.mark.parametrize(("block", "group", "terms"), [(256, 64, 10**6), (4, 3, 10**6), (1, 1, 40)])
def test_search_equals_a_plain_search(spark, corpus, monkeypatch, block, group, terms):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "QUERY_TERMS", terms)
    assert searched(spark, *corpus) == plain_search(*corpus)


def test_blocks_are_pruned(corpus):
    """Fewer than half of the blocks are scored when bounds are sorted, with the same result."""
    docs, items = corpus
    queries = S.queries_of([(i, S.terms_of(t.encode())) for i, t in items[:20]], 0)
    rows = [(i, Counter(S.terms_of(t.encode()))) for i, t in docs if t and i is not None]
    df = Counter(w for _, c in rows for w in c)
    weights = np.array([math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[w] + 1))) for w in queries.vocabulary], np.int64)
    corpus = S.Corpus(len(rows), sum(c.total() for _, c in rows), weights)
    blocks = []
    for at in range(0, len(rows), 4):
        part = [(i, c, [(queries.vocabulary[w], n) for w, n in c.items() if w in queries.vocabulary]) for i, c in rows[at : at + 4]]
        part = [x for x in part if x[2]]
        blocks.append(S.block_of({"doc_ids": [x[0] for x in part], "lengths": [x[1].total() for x in part], "ends": np.cumsum([0, *(len(x[2]) for x in part)]), "terms": [t for x in part for t, _ in x[2]], "counts": [n for x in part for _, n in x[2]]}, corpus))
    bounds, times, scored = np.stack([S.bounds_of(b, queries) for b in blocks]), np.zeros(len(queries.vocabulary), np.int64), 0
    for k in range(20):
        best, everything = S.Best(1), S.Best(1)
        for b in blocks:
            everything.take(S.score(b, queries, k, times), b.doc_ids, b.null_ids)
        for i in np.argsort(-bounds[:, k], kind="stable"):
            assert S.score(blocks[i], queries, k, times).max() <= bounds[i, k]
            if bounds[i, k] < best.least:
                break
            scored += 1
            best.take(S.score(blocks[i], queries, k, times), blocks[i].doc_ids, blocks[i].null_ids)
        assert best.ids.tolist() == everything.ids.tolist() and best.scores.tolist() == everything.scores.tolist()
    assert scored < 20 * len(blocks) / 2


def test_sql_equals_a_plain_search(corpus):
    docs, items = ([r for r in rows if r[0] is not None and r[0] != 51] for rows in corpus)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in docs], "text": pa.array([r[1] for r in docs], pa.string())}))
    con.register("benchmark", pa.table({"item_id": [r[0] for r in items], "text": pa.array([r[1] for r in items], pa.string())}))
    assert sorted(con.execute(S.ORACLE).fetchall(), key=str) == plain_search(docs, items)


def test_tables_equal_a_plain_search(spark):
    docs, items = ([tuple(r)[:2] for r in table(spark, SF, t).select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = S.op13_block_max_search(spark, SF)
    assert got.columns[:4] == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items)


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a b")], []) == [] and searched(spark, [(1, None)], [(1, "a")]) == []

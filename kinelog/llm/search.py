"""Ranked lexical search with block-max pruning, scores in whole numbers.

Documents are laid down once as a forward index in blocks of BLOCK documents, in the order they are read: for each document its length, and the
queries' terms it holds with their counts. Once frequencies are known, a block's bound for a query is the sum of the greatest contribution that
each of its terms makes in the block. Tasks take GROUP blocks at a time, sort them by bound for each query and score whole blocks until the
bound drops below the query's threshold. The threshold is the TOP-th best score found so far in the task, and to begin with one that
holds for all tasks: each task scores the blocks of the highest bound of its groups, and of these scores the TOP-th best of all tasks counts.
A block whose bound equals the threshold is scored, since equal scores rank by doc_id. Nothing is approximated.

Queries come in passes of at most QUERY_TERMS terms (or one query); each pass broadcasts its own queries and lays down its own index, which is
deleted after it. What tasks hand on is at most TOP rows a query and task.

Defined results: texts without a term, null ones included, count for nothing and are never found; a null doc_id ranks after others of its score;
repeated rows of documents are documents of their own. Items without a term have no rows; repeated rows of items are one item; texts that
differ under one item_id are items of their own. A very long text is one row of one block. Empty tables give no rows. Extra columns are not
looked at. A term that most documents hold may weigh 0 and finds nothing by itself.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, discard, mapped, saved, table

TOP = 10
#: Documents in a block, blocks that are held and sorted at once, terms of the queries of one pass.
BLOCK, GROUP, QUERY_TERMS = 256, 64, 1_000_000
#: Fixed value: the characters that part terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = (
    "n_docs long, n_terms long, doc_ids array<bigint>, lengths array<bigint>, ends array<int>, terms array<int>, counts array<bigint>, "
    "held array<int>, holders array<bigint>"
)
FOUND = "query long, item_id long, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLDED).split() if text else []


class Queries(NamedTuple):
    """Queries of one pass: query k has the terms from ``ends[k]`` to ``ends[k + 1]``, each as often as ``times`` says."""

    first: int
    item_ids: list[int | None]
    vocabulary: dict[bytes, int]
    ends: np.ndarray
    terms: np.ndarray
    times: np.ndarray


def queries_of(items: list[tuple[int | None, list[bytes]]], first: int) -> Queries:
    vocabulary: dict[bytes, int] = {}
    terms, times, ends = [], [], [0]
    for _, words in items:
        for word, n in Counter(words).items():
            terms.append(vocabulary.setdefault(word, len(vocabulary)))
            times.append(n)
        ends.append(len(terms))
    return Queries(first, [i for i, _ in items], vocabulary, np.array(ends), np.array(terms, np.int64), np.array(times, np.int64))


def passes(items: DataFrame) -> Iterator[Queries]:
    """The queries a pass at a time; the driver holds one pass."""
    part, size, first = [], 0, 0
    for item_id, text in items.select("item_id", "text").distinct().toLocalIterator():
        words = terms_of(text.encode("utf-8", "surrogatepass") if text else None)
        if not words:
            continue
        if part and size + len(words) > QUERY_TERMS:
            yield queries_of(part, first)
            first += len(part)
            part, size = [], 0
        part.append((item_id, words))
        size += len(words)
    if part:
        yield queries_of(part, first)


def forward_index(docs: DataFrame, queries: Broadcast) -> DataFrame:
    """Blocks of documents (doc_id, text) with the queries' terms they hold. Documents that hold none are only counted."""

    def row(n_docs: int, n_terms: int, ids: list, lengths: list, ends: list, terms: list, counts: list) -> list:
        held, holders = np.unique(np.array(terms, np.int32), return_counts=True)
        return [[x] for x in (n_docs, n_terms, ids, lengths, ends, terms, counts, held, holders)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        vocabulary = queries.value.vocabulary
        n_docs = n_terms = 0
        ids, lengths, ends, terms, counts = [], [], [0], [], []
        for batch in chunks(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                n_docs += 1
                n_terms += len(words)
                own = [(vocabulary[w], n) for w, n in Counter(words).items() if w in vocabulary]
                if not own:
                    continue
                terms += [t for t, _ in own]
                counts += [n for _, n in own]
                ends.append(len(terms))
                ids.append(doc_id)
                lengths.append(len(words))
                if len(ids) == BLOCK:
                    yield row(n_docs, n_terms, ids, lengths, ends, terms, counts)
                    n_docs = n_terms = 0
                    ids, lengths, ends, terms, counts = [], [], [0], [], []
        if n_docs:
            yield row(n_docs, n_terms, ids, lengths, ends, terms, counts)

    return mapped(docs.select("doc_id", "text"), work, INDEX)


class Corpus(NamedTuple):
    """What contributions need of the whole corpus: documents, terms in all, weight of each term of the queries."""

    n_docs: int
    n_terms: int
    weights: np.ndarray


def corpus_of(index: DataFrame, n_words: int) -> Corpus:
    """One row a term of the queries comes to the driver."""
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = index.select(F.explode(F.arrays_zip("held", "holders")).alias("x")).groupBy("x.held").agg(F.sum("x.holders"))
    weights = np.zeros(n_words, np.int64)
    for term, df in held.collect():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return Corpus(n_docs, n_terms, weights)


class Block(NamedTuple):
    doc_ids: np.ndarray
    null_ids: np.ndarray
    begins: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray


def block_of(row: dict, corpus: Corpus) -> Block:
    ids = row["doc_ids"]
    lengths, ends = np.array(row["lengths"], np.int64), np.array(row["ends"], np.int64)
    terms, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
    slower = 100 - 75 + (75 * lengths * corpus.n_docs) // corpus.n_terms
    impacts = corpus.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * np.repeat(slower, np.diff(ends))))
    return Block(np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], bool), ends[:-1], terms, impacts)


def bounds_of(block: Block, queries: Queries) -> np.ndarray:
    """The most that any document of the block can score, for each query."""
    most = np.zeros(len(queries.vocabulary), np.int64)
    np.maximum.at(most, block.terms, block.impacts)
    return np.add.reduceat(queries.times * most[queries.terms], queries.ends[:-1])


class Best:
    """The best documents so far of one query: score falling, doc_id rising, null last."""

    def __init__(self, least: int) -> None:
        #: Nothing below this can be among the best of all.
        self.least = least
        self.scores, self.ids, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def take(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        fit = np.flatnonzero(scores >= self.least)
        if not len(fit):
            return
        scores, ids, null = np.append(self.scores, scores[fit]), np.append(self.ids, ids[fit]), np.append(self.null, null[fit])
        order = np.lexsort((ids, null, -scores))[:TOP]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]
        if len(order) == TOP:
            self.least = max(self.least, int(self.scores[-1]))


def score(block: Block, queries: Queries, k: int, times: np.ndarray) -> np.ndarray:
    """Scores of a block's documents for query k; ``times`` is a row of zeros, one for each term, and is left so."""
    own = slice(queries.ends[k], queries.ends[k + 1])
    times[queries.terms[own]] = queries.times[own]
    scores = np.add.reduceat(times[block.terms] * block.impacts, block.begins)
    times[queries.terms[own]] = 0
    return scores


def searched(index: DataFrame, queries: Broadcast, corpus: Broadcast, thresholds: dict[int, int], first_only: bool = False) -> DataFrame:
    """The best documents of each task for each query. ``first_only``: of each group, just the block with the highest bound is scored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        q, c = queries.value, corpus.value
        best = [Best(thresholds.get(q.first + k, 1)) for k in range(len(q.item_ids))]
        times = np.zeros(len(q.vocabulary), np.int64)

        def group(blocks: list[Block]) -> None:
            bounds = np.stack([bounds_of(b, q) for b in blocks])
            for k, order in enumerate(np.argsort(-bounds, axis=0, kind="stable").T.tolist()):
                for i in order[:1] if first_only else order:
                    if bounds[i, k] < best[k].least:
                        break
                    best[k].take(score(blocks[i], q, k, times), blocks[i].doc_ids, blocks[i].null_ids)

        held: list[Block] = []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if not row["doc_ids"]:
                    continue
                held.append(block_of(row, c))
                if len(held) == GROUP:
                    group(held)
                    held = []
        if held:
            group(held)
        rows = [(q.first + k, q.item_ids[k], None if null else i, s) for k, b in enumerate(best) for s, i, null in zip(b.scores.tolist(), b.ids.tolist(), b.null.tolist())]
        if rows:
            yield [list(x) for x in zip(*rows)]

    return mapped(index.select("doc_ids", "lengths", "ends", "terms", "counts"), work, FOUND)


def ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP documents (doc_id, text) for each item (item_id, text), equal scores by doc_id."""
    spark = docs.sparkSession
    out = None
    for queries in passes(items):
        shared = spark.sparkContext.broadcast(queries)
        index = saved(forward_index(docs, shared))
        corpus = spark.sparkContext.broadcast(corpus_of(index, len(queries.vocabulary)))
        first = ranked(searched(index, shared, corpus, {}, first_only=True))
        least = dict(first.filter(F.col("rank") == TOP).select("query", "score").collect())  # a row a query of the pass
        part = saved(ranked(searched(index, shared, corpus, least)).select("item_id", "rank", "doc_id", "score"))
        discard(index)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM (SELECT doc_id, {_TERMS_SQL} AS w FROM documents) WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, corpus GROUP BY term),
impacts AS (
  SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))) AS impact
  FROM tf JOIN weights USING (term) JOIN d USING (r), corpus
), scores AS (SELECT item_id, r, CAST(sum(times * impact) AS BIGINT) AS score FROM impacts JOIN q USING (term) GROUP BY item_id, r HAVING sum(times * impact) > 0),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores JOIN d USING (r))
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= {TOP}
"""

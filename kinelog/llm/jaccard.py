"""Jaccard join of word-shingle sets by chosen paths.

Each set is embedded into ``SIZE`` tokens (minimum hashes). A run deals all sets to buckets: in a bucket, each
token that passes a random test leads to a child bucket, and sets that share a token share the decision. Buckets of
up to ``LEAF`` sets are compared by brute force, larger ones are split again up to ``DEPTH`` times, unless near copies
fill them; what is still large then is compared in blocks. The number of runs follows from the target recall
at the second level; sets whose buckets are split beyond it are dealt in further runs, enough for the deepest level. Candidates are verified with
the whole shingle sets, so no false link is returned.

Sets that are equal count as one class with a number (rep) of its own and the least doc_id. A pair that meets in several buckets is
taken up in the least of them only, so links are counted without a row for each.

Defined results: texts with under five words are one shingle; null texts and texts without a word have no shingle
and no link and are classes of their own; rows with equal text share a class, under one doc_id too; rows of different sets under one doc_id are linked
each by its own set; a row with a null doc_id takes no
part in links (class null, 0 links); extra columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, groups, join_unique, mapped, saved, table
from .graph import components
from .shingles import mixed, shingle_sets, words

#: Fixed values.
LEAST = 0.8
SIZE = 64
#: Expected children of a bucket that a pair at the least similarity shares: LEAST / RATE.
RATE = 0.75
RECALL = 0.9999
LEAF, FIRST, DEPTH, BLOCK = 64, 2, 8, 512
#: A bucket with fewer different tokens at an end than this share of its sets is dense.
DENSE = 0.5
#: Pairs that agree in fewer of the tokens aren't verified: five standard deviations under LEAST.
PRUNE = 0.55
_LIMIT = np.uint64(int(2**64 / (RATE * SIZE)))


def missed(level: int, n: int) -> float:
    """Probability that n runs bring a pair at the least similarity together in no bucket of a level. Its agreeing tokens vary."""
    out = 0.0
    for k in range(SIZE + 1):
        p = 1.0
        for _ in range(level):
            p = 1 - math.exp(-k / SIZE / RATE * p)
        out += math.comb(SIZE, k) * LEAST**k * (1 - LEAST) ** (SIZE - k) * (1 - p) ** n
    return out


def runs() -> int:
    """Runs after which a pair at the least similarity was together in a bucket of level FIRST with probability RECALL."""
    return next(n for n in itertools.count(1) if missed(FIRST, n) <= 1 - RECALL)


def all_runs() -> int:
    """Runs of sets in buckets that are split beyond level FIRST.

    A pair is lost if it is never together at level FIRST in the first runs, or if it is there but parted below and in
    all runs never together at level DEPTH; both are at most 1 - RECALL.
    """
    return next(n for n in itertools.count(runs()) if missed(FIRST, runs()) + missed(DEPTH, n) <= 1 - RECALL)


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    return rng.integers(1, 2**64, SIZE, np.uint64) | np.uint64(1), rng.integers(0, 2**64, SIZE, np.uint64)


def embed(sets: list[np.ndarray]) -> np.ndarray:
    """``SIZE`` minimum hashes of each non-empty set, 32 bits each."""
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), SIZE), np.uint32)
    for i, (a, b) in enumerate(zip(*_factors())):
        out[:, i] = np.minimum.reduceat((flat * a + b) >> np.uint64(32), starts)
    return out


def identity(data: bytes) -> tuple[int, int]:
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(data), "<i8").tolist())


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with the identity of the text; a null text is the empty one."""
    return docs.withColumn("content", F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, identity of the text and of the set (two longs) and tokens (binary; null without shingles)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches):
            sets = shingle_sets([words(t) for t in batch.column(1).to_pylist()])
            full = [i for i, s in enumerate(sets) if len(s)]
            tokens: list = [None] * len(sets)
            for i, row in zip(full, embed([sets[i] for i in full]) if full else ()):
                tokens[i] = row.tobytes()
            own = [identity(s.tobytes()) for s in sets]
            yield [batch.column(0), batch.column(2), *map(list, zip(*own)), tokens]

    return mapped(identified(docs.select("doc_id", "text")), work, "doc_id long, content binary, s1 long, s2 long, tokens binary")


def _tokens(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIZE).astype(np.uint64)
    return mixed(raw | (np.arange(SIZE, dtype=np.uint64) << np.uint64(32)))


def split(rows: DataFrame, some: range | None = None) -> DataFrame:
    """(path, rep) of the children: of the roots of ``some`` runs (rows: rep, tokens), else of each row's path."""
    roots = None if some is None else mixed(np.arange(some.start + 1, some.stop + 1, dtype=np.uint64) << np.uint64(20))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                rep, tokens = part.column(0).to_numpy(), _tokens(part.column(1))
                paths = [np.full(len(rep), r) for r in roots] if roots is not None else [part.column(2).to_numpy().view(np.uint64)]
                for path in paths:
                    test = mixed(tokens ^ path[:, None])
                    row, token = np.nonzero(test < _LIMIT)
                    yield [rep[row], mixed(test[row, token] ^ path[row]).view(np.int64)]

    return mapped(rows, work, "rep long, path long")


def leaves(reps: DataFrame) -> DataFrame:
    """(path, rep, n) for each bucket of two or more sets to compare, n its size. ``reps``: rep, tokens."""
    found, deep = dealt(reps, range(runs()))
    if deep is None:
        return found
    return found.unionByName(dealt(deep, range(runs(), all_runs()))[0])


def dealt(reps: DataFrame, some: range) -> tuple[DataFrame, DataFrame | None]:
    """The buckets of ``some`` runs as in ``leaves``, and (rep, tokens) of the sets in buckets split beyond level FIRST.

    A large bucket is split again unless it is dense: if its sets have few different first or last tokens they are
    near copies of each other, which further splits would not part.
    """
    found, deep, now = None, None, saved(split(reps, some))
    for depth in range(1, DEPTH + 1):
        sizes = now.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        sized = saved(now.join(sizes, "path"))
        leaf = sized.filter(F.col("n") <= LEAF)
        found = leaf if found is None else found.unionByName(leaf)
        large = sized.filter(F.col("n") > LEAF)
        if large.isEmpty():
            return found, deep
        known = saved(large.join(reps, "rep"))
        ends = [F.approx_count_distinct(F.substring("tokens", at, 4)) for at in (1, 4 * SIZE - 3)]
        dense = known.groupBy("path").agg(F.least(*ends).alias("d"), F.count("*").alias("m")).filter(F.lit(depth == DEPTH) | (F.col("d") < DENSE * F.col("m")))
        found = found.unionByName(known.join(dense, "path", "left_semi").select("path", "rep", "n"))
        rest = known.join(dense, "path", "left_anti").select("rep", "tokens", "path")
        if depth == DEPTH or rest.isEmpty():
            return found, deep
        if depth == FIRST:  # deeper buckets hold no others
            deep = saved(rest.select("rep", "tokens").dropDuplicates(["rep"]))
        now = saved(split(rest))


def candidates(reps: DataFrame, found: DataFrame) -> DataFrame:
    """(path, i, j, rep, partners): for each set in a block of a bucket that has to be verified there, against which of
    the block's sets of larger rep, as one bit for each of the block's sets in order of rep. No pair has a row of its own.

    A bucket of more than BLOCK sets is cut into blocks by a hash; two blocks at a time meet in one task's group.
    """
    own = found.groupBy("rep").agg(F.sort_array(F.collect_list("path")).alias("paths"))  # a few dozen for each set
    cut = found.withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = (
        pairs.join(own, "rep").join(reps, "rep")
        .select("path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "tokens", "paths")
        .repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for some in groups(batches, 3):
            out: list[list] = [[], [], [], [], []]
            for g in some:
                if g.num_rows < 2:
                    continue
                path, i, j = (g.column(c)[0].as_py() for c in range(3))
                block, rep = g.column(3).to_numpy(), g.column(4).to_numpy()
                order = np.argsort(rep)
                block, rep = block[order], rep[order]
                raw = g.column(5).to_pylist()
                tokens = np.frombuffer(b"".join(raw[x] for x in order), np.uint32).reshape(-1, SIZE)
                met = earlier(path, [g.column(6)[int(x)].values.to_numpy() for x in order])
                pair = np.zeros((len(rep), len(rep)), bool)
                for a in range(len(rep) - 1):
                    ok = (tokens[a + 1 :] == tokens[a]).sum(1) >= PRUNE * SIZE
                    ok &= ~met[a, a + 1 :]
                    if i != j:
                        ok &= block[a + 1 :] != block[a]
                    pair[a, a + 1 :] = ok
                there = np.flatnonzero(pair.any(0) | pair.any(1))
                bits = np.packbits(pair[np.ix_(there, there)], axis=1)
                for a, row in zip(there.tolist(), bits):
                    for c, v in zip(out, (path, i, j, rep[a], row.tobytes())):
                        c.append(v)
            if out[0]:
                yield out

    return mapped(rows, work, "path long, i int, j int, rep long, partners binary")


def earlier(path: int, paths: list[np.ndarray]) -> np.ndarray:
    """For each two sets of a bucket, whether they also share a lesser bucket."""
    low = [p[p < path] for p in paths]
    flat = np.concatenate(low)
    if not len(flat):
        return np.zeros((len(paths), len(paths)), bool)
    names, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(paths)), list(map(len, low)))
    rank = np.cumsum(often > 1) - 1  # only what two sets share matters
    row, column = row[often[column] > 1], rank[column[often[column] > 1]]
    met = np.zeros((len(paths), len(paths)), bool)
    for k in range(0, int((often > 1).sum()), 1024):
        some = (column >= k) & (column < k + 1024)
        shared = np.zeros((len(paths), 1024), np.float32)
        shared[row[some], column[some] - k] = 1
        met |= shared @ shared.T > 0
    return met


def verified(docs: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, n): for each set of a verified link, the number of linked texts seen in a block, and an edge to the least set there.

    A class is given by one of its texts, whose doc_id other texts may share.
    """
    found = saved(found)
    needed = classes.join(found.select("rep").distinct(), "rep").select("doc_id", "content", "rep", "n_texts")
    # Grows with the documents, so both sides are shuffled at every size.
    texts = identified(docs.select("doc_id", "text")).join(needed.hint("merge"), ["doc_id", "content"]).select("rep", "text", "n_texts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches):
            found = shingle_sets([words(t) for t in batch.column(1).to_pylist()])
            yield [batch.column(0), batch.column(2), [s.view(np.int64) for s in found]]

    whole = mapped(texts, sets, "rep long, n_texts long, shingles array<long>").dropDuplicates(["rep"])
    rows = (
        found.join(whole, "rep")
        .select("path", "i", "j", "rep", "n_texts", "shingles", "partners")
        .repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for some in groups(batches, 3):
            out: list[list] = [[], [], []]
            for g in some:
                for c, v in zip(out, links(g)):
                    c.extend(v)
            if out[0]:
                yield out

    return mapped(rows, work, "a long, b long, n long")


def links(g: pa.Table) -> tuple[list, list, list]:
    order = np.argsort(g.column(3).to_numpy())
    rep, n_texts = g.column(3).to_numpy()[order], g.column(4).to_numpy()[order]
    sets, bits = g.column(5).combine_chunks(), g.column(6).to_pylist()
    if len(np.unique(rep)) != len(rep) or any(len(b) != (len(rep) + 7) // 8 for b in bits):
        raise ValueError("a block has other sets than its bits were made for")
    shingles = [sets[int(k)].values.to_numpy().view(np.uint64) for k in order]
    count, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, k in enumerate(order.tolist()):
        others = np.flatnonzero(np.unpackbits(np.frombuffer(bits[k], np.uint8), count=len(rep))).tolist()
        if not others:
            continue
        own = shingles[a]
        flat = np.concatenate([shingles[b] for b in others])
        sizes = np.array([len(shingles[b]) for b in others])
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        same = np.add.reduceat((own[place] == flat).astype(np.int64), np.append(0, np.cumsum(sizes)[:-1]))
        # same / union >= 4 / 5, in whole numbers
        for b in np.array(others)[5 * same >= 4 * (sizes + len(own) - same)].tolist():
            count[a] += n_texts[b]
            count[b] += n_texts[a]
            x, y = top(a), top(b)
            if x != y:
                low, high = (x, y) if rep[x] < rep[y] else (y, x)
                root[high] = low
    hit = np.flatnonzero(count)
    return rep[hit].tolist(), [int(rep[top(k)]) for k in hit.tolist()], count[hit].tolist()


def linked(docs: DataFrame) -> DataFrame:
    """The columns of ``near_duplicates``, the identity of the text and ``stays``: whether it is the first text of its group."""
    own = saved(sketches(docs))
    full = own.filter("tokens IS NOT NULL AND doc_id IS NOT NULL")
    texts = full.groupBy("s1", "s2", "content").agg(F.min("doc_id").alias("d"), F.count("*").alias("n"), F.first("tokens").alias("tokens"))
    classes = texts.groupBy("s1", "s2").agg(F.min(F.struct("d", "content")).alias("head"), F.count("*").alias("n_texts"), F.sum("n").alias("n"), F.first("tokens").alias("tokens"))
    classes = classes.select("s1", "s2", "n_texts", "n", "tokens", F.col("head.d").alias("doc_id"), F.col("head.content").alias("content"))
    classes = saved(classes.withColumn("rep", F.monotonically_increasing_id()))  # the numbers hold once they are written
    reps = classes.select("rep", "tokens")
    found = saved(verified(docs, classes, candidates(reps, leaves(reps))))
    near = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    heads = near.join(classes.select("rep", F.struct("doc_id", "content").alias("head")), "rep")
    near = near.join(heads.groupBy("component").agg(F.min("head").alias("head")), "component").select("rep", "head")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    known = saved(
        classes.drop("tokens").join(near, "rep", "left").join(counts, "rep", "left")
        .select("s1", "s2", "n", F.col("doc_id").alias("copy_of"), F.coalesce("head", F.struct("doc_id", "content")).alias("head"), (F.coalesce("links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"))
    )
    keyed = own.select("doc_id", "content", "s1", "s2", (F.col("tokens").isNotNull() & F.col("doc_id").isNotNull()).alias("full"))
    return (
        join_unique(keyed.filter("full"), known, "s1", "s2")
        .select("doc_id", "copy_of", F.col("head.doc_id").alias("class_id"), "n_links", "content", (F.col("head") == F.struct("doc_id", "content")).alias("stays"))
        .unionByName(keyed.filter("NOT full").select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "content", F.lit(True).alias("stays")))
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, copy_of, class_id, n_links for each row of ``docs`` (doc_id, text).

    copy_of: least doc_id with the same shingle set. class_id: least doc_id of the connected group of links.
    n_links: other texts with similarity LEAST or more. Groups whose least document is one doc_id with unlike texts share
    its name; ``representatives`` tells them apart.
    """
    return linked(docs).drop("content", "stays")


def representatives(docs: DataFrame) -> DataFrame:
    """Of each group of links the first row by doc_id and text, whole; rows with a null doc_id stay all."""
    stay = linked(docs).filter("stays AND doc_id IS NOT NULL").select("doc_id", "content").distinct()
    once = identified(docs.filter("doc_id IS NOT NULL")).join(stay, ["doc_id", "content"], "left_semi").dropDuplicates(["doc_id", "content"])
    return once.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def op3_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

"""Substring duplicates by a relative Lempel-Ziv parse.

The reference of a document is every document of smaller doc_id. The reference is indexed in blocks: the words around
each minimiser that recurs (see ``repeats``), each different block once, with the least document and place that has it. A
document's own places are looked up by their block. If a smaller document has the whole block, that is the factor's
candidate; otherwise the candidates are the other indexed blocks of the same minimiser in smaller documents, each extended
to the left and right as far as the words agree. Candidates that go on with the same words of the same reference are one
stretch. The parse then goes from left to right: of the stretches at hand the one that reaches farthest becomes a
factor, and the next begins at its end; other words are literals. At a factor's end the stretches that reach over it
are checked, so a window of two references is not missed.

Blocks of one minimiser are compared with each other in a task if they are at most ``LARGE``. If there are more, each block is
looked up by its windows instead, of which the index then holds the least document and place; only windows with a stem of
``STEM`` words around the minimiser that two documents have are written down.

Words in factors are removed. See ``repeats`` for nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import chunks, groups, join_unique, mapped, saved, table
from .repeats import RIGHT, WINDOW, Stretch
from .shingles import word_hashes, words

#: Different blocks of one minimiser that are extended against each other inside a task.
LARGE = 32
_BLOCK = ("g", "b1", "b2")


def places(found: DataFrame) -> DataFrame:
    """Saved: every place of a shared minimiser with the words before and after it in its block, and 64 bits of the minimiser (g) and 128 of the block (b1, b2)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches, 2):
            flat, ends = word_hashes([words(t) for t in batch.column(2).to_pylist()])
            shared = batch.column(3)
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                grams, at = repeats.anchors(flat[a:b])
                at = np.unique(at)
                at = at[np.isin(grams[at], shared[k].values.to_numpy().view(np.uint64))]
                for s in range(0, len(at), repeats.SLICE):
                    pos = at[s : s + repeats.SLICE]
                    same = pa.array(np.zeros(len(pos), np.int64))
                    some = repeats.block_words(flat[a:b], pos)
                    b1, b2 = (repeats.hashes_of_rows(some, some.shape[1], second)[:, 0].view(np.int64) for second in (False, True))
                    before, after = repeats.extents(some)
                    yield [batch.column(0).slice(k, 1).take(same), batch.column(1).slice(k, 1).take(same), pos, before, after, grams[pos].view(np.int64), b1, b2]

    ddl = "doc_id long, content binary, pos int, before int, after int, g long, b1 long, b2 long"
    return saved(mapped(found.filter("text IS NOT NULL").select("doc_id", "content", "text", "anchors"), work, ddl))


def reference_index(rows: DataFrame) -> DataFrame:
    """(g, b1, b2, doc_id, content, pos, n, entry), saved: each different block with its least document and place, how many places have it, and a number."""
    least = rows.groupBy(*_BLOCK).agg(F.min(F.struct("doc_id", "content", "pos")).alias("r"), F.count("*").alias("n"))
    return saved(least.select(*_BLOCK, "r.*", "n", F.monotonically_increasing_id().alias("entry")))


def with_words(found: DataFrame, index: DataFrame) -> DataFrame:
    """(entry, g, size, doc_id, pos, block), saved: the words of the indexed blocks whose minimiser has ``size`` different ones, two or more."""
    sizes = saved(index.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n")))
    wanted = join_unique(index.select("entry", "g", "doc_id", "content", "pos"), sizes, "g")
    per = wanted.groupBy("doc_id", "content").agg(F.collect_list(F.struct("entry", "g", "size", "pos")).alias("w"))  # bounded by one text
    # Rows repeated under one doc_id are one text.
    texts = found.filter("text IS NOT NULL").select("doc_id", "content", "text").join(per, ["doc_id", "content"])
    texts = texts.select("doc_id", "text", *(F.col("w")[c].alias(c) for c in ("entry", "g", "size", "pos")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches):
            flat, ends = word_hashes([words(t) for t in batch.column(1).to_pylist()])
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                entry, g, size, pos = (batch.column(c)[k].values.to_numpy() for c in range(2, 6))
                for s in range(0, len(pos), repeats.SLICE):
                    e = slice(s, s + repeats.SLICE)
                    n = len(pos[e])
                    yield [entry[e], g[e], size[e], batch.column(0).slice(k, 1).take(pa.array(np.zeros(n, np.int64))), pos[e], repeats.binaries(repeats.block_words(flat[a:b], pos[e]))]

    return saved(mapped(texts, work, "entry long, g long, size long, doc_id long, pos int, block binary"))


def extended(some: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, left, right): the longest match of block i with block j of a smaller document around their minimiser, if it has a window."""
    i, j = np.nonzero(doc[None, :] < doc[:, None])
    left = np.concatenate([repeats.agreeing(some[i[k : k + 4096], RIGHT:] == some[j[k : k + 4096], RIGHT:]) for k in range(0, len(i), 4096)] or [i])
    right = np.concatenate([repeats.agreeing(some[i[k : k + 4096], :RIGHT] == some[j[k : k + 4096], :RIGHT]) for k in range(0, len(i), 4096)] or [i])
    has_left, has_right = repeats.extents(some)
    left, right = np.minimum(left, has_left[i]), np.minimum(right, has_right[i])
    ok = left + right >= WINDOW
    return i[ok], j[ok], left[ok], right[ok]


def _ladder(before: int, after: int, left_over: int, depth: int) -> list[int]:
    """Words before the minimiser of the stretches that every window holds one of: a window with so many words left over has half of them on one side."""
    if not depth:
        return [before]
    half = -(-left_over // 2)
    return _ladder(before + half, after, left_over - half, depth - 1) + _ladder(before, after + half, left_over - half, depth - 1)


#: A window has one of these stretches of STEM words around its minimiser, given by the words before it.
STEM = WINDOW - 4
STEMS = sorted(set(_ladder(0, 0, repeats.LEFT, 3)))


def shared_lefts(crowded: DataFrame) -> DataFrame:
    """(entry, lefts): bits of the numbers of words before the minimiser for which a window of the block may be in two documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            some = repeats.numbers(batch.column(2))
            left, right = repeats.extents(some)
            stem = repeats.hashes_of_rows(some[:, repeats.IN_TEXT], STEM).view(np.int64)
            for a in STEMS:
                at = np.flatnonzero((left >= a) & (right >= STEM - a))
                if len(at):
                    yield [stem[at, repeats.LEFT - a] ^ a, batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at], np.full(len(at), sum(1 << x for x in range(a, a + 5)))]

    stems = saved(mapped(crowded.select("entry", "doc_id", "block"), work, "stem long, entry long, doc_id long, lefts long"))
    twice = stems.groupBy("stem").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low < high").select("stem", "n")
    return join_unique(stems, saved(twice), "stem").groupBy("entry").agg(F.bit_or("lefts").alias("lefts"))


def candidates(blocks: DataFrame, large: int = LARGE) -> DataFrame:
    """(entry, left, right, ref, ref_pos): for each block of the index (``with_words``) its matches with blocks of smaller documents,
    ref_pos the place of the reference's minimiser."""
    rows = blocks.filter(F.col("size") <= large).select("g", "entry", "doc_id", "pos", "block").repartition("g").sortWithinPartitions("g", "entry")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for some in groups(batches, 1):
            out: list[list] = [[] for _ in range(5)]
            for g in some:
                if g.num_rows < 2:
                    continue
                entry, doc, pos = (g.column(c).to_numpy() for c in (1, 2, 3))
                i, j, left, right = extended(repeats.numbers(g.column(4)), doc)
                keep = repeats.staircase(i, left, right, doc[j])
                i, j = i[keep], j[keep]
                for c, v in zip(out, (entry[i], left[keep], right[keep], doc[j], pos[j])):
                    c.append(v)
            if out[0]:
                yield [np.concatenate(c) for c in out]

    near = mapped(rows, work, "entry long, left int, right int, ref long, ref_pos int")
    crowded = blocks.filter(F.col("size") > large).select("entry", "doc_id", "pos", "block")
    windows = saved(repeats.block_windows(crowded.join(shared_lefts(crowded), "entry"), "lefts"))
    least = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "pos")).alias("r"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    least = saved(least.filter("last > r.doc_id").select("w1", "w2", "n", F.col("r.doc_id").alias("ref"), F.col("r.pos").alias("ref_pos")))
    far = join_unique(windows.drop("pos"), least, "w1", "w2").filter("doc_id > ref")
    # Windows that one place of a reference has all hold the minimiser, so they are one match.
    far = far.groupBy("entry", "ref", "ref_pos").agg(F.max("left").alias("left"), (WINDOW - F.min("left")).alias("right"))
    return near.unionByName(far)


def looked_up(found: DataFrame, large: int = LARGE) -> DataFrame:
    """Matches of every place, as ``repeats.cut`` takes them."""
    rows = places(found)
    index = reference_index(rows)
    matches = candidates(with_words(found, index), large).groupBy("entry").agg(F.collect_list(F.struct("left", "right", "ref", "ref_pos")).alias("found"))  # LARGE or a block's windows at most
    known = index.join(matches, "entry", "left").filter("n > 1 OR found IS NOT NULL")
    known = saved(known.select(*_BLOCK, "n", F.col("doc_id").alias("owner"), F.col("pos").alias("owner_pos"), "found"))
    own = join_unique(rows, known, *_BLOCK)
    whole = F.array(F.struct(F.col("before").alias("left"), F.col("after").alias("right"), F.col("owner").alias("ref"), F.col("owner_pos").alias("ref_pos")))
    own = own.withColumn("m", F.explode(F.when(F.col("doc_id") > F.col("owner"), whole).otherwise(F.col("found"))))
    own = own.filter(F.col("m.left") + F.col("m.right") >= WINDOW)
    return own.select("doc_id", "content", (F.col("pos") - F.col("m.left")).alias("begin"), (F.col("pos") + F.col("m.right")).alias("end"), F.col("m.ref").alias("ref"), (F.col("pos") - F.col("m.ref_pos")).alias("shift"))


def parse(stretches: list[Stretch]) -> list[Stretch]:
    """The greedy factors (start, end, ref), none overlapping, from stretches sorted by start."""
    out: list[Stretch] = []
    at, k, reach, ref = 0, 0, -1, -1
    while k < len(stretches) or reach > at:
        while k < len(stretches) and stretches[k][0] <= at:
            if stretches[k][1] > reach:
                _, reach, ref = stretches[k]
            k += 1
        if reach > at:
            out.append((at, reach, ref))
            at = reach
        elif k < len(stretches):
            at = stretches[k][0]  # literals up to here
    return out


def factors(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """For each document its factors (starts, ends, refs), the text without them and figures. Columns as in ``repeats.cut``."""
    found = repeats.candidates(docs)
    return repeats.cut(found, looked_up(found, large), parse)


def op9_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors(table(spark, sf_dir, "documents")).drop("kept_text")

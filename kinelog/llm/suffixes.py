"""Substring duplicates by a sparse suffix array.

Suffixes are retained only at minimiser positions, which the content selects, and only where the minimiser recurs in another
content. They are sorted over all partitions, by minimiser and then by their words (those that a window can reach, see
``repeats``). Neighbours are compared: the common prefix of any two suffixes is the least of the common prefixes of the neighbours between
them. From there a match is extended to the left as far as the words before the two places agree. Two suffixes
of one minimiser whose match reaches WINDOW words mark it in the document of greater doc_id; a suffix is held against all
those of its minimiser, since the one that agrees farthest to the right may not agree to the left.

A group of suffixes of one minimiser that reaches over the edge of a partition, or has more than ``LARGE`` different
blocks, can't be settled inside one task. There the suffixes from every place are retained at which a window with that
minimiser may begin, sorted over all partitions again, and neighbours with WINDOW words in common are one run that the
least document leads. A run may lie over several partitions too: each says which run it begins and ends with, and those
edges, two rows a partition, settle what the first rows can't know.

Each word in a match of WINDOW words or more with a document of smaller doc_id is marked. See ``repeats`` for nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import mapped, saved, table
from .repeats import GRAM, LEFT, RIGHT, WINDOW

#: Different blocks of one minimiser that are compared inside a task.
LARGE = 256
SURE, OPEN, EDGE = 0, 1, 2


def common_prefixes(some: np.ndarray) -> np.ndarray:
    """Words to the right that each suffix has in common with the next."""
    return repeats.agreeing(some[1:, :RIGHT] == some[:-1, :RIGHT])


def matches(some: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, left, right) for sorted suffixes of one minimiser: that of i matches that of j, of a smaller document, for WINDOW words or more."""
    n = len(some)
    least = common_prefixes(some)
    right = np.zeros((n, n), np.int64)
    for i in range(n - 1):
        right[i, i + 1 :] = np.minimum.accumulate(least[i:])
    right = np.maximum(right, right.T)
    i, j = np.nonzero(doc[None, :] < doc[:, None])
    left = repeats.agreeing(some[i, RIGHT:] == some[j, RIGHT:])
    # Beyond the text nothing agrees.
    has_left, has_right = repeats.extents(some)
    left, right = np.minimum(left, has_left[i]), np.minimum(right[i, j], has_right[i])
    ok = left + right >= WINDOW
    return i[ok], j[ok], left[ok], right[ok]


def compared(suffixes: DataFrame, large: int = LARGE) -> DataFrame:
    """Saved (kind, doc_id, content, begin, end, ref, shift, pos, block): SURE matches, and OPEN suffixes that one task can't settle."""
    # Ranges are found from a sample of the keys on the driver, so the key is short: minimisers come in order of a hash, their suffixes by words.
    rows = suffixes.select("doc_id", "content", "pos", "block", F.xxhash64(F.substring("block", 1, 8 * GRAM)).alias("g"))
    rows = rows.repartitionByRange("g", "doc_id", "pos").sortWithinPartitions("g", "block", "doc_id", "pos").drop("g")

    def settled(part: pa.Table, some: np.ndarray, edges: bool) -> Iterator[list]:
        doc, pos = part.column(0).to_numpy(), part.column(2).to_numpy().astype(np.int64)
        new = np.ones(len(doc), bool)
        new[1:] = (some[1:] != some[:-1]).any(1)
        head = np.flatnonzero(new)  # of each different block the least document
        of = head[np.cumsum(new) - 1]
        has_left, has_right = repeats.extents(some)
        hit = np.flatnonzero((doc > doc[of]) & (has_left + has_right >= WINDOW))
        found = [[hit, has_left[hit], has_right[hit], of[hit]]]
        starts = np.flatnonzero(np.append(True, (some[head[1:], :GRAM] != some[head[:-1], :GRAM]).any(1)))
        open_ = []
        for a, b in zip(starts, np.append(starts[1:], len(head))):
            own = head[a:b]
            if edges or len(own) > large:
                open_.append(own)
            elif len(own) > 1:
                i, j, left, right = matches(some[own], doc[own])
                keep = repeats.staircase(i, left, right, doc[own][j])
                found.append([own[i[keep]], left[keep], right[keep], own[j[keep]]])
        at, left, right, ref = map(np.concatenate, zip(*found))
        content, none = part.column(1).combine_chunks(), [None]
        if len(at):
            k = len(at)
            yield [np.full(k, SURE), doc[at], content.take(pa.array(at)), pos[at] - left, pos[at] + right, doc[ref], pos[at] - pos[ref], none * k, none * k]
        if open_:
            at = np.concatenate(open_)
            k, take = len(at), pa.array(at)
            yield [np.full(k, OPEN), doc[at], content.take(take), *[none * k] * 4, pos[at], part.column(3).combine_chunks().take(take)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        rest, first = None, True
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now]).combine_chunks()
            if not now.num_rows:
                continue
            some = repeats.numbers(now.column(3))
            last = np.flatnonzero(np.append(True, (some[1:, :GRAM] != some[:-1, :GRAM]).any(1)))[-1]
            if last:
                if first:  # the first group may have begun in the partition before
                    end = np.flatnonzero((some[1:, :GRAM] != some[:-1, :GRAM]).any(1))[0] + 1
                    yield from settled(now.slice(0, end), some[:end], True)
                    if end < last:
                        yield from settled(now.slice(end, last - end), some[end:last], False)
                else:
                    yield from settled(now.slice(0, last), some[:last], False)
                first = False
            rest = now.slice(last)
        if rest is not None:
            yield from settled(rest, repeats.numbers(rest.column(3)), True)

    ddl = "kind int, doc_id long, content binary, begin int, end int, ref long, shift int, pos int, block binary"
    return saved(mapped(rows, work, ddl))


def neighbours(suffixes: DataFrame) -> DataFrame:
    """(doc_id, content, pos, ref, ref_pos): each suffix (w1, w2, doc_id, content, pos) whose first window also starts in a smaller document, with the least one."""
    rows = suffixes.repartitionByRange("w1", "w2", "doc_id", "pos").sortWithinPartitions("w1", "w2", "doc_id", "pos").select("w1", "w2", "doc_id", "pos", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        run = None  # w1, w2, least doc_id and its position in the current run
        first = True  # still in the first run of this partition
        for batch in batches:
            w1, w2, doc, pos = (batch.column(c).to_numpy() for c in range(4))
            if not len(doc):
                continue
            content = batch.column(4)
            new = np.ones(len(doc), bool)
            new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            if run is not None and (w1[0], w2[0]) == run[:2]:
                new[0] = False
            begins = np.flatnonzero(new)
            number = np.cumsum(new)  # 0: the run goes on from the batch before
            head = np.append(run[2] if run else 0, doc[begins])[number]
            head_pos = np.append(run[3] if run else 0, pos[begins])[number]
            in_first = (number == (0 if run else 1)) & first
            sure = doc > head
            open_ = in_first & ~sure
            for kind, at in ((SURE, np.flatnonzero(sure)), (OPEN, np.flatnonzero(open_))):
                if len(at):
                    yield [np.full(len(at), kind), w1[at], w2[at], doc[at], pos[at], head[at], head_pos[at], content.take(pa.array(at))]
            if run is None:
                yield [[EDGE], w1[:1], w2[:1], doc[:1], pos[:1], doc[:1], pos[:1], [None]]
            first = first and not new[1 if run is None else 0 :].any()
            run = (w1[-1], w2[-1], head[-1], head_pos[-1])
        if run is not None:
            yield [[EDGE], *([v] for v in (*run, *run[2:])), [None]]

    seen = saved(mapped(rows, work, "kind int, w1 long, w2 long, doc_id long, pos int, ref long, ref_pos int, content binary"))
    edges = seen.filter(F.col("kind") == EDGE).groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "pos")).alias("low"))
    late = seen.filter(F.col("kind") == OPEN).select("w1", "w2", "doc_id", "pos", "content").join(edges, ["w1", "w2"]).filter("low.doc_id < doc_id")
    return seen.filter(F.col("kind") == SURE).select("doc_id", "content", "pos", "ref", "ref_pos").unionByName(
        late.select("doc_id", "content", "pos", F.col("low.doc_id").alias("ref"), F.col("low.pos").alias("ref_pos"))
    )


def substring_duplicates(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """For each document the marked stretches, the text without them and figures. Columns as in ``repeats.cut``."""
    found = repeats.candidates(docs)
    seen = compared(repeats.blocks(found), large)
    open_ = repeats.block_windows(seen.filter(F.col("kind") == OPEN).select("doc_id", "content", "pos", "block"))
    late = neighbours(open_.withColumn("pos", F.col("pos") - F.col("left")).drop("left"))
    sure = seen.filter(F.col("kind") == SURE).select("doc_id", "content", "begin", "end", "ref", "shift")
    late = late.select("doc_id", "content", F.col("pos").alias("begin"), (F.col("pos") + WINDOW).alias("end"), "ref", (F.col("pos") - F.col("ref_pos")).alias("shift"))
    return repeats.cut(found, sure.unionByName(late), lambda stretches: stretches)


def op2_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_duplicates(table(spark, sf_dir, "documents")).drop("kept_text")

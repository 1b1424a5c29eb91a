"""Passages that repeat across documents: what the two operators on them share.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return. A
window is ``WINDOW`` consecutive words. Its minimiser is the group of ``GRAM`` words in it with the least hash, so equal
windows have equal minimisers at the same place in them. Only minimisers that occur in two different contents can lie in a
window that does; the places of the others are never written down. The words around a place that a window with this
minimiser can reach, ``LEFT`` before it and ``RIGHT`` from it on, are its block. Rows with the text of one of smaller doc_id
are wholly marked and take no part beyond that.

Defined results for both operators: a null text has no words; texts under ``WINDOW`` words lose nothing; a row with a
null doc_id loses nothing and is nobody's reference; rows repeated under one doc_id are judged alike, and texts that differ
under one doc_id are judged each by itself, against smaller doc_ids only; equal windows are referred to the least
document; a very long text is one task's work, its places are handed on in slices; extra columns are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, join_unique, mapped, saved
from .shingles import gram_hashes, mixed, word_hashes, words

WINDOW, GRAM = 50, 16
LEFT, RIGHT = WINDOW - GRAM, WINDOW
#: Places that one text hands on at once.
SLICE = 4096


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every group of GRAM words, and for each window the place of its minimiser among them."""
    grams = gram_hashes(hashes, GRAM)
    span = WINDOW - GRAM + 1
    if len(grams) < span:
        return grams, np.empty(0, np.int64)
    return grams, np.lib.stride_tricks.sliding_window_view(grams, span).argmin(1) + np.arange(len(grams) - span + 1)


def digest(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


CONTENT, ANCHOR = 0, 1


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and the identity of the text."""
    return docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("content"))


def scan(docs: DataFrame) -> DataFrame:
    """Saved rows (kind, a, b, content, doc_id) of texts of WINDOW words or more, b the identity's first half: one with the content,
    and one for each different minimiser (a)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            contents = batch.column(2).to_pylist()
            flat, ends = word_hashes([words(t) for t in batch.column(1).to_pylist()])
            kind, first, second, whole, of = [], [], [], [], []
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                if b - a >= WINDOW:
                    grams, at = anchors(flat[a:b])
                    found = np.unique(grams[np.unique(at)]).view(np.int64)
                    half = np.frombuffer(contents[k], "<i8")[:1]
                    kind += [[CONTENT], np.full(len(found), ANCHOR)]
                    first += [half, found]
                    second.append(np.full(len(found) + 1, half[0]))
                    whole += [contents[k], *[None] * len(found)]
                    of.append(np.full(len(found) + 1, ids[k]))
            if of:
                yield [np.concatenate(kind), np.concatenate(first), np.concatenate(second), whole, np.concatenate(of)]

    return saved(mapped(identified(docs.filter("doc_id IS NOT NULL")), work, "kind int, a long, b long, content binary, doc_id long"))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, content, n_words, kept_sha256, text, anchors, copy_of), saved, a row for each of ``docs``. Texts that a smaller doc_id
    has too are copies; of the rest, text and anchors are kept only where a minimiser is in two different contents."""
    rows = scan(docs)
    content, picked = rows.filter(F.col("kind") == CONTENT), rows.filter(F.col("kind") == ANCHOR)
    owners = saved(content.groupBy("content", "b").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n")))
    several = owners.filter("last > owner").select("content", "owner", "n")
    copies = join_unique(content.select("content", "doc_id"), several, "content").filter("doc_id > owner").select("doc_id", "content", F.col("owner").alias("copy_of")).distinct()
    shared = saved(picked.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count("*").alias("n")).filter("low < high").select("a", "n"))
    own = join_unique(picked.select("a", "b"), shared, "a").groupBy("b").agg(F.collect_set("a").alias("anchors"))  # bounded by one text
    own = own.join(owners.select("b", "content", F.col("owner").alias("doc_id")), "b")
    none = F.lit(None)
    marks = own.select("doc_id", "content", "anchors", none.cast("long").alias("copy_of")).unionByName(copies.withColumn("anchors", none.cast("array<long>")))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches):
            texts = batch.column(1).to_pylist()
            split = [words(t) for t in texts]
            some, copy = (batch.column(c).is_valid().to_pylist() for c in (3, 4))
            yield [
                batch.column(0), batch.column(2), list(map(len, split)), [None if s else digest([] if c else w) for s, c, w in zip(some, copy, split)],
                [t if s else None for s, t in zip(some, texts)], batch.column(3), batch.column(4),
            ]

    ddl = "doc_id long, content binary, n_words long, kept_sha256 string, text string, anchors array<long>, copy_of long"
    whole = identified(docs).join(marks, ["doc_id", "content"], "left").select("doc_id", "text", "content", "anchors", "copy_of")
    found = saved(mapped(whole, settle, ddl))
    for done in (rows, owners, shared):
        discard(done)
    return found


def binaries(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of numbers."""
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def numbers(column: pa.Array) -> np.ndarray:
    """The rows of numbers of ``binaries``."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def block_words(own: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each place RIGHT words from it on, then LEFT words before it, the nearest first; 0 beyond the text."""
    padded = np.concatenate([np.zeros(LEFT, np.uint64), np.maximum(own, 1), np.zeros(RIGHT, np.uint64)])
    return padded[pos[:, None] + LEFT + np.concatenate([np.arange(RIGHT), -1 - np.arange(LEFT)])]


def blocks(found: DataFrame) -> DataFrame:
    """(doc_id, content, pos, block) of every place of a shared minimiser."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches, 2):
            flat, ends = word_hashes([words(t) for t in batch.column(2).to_pylist()])
            shared = batch.column(3)
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                grams, at = anchors(flat[a:b])
                at = np.unique(at)
                at = at[np.isin(grams[at], shared[k].values.to_numpy().view(np.uint64))]
                for s in range(0, len(at), SLICE):
                    pos = at[s : s + SLICE]
                    same = pa.array(np.zeros(len(pos), np.int64))
                    yield [batch.column(0).slice(k, 1).take(same), batch.column(1).slice(k, 1).take(same), pos, binaries(block_words(flat[a:b], pos))]

    return mapped(found.filter("text IS NOT NULL").select("doc_id", "content", "text", "anchors"), work, "doc_id long, content binary, pos int, block binary")


def extents(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that each block has to the left and to the right."""
    return (some[:, RIGHT:] != 0).sum(1), (some[:, :RIGHT] != 0).sum(1)


def agreeing(equal: np.ndarray) -> np.ndarray:
    """How many values at the start of the last axis are true."""
    return np.where(equal.all(-1), equal.shape[-1], (~equal).argmax(-1))


def staircase(i: np.ndarray, left: np.ndarray, right: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Of the matches of each i those that no other reaches over on both sides; of equal ones that with the least reference."""
    order = np.lexsort((ref, -right, -left, i))
    keep, now, best = [], -1, -1
    for k, (a, r) in zip(order.tolist(), zip(i[order].tolist(), right[order].tolist())):
        if a != now:
            now, best = a, -1
        if r > best:
            best = r
            keep.append(k)
    return np.array(keep, np.int64)


#: The columns of a block in the order of the text.
IN_TEXT = np.concatenate([RIGHT + np.arange(LEFT)[::-1], np.arange(RIGHT)])


def hashes_of_rows(rows: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """Hash of each ``width`` numbers in a row, for every row; a second one makes 128 bits."""
    if second:
        rows = mixed(rows ^ np.uint64(0x5851F42D4C957F2D))
    out = np.zeros((len(rows), rows.shape[1] - width + 1), np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i : i + out.shape[1]]
    return mixed(out)


def block_windows(rows: DataFrame, asked: str | None = None) -> DataFrame:
    """(w1, w2, left) and the columns of ``rows`` but block, for each window of a block that holds its place: ``left`` words of it come
    before. ``asked`` names a column of bits that says for which ``left``."""
    names = [c for c in rows.columns if c not in ("block", asked)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE):
                part = batch.slice(s, SLICE)
                some = numbers(part.column(len(names)))
                left, right = extents(some)
                start = np.arange(LEFT + 1)
                there = (start >= LEFT - left[:, None]) & (start + WINDOW <= LEFT + right[:, None])
                if asked:
                    there &= (part.column(len(names) + 1).to_numpy()[:, None] >> (LEFT - start)) & 1 > 0
                row, at = np.nonzero(there)
                text = some[:, IN_TEXT]
                w1, w2 = (hashes_of_rows(text, WINDOW, second)[row, at].view(np.int64) for second in (False, True))
                take = pa.array(row)
                yield [w1, w2, LEFT - at, *(part.column(c).take(take) for c in range(len(names)))]

    ddl = "w1 long, w2 long, left int" + "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return mapped(rows.select(*names, "block", *([asked] if asked else [])), work, ddl)


Stretch = tuple[int, int, int]


def chained(starts: np.ndarray, ends: np.ndarray, refs: np.ndarray, shifts: np.ndarray) -> list[Stretch]:
    """(start, end, ref) by start: matches that go on with the same words of the same reference, as one."""
    order = np.lexsort((ends, starts, shifts, refs))
    out: list[list[int]] = []
    last = None
    for s, e, r, d in zip(*(x[order].tolist() for x in (starts, ends, refs, shifts))):
        if last == (r, d) and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, r])
            last = r, d
    return sorted(map(tuple, out))


def cut(found: DataFrame, matches: DataFrame, chosen: Callable[[list[Stretch]], list[Stretch]]) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null where nothing went), starts, ends, refs for each document.

    ``matches``: doc_id, content, begin, end, ref, shift (how far the reference's place is to the left). ``chosen``
    picks stretches to remove.
    """
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, starts array<int>, ends array<int>, refs array<long>"
    names = ("begin", "end", "ref", "shift")
    per = matches.groupBy("doc_id", "content").agg(F.collect_list(F.struct(*names)).alias("all"))  # bounded by one text
    per = per.select("doc_id", "content", *(F.col("all")[n].alias(n) for n in names))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches, 3):
            shas, n_words, removed = batch.column(2).to_pylist(), batch.column(1).to_pylist(), [0] * batch.num_rows
            kept_text, spans = [None] * batch.num_rows, [None] * batch.num_rows
            copies = batch.column(4).to_pylist()
            for k, text in enumerate(batch.column(3).to_pylist()):
                if copies[k] is not None:
                    removed[k], kept_text[k], spans[k] = n_words[k], "", [(0, n_words[k], copies[k])]
                elif text is not None:
                    own, gone = words(text), np.zeros(n_words[k] + 1, np.int64)
                    if batch.column(5)[k].is_valid:
                        spans[k] = chosen(chained(*(batch.column(c)[k].values.to_numpy() for c in range(5, 9))))
                        for s, e, _ in spans[k]:
                            gone[s] += 1
                            gone[e] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    kept = [w for w, g in zip(own, gone.tolist()) if not g]
                    removed[k], shas[k] = int(gone.sum()), digest(kept)
                    if removed[k]:
                        kept_text[k] = b" ".join(kept).decode()
            yield [batch.column(0), batch.column(1), removed, shas, kept_text, *([None if s is None else [x[c] for x in s] for s in spans] for c in range(3))]

    whole = found.drop("anchors").join(per, ["doc_id", "content"], "left")
    return mapped(whole.select("doc_id", "n_words", "kept_sha256", "text", "copy_of", *names), work, ddl)

"""Periodic runs of words in whole texts.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) that no neighbouring word
extends, of at least MIN_WORDS words and MIN_EXPONENT periods. Two ends of a word sequence that lie q apart, no further
from each other than the sequence is long, are a square of period q. The suffix automaton has each class of sequences with the
same ends once; its end positions are gathered from the longest sequences to the shorter, the smaller ordered set into the larger,
and each pair that become neighbours on the way is looked at once. A run's last word and the one a period before it are neighbours in
the class of the run without its first period: all runs are found, each with its smallest period.

Inside a run each group of GRAM words occurs twice or more in the text, so the automaton is built of such stretches of words only; other
words can't lie in a run. Texts are independent of each other: one pass, no shuffle.

Defined results: a null text has no words and no runs, and collapses to the empty text; so does a text without words. A null doc_id is
carried through. Repeated rows are looked at row by row. A very long text is one task's work, of memory in proportion to its repeated
stretches. Runs with the same start are told apart by period. An empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, mapped, table
from .shingles import gram_hashes, mixed

MIN_WORDS, MIN_EXPONENT = 24, 3
#: Sequences whose ends can make a run: the run of MIN_WORDS with the longest period, without its first period.
LEAST = MIN_WORDS - MIN_WORDS // MIN_EXPONENT
#: Words in groups that all recur inside a run: for a period q and a length l of at least both bounds, l - 2q + 1 or less.
GRAM = MIN_WORDS - 2 * (MIN_WORDS // MIN_EXPONENT) + 1

WORD = r"([^\x20\x09-\x0D]+)"
SCHEMA = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def suffix_automaton(words: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """For each state the length of its longest sequence, the state of the next shorter class of ends, and the end it was made for (-1: a copy)."""
    length, link, own, nexts = [0], [-1], [-1], [{}]
    last = 0
    for at, word in enumerate(words):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        own.append(at)
        nexts.append({})
        state = last
        while state >= 0 and word not in nexts[state]:
            nexts[state][word] = new
            state = link[state]
        if state >= 0:
            after = nexts[state][word]
            if length[state] + 1 < length[after]:
                part = len(length)
                length.append(length[state] + 1)
                link.append(link[after])
                own.append(-1)
                nexts.append(dict(nexts[after]))
                link[after] = link[new] = part
                while state >= 0 and nexts[state].get(word) == after:
                    nexts[state][word] = part
                    state = link[state]
            else:
                link[new] = after
        last = new
    return length, link, own


def neighbour_seeds(words: Sequence[int]) -> dict[tuple[int, int], int]:
    """(start, period) -> last word found of it, for stretches that the word before doesn't extend, long enough for a run."""
    length, link, own = suffix_automaton(words)
    ends: list[list[int] | None] = [[x] if x >= 0 else [] for x in own]
    seeds: dict[tuple[int, int], int] = {}

    def seen(left: int, right: int, common: int) -> None:
        period = right - left
        if common >= (MIN_EXPONENT - 1) * period and common + period >= MIN_WORDS:
            start = left - common + 1
            if start == 0 or words[start - 1] != words[start - 1 + period]:
                seeds[start, period] = max(right, seeds.get((start, period), 0))

    for state in sorted((s for s, n in enumerate(length) if n > LEAST), key=length.__getitem__, reverse=True):
        to = link[state]
        common = length[to]
        if common < LEAST:
            ends[state] = None
            continue
        few, many = ends[state], ends[to]
        ends[state] = None
        if len(few) > len(many):
            few, many = many, few
        for end in few:
            at = bisect_left(many, end)
            if at:
                seen(many[at - 1], end, common)
            if at < len(many):
                seen(end, many[at], common)
            many.insert(at, end)
        ends[to] = many
    return seeds


def runs_of(words: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    stretches: dict[tuple[int, int], int] = {}
    for (start, period), end in neighbour_seeds(words).items():
        while end + 1 < len(words) and words[end + 1] == words[end + 1 - period]:
            end += 1
        # A stretch of this period that has a smaller one too was found with that as well.
        stretches[start, end] = min(period, stretches.get((start, end), period))
    return sorted((start, end - start + 1, period) for (start, end), period in stretches.items())


def recurring_stretches(words: np.ndarray) -> Iterator[tuple[int, int]]:
    """From and to of stretches of MIN_WORDS words or more in which each group of GRAM words occurs twice or more in the text."""
    grams = gram_hashes(mixed(words.astype(np.uint64)), GRAM)
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return
    again = np.zeros(len(grams) + 2, np.int8)
    again[order[1:][same] + 1] = 1
    again[order[:-1][same] + 1] = 1
    steps = np.diff(again)
    for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)):
        if b - a + GRAM - 1 >= MIN_WORDS:
            yield int(a), int(b) + GRAM - 1


def text_runs(words: list[bytes], ids: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """The runs of a text of these words; ``ids`` numbers the words seen so far."""
    if len(words) < MIN_WORDS:
        return []
    numbers = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    return [(a + start, size, period) for a, b in recurring_stretches(numbers) for start, size, period in runs_of(numbers[a:b].tolist())]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for those that a run holds after its first period, joined by spaces."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, size, period in runs:
            keep[start + period : start + size] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): number of words, runs by start and period, the text with each run collapsed to its first period."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in chunks(batches):
            ids: dict[bytes, int] = defaultdict(count().__next__)
            sizes, found, texts = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = text.split() if text else []
                runs = text_runs(words, ids)
                sizes.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(collapsed(words, runs))
            yield [batch.column(0), sizes, pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())]

    return mapped(docs.select("doc_id", "text"), work, SCHEMA)


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of one in ten documents repeated from some word on, as crc32 of doc_id says. A null doc_id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD))).alias("words"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    k = (3 + F.col("g") % 8).cast("int")
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / k)).cast("int"))
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), k)), F.lit(1), F.col("n") - F.col("a"))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period, compared as whole numbers; of equals the first."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def op11_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(looped(table(spark, sf_dir, "documents"))).withColumn("best", most_repeated(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )

"""Benchmark decontamination by greedy string tiling.

Tokens are runs of word characters in lower case. A document and a benchmark item that share a seed (``LEAST``
tokens in a row) are tiled: running Karp-Rabin fingerprints find the longest match that is not yet marked in
either, it is marked, and so on down to LEAST tokens. The marked part of the item is its coverage; since tiles may lie
anywhere, passages in another order are caught. A document is contaminated by an item covered at COVERAGE or more.

Items without tokens are left out first. A benchmark of at most SLICE tokens and BYTES bytes is broadcast and looked up where the documents are. The seeds of a larger one are joined
with those of the documents: documents send only seeds that pass a filter of 2 ** FILTER_BITS bits, whatever the benchmark's
size; seeds with more than one in HOT of all rows (fewer than HOT) are dealt over HOT parts; the seeds of each pair are counted before its texts are joined, and each pair of a document and an item that share a seed
is tiled by itself. Where only the verdict is wanted (``shares`` false), pairs whose seeds can't cover COVERAGE of the item are not
tiled: a tile of LEAST tokens takes one seed, so n places of seeds cover n times LEAST tokens at most. Texts are tiled whole, with memory in proportion to a text and an item.

Defined results: null texts and texts without tokens have no tile; items without tokens match nothing; an item of
under LEAST tokens must be there whole; equal items are judged each; null ids are carried through; repeated rows are
judged alike; with an empty benchmark no document is contaminated; extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, carried, chunks, mapped, saved, table
from .shingles import gram_hashes, mixed, word_hashes

#: Fixed values.
LEAST = 5
COVERAGE = 0.6
#: Tokens and bytes of a benchmark that is broadcast; the bits of the filter of a larger one.
SLICE, BYTES = 1_000_000, 64_000_000
FILTER_BITS = 26
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


class Items:
    """A slice of the benchmark: token numbers of each item and an index of the seeds."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.number: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        seeds, owners, places = defaultdict(list), defaultdict(list), defaultdict(list)
        for item, text in items:
            ids = np.array([self.number.setdefault(t, len(self.number)) for t in tokens(text)], np.int64)
            if len(ids):
                k = min(LEAST, len(ids))
                h, n = np.unique(fingerprints(ids, k), return_counts=True)
                seeds[k].append(h)
                places[k].append(n)
                owners[k].append(np.full(len(h), len(self.items)))
                self.items.append((item, ids))
        self.seeds = {}
        for k in seeds:
            h, o, n = np.concatenate(seeds[k]), np.concatenate(owners[k]), np.concatenate(places[k])
            order = np.argsort(h, kind="stable")
            self.seeds[k] = h[order], o[order], n[order]

    def numbers(self, text: str | None) -> np.ndarray:
        """Token numbers of a document, -1 for those that no item has."""
        get = self.number.get
        return np.fromiter((get(t, -1) for t in tokens(text)), np.int64)

    def seeded(self, ids: np.ndarray, least: float = 0.0) -> list[int]:
        """The items that share a seed with a document, and whose seeds in it may cover a share of them."""
        found: dict[int, int] = defaultdict(int)
        for k, (hashes, owners, places) in self.seeds.items():
            if len(ids) < k:
                continue
            known = np.append(0, np.cumsum(ids < 0))
            at = np.flatnonzero(known[k:] == known[:-k])  # only groups of known tokens
            if len(at):
                h = np.unique(fingerprints(ids, k)[at])
                low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                for a, b in zip(low[high > low].tolist(), high[high > low].tolist()):
                    for o, n in zip(owners[a:b].tolist(), places[a:b].tolist()):
                        found[o] += n * k
        return sorted(o for o, n in found.items() if n >= least * len(self.items[o][1]))


def fingerprints(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin fingerprint of each k tokens in a row."""
    return gram_hashes(mixed(ids.view(np.uint64)), k)


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the document, place in the item, length), longest first, none overlapping in either."""
    free_doc, free_item = doc >= 0, np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    length = len(item)
    while length >= least:
        matches = _matches(doc, item, free_doc, free_item, length)
        if not matches:
            # Next: the longest length at which anything matches, by halving between least and length.
            low, high = least - 1, length
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if _matches(doc, item, free_doc, free_item, mid) else (low, mid)
            length = low
            continue
        for a, b in matches:
            if free_doc[a : a + length].all() and free_item[b : b + length].all():
                tiles.append((a, b, length))
                free_doc[a : a + length] = False
                free_item[b : b + length] = False
        length -= 1
    return tiles


def _matches(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Places of equal free stretches of k tokens, in order of the document."""
    a, b = _open(free_doc, k), _open(free_item, k)
    if not len(a) or not len(b):
        return []
    x, y = fingerprints(doc, k)[a], fingerprints(item, k)[b]
    order = np.argsort(y, kind="stable")
    y, b = y[order], b[order]
    low, high = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
    return [
        (int(a[i]), int(p)) for i in np.flatnonzero(high > low).tolist() for p in b[low[i] : high[i]]
        if np.array_equal(doc[a[i] : a[i] + k], item[p : p + k])
    ]


def _open(free: np.ndarray, k: int) -> np.ndarray:
    if len(free) < k:
        return np.empty(0, np.int64)
    taken = np.append(0, np.cumsum(~free))
    return np.flatnonzero(taken[k:] == taken[:-k])


def near(doc: np.ndarray, item: np.ndarray, least: int) -> np.ndarray:
    """The stretches of a document that hold seeds of the item, parted by -1: all that tiling can use."""
    if len(doc) < least:
        return doc[:0]
    hit = np.flatnonzero(np.isin(fingerprints(doc, least), fingerprints(item, least)))
    keep = np.zeros(len(doc) + 1, np.int64)
    np.add.at(keep, hit, 1)
    np.add.at(keep, hit + least, -1)
    keep = np.cumsum(keep)[:-1] > 0
    places = np.flatnonzero(keep)
    if not len(places):
        return doc[:0]
    gaps = np.flatnonzero(np.diff(places) > 1) + 1
    return np.insert(doc[places], gaps, -1)


def coverage(doc: np.ndarray, item: np.ndarray) -> int:
    """Tokens of the item that tiles cover."""
    least = min(LEAST, len(item))
    return sum(t[2] for t in tile(near(doc, item, least), item, least))


def contaminated(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = (), shares: bool = True) -> DataFrame:
    """doc_id, n_tokens, contaminated, items (those at COVERAGE or more, sorted), max_coverage for each row of ``docs`` (doc_id, text), and columns to carry.

    ``shares`` false: only the verdict is wanted, and max_coverage is null.
    """
    held = with_tokens(benchmark)
    n_tokens, n_bytes = held.agg(F.sum("n"), F.sum(F.octet_length("text"))).first()
    small = (n_tokens or 0) <= SLICE and (n_bytes or 0) <= BYTES
    found = (looked_up if small else joined)(docs, held, carry, 0.0 if shares else COVERAGE)
    best = F.col("max_coverage") if shares else F.lit(None).cast("double").alias("max_coverage")
    return found.select("doc_id", "n_tokens", (F.size("items") > 0).alias("contaminated"), "items", best, *carry)


def with_tokens(benchmark: DataFrame) -> DataFrame:
    """The items (text, n, item_id) that have tokens, with their number."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches):
            n = pa.array([len(tokens(t)) for t in batch.column(1).to_pylist()], pa.int64())
            some = batch.filter(pc.greater(n, 0))
            yield [some.column(1), n.filter(pc.greater(n, 0)), some.column(0)]

    return mapped(benchmark.select("item_id", "text"), work, "text string, n long" + carried(benchmark, ("item_id",)))


def in_order(items: list) -> list:
    return sorted(items, key=lambda x: (x is None, x))


def looked_up(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...], least: float = 0.0) -> DataFrame:
    """The documents against a benchmark whose size was checked, broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in benchmark.select("item_id", "text").collect()])  # SLICE tokens and BYTES bytes at most, each row with a token

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        items = Items(shared.value)
        for batch in chunks(batches):
            out: list[list] = [[], [], []]
            for text in batch.column(1).to_pylist():
                ids, over, best = items.numbers(text), [], 0.0
                for k in items.seeded(ids, least):
                    item, own = items.items[k]
                    n = coverage(ids, own)
                    best = max(best, n / len(own))
                    if n >= COVERAGE * len(own):
                        over.append(item)
                for c, v in zip(out, (len(ids), in_order(over), best)):
                    c.append(v)
            yield [batch.column(0), *out, *batch.columns[2:]]

    return mapped(docs.select("doc_id", "text", *carry), work, "doc_id long, n_tokens long, items array<long>, max_coverage double" + carried(docs, carry))


def seeds_of(text: str | None, sizes: Iterator[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The different seeds of a text as 64-bit numbers, with how many places each has: of an item's own size, or of the sizes given."""
    own = word_hashes([[t.encode("utf-8", "replace") for t in tokens(text)]])[0]
    return [np.unique(gram_hashes(own, k) ^ np.uint64(k), return_counts=True) for k in ([min(LEAST, len(own))] if sizes is None else sizes) if 0 < k <= len(own)]


def joined(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...], least: float = 0.0) -> DataFrame:
    """The documents against a benchmark of any size: seeds meet in a join, then each pair is tiled."""
    own = saved(docs.select("doc_id", "text", *carry).withColumn("row", F.monotonically_increasing_id()))
    items = saved(benchmark.select("item_id", F.col("text").alias("item_text"), "n").withColumn("item", F.monotonically_increasing_id()))

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for h, n in seeds_of(text):
                    k = min(LEAST, len(tokens(text)))
                    yield [h.view(np.int64), np.full(len(h), item), np.full(len(h), k), n * k]

    seeds = saved(mapped(items.select("item", "item_text"), item_seeds, "seed long, item long, k int, reach long"))
    sizes = [r[0] for r in seeds.select("k").distinct().collect()]  # LEAST rows at most
    place = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    bits = seeds.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for at, value in bits.collect():  # no more rows than the filter has words
        table[at] = value
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for h, _ in seeds_of(text, sizes):
                    at = h >> np.uint64(64 - FILTER_BITS)
                    h = h[(shared.value.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0]
                    if len(h):
                        yield [h.view(np.int64), np.full(len(h), row)]

    some = saved(mapped(own.select("row", "text"), doc_seeds, "seed long, row long"))
    often = some.groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") * HOT > some.count())
    hot = F.broadcast(saved(often.select("seed", F.lit(True).alias("hot"))))  # fewer than HOT rows
    dealt = some.join(hot, "seed", "left").select("seed", "row", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(HOT)).cast("int")).otherwise(0).alias("salt"))
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(HOT - 1))).otherwise(F.array(F.lit(0)))
    salted = seeds.join(hot, "seed", "left").select("seed", "item", "reach", F.explode(parts).alias("salt"))
    pairs = dealt.join(salted, ["seed", "salt"]).groupBy("row", "item").agg(F.sum("reach").alias("reach"))
    texts = pairs.join(items, "item").filter(F.col("reach") >= least * F.col("n")).join(own.select("row", "text"), "row").select("row", "text", "item_id", "item_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches):
            out: list[list] = [[], [], []]
            for row, text, item, item_text in zip(*(c.to_pylist() for c in batch.columns)):
                one = Items([(item, item_text)])
                n, size = coverage(one.numbers(text), one.items[0][1]), len(one.items[0][1])
                for c, v in zip(out, (row, n / size, n >= COVERAGE * size)):
                    c.append(v)
            yield [out[0], batch.column(2), *out[1:]]

    tiled = mapped(texts, work, "row long, item_id long, share double, over boolean")
    scores = tiled.groupBy("row").agg(F.collect_list(F.when(F.col("over"), F.struct(F.col("item_id").alias("id")))).alias("over"), F.max("share").alias("best"))
    whole = own.join(scores, "row", "left").select("doc_id", "text", F.coalesce(F.col("over.id"), F.array().cast("array<long>")).alias("items"), F.coalesce("best", F.lit(0.0)).alias("best"), *carry)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches):
            yield [batch.column(0), [len(tokens(t)) for t in batch.column(1).to_pylist()], [in_order(x) for x in batch.column(2).to_pylist()], *batch.columns[3:]]

    return mapped(whole, counted, "doc_id long, n_tokens long, items array<long>, max_coverage double" + carried(docs, carry))


def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

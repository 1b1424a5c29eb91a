"""Quality rules, line first.

Each line is judged by itself (navigation, symbols, shouting, missing end punctuation, boilerplate).
Failing lines are removed. A document is rejected if it fails the base rules or if the removed lines
held more than ``MAX_LOST_PERCENT`` of its words.

A line ends well with a mark that ends sentences in any script; lines with letters of a script that has no such
mark are spared that rule. Boilerplate is learned: a line is common if it recurs in RECURS different texts and in one of SHARE. Each text
has its share of lines, so there are at most SHARE times the mean number of lines of common ones, however many
documents there are, and they are broadcast. In a text whose words are common lines for more than
``MAX_COMMON_PERCENT`` they are no boilerplate: it is a copy, which other operators handle. Lines with one
of ``BOILERPLATE`` in any case are boilerplate too, however rare: the query and the pipeline give these phrases to ``clean_lines``.

Nulls and texts without a word: all counts 0, ``base_failed`` true, ``kept`` false, clean text null for
a null text and empty otherwise. A null doc_id is carried through. Repeated rows are judged alike and count as one text.
A very long text is one task's work, of memory in proportion to it. An empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, chunks, mapped, table

#: Fixed values.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document stays if at most this share (percent) of its words was in removed lines.
MAX_LOST_PERCENT = 50
MIN_BARS = 2
#: A line of that many words is prose, whatever it ends with.
LONG_LINE = 30
MIN_SHOUTED = 3
#: Phrases of small ASCII letters and spaces.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign in to",
    "subscribe to our",
    "terms of service",
    "terms of use",
)
SYMBOLS = "#*$%&|<>"
#: Marks that end a sentence in any script (a property of Unicode), and what may follow them or stand for them.
SENTENCE_ENDS = "".join(regex.findall(r"\p{Sentence_Terminal}", "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
CLOSING = "…:;\"'”’»)）」』】》〉؛"
END_MARKS = frozenset(SENTENCE_ENDS + CLOSING)
#: Scripts without a mark at the end of a sentence.
UNMARKED = r"[\p{Thai}\p{Lao}]"
#: A line is common if it is in RECURS different texts and in one of SHARE of them.
RECURS, SHARE = 50, 1000
MAX_COMMON_PERCENT = 20

_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")
_UNMARKED = regex.compile(UNMARKED)
_LOWER, _UPPER = regex.compile(r"\p{Ll}"), regex.compile(r"\p{Lu}")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_bad_lines long, n_lost_words long"
)


def bad_line(line: str, n_words: int) -> bool:
    """Whether a line with ``n_words`` > 0 words fails one of the line rules."""
    if n_words < LONG_LINE and line.rstrip(_SPACE)[-1] not in END_MARKS and not _UNMARKED.search(line):
        return True
    if line.count("|") >= MIN_BARS or len(_SYMBOL.findall(line)) >= n_words:
        return True
    return bool(n_words >= MIN_SHOUTED and not _LOWER.search(line) and _UPPER.search(line))


def repeated_words(ids: np.ndarray) -> int:
    """Positions covered by a window of three word ids (under 2**21) that occurs twice or more."""
    if len(ids) < 4:
        return 0
    key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    covered[:-2] = hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def lowered(text: str) -> str:
    """As lower() of the SQL, a character for a character: Python makes two of İ."""
    return text.replace("İ", "i").lower()


def line_key(line: str) -> bytes:
    return hashlib.md5(line.encode("utf-8", "surrogatepass")).digest()


def common_lines(docs: DataFrame, recurs: int = RECURS, share: int = SHARE) -> frozenset[bytes]:
    """Keys of the lines that recur in many different texts: at most ``share`` times the mean number of lines of a text."""
    texts = docs.filter("text IS NOT NULL").select(F.md5("text").alias("whole"), "text")
    lines = texts.select("whole", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    often = lines.select("whole", F.unhex(F.md5("line")).alias("line")).distinct().groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= recurs)
    n_texts = texts.select("whole").distinct().count()
    return frozenset(bytes(r[0]) for r in often.filter(F.col("n") * share >= n_texts).select("line").collect())


def judge(text: str, ids: dict[bytes, int], common: frozenset[bytes] = frozenset(), phrases: tuple[str, ...] = BOILERPLATE) -> tuple:
    """The figures of one text and its clean lines. ``ids`` numbers the words seen so far, ``common`` has the keys of common lines."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    numbers = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    if len(ids) >= 1 << 21:
        numbers = np.unique(numbers, return_inverse=True)[1]
    spaces = sum(text.count(c) for c in _SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    dup = lines = bad = lost = 0
    clean = []
    parts = text.split("\n")
    sizes = [len(line.encode("utf-8", "surrogatepass").split()) for line in parts]
    shared = {line for line in set(parts) if line_key(line) in common} if common else set()
    if 100 * sum(k for line, k in zip(parts, sizes) if line in shared) > MAX_COMMON_PERCENT * n:
        shared = set()
    low = lowered(text)
    held = [p for p in phrases if p in low]
    for line, in_line in zip(parts, sizes):
        if not in_line:
            clean.append(line)
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        if line in shared or bad_line(line, in_line) or (held and any(p in lowered(line) for p in held)):
            bad += 1
            lost += in_line
        else:
            clean.append(line)
    repeat = repeated_words(numbers)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    kept = not failed and 100 * lost <= MAX_LOST_PERCENT * n
    return (n, len(text) - spaces, symbols, dup, repeat, failed, kept, lines, bad, lost), "\n".join(clean)


def clean_lines(docs: DataFrame, with_text: bool = True, carry: tuple[str, ...] = (), recurs: int = RECURS, share: int = SHARE, phrases: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): the figures, the verdict, if asked the clean text, and columns to carry.

    Lines with one of ``phrases`` go as well.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_lines(docs, recurs, share))
    ddl = SCHEMA + (", clean_text string" if with_text else "") + carried(docs, carry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches):
            ids: dict[bytes, int] = defaultdict(count().__next__)
            found, texts = [], []
            for text in batch.column(1).to_pylist():
                figures, clean = judge(text or "", ids, shared.value, phrases)
                found.append(figures)
                texts.append(None if text is None else clean)
            yield [batch.column(0), *map(list, zip(*found)), *([texts] if with_text else []), *batch.columns[2:]]

    return mapped(docs.select("doc_id", "text", *carry), work, ddl)


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents"), with_text=False, phrases=BOILERPLATE)


_W = r"'[^\x20\x09-\x0D]+'"
_ENDS_SQL = "[" + "".join(map(re.escape, sorted(END_MARKS))).replace("'", "''") + "]"


def sql(recurs: int = RECURS, share: int = SHARE, phrases: tuple[str, ...] = ()) -> str:
    held = f"\n    OR regexp_matches(lower(line), '{'|'.join(phrases)}')" if phrases else ""
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n >= 2) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, len(regexp_extract_all(line, {_W})) AS k
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
), texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL
), common AS (
  SELECT line FROM (SELECT DISTINCT text, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, {_W}) GROUP BY line
  HAVING count(*) >= {recurs} AND count(*) * {share} >= (SELECT count(*) FROM texts)
), marked AS (
  SELECT doc_id, l.line, k, c.line IS NOT NULL
    AND 100 * coalesce(sum(k) FILTER (WHERE c.line IS NOT NULL) OVER (PARTITION BY doc_id), 0) <= {MAX_COMMON_PERCENT} * sum(k) OVER (PARTITION BY doc_id) AS shared
  FROM lines l LEFT JOIN common c ON l.line = c.line WHERE k > 0
), judged AS (
  SELECT doc_id, line, k, shared
    OR (k < {LONG_LINE} AND NOT regexp_matches(line, '{_ENDS_SQL}[\x20\x09-\x0D]*$') AND NOT regexp_matches(line, '{UNMARKED}'))
    OR length(line) - length(replace(line, '|', '')) >= {MIN_BARS}
    OR length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) >= k
    OR (k >= {MIN_SHOUTED} AND NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}')){held} AS bad
  FROM marked
), per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (WHERE bad) AS n_bad_lines, coalesce(sum(k) FILTER (WHERE bad), 0) AS n_lost_words
  FROM judged GROUP BY doc_id
), figures AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(n_bad_lines, 0) AS BIGINT) AS n_bad_lines,
    CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN per USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND 100 * n_lost_words <= {MAX_LOST_PERCENT} * n_words AS kept
FROM figures
"""


#: Of ``clean_lines`` as it is called without phrases, and of the query.
ORACLE = sql()
QUERY_SQL = sql(phrases=BOILERPLATE)

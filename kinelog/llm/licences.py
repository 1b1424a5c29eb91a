"""Licence passages found by a positional index of rare words, in DataFrame operations only.

Each template is a short passage with mandatory key phrases. Document frequencies of the templates' words are counted over all files; the
index has, for each template, the places of its RARE words of highest IDF. A file looks up those of its words that are in the index.
Postings that agree on where the passage would begin are a candidate: two of a passage's, all of an exact phrase's. Of a candidate, the
words at the template's places are compared with it: it is found if PERCENT of them are the same (all of an exact phrase) and every key
phrase stands at its place. The score is the best share of same words.

All of this happens inside a file's row: no shuffle but that of the document frequencies, whose groups are the templates' words.

Defined results: a null text or one without words has no labels (empty strings), no places (null) and score 0. A null doc_id is carried
through; repeated rows are judged row by row and count in frequencies row by row. Words of equal frequency rank by themselves. A very
long text is one row's work. An empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: Words of a template that are indexed, and how many percent of its words must be there.
RARE, PERCENT = 3, 80


class Template(NamedTuple):
    label: str
    passage: str
    #: Phrases that must stand where the passage has them.
    keys: tuple[str, ...]
    #: An exact phrase: every word counts.
    exact: bool = False


def phrase(label: str, words: str) -> Template:
    return Template(label, words, (words,), True)


#: The phrases of the base.
PHRASES = (phrase("mit", "under the mit license"), phrase("apache-2", "apache license version 2"), phrase("cc-by-nc", "cc by nc"))
#: Passages of licences and of the notices that name them.
PASSAGES = (
    Template("agpl-3", "the terms of the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    Template("apache-2", "spdx license identifier apache 2 0", ("license identifier apache 2",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", ("to endorse or promote products",)),
    Template("bsl-1", "distributed under the boost software license version 1 0", ("boost software license version 1",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "to the extent possible under law has waived all copyright and related or neighboring rights", ("waived all copyright",)),
    Template("epl-2", "made available under the terms of the eclipse public license 2 0", ("eclipse public license 2",)),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("mit", "spdx license identifier mit", ("license identifier mit",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("in no event will the authors",)),
)
TEMPLATES = PHRASES + PASSAGES

#: A candidate in one number: the template, then where the passage begins, moved up so that it isn't negative.
_SPAN, _MOVED = 1 << 32, 1 << 10


def places_of(words: list[str], part: list[str]) -> int:
    """Where ``part`` first stands in ``words``."""
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)


def index_of(templates: Sequence[Template], frequency: dict[str, int]) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Postings (template, place) of the rarest words, and how many of a template's postings must agree. Words that no file has are left out."""
    postings: dict[str, list[tuple[int, int]]] = {}
    needs = []
    for t, template in enumerate(templates):
        words = template.passage.split()
        rare = sorted((w for w in set(words) if frequency.get(w)), key=lambda w: (frequency[w], w))[:RARE]
        at = [(w, i) for i, w in enumerate(words) if w in rare]
        for w, i in at:
            postings.setdefault(w, []).append((t, i))
        needs.append(len(at) if template.exact else min(2, len(at)))
    return postings, needs


def words_of(text: str) -> Column:
    """Words with A-Z lower-cased. Lower-casing makes an ASCII letter of one other character, the Kelvin sign; it is replaced before."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\u212a"), F.lit("\u212b"))), F.lit(WORD))


def frequencies(docs: DataFrame, templates: Sequence[Template]) -> dict[str, int]:
    """In how many rows each word of the templates stands: at most a row for each of these words."""
    known = sorted({w for t in templates for w in t.passage.split()})
    found = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, known)), words_of("text"))).alias("word"))
    return {r[0]: r[1] for r in found.groupBy("word").count().collect()}


def _template_columns(templates: Sequence[Template], needs: list[int]) -> Column:
    def strings(words: list[str]) -> Column:
        return F.array(*map(F.lit, words))

    rows = []
    for t, need in zip(templates, needs):
        words = t.passage.split()
        keys = F.array(*(F.struct(F.lit(places_of(words, k.split())).alias("at"), strings(k.split()).alias("words")) for k in t.keys))
        least = len(words) if t.exact else -(-PERCENT * len(words) // 100)
        rows.append(F.struct(F.lit(t.label).alias("label"), F.lit(t.exact).alias("exact"), strings(words).alias("words"), F.lit(least).alias("least"), F.lit(need).alias("need"), keys.alias("keys")))
    return F.array(*rows)


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and the passages found (label, exact, start, score) for each row of ``docs`` (doc_id, text)."""
    postings, needs = index_of(templates, frequencies(docs, templates))
    nothing = F.array().cast("array<struct<label:string,exact:boolean,start:bigint,score:double>>")
    rows = docs.select("doc_id", words_of("text").alias("words"))
    n_words = F.size("words").cast("long").alias("n_words")
    if not postings:
        return rows.select("doc_id", n_words, nothing.alias("found"))
    looked_up = F.create_map(*(x for w, at in postings.items() for x in (F.lit(w), F.array(*(F.lit(t * _SPAN + _MOVED - i) for t, i in at)))))
    known = _template_columns(templates, needs)
    # Where the file's indexed words stand, then what their postings say of the passage's beginning.
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*postings), i)), lambda i: i.isNotNull())
    has = F.arrays_overlap("words", F.array(*map(F.lit, postings)))
    rows = rows.withColumn("at", F.when(has, at).otherwise(F.array().cast("array<int>")))
    codes = F.flatten(F.transform("at", lambda i: F.transform(F.element_at(looked_up, F.element_at("words", i + 1)), lambda p: p + i)))
    rows = rows.withColumn("codes", F.sort_array(codes))
    template = lambda code: F.element_at(known, F.shiftright(code, 32).cast("int") + 1)
    agreed = lambda code, i: F.try_element_at("codes", F.greatest(i + 2 - template(code)["need"], F.lit(-1)).cast("int")) == code
    first = lambda code, i: i + 1 >= template(code)["need"]
    rows = rows.withColumn("begins", F.when(F.size("codes") > 0, F.array_distinct(F.filter("codes", lambda c, i: first(c, i) & agreed(c, i)))))

    def compared(code: Column) -> Column:
        start = code.bitwiseAND(_SPAN - 1) - _MOVED
        there = F.slice("words", F.greatest(start + 1, F.lit(1)).cast("int"), F.size(template(code)["words"]))
        same = F.size(F.filter(F.zip_with(there, template(code)["words"], lambda a, b: a.eqNullSafe(b)), lambda x: x))
        keys = F.forall(template(code)["keys"], lambda k: F.slice("words", F.greatest(start + 1 + k["at"], F.lit(1)).cast("int"), F.size(k["words"])) == k["words"])
        fits = (start >= 0) & (same >= template(code)["least"]) & keys
        return F.when(fits, F.struct(template(code)["label"].alias("label"), template(code)["exact"].alias("exact"), start.alias("start"), (same / F.size(template(code)["words"])).alias("score")))

    found = F.filter(F.transform("begins", compared), lambda x: x.isNotNull())
    return rows.select("doc_id", n_words, F.when(F.size("begins") > 0, found).otherwise(nothing).alias("found"))


def op12_rare_word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    def labels(found: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")

    rows = scan(table(spark, sf_dir, "documents")).withColumn("base", F.filter("found", lambda x: x["exact"]))
    starts = F.transform("base", lambda x: x["start"])
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def oracle(templates: Sequence[Template] = TEMPLATES) -> str:
    """The same by joins of all words with all words of the templates, for DuckDB."""
    words, keys = [], []
    for t, template in enumerate(templates):
        own = template.passage.split()
        words += [f"({t}, {i}, '{w}')" for i, w in enumerate(own)]
        for k in template.keys:
            at = places_of(own, k.split())
            keys += [f"({t}, {at + i}, '{w}')" for i, w in enumerate(k.split())]
    sizes = Counter(t for t, x in enumerate(templates) for _ in x.passage.split())
    about = [f"({t}, '{x.label}', {str(x.exact).lower()}, {sizes[t]}, {sizes[t] if x.exact else -(-PERCENT * sizes[t] // 100)})" for t, x in enumerate(templates)]
    pattern = WORD.replace("'", "''")
    return f"""
WITH about(t, label, exact, size, least) AS (VALUES {', '.join(about)}),
tw(t, i, word) AS (VALUES {', '.join(words)}),
key_words(t, i, word) AS (VALUES {', '.join(keys)}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}') AS w FROM documents
), dw AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
df AS (SELECT word, count(DISTINCT r) AS n FROM dw WHERE word IN (SELECT word FROM tw) GROUP BY word),
rare AS (
  SELECT t, word FROM (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY n, word) AS k FROM (SELECT DISTINCT t, word FROM tw) JOIN df USING (word))
  WHERE k <= {RARE}
), post AS (SELECT t, i, word FROM tw JOIN rare USING (t, word)),
needs AS (SELECT t, CASE WHEN exact THEN count(*) ELSE least(2, count(*)) END AS need FROM post JOIN about USING (t) GROUP BY t, exact),
begins AS (
  SELECT r, t, pos - i AS start FROM dw JOIN post USING (word) JOIN needs USING (t) GROUP BY r, t, pos - i, need HAVING count(*) >= need AND pos - i >= 0
), same AS (
  SELECT b.r, b.t, b.start, count(dw.word) AS same FROM begins b JOIN tw USING (t) LEFT JOIN dw ON dw.r = b.r AND dw.pos = b.start + tw.i AND dw.word = tw.word
  GROUP BY b.r, b.t, b.start
), lacking AS (
  SELECT DISTINCT b.r, b.t, b.start FROM begins b JOIN key_words USING (t) LEFT JOIN dw ON dw.r = b.r AND dw.pos = b.start + key_words.i AND dw.word = key_words.word
  WHERE dw.word IS NULL
), found AS (
  SELECT r, label, exact, start, same / size AS score FROM same JOIN about USING (t) ANTI JOIN lacking USING (r, t, start) WHERE same >= least
)
SELECT d.doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE exact) AS n_base,
  CAST(min(start) FILTER (WHERE exact) AS BIGINT) AS first_word, CAST(max(start) FILTER (WHERE exact) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0.0) AS score
FROM d LEFT JOIN found USING (r) GROUP BY d.r, d.doc_id
"""


ORACLE = oracle()

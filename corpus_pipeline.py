"""The corpus pipeline: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs
of the next. All but the last return the columns of documents. Columns beyond these are dropped at the start, so
that names can't clash. A null text fails the quality rules; a row with a null doc_id has no near duplicates; rows
repeated under one doc_id stay once, texts that differ under one doc_id are documents of their own; an empty table stays
empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelog.llm import decontamination, jaccard, personal, quality, sentencepieces
from kinelog.llm.common import discard, saved, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_text(found: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another text and its length."""
    return found.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the quality rules go, and documents that are rejected."""
    found = quality.clean_lines(docs.select(*COLUMNS), carry=("lang", "source"), phrases=quality.BOILERPLATE)
    return with_text(found.filter("kept"), "clean_text")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least doc_id stays. Texts of one group under that doc_id are one document."""
    docs = docs.select(*COLUMNS)
    return jaccard.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item, in any order, go."""
    docs = docs.select(*COLUMNS).withColumn("own_text", F.col("text"))
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), carry=("own_text", "lang", "source", "n_chars"))
    return found.filter("NOT contaminated").select("doc_id", F.col("own_text").alias("text"), "lang", "source", "n_chars")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return with_text(personal.find(docs.select(*COLUMNS), with_text=True, carry=("lang", "source")), "redacted_text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of them and of the decoded text."""
    return sentencepieces.encode_texts(docs.select(*COLUMNS), public_tokenizers.path(sentencepieces.MODEL), with_ids=True)


STAGES = [("quality", clean), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("personal_data", redact), ("encoding", encode)]

#: SQL can't express the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch() as tables:
            done = saved(stage(spark, docs, sf_dir))
            tables.remove(done)
        if docs is not given:
            discard(docs)
        docs = done
    return docs

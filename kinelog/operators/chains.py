"""Linked lists: the place of each row in a list whose rows name their next one, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, written


def ranked(rows: DataFrame, node: str = "token", after: str = "next") -> DataFrame:
    """(node, head, rank): the first row of each row's list and the steps from there, 0 for the first.

    A round doubles the steps that each open row looks back, so lists of n rows take log n rounds of one join each; a row that has met its head is
    done. A null or empty ``after``, or one that no row has, ends a list. Of several rows with the same next the least one is before it, and the lists of
    the others end there. Rows of a ring have neither head nor rank. Repeated and null nodes: a node is taken once, a null one is left out.
    """
    links = rows.filter(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(after).alias("_next")).groupBy("node").agg(F.min("_next").alias("_next"))
    before = links.filter("_next IS NOT NULL").groupBy(F.col("_next").alias("node")).agg(F.min("node").alias("back"))
    first = F.col("back").isNull()
    state = written(links.select("node").join(before, "node", "left").select("node", "back", F.when(first, F.col("node")).alias("head"), F.when(first, 0).otherwise(1).cast("long").alias("rank")))
    left = state.filter("head IS NULL").count()
    while left:
        done, going = state.filter("head IS NOT NULL"), state.filter("head IS NULL")
        seen = state.select(F.col("node").alias("back"), F.col("back").alias("_back"), F.col("head").alias("_head"), F.col("rank").alias("_rank"))
        step = going.join(seen, "back").select("node", F.col("_back").alias("back"), F.col("_head").alias("head"), (F.col("rank") + F.col("_rank")).alias("rank"))
        old, state = state, written(done.unionByName(step))
        discard(old)
        total, now = state.agg(F.count("*"), F.count(F.when(F.col("head").isNull(), True))).first()
        # All that are left look back farther than there are rows: rings.
        if now == left and not state.filter((F.col("head").isNull()) & (F.col("rank") <= total)).count():
            break
        left = now
    ring = F.col("head").isNull()
    return state.select(F.col("node").alias(node), "head", F.when(~ring, F.col("rank")).alias("rank"))

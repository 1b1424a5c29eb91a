"""Sketches stored by group and merged later, so that coarser groups are answered without reading rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of a sketch's buckets: the relative standard error of a count is about 0.8 / sqrt(2 ** LOG_BUCKETS), 0.7 percent.
LOG_BUCKETS = 14


def distinct_sketches(rows: DataFrame, by: Sequence[str], value: str, log_buckets: int = LOG_BUCKETS) -> DataFrame:
    """(``by``, n, sketch) of each group: its rows, and a sketch of the different values, of a bounded size. Nulls are no value."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(value, log_buckets).alias("sketch"))


def rolled_up(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(``by``, level, n, n_distinct) of all prefixes of ``by`` out of stored sketches; ``level`` is the number of columns that count, the others are null."""
    level = (len(by) - sum(F.grouping(c) for c in by)).cast("int").alias("level")
    return sketches.rollup(*by).agg(level, F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))

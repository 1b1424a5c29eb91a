"""Nearest vectors of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Queries that are broadcast at a time.
BLOCK = 4096


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, distance, rank): the k nearest rows of each query but itself, by distance and key.

    Each task keeps its own k best of each query, so what is shuffled is k rows for each query and task. Queries come in blocks; of
    more than one, each is answered and written down before the next, so that one block is held at a time. Rows and queries without
    key or vector take no part, and a repeated query is asked once.
    """
    found, last = None, None
    rows = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    ordered = queries.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector).dropDuplicates([key]).orderBy(key)
    while True:
        some = ordered if last is None else ordered.filter(F.col(key) > last)
        block = some.limit(BLOCK).collect()
        if not block:
            break
        last = block[-1][0]
        ids = np.array([r[0] for r in block])
        sent = rows.sparkSession.sparkContext.broadcast((ids, np.array([r[1] for r in block], np.float64)))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, points = sent.value
            best = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
            for batch in batches:
                own = batch.column(0).to_numpy()
                all_ = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64) if len(own) else np.empty((0, points.shape[1]))
                for q, point in enumerate(points):
                    d = np.sqrt(((all_ - point) ** 2).sum(1))
                    keep = own != ids[q]
                    d, o = np.append(best[q][0], d[keep]), np.append(best[q][1], own[keep])
                    order = np.lexsort((o, d))[:k]
                    best[q] = d[order], o[order]
            n = [len(d) for d, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([o for _, o in best])), pa.array(np.concatenate([d for d, _ in best]))], names=["query_id", key, "distance"])

        part = rows.select(key, vector).mapInArrow(work, f"query_id long, {key} long, distance double")
        if found is None and len(block) < BLOCK:
            found = part
            break
        part = written(part)
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
        if len(block) < BLOCK:
            break
    if found is None:
        return rows.sparkSession.createDataFrame([], f"query_id long, {key} long, distance double, rank int")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))).filter(F.col("rank") <= k)

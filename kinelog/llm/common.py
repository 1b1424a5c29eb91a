"""What the corpus operators share: tables, scratch tables, batches of whole texts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters of text that a Python worker takes up at once. A longer text is a chunk of its own.
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. One of our own only where the session names none and runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kinelog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SCOPES: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """What ``saved`` writes inside is deleted at the end, but for the tables taken out of the list."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        for df in _SCOPES.pop():
            discard(df)


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinelog-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``saved`` wrote, once nothing will read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than one in so many of all rows is joined by broadcast. Fewer keys than this can be.
HOT = 64


def join_unique(many: DataFrame, few: DataFrame, *keys: str) -> DataFrame:
    """Inner join of ``many`` with ``few``, saved, one row for each key, whose n is the number of rows of ``many`` under it or more.

    Keys with more than one in HOT of these rows would meet in one task; they are fewer than HOT, so their rows of ``few`` are broadcast.
    """
    total = few.agg(F.sum("n")).first()[0] or 0
    names, more = list(keys), [c for c in few.columns if c not in (*keys, "n")]
    hot, rest = few.filter(F.col("n") * HOT > total), few.filter(F.col("n") * HOT <= total)
    marked = many.join(F.broadcast(hot.select(*names, F.struct(F.lit(True).alias("hot"), *more).alias("_found"))), names, "left")
    joined = marked.filter("_found IS NOT NULL").select(*names, *(c for c in many.columns if c not in names), *(F.col("_found")[c].alias(c) for c in more))
    return joined.unionByName(marked.filter("_found IS NULL").drop("_found").join(rest.drop("n"), names))


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes in the text column, or one row."""
    for batch in batches:
        start, size = 0, 0
        column = batch.column(text)
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[Sequence]], ddl: str) -> DataFrame:
    """mapInArrow with ``work`` giving, for each batch of rows, one list or array for each column of ``ddl``."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return df.mapInArrow(run, ddl)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.Table]]:
    """The complete groups of rows that are sorted by the first ``keys`` columns, some at a time. A group is bounded."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]) if rest is not None else now
        if not now.num_rows:
            continue
        cuts = _cuts(now, keys)
        yield [now.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]
        rest = now.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield [rest]


def _cuts(rows: pa.Table, keys: int) -> list[int]:
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in range(keys):
        c = rows.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new).tolist()


def carried(docs: DataFrame, names: Sequence[str]) -> str:
    """DDL of columns that an operator hands on unchanged, after its own."""
    return "".join(f", `{n}` {docs.schema[n].dataType.simpleString()}" for n in names)

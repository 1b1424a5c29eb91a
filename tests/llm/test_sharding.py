import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinelog.llm import sharding as S


def brute(supply, capacity, cost):
    """Least cost of a tiny instance: every way to send each unit."""
    units = [i for i, s in enumerate(supply) for _ in range(s)]
    best = None
    for way in itertools.product(range(len(capacity)), repeat=len(units)):
        if all(n <= capacity[j] for j, n in Counter(way).items()):
            c = sum(cost[i][j] for i, j in zip(units, way))
            best = c if best is None else min(best, c)
    return best


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 2) for _ in range(n)]
        capacity = [rng.randint(0, 4) for _ in range(m)]
        cost = [[rng.randint(0, 5) for _ in range(m)] for _ in range(n)]
        if sum(supply) > sum(capacity):
            with pytest.raises(ValueError):
                S.min_cost_flow(supply, capacity, cost)
            continue
        flow = S.min_cost_flow(supply, capacity, cost)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == supply
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= capacity[k] for k in range(m))
        assert sum(cost[i][j] * v for (i, j), v in flow.items()) == brute(supply, capacity, cost)


def test_query_is_whole_even_and_gapless(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = S.op1_flow_reshard(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= max(r["size"] for r in rows)


def test_nulls_repeats_and_empty_table(spark):
    kind = "doc_id long, text string, shard int, block int"
    docs = spark.createDataFrame([(1, "é", 0, 9), (1, "é", 0, 9), (None, None, 1, 9), (2, "", None, 9)], kind)
    rows = S.with_blocks(docs, F.coalesce("shard", F.lit(0)), F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    got = S.reshard(rows, 2).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 3, 3]
    assert len({(r.new_shard, r.slot) for r in got}) == 4
    assert S.reshard(rows.limit(0), 2).count() == 0


def test_files_of_changed_shards_are_rewritten(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 2 + 1).alias("shard"))
    docs.write.partitionBy("shard").parquet(f"{tmp_path}/old")
    total = docs.agg(F.sum(F.length("text") + 1)).first()[0]
    moved = S.rewrite(f"{tmp_path}/old", spark, [total // 2, total, total], f"{tmp_path}/new")
    got = {(r.old_shard, r.new_shard): r.bytes for r in moved.collect()}
    assert {k[0] for k in got} == {0}  # only the shard that is too large gives
    new = spark.read.parquet(f"{tmp_path}/new")
    touched = {0, *(k[1] for k in got)}
    assert {r[0] for r in new.select("shard").distinct().collect()} == touched
    kept = docs.filter(F.col("shard").isin(*touched)).select("doc_id", "text")
    assert new.select("doc_id", "text").exceptAll(kept).count() == 0 and new.count() == kept.count()


def test_rewriting_carries_columns_of_any_name(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), (F.col("id") * 2).alias("block"), F.lit("o").alias("old_shard"), F.lit(1.5).alias("new_shard"), F.lit(True).alias("first_slot"), F.when(F.col("id") < 250, 0).otherwise(1).alias("shard"))
    docs.write.partitionBy("shard").parquet(f"{tmp_path}/old")
    S.rewrite(f"{tmp_path}/old", spark, [1500, 1500], f"{tmp_path}/new")
    new = spark.read.parquet(f"{tmp_path}/new")
    assert set(new.columns) == set(docs.columns)
    names = [c for c in docs.columns if c != "shard"]
    assert new.select(*names).exceptAll(docs.select(*names)).count() == 0 and new.count() == 300


def test_blocks_follow_from_the_bytes():
    assert S.block_count(0, 12) == S.block_count(10**12, 12) == 512
    assert 25_000 < S.block_count(10**14, 12) <= S.MOST_BLOCKS == S.block_count(10**16, 12)


@pytest.mark.parametrize("kind", ["all null", "one id", "one text", "one row"])
def test_shards_are_even_whatever_repeats(spark, kind, tmp_path):
    ids = {"all null": "CAST(NULL AS LONG)", "one id": "IF(id % 2 = 0, 7, id)", "one text": "id", "one row": "IF(id % 2 = 0, 7, id)"}[kind]
    text = {"one text": "repeat('x', 80)", "one row": "IF(id % 2 = 0, repeat('x', 80), CONCAT(repeat('y', 78), id))"}.get(kind, "CONCAT(repeat('y', 78), id)")
    docs = spark.range(20_000).selectExpr(f"{ids} AS doc_id", f"{text} AS text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    rows = S.with_blocks(docs, F.lit(0), size)
    shards = S.reshard(rows, 16).groupBy("new_shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    mean = sum(r.bytes for r in shards) / 16
    assert len(shards) == 16 and max(r.bytes for r in shards) < 1.05 * mean and all(r.last == r.n - 1 for r in shards)
    docs.withColumn("shard", F.lit(0)).write.partitionBy("shard").parquet(f"{tmp_path}/old")
    total = int(16 * mean)
    S.rewrite(f"{tmp_path}/old", spark, [total // 4 + 1] * 4, f"{tmp_path}/new")
    new = spark.read.parquet(f"{tmp_path}/new")
    assert new.select("doc_id", "text").exceptAll(docs).count() == 0 and new.count() == 20_000
    assert max(r.bytes for r in new.groupBy("shard").agg(F.sum(size).alias("bytes")).collect()) < 1.05 * total / 4

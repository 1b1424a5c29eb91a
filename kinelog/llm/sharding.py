"""Resharding by minimum-cost flow.

Rows lie in old shards. Each old shard is cut into a fixed number of blocks by a hash of doc_id and text. Rows that are alike in all of these and
together exceed a block's mean size are dealt over the blocks by their place in the files. What the
driver sees is a table of blocks (bounded by shards times blocks, never by rows). A minimum-cost flow from
old shard sizes to new capacities says how many bytes go from where to where, moving the fewest bytes; the
flow is then filled with whole blocks. Rows learn their new shard from the plan, a table of that same bound.

Defined results: a null text counts 1 byte and has the crc32 of the empty text; a null doc_id or source is a
value like any other; repeated rows take slots of their own, and a few of them share a block while many are dealt out; an empty table gives an
empty plan; blocks of equal size are placed by shard and number; a very long text is one row of one block; extra columns
are not looked at, and ``rewrite`` carries them through, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, table

N_OLD, N_NEW = 12, 16
#: Blocks of one old shard: the least and the most, and the bytes that one should have between these. The plan has at most
#: MOST_BLOCKS rows for each old shard.
BLOCKS, MOST_BLOCKS, BLOCK_BYTES = 512, 32768, 256 << 20


def block_count(total: int, n_old: int) -> int:
    """Blocks of an old shard for a number of bytes in all."""
    return min(MOST_BLOCKS, max(BLOCKS, -(-total // (n_old * BLOCK_BYTES))))


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Bytes from each source to each sink at the least total cost: successive shortest paths with potentials.

    The graph has one node for each shard, so its size doesn't depend on the rows.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new capacities don't hold all bytes")
    n, m = len(supply), len(capacity)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, room, height = list(supply), list(capacity), [0] * (n + m)
    while any(left):
        far = [float("inf")] * (n + m)
        came: list[int | None] = [None] * (n + m)
        queue = [(0, i) for i in range(n) if left[i]]
        for _, i in queue:
            far[i] = 0
        heapq.heapify(queue)
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            edges = ((n + j, cost[u][j]) for j in range(m)) if u < n else ((i, -cost[i][u - n]) for i in range(n) if flow[i, u - n])
            for v, c in edges:
                if d + (step := c + height[u] - height[v]) < far[v]:
                    far[v], came[v] = d + step, u
                    heapq.heappush(queue, (far[v], v))
        end = min((j for j in range(m) if room[j]), key=lambda j: (far[n + j] + height[n + j], j)) + n
        height = [h + min(f, far[end]) for h, f in zip(height, far)]
        path, v = [], end
        while v is not None:
            path.append(v)
            v = came[v]
        path.reverse()
        amount = min(left[path[0]], room[end - n], *(flow[v, u - n] for u, v in zip(path, path[1:]) if u >= n))
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[u, v - n] += amount
            else:
                flow[v, u - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return {k: v for k, v in flow.items() if v}


def fill(blocks: list[tuple[int, int, int, int]], flow: dict[tuple[int, int], int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """New shard of each block (old shard, block, bytes, rows): large blocks first, each where most of the flow is still open.

    Once the flow of an old shard is used up to less than a block, the new shard with the most room takes it.
    """
    open_flow, room, placed = dict(flow), list(capacity), {}
    sinks = defaultdict(list)
    for i, j in flow:
        sinks[i].append(j)
    for old, block, size, _ in sorted(blocks, key=lambda b: (-b[2], b[0], b[1])):
        best = max(sinks[old], key=lambda j: (open_flow[old, j], -j))
        if open_flow[old, best] < size:
            best = max(range(len(room)), key=lambda j: (room[j], -j))
        open_flow[old, best] = open_flow.get((old, best), 0) - size
        room[best] -= size
        placed[old, block] = best
    return placed


#: What rows must share to be alike.
ALIKE = ("doc_id", "text_crc32", "size", "old_shard")


def many_alike(rows: DataFrame, blocks: int) -> DataFrame:
    """(ALIKE) of the rows (ALIKE) whose repeats exceed an old shard's mean block: at most as many as there are blocks."""
    total, n_old = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.countDistinct("old_shard")).first()
    alike = rows.groupBy(*ALIKE).agg(F.count("*").alias("n"))
    return F.broadcast(alike.filter((F.col("n") > 1) & (F.col("n") * F.col("size") * max(1, n_old) * blocks > total)).select(*(F.col(c).alias(f"_{c}") for c in ALIKE)))


def in_blocks(rows: DataFrame, place: Column, blocks: int) -> DataFrame:
    """``rows`` (ALIKE and more) with their block. ``place`` tells rows that are alike from each other; it must not change when a task runs again."""
    many = many_alike(rows.select(*ALIKE), blocks)
    marked = rows.withColumn("_place", place).join(many, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ALIKE], "left")
    salt = F.when(F.col("_size").isNotNull(), F.col("_place")).otherwise(F.lit(0))
    return marked.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1), "text_crc32", "size", salt), F.lit(blocks)).cast("int")).drop("_place", *(f"_{c}" for c in ALIKE))


def described(old_shard: Column, size: Column) -> list[Column]:
    """doc_id, size, crc32 of the text and old shard of each row."""
    return [F.col("doc_id"), size.cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), old_shard.cast("int").alias("old_shard")]


def with_blocks(docs: DataFrame, old_shard: Column, size: Column, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, crc32 of the text, old shard and block of each row, written down, so that a row stays in its block."""
    return saved(in_blocks(docs.select(*described(old_shard, size)), F.monotonically_increasing_id(), blocks))


def plan(rows: DataFrame, capacity: list[int] | int) -> DataFrame:
    """old_shard, block, new_shard, first_slot for each block of ``rows`` (old_shard, block, size).

    ``capacity``: bytes for each new shard, or a number of shards that get equal parts.
    """
    spark = rows.sparkSession
    sums = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    blocks = [tuple(r) for r in sums.collect()]  # at most shards times BLOCKS rows, however many rows there are
    total = sum(b[2] for b in blocks)
    if isinstance(capacity, int):
        capacity = [total // capacity + (j < total % capacity) for j in range(capacity)]
    olds = sorted({b[0] for b in blocks})
    supply = [sum(b[2] for b in blocks if b[0] == i) for i in olds]
    cost = [[int(i != j) for j in range(len(capacity))] for i in olds]
    flow = {(olds[i], j): v for (i, j), v in min_cost_flow(supply, capacity, cost).items()}
    placed, slots, out = fill(blocks, flow, capacity), defaultdict(int), []
    for old, block, _, n in sorted(blocks):
        new = placed[old, block]
        out.append((old, block, new, slots[new]))
        slots[new] += n
    return spark.createDataFrame(out, "old_shard int, block int, new_shard int, first_slot long")


def reshard(rows: DataFrame, capacity: list[int] | int) -> DataFrame:
    """``rows`` with new_shard and a gapless slot in it. Slots are counted inside blocks, so no task holds a whole shard."""
    moves = F.broadcast(plan(rows, capacity))  # bounded as the plan is
    inside = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("in_block", F.row_number().over(inside) - 1)
        .join(moves, ["old_shard", "block"])
        .withColumn("slot", F.col("first_slot") + F.col("in_block"))
        .drop("in_block", "first_slot")
    )


def rewrite(docs_path: str, spark: SparkSession, capacity: list[int], out_path: str) -> DataFrame:
    """Carries out a plan on files under ``docs_path``/shard=K/: rewrites the shards that give or take blocks into
    ``out_path`` and returns those transfers (old_shard, new_shard, blocks, bytes). Shards without a transfer stay
    where they are; the caller swaps the rewritten ones in.
    """
    docs = spark.read.parquet(docs_path)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    n_old, total = docs.agg(F.countDistinct("shard"), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = block_count(total, max(1, n_old))
    # The rows travel in a column of their own, so that their names can't clash. A row's place is its file and its number in it.
    whole = F.struct(*(c for c in docs.columns if c != "shard")).alias("row")
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("place")
    wide = docs.select(*described(F.col("shard"), size), place, whole)
    rows = in_blocks(wide.drop("row"), F.col("place"), blocks)
    moves = saved(plan(rows, capacity))
    touched = [r[0] for r in moves.filter("old_shard <> new_shard").selectExpr("explode(array(old_shard, new_shard))").distinct().collect()]  # shards, not rows
    (
        in_blocks(wide, F.col("place"), blocks).filter(F.col("old_shard").isin(touched))
        .select("old_shard", "block", "row")
        .join(F.broadcast(moves.drop("first_slot")), ["old_shard", "block"])
        .repartition("new_shard", F.pmod("block", F.lit(blocks // 32)))
        .select("row.*", F.col("new_shard").alias("shard"))
        .write.partitionBy("shard")
        .parquet(out_path)
    )
    sums = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"))
    return (
        moves.filter("old_shard <> new_shard").join(sums, ["old_shard", "block"])
        .groupBy("old_shard", "new_shard").agg(F.count("*").alias("blocks"), F.sum("bytes").alias("bytes"))
    )


def op1_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out in 12 shards by source (so that one is hot) are dealt to 16 shards of equal bytes."""
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    total = docs.agg(F.sum(size)).first()[0] or 0
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(N_OLD))
    rows = with_blocks(docs, old, size, block_count(total, N_OLD))
    return reshard(rows, N_NEW).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("new_shard").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )

"""Resharding by minimum-cost flow.

Old shards supply their bytes, new shards have capacities, and a byte costs one
where it leaves its shard and nothing where it stays. The flow says how many
bytes go from which old shard to which new one; each old shard is then cut, in
a fixed order of its rows, at the places the flow gives. Only shard sizes reach
the driver (old shards times new ones); rows are numbered in blocks of bounded
size whose totals are added up in a small table.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize, shuffles_freed


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def transfers(old: list[int], capacity: list[int]) -> list[list[int]]:
    """Bytes from each old shard to each new one that move the fewest; shard i of both is the same place.

    Successive shortest paths. Capacities must hold all: sum(old) <= sum(capacity).
    """
    n, m = len(old), len(capacity)
    if sum(old) > sum(capacity):
        raise ValueError("the new shards can't hold all bytes")
    source, sink = n + m, n + m + 1
    room: dict[tuple[int, int], int] = {}
    cost: dict[tuple[int, int], int] = {}
    near: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, size: int, price: int) -> None:
        room[a, b], room[b, a], cost[a, b], cost[b, a] = size, 0, price, -price
        near[a].append(b)
        near[b].append(a)

    for i, size in enumerate(old):
        edge(source, i, size, 0)
        for j in range(m):
            edge(i, n + j, size, int(i != j))
    for j, size in enumerate(capacity):
        edge(n + j, sink, size, 0)
    while True:
        best, came, queue = {source: 0}, {}, deque([source])
        while queue:
            a = queue.popleft()
            for b in near[a]:
                if room[a, b] and best[a] + cost[a, b] < best.get(b, 1 << 60):
                    best[b], came[b] = best[a] + cost[a, b], a
                    queue.append(b)
        if sink not in best:
            break
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        push = min(room[e] for e in path)
        for a, b in path:
            room[a, b] -= push
            room[b, a] += push
    return [[room[n + j, i] for j in range(m)] for i in range(n)]


@dataclass(frozen=True)
class Layout:
    """rows: number, old_shard, size, text_crc32 and row (the user's columns); plan: number, old_shard, shard, slot, size, text_crc32 of each."""

    rows: DataFrame
    plan: DataFrame

    @property
    def changed(self) -> list[int]:
        """New shards that gain or lose a row."""
        moved = self.plan.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
        return sorted(r["shard"] for r in moved.collect())  # at most one row per shard


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, shards: int = 16, rows_per_block: int = 2_000, id_col: str = "doc_id", text_col: str = "text") -> Layout:
    """Where each row of docs goes, and its place there (slot, gapless from 0).

    Sizes are UTF-8 bytes plus one; a null text has size one and the CRC of nothing. New shards get near equal bytes:
    a shard misses its capacity by parts of the rows at its cuts only. Repeated rows are rows of their own, told apart by
    a number, and so are rows without an id; old_shard null counts as shard 0. An empty table makes an empty layout.
    """
    data = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("number"),
        (F.length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.coalesce(F.pmod(old_shard, F.lit(old_shards)), F.lit(0)).cast("int").alias("old_shard"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )
    whole = materialize(rows, "rows", compression="zstd")
    rows = whole.drop("row")
    found = {r["old_shard"]: (r["bytes"], r["n"]) for r in rows.groupBy("old_shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}  # one row per old shard
    old = [found.get(i, (0, 0))[0] for i in range(old_shards)]
    flow = transfers(old, even_capacities(sum(old), shards))
    cuts = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != i, j)):  # what stays comes first
            if row[j]:
                cuts.append((i, at, at + row[j], j))
                at += row[j]
    blocks = max(1, -(-sum(n for _, n in found.values()) // rows_per_block))
    # Large rows first: they stay where they are, and the cuts fall between small ones.
    small = (F.lit(63) - F.floor(F.log2("size"))).cast("long")
    rows = rows.withColumn("block", small * blocks + F.pmod(F.xxhash64("number"), F.lit(blocks)))
    sums = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("old_shard", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("old_shard", "block").orderBy(F.desc("size"), "number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(sums, ["old_shard", "block"])
    placed = placed.withColumn("middle", F.col("base") + F.col("upto") - F.col("size") / 2)
    shard = F.lit(0)
    for i, start, end, j in cuts:  # at most old shards plus new shards
        shard = F.when((F.col("old_shard") == i) & (F.col("middle") > start) & (F.col("middle") <= end), F.lit(j)).otherwise(shard)
    here = Window.partitionBy("old_shard", "block", "shard").orderBy(F.desc("size"), "number")
    placed = placed.withColumn("shard", shard.cast("int")).withColumn("n", F.row_number().over(here) - 1)
    placed = materialize(placed.select("number", "size", "text_crc32", "old_shard", "block", "shard", "n"), "placed")
    counts = placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "old_shard", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    out = placed.join(counts, ["shard", "old_shard", "block"])
    plan = out.select("number", "size", "text_crc32", "old_shard", "shard", (F.col("base") + F.col("n")).cast("long").alias("slot"))
    return Layout(whole, materialize(plan, "plan"))


def rewrite(layout: Layout, folder: str) -> list[int]:
    """Write the whole rows of each new shard that gains or loses a row, one folder (shard=N) a shard; returns those shards.

    Every row goes where the plan has it, also those without an id and repeated ones. No rows write nothing.
    """
    changed = layout.changed
    if not changed:
        return changed
    to = layout.plan.where(F.col("shard").isin(*changed)).select("number", "shard", "slot", "old_shard")
    # Every task of the join writes to all shards, so that a large shard is no single task and rows are shuffled once.
    with shuffles_freed(layout.rows.sparkSession):
        layout.rows.select("number", "row").join(to, "number").write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    return changed


def files(layout: Layout, folder: str, changed: list[int]) -> DataFrame:
    """row, shard, slot and old_shard of every row, read from the rewritten folder and, for shards that stay, from where they are."""
    names = ["row", "shard", "slot", "old_shard"]
    whole = layout.rows.select("number", "row", F.col("old_shard").alias("_from"))
    stay = sorted({r["shard"] for r in layout.plan.select("shard").distinct().collect()} - set(changed))  # at most one row per shard
    # An unchanged shard has rows of its own only, so no others are read.
    here = whole.where(F.col("_from").isin(*stay)).join(layout.plan.where(F.col("shard").isin(*stay)).drop("size", "text_crc32"), "number").select(names)
    if not changed:
        return here
    schema = whole.select("number", "row").join(layout.plan.select("number", "slot", "old_shard", "shard"), "number").schema
    moved = layout.rows.sparkSession.read.schema(schema).parquet(folder).select(names)
    return moved.unionByName(here) if stay else moved

"""Resharding by minimum-cost flow: new capacities are met with the fewest bytes moved.

The flow is solved over shards, never over documents: each old shard supplies its bytes, each new one takes its
capacity, staying is free and moving costs its bytes. An old shard's documents lie on a line, large ones first, in
blocks of one size class; the flow cuts the line into stretches, and a stretch's documents go to its target. The last
documents of a line are small, so the cuts fall between small documents and the shards come out equal up to those.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.plans.workspace import staged, work_folder

# Bytes that a document takes beside its text.
OVERHEAD = 16
# Size classes per doubling, and documents that a block holds on average.
_CLASSES = 8
_TOP_CLASS = 400
ROWS_PER_BLOCK = 20_000


def min_cost_flow(supplies: Sequence[int], capacities: Sequence[int],
                  costs: Sequence[Sequence[int]]) -> list[list[int]]:
    """Amounts from each source to each sink at the least total cost; the capacities must hold all supplies.

    Successive shortest paths over the residual graph. Paths are found with potentials kept as distances, by
    relaxation, as residual arcs have negative costs.
    """
    n, m = len(supplies), len(capacities)
    if sum(supplies) > sum(capacities):
        raise ValueError("the capacities are too small")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supplies), list(capacities)
    while any(left):
        # Distances from any source with supply; sources are 0..n-1, sinks n..n+m-1.
        far = [0 if left[i] else math.inf for i in range(n)] + [math.inf] * m
        before: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] + costs[i][j] < far[n + j]:
                        far[n + j], before[n + j], changed = far[i] + costs[i][j], i, True
                    if flow[i][j] and far[n + j] - costs[i][j] < far[i]:
                        far[i], before[i], changed = far[n + j] - costs[i][j], n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: (far[n + j], j))
        path, node = [], n + end
        while before[node] is not None:
            path.append((before[node], node))
            node = before[node]
        amount = min(left[node], room[end])
        for a, b in path:
            if a >= n:  # a way back, along an amount sent before
                amount = min(amount, flow[b][a - n])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[node] -= amount
        room[end] -= amount
    return flow


def transfers(sizes: dict[int, int], shards: int, capacities: Sequence[int] | None = None) -> list[list[int]]:
    """Bytes from each old shard (0 to the largest in ``sizes``) to each new one; equal capacities by default."""
    old = max([*sizes, shards - 1]) + 1
    supplies = [sizes.get(i, 0) for i in range(old)]
    total = sum(supplies)
    if capacities is None:
        capacities = [total // shards + (j < total % shards) for j in range(shards)]
    costs = [[0 if i == j else 1 for j in range(shards)] for i in range(old)]
    return min_cost_flow(supplies, capacities, costs)


def _size(text_col: str) -> Column:
    return F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint") + OVERHEAD


def reshard(docs: DataFrame, old_shard: Column, shards: int, capacities: Sequence[int] | None = None,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its ``size`` and new ``shard``, and its place on the line (``old``, ``block``, ``rank``).

    ``old_shard`` is a number from 0; an old shard of the same number as a new one keeps what fits. Documents whose old
    shard is null are new: they are moved wherever there is room. One row per input row. A null text has no bytes beside the overhead and stays null, ids may be null or repeated, no documents give no
    rows. Ties on the line go by id and text. ``rank`` counts from 0 within shard, old shard and block.
    """
    sub_blocks = max(1, math.ceil(docs.count() / ROWS_PER_BLOCK / 64))
    # Rows without an id could all be equal, so their place in the input spreads them.
    spread = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(F.col(id_col))
    step = _TOP_CLASS - F.floor(F.log2(_size(text_col)) * _CLASSES)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), _size(text_col).alias("size"),
        old_shard.cast("int").alias("old"),
        (step * sub_blocks + F.pmod(F.xxhash64(spread), F.lit(sub_blocks))).cast("int").alias("block"))
    blocks = staged(rows.groupBy("old", "block").agg(F.sum("size").alias("bytes")), "blocks")
    sizes = {r["old"]: r["bytes"] for r in blocks.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect()}
    # Documents without an old shard come from a source of their own, with a number that no shard has.
    nowhere = max([shards - 1, *(i for i in sizes if i is not None)]) + 1
    if None in sizes:
        sizes[nowhere] = sizes.pop(None)
    rows, blocks = [t.withColumn("old", F.coalesce("old", F.lit(nowhere))) for t in (rows, blocks)]
    flow = transfers(sizes, shards, capacities)
    cuts = []
    for i, amounts in enumerate(flow):
        end, ends = 0, []
        for j in sorted((j for j in range(shards) if amounts[j]), key=lambda j: (j != i, j)):
            end += amounts[j]
            ends.append((end, j))
        cuts.append((i, ends))
    lines = docs.sparkSession.createDataFrame(cuts, "old int, cuts array<struct<until:bigint,shard:int>>")
    before = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("old", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("block_start"))
    # One task gets neighbouring blocks of one old shard, so it writes to few new ones.
    placed = rows.repartitionByRange("old", "block").join(starts, ["old", "block"]).join(
        F.broadcast(lines), "old")  # as many rows as there are shards
    order = [F.desc("size"), F.col("doc_id"), F.col("text")]
    within = Window.partitionBy("old", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("block_start") + F.sum("size").over(within) - F.col("size") / 2
    target = F.get(F.filter("cuts", lambda c: F.col("_middle") < c["until"]), 0)["shard"]
    sent = placed.withColumn("_middle", middle).withColumn("shard", target).drop("_middle", "cuts", "block_start")
    same = Window.partitionBy("old", "block", "shard").orderBy(*order)
    return sent.withColumn("rank", F.row_number().over(same) - 1)


def rewrite(assigned: DataFrame, affected: Sequence[int] | None = None) -> DataFrame:
    """Write the affected shards, one folder each, and return all documents.

    ``affected`` lists the shards that lose or gain documents (``changed_shards``); all by default. The others are read
    from where they are.
    """
    folder = f"{work_folder(assigned.sparkSession, 'shards')}/shards"
    rows = assigned if affected is None else assigned.where(F.col("shard").isin(*affected))
    rows.write.partitionBy("shard").parquet(folder)
    written = assigned.sparkSession.read.schema(assigned.schema).parquet(folder).select(*assigned.columns)
    return written if affected is None else written.union(assigned.where(~F.col("shard").isin(*affected)))


def changed_shards(flow: list[list[int]]) -> list[int]:
    """New shards that take bytes from another one or give some away."""
    moved = [(i, j) for i, amounts in enumerate(flow) for j, amount in enumerate(amounts) if amount and i != j]
    return sorted({j for _, j in moved} | {i for i, _ in moved if i < len(flow[0])})


def slots_digest(written: DataFrame) -> DataFrame:
    """Size and checksum of the written text, the shard, and a gapless slot in it.

    Slots count along the lines: documents of earlier blocks come first. Only counts per block are gathered.
    """
    place = ["shard", "old", "block"]
    counts = written.groupBy(*place).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*place, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written.select("doc_id", *place, "rank", (F.octet_length(text).cast("bigint") + OVERHEAD).alias("size"),
                          F.crc32(text).alias("text_crc32"))
    return rows.join(offsets, place).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.plans.workspace import staged


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest node of its neighbourhood."""
    both = links.union(links.select("b", "a")).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
    return both.where("other > node").join(least, "node").select(F.col("other").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, goes to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = down.groupBy("node").agg(F.min("other").alias("low"))
    moved = down.join(least, "node").select(F.col("other").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("node", "low"))


def _tidy(links: DataFrame) -> DataFrame:
    return links.where("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node`` and ``root`` (smallest node of the component) for every node of the links ``a``, ``b`` (longs).

    Alternates the two star steps until nothing changes; each needs rounds in the logarithm of the nodes, and a hub
    is spread over tasks by the adaptive skew join. Every round is a written table. Links of a node with itself and
    repeated links count for nothing; no links give no rows.
    """
    current = staged(_tidy(links), "links")
    mark = _mark(current)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        current = staged(_tidy(_small_star(_tidy(_large_star(current)))), "links")
        before, mark = mark, _mark(current)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = current.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return roots.union(roots.select(F.col("root"), F.col("root"))).distinct().toDF("node", "root")

"""Connected components of a link table, distributed.

Alternating star steps (Kiveris et al., "Connected components in MapReduce
and beyond", 2014): the large star links every larger neighbour of a node to
the smallest one near it, the small star every smaller neighbour. Each is one
aggregate and one join; the smallest neighbour of a hub is found by a partial
aggregate, and no neighbour list is ever gathered. The links of each round are
stored in the shared checkpoint folder, so a lost executor costs one round at
most and plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wastelens.llm.common import stored


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    """``e`` has u > v. Every larger neighbour of a node goes to the node's smallest one."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both)
    # Only larger neighbours move, so the probing side holds each link once,
    # seen from its smaller end.
    return e.select(F.col("v").alias("k"), F.col("u").alias("w")).join(low, "k").select(
        F.col("w").alias("u"), F.least("k", "m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, goes to the smallest one."""
    low = _smallest(e)
    moved = e.select(F.col("u").alias("k"), F.col("v").alias("w")).join(low, "k").where(
        F.col("w") != F.col("m")).select(F.col("w").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root) for every node of ``links`` (columns u, v; any order, repeats
    allowed) other than the roots; ``root`` is the smallest node reachable."""
    e = stored(links.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(e)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        e = stored(_small_star(_large_star(e)))
        old, mark = mark, _mark(e)
        if old == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select("u", F.col("v").alias("root"))

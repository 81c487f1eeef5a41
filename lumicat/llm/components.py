"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round replaces edges by ones that point at smaller ids, until each node points at the smallest id it can reach.
Rounds grow with the logarithm of a component's size; a node with very many neighbours is an ordinary join key, which
adaptive execution splits. Each round is stored in the shared checkpoint folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.llm.base import stage



def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` hold u > v."""
    mins = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(mins, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(mins.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for each node of ``edges (u, v)`` (long); loops, repeats, nulls and directions don't matter.
    The component is its smallest node. No edges give no rows."""
    now = stage(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        now = stage(_small_star(_large_star(now)))
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

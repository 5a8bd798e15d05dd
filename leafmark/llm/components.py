"""Connected components by alternating large-star and small-star joins.

Edges are rewired towards the smallest neighbour until only stars are left; every round is written to the shared folder, so a
lost executor costs one round at most, and minima are pre-aggregated, so a hub with very many edges stays cheap. The driver
remembers every task, so rounds are few and have few steps: stars that are given take none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import dropped, stored


def _rewired(edges: DataFrame, smaller: bool) -> DataFrame:
    """edges(u, v), u > v, towards the minimum of each node's neighbourhood (small star: smaller neighbours only)."""
    if smaller:
        low = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        moved = edges.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v")))
    else:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.col("n")).alias("m"))
        out = both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether in edges(u, v), u > v, each once, every u has one edge and is no v."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of edges(u, v) the smallest node it reaches. Loops and repeats do no harm. The number of
    rounds is about the logarithm of the longest path."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(now):
        # what the first half repeats, at most as many rows as there are edges, goes in the second
        after = stored(_rewired(_rewired(now, smaller=False), smaller=True).distinct(), "edges")
        dropped(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frozen

#: Every task writes files for each shuffle, and rounds have many: tasks follow the number of edges, not that of partitions.
EDGES_PER_TASK = 100_000


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest in the node's neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return (both.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("low").alias("v")).where(F.col("u") != F.col("v"))
            .coalesce(tasks).distinct().coalesce(tasks))


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return (linked.union(low.select("u", F.col("low").alias("v"))).where(F.col("u") != F.col("v"))
            .coalesce(tasks).distinct().coalesce(tasks))


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``): for every node of the edges (columns ``u``, ``v``) the smallest node it reaches.

    The edges, then each round, are written to the checkpoint folder.  Rounds end when the edges no
    longer change, which is when every node is linked to its root alone.
    """
    state = None
    edges = frozen(edges.where(F.col("u") != F.col("v")))
    n = edges.count()
    while True:
        tasks = max(1, -(-n // EDGES_PER_TASK))
        edges = frozen(_small_star(_large_star(edges.coalesce(tasks), tasks), tasks))
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
        n = new[0]
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

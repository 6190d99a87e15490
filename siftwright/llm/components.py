"""Connected components of an edge table by alternating large and small stars.

Every step is written to the shared folder, so plans and lineage stay short and a lost executor costs a re-read. Minima are
partial aggregates, and the edges of hubs meet a broadcast of bounded size, so a hub is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import join_heavy
from siftwright.shared import written


def _large_star(edges: DataFrame, n: int, name: str) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).withColumn("m", F.least("m", "u"))
    met = join_heavy(both, written(least, f"{name}-least"), "u", 2 * n)
    return met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int, name: str) -> DataFrame:
    least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")), f"{name}-least")
    moved = join_heavy(edges, least, "a", n).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def star_forest(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) for every node but the smallest of its component, b being that smallest node.

    edges: columns a and b of one orderable type, any direction; loops and repeats are allowed.
    """
    held = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held, before = written(held, name), None
    while True:
        seen = held.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == before or seen["n"] == 0:
            return held
        before = seen
        wide = written(_large_star(held, seen["n"], name), f"{name}-wide")  # no more edges than before
        held = written(_small_star(wide, seen["n"], name), name)

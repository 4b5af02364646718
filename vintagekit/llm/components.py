"""Connected components of an edge table by alternating star contractions.

Each round hangs every node's larger, then smaller, neighbours on its smallest one, until all edges
point at the smallest node of their component. Rounds grow with the logarithm of the longest path.
Rows stay one per edge; every round is written to the shared folder, which cuts its lineage. Minimums
combine before the shuffle, and a hub's rows are joined by plain equi-joins that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagekit.session import materialize


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b")))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b) that is not its component's smallest node."""
    now = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a > b").distinct(), "edges")
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(mark)
        now = materialize(small_star(large_star(now)).distinct(), "edges")

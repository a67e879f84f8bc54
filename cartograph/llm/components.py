"""Connected components of an edge table by alternating large and small stars.

Each round rewires every node to the smallest neighbour it knows, with one aggregation and one join by node;
the number of edges never grows, and rounds grow with the logarithm of the longest path. Hubs are cut
down by partial aggregation, and adaptive execution splits their side of the join. Edges stay in
tables of the shared folder; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.runtime import spool


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = spool(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")))
    return both.join(low, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = spool(down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"))
    moved = down.join(low, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each node's component; only nodes with edges, roots without a row.

    edges: a, b of one orderable type. Loops and repeated edges are ignored; no edges give no rows.
    """
    current = spool(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
        current = spool(_small_star(spool(_large_star(current))))
    raise RuntimeError(f"no fixed point after {rounds} rounds")

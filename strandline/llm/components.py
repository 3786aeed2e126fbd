"""Connected components by alternating large and small stars, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the least of them.  Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b")
    up = moved.select(F.col("m").alias("a"), F.col("a").alias("b"))
    return up.unionByName(least.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of one orderable type; returns (node, root), root the least node, for every node with an edge."""
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    now = written(now, "edges")
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = written(_small(written(_large(now), "large")), "edges")
    else:
        raise RuntimeError("the components did not settle")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())

"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Steps after which a run is given up; the steps needed grow with the logarithm of the longest path.
MOST_ROUNDS = 60


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Large star (``both``): every larger neighbour of a node is hung on the node's least neighbour; small star: every smaller one."""
    if both:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = near.join(least, "a")
    if both:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), root being the least node of its component.

    Loops, repeated edges and an empty table are allowed; a null end drops the edge. Each round is written in the shared
    folder, so a lost executor costs one round.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        now = written(_star(_star(now, True), False), "edges")
        # the steps keep what is connected, so a set of stars (one parent each, and no parent has one) is the answer
        one_each = now.agg((F.count("*") == F.countDistinct("a")).alias("x")).first().x
        if one_each and not now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

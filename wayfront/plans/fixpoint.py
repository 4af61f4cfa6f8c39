"""Shortest distances as a fixpoint of joins, for networks that no single task can hold.

Each round relaxes the edges of the nodes that improved in the round before; tables are
cut into the shared folder.  A round's shuffles grow with its frontier, not with the
network's edges (which are read from where they were written).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import cut


def distances(edges: DataFrame, sources: DataFrame, cost: str) -> DataFrame:
    """dataset, source, node, distance: least sums of ``cost`` from each (dataset, source)."""
    steps = edges.select("dataset", F.col("src").alias("node"), "dst", F.col(cost).alias("step"))
    best = cut(sources.select("dataset", "source", F.col("source").alias("node"), F.lit(0).cast("long").alias("distance")).distinct())
    frontier = best
    while not frontier.isEmpty():
        reached = frontier.join(steps, ["dataset", "node"]).select("dataset", "source", F.col("dst").alias("node"), (F.col("distance") + F.col("step")).alias("new"))
        reached = reached.groupBy("dataset", "source", "node").agg(F.min("new").alias("new"))
        merged = cut(best.join(reached, ["dataset", "source", "node"], "full_outer"))
        frontier = merged.where("distance is null or new < distance").select("dataset", "source", "node", F.col("new").alias("distance"))
        best = merged.select("dataset", "source", "node", F.least("distance", "new").alias("distance"))
    return best


def hops(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """dataset, source, node, hops."""
    return distances(edges.withColumn("_one", F.lit(1).cast("long")), sources, "_one").withColumnRenamed("distance", "hops")

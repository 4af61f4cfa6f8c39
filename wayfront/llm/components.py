"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))  # the small star's rows are made distinct


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a")
    return near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """node and root (the least node of its component) of every node that is not its own root.

    ``edges`` has columns a and b of one orderable type.  Every round is written to
    the shared folder, and deleted when the next one is; the driver sees only whether a
    round is the last one.  A node that most rows name is the centre of a star: its rows
    meet by merge joins, whose hot keys adaptive execution splits.  ``tasks`` bounds the
    tasks that write a round.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tasks)
    while True:
        before, now = now, cut(_small_star(_large_star(now)), tasks)
        drop(before)
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        # done when every node has one root, and no root has one itself
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty():
            found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            found.cut_path = now.cut_path
            return found

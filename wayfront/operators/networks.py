"""Networks as edge tables: dataset, src, dst, c1..c5, edge_seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import COSTS


def canonical(edges: DataFrame) -> DataFrame:
    """One edge for each (dataset, src, dst): the first in the file; loops go."""
    order = Window.partitionBy("dataset", "src", "dst").orderBy("edge_seq")
    return edges.where("src <> dst").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def reverse(edges: DataFrame) -> DataFrame:
    other = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    return edges.select(*[other.get(c, F.col(c)) for c in edges.columns])


def degrees(edges: DataFrame) -> DataFrame:
    """dataset, node, out_degree, in_degree."""
    ends = edges.select("dataset", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("dataset", "e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def without(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Edges that are not closed; all parallels of a closed pair go."""
    return edges.join(closed.select("dataset", "src", "dst"), ["dataset", "src", "dst"], "left_anti").select(edges.columns)


def existing(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs that are edges."""
    return pairs.join(edges.select("dataset", "src", "dst"), ["dataset", "src", "dst"], "left_semi")


def positive_medians(edges: DataFrame, m: int = 5) -> DataFrame:
    """dataset and s1..sm: medians of the positive costs, whole and at least 1; 1 without any."""
    return edges.groupBy("dataset").agg(*[F.greatest(F.lit(1), F.coalesce(F.expr(f"cast(percentile(case when {c} > 0 then {c} end, 0.5) as bigint)"), F.lit(1))).cast("long").alias(f"s{i + 1}") for i, c in enumerate(COSTS[:m])])


def path_costs(paths: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, sums c1..c5 of each path's edges, and valid (no step is missing).

    ``paths`` has dataset, path (array of nodes) and ``keys``; a path of one node costs 0.
    """
    steps = paths.select("dataset", *[k for k in keys if k != "dataset"], "path", F.explode_outer(F.expr("case when size(path) > 1 then sequence(1, size(path) - 1) end")).alias("i"))
    steps = steps.select("dataset", *[k for k in keys if k != "dataset"], "i", F.expr("case when i is not null then element_at(path, i) end").alias("src"), F.expr("case when i is not null then element_at(path, i + 1) end").alias("dst"))
    priced = steps.join(edges.select("dataset", "src", "dst", *COSTS), ["dataset", "src", "dst"], "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COSTS]
    return priced.groupBy(*keys).agg(*sums, F.coalesce(F.min(F.when(F.col("i").isNotNull(), F.col("c1").isNotNull())), F.lit(True)).alias("valid"))

"""Corridors: what lower bounds and known vectors leave of a network."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _worse(left: DataFrame, incumbents: DataFrame, m: int, exempt: Column) -> DataFrame:
    """Rows of ``left`` (dataset, query_id, l1..lm) that no incumbent of their query reaches."""
    a, b = left.alias("a"), incumbents.alias("b")
    below = reduce(Column.__and__, [F.col(f"b.c{k}") <= F.col(f"a.l{k}") for k in range(1, m + 1)])
    return a.join(b, (F.col("a.dataset") == F.col("b.dataset")) & (F.col("a.query_id") == F.col("b.query_id")) & ~exempt & below, "left_anti")


def nodes(queries: DataFrame, so_far: DataFrame, to_go: DataFrame, incumbents: DataFrame, m: int = 3) -> DataFrame:
    """dataset, query_id, node, l1..lm: nodes that a path better than all incumbents may pass; source and target stay."""
    bounds = queries.join(so_far, ["dataset", "source"]).join(to_go, ["dataset", "target", "node"])
    bounds = bounds.select("dataset", "query_id", "source", "target", "node", *[(F.col(f"d{k}") + F.col(f"h{k}")).alias(f"l{k}") for k in range(1, m + 1)])
    own = (F.col("a.node") == F.col("a.source")) | (F.col("a.node") == F.col("a.target"))
    return _worse(bounds, incumbents, m, own).drop("source", "target")


def edges(queries: DataFrame, network: DataFrame, so_far: DataFrame, to_go: DataFrame, incumbents: DataFrame, m: int = 3) -> DataFrame:
    """dataset, query_id, src, dst, c1..c5, edge_seq, l1..lm: edges that a path better than all incumbents may use."""
    ahead = so_far.withColumnRenamed("node", "src")
    behind = to_go.withColumnRenamed("node", "dst")
    bounds = queries.join(network, "dataset").join(ahead, ["dataset", "source", "src"]).join(behind, ["dataset", "target", "dst"])
    bounds = bounds.select("dataset", "query_id", *[c for c in network.columns if c != "dataset"], *[(F.col(f"d{k}") + F.col(f"c{k}") + F.col(f"h{k}")).alias(f"l{k}") for k in range(1, m + 1)])
    return _worse(bounds, incumbents, m, F.lit(False))


def counts(all_nodes: DataFrame, kept_nodes: DataFrame, all_edges: DataFrame, kept_edges: DataFrame) -> DataFrame:
    """By query: nodes and edges in all, and how many the corridor keeps."""
    keys = ["dataset", "query_id"]
    tally = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    out = tally(all_nodes, "n_nodes").join(tally(kept_nodes, "kept_nodes"), keys, "left").join(tally(all_edges, "n_edges"), keys, "left").join(tally(kept_edges, "kept_edges"), keys, "left")
    return out.na.fill(0, ["kept_nodes", "n_edges", "kept_edges"])

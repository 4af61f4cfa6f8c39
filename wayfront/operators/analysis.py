"""Conflict between objectives, overlap of routes, and sizes of fronts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import COSTS, OBJECTIVES, jaccard, path_edges
from ..functions.ship import ship

ORDINAL = {name: k + 1 for k, name in enumerate(OBJECTIVES)}


def quantiles(value: str) -> list[Column]:
    """mean, median, q25, q75 and max of a column; quantiles are interpolated."""
    return [F.avg(value).alias("mean"), *[F.percentile(value, p).alias(n) for n, p in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))], F.max(value).alias("max")]


def cost_matrix(vectors: DataFrame) -> DataFrame:
    """dataset, query_id, i, j, cost, best, worst: cost j of the route that is best for objective i, and j's range."""
    i = F.element_at(F.create_map(*[F.lit(x) for kv in ORDINAL.items() for x in kv]), F.col("objective"))
    long = vectors.select("dataset", "query_id", i.alias("i"), F.posexplode(F.array(*COSTS)).alias("j", "cost")).withColumn("j", F.col("j") + 1)
    ends = long.groupBy("dataset", "query_id", "j").agg(F.max(F.when(F.col("i") == F.col("j"), F.col("cost"))).alias("best"), F.max("cost").alias("worst"))
    return long.join(ends, ["dataset", "query_id", "j"]).select("dataset", "query_id", "i", "j", "cost", "best", "worst")


def regret(matrix: DataFrame) -> DataFrame:
    """dataset, query_id, i, j, regret = (cost - best) / max(best, 1)."""
    return matrix.select("dataset", "query_id", "i", "j", ((F.col("cost") - F.col("best")) / F.greatest("best", F.lit(1))).alias("regret"))


def range_loss(matrix: DataFrame) -> DataFrame:
    """dataset, query_id, i, j, loss = (cost - best) / (worst - best), 0 without a range."""
    loss = F.when(F.col("worst") > F.col("best"), (F.col("cost") - F.col("best")) / (F.col("worst") - F.col("best"))).otherwise(0.0)
    return matrix.select("dataset", "query_id", "i", "j", loss.alias("loss"))


def directional(values: DataFrame, value: str) -> DataFrame:
    """city, i, j and the quantiles of ``value`` over queries; ``values`` has city."""
    return values.groupBy("city", "i", "j").agg(*quantiles(value))


def symmetric(matrix: DataFrame, value: str) -> DataFrame:
    """city, i, j (i <= j), conflict: half the sum of both directions; 0 on the diagonal."""
    a, b = matrix.select("city", "i", "j", F.col(value).alias("x")), matrix.select("city", F.col("i").alias("j"), F.col("j").alias("i"), F.col(value).alias("y"))
    return a.where("i <= j").join(b, ["city", "i", "j"]).select("city", "i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise((F.col("x") + F.col("y")) / 2).alias("conflict"))


def route_overlap(vectors: DataFrame) -> DataFrame:
    """dataset, query_id, i, j (i < j), edge_jaccard, node_jaccard, identical."""
    i = F.element_at(F.create_map(*[F.lit(x) for kv in ORDINAL.items() for x in kv]), F.col("objective"))
    own = vectors.select("dataset", "query_id", i.alias("i"), "path")
    other = own.select("dataset", "query_id", F.col("i").alias("j"), F.col("path").alias("other"))
    pairs = own.join(other, ["dataset", "query_id"]).where("i < j")
    nodes = jaccard(F.array_distinct("path"), F.array_distinct("other"))
    return pairs.select("dataset", "query_id", "i", "j", jaccard(path_edges("path"), path_edges("other")).alias("edge_jaccard"), nodes.alias("node_jaccard"), (F.col("path") == F.col("other")).alias("identical"))


def identical_rate(overlap: DataFrame) -> DataFrame:
    """city, i, j, n, n_same, rate."""
    return overlap.groupBy("city", "i", "j").agg(F.count("*").alias("n"), F.sum(F.col("identical").cast("long")).alias("n_same"), F.avg(F.col("identical").cast("double")).alias("rate"))


def mean_best(matrix: DataFrame) -> DataFrame:
    """city, j, mean_best: mean least cost of each objective."""
    return matrix.where("i = j").groupBy("city", "j").agg(F.avg("best").alias("mean_best"))


def wide_metrics(overlap: DataFrame) -> DataFrame:
    """A row for each query, with edge Jaccard of each two objectives in a column."""
    names = [f"{i}-{j}" for i in range(1, 6) for j in range(i + 1, 6)]
    return overlap.withColumn("pair", F.concat_ws("-", "i", "j")).groupBy("dataset", "query_id").pivot("pair", names).agg(F.max("edge_jaccard")).withColumnsRenamed({n: "j" + n.replace("-", "") for n in names})


def front_sizes(fronts: DataFrame) -> DataFrame:
    """city, n_queries and mean, median, max and min front size."""
    sizes = fronts.groupBy("city", "dataset", "query_id").agg(F.count("*").alias("n"))
    return sizes.groupBy("city").agg(F.count("*").alias("n_queries"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("max"), F.min("n").alias("min"))


def sizes_by_objectives(fronts: DataFrame) -> DataFrame:
    """objective_count, groups, and mean, min and max front size."""
    sizes = fronts.groupBy("objective_count", "dataset", "query_id").agg(F.count("*").alias("n"))
    return sizes.groupBy("objective_count").agg(F.count("*").alias("groups"), F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"))


def median_query(fronts: DataFrame) -> DataFrame:
    """city and the query whose front has the median size (the upper one of two; ties by dataset, query_id).

    Sizes are counted first; only the queries of the median size are then put in order.
    """
    sizes = fronts.groupBy("city", "dataset", "query_id").agg(F.count("*").alias("n"))
    counted = sizes.groupBy("city", "n").agg(F.count("*").alias("times"))
    placed = counted.withColumn("upto", F.expr("sum(times) over (partition by city order by n)")).withColumn("total", F.expr("sum(times) over (partition by city)"))
    middle = placed.where("upto > total div 2 and upto - times <= total div 2").select("city", "n", (F.expr("total div 2") - F.col("upto") + F.col("times")).alias("_at"))
    own = sizes.join(middle, ["city", "n"]).withColumn("_n", F.expr("row_number() over (partition by city order by dataset, query_id) - 1"))
    return own.where("_n = _at").select("city", "dataset", "query_id", "n")


def replay(traces: DataFrame, key: str, step: str) -> DataFrame:
    """key, n_steps, n_different: steps (g1, g2, g3 in order of ``step``, then by vector) after which the front that is kept
    in order and a front that is compared in full don't hold the same vectors.

    One task replays one trace.
    """
    ship(traces.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        from ..plans.kernels import FrontN  # the kernels import nothing from here

        ordered = rows.sort_values([step, "g1", "g2", "g3"])[["g1", "g2", "g3"]].to_numpy()
        own, full, different = FrontN(), np.zeros((0, 3), np.int64), 0
        for g in ordered:
            if not own.covers(*g.tolist()):
                own.add(*g.tolist())
            if not (full <= g).all(1).any():
                full = np.concatenate([full[~(full >= g).all(1)], g[None]])
            different += sorted(own.rows) != sorted(map(tuple, full.tolist()))
        return pd.DataFrame([(rows[key].iloc[0], len(ordered), different)], columns=[key, "n_steps", "n_different"])

    kind = traces.schema[key].dataType.simpleString()
    return traces.groupBy(key).applyInPandas(run, f"{key} {kind}, n_steps long, n_different long")


def truncated_percentiles(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, avg, p50, p90, p95, p99, p999, max; a percentile is the value at index int((n - 1) p)."""
    # values are counted before they are put in order, so a group holds its distinct values only
    counted = values.groupBy(*keys, value).agg(F.count("*").alias("times"))
    over = f"over (partition by {', '.join(keys)} order by {value})"
    placed = counted.withColumn("upto", F.expr(f"sum(times) {over}")).withColumn("n", F.expr(f"sum(times) over (partition by {', '.join(keys)})"))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * F.lit(p)), F.col(value)))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), (F.sum(F.col(value) * F.col("times")) / F.max("n")).alias("avg"), *[at(p).alias(f"p{str(p)[2:].ljust(2, '0')}") for p in (0.5, 0.9, 0.95, 0.99, 0.999)], F.max(value).alias("max"))


def concentration(nodes: DataFrame, width: str, cost: str, tie: str) -> DataFrame:
    """r10, r100: shares of all ``cost`` at the 10 and 100 widest nodes (by width, then cost, then ``tie``)."""
    top = nodes.orderBy(F.desc(width), F.desc(cost), tie).limit(100).withColumn("rank", F.expr(f"row_number() over (order by {width} desc, {cost} desc, {tie})"))
    some = top.agg(F.sum(F.when(F.col("rank") <= 10, F.col(cost)).otherwise(0)).alias("t10"), F.sum(cost).alias("t100")).withColumn("_one", F.lit(1))
    total = nodes.agg(F.greatest(F.sum(cost), F.lit(1)).alias("total")).withColumn("_one", F.lit(1))
    return some.join(total, "_one").select((F.col("t10") / F.col("total")).alias("r10"), (F.col("t100") / F.col("total")).alias("r100"))


def widest(nodes: DataFrame, width: str, cost: str, tie: str, k: int = 100) -> DataFrame:
    """The k widest nodes with their rank: a report."""
    return nodes.orderBy(F.desc(width), F.desc(cost), tie).limit(k).withColumn("rank", F.expr(f"row_number() over (order by {width} desc, {cost} desc, {tie})"))

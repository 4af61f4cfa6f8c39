"""Recommendation by preference weights, sensitivity, and comparison after closures.

The weights of the four schemes are this library's own choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import COSTS, jaccard, path_edges, relative_delta
from .approximate import every, normalize

SCHEMES = {
    "time": (0.1, 0.6, 0.1, 0.1, 0.1),
    "distance": (0.6, 0.1, 0.1, 0.1, 0.1),
    "stable": (0.1, 0.1, 0.4, 0.3, 0.1),
    "balanced": (0.2, 0.2, 0.2, 0.2, 0.2),
}
ORDER = {"time": 1, "distance": 2, "stable": 3, "balanced": 4}


def schemes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in SCHEMES.items()], "scheme string, " + ", ".join(f"w{k} double" for k in range(1, 6)))


def sensitivity_weights(spark: SparkSession, focus: int, steps: int = 10) -> DataFrame:
    """scheme (``w0.3``), w_focus, w1..w5: one weight goes from 0 to 1, the others share the rest."""
    grid = spark.range(steps + 1).select((F.col("id") / F.lit(float(steps))).alias("w_focus"))
    return grid.select(F.concat(F.lit("w"), F.format_number("w_focus", 1)).alias("scheme"), "w_focus", *[(F.col("w_focus") if k == focus else (1 - F.col("w_focus")) / 4).alias(f"w{k}") for k in range(1, 6)])


def _scored(candidates: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    both = every(normalize(candidates, keys, 5), weights)
    total = F.col("w1") * F.col("z1")
    for k in range(2, 6):
        total = total + F.col(f"w{k}") * F.col(f"z{k}")
    return both.withColumn("score", F.round(total, 12))


def recommend(candidates: DataFrame, weights: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, scheme, score, c1..c5 and ``order`` columns of the candidate with the least weighted normalised cost.

    The weights are a table of parameters; ties go by c1..c5 and ``order``.  A partial
    minimum in every task keeps a large pool from meeting in one.
    """
    extra = [c for c in weights.columns if c not in ("scheme", *[f"w{k}" for k in range(1, 6)])]
    keep = F.struct("score", *COSTS, *order)
    best = _scored(candidates, weights, keys).groupBy(*keys, "scheme", *extra).agg(F.min(keep).alias("r"))
    return best.select(*keys, "scheme", *extra, "r.*")


def robust(candidates: DataFrame, weights: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The candidate that is best under most weights (ties by lower mean rank vector): keys, wins, c1..c5, order."""
    wins = recommend(candidates, weights, keys, order).groupBy(*keys, *COSTS, *order).agg(F.count("*").alias("wins"))
    best = wins.groupBy(*keys).agg(F.min(F.struct((-F.col("wins")).alias("lost"), *COSTS, *order)).alias("r"))
    return best.select(*keys, (-F.col("r.lost")).alias("wins"), *[F.col(f"r.{c}").alias(c) for c in (*COSTS, *order)])


def avoiding(candidates: DataFrame, closed: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (``keys``, dataset, path, ...) none of whose steps is a closed edge; all of a group's where none is left."""
    steps = F.transform(path_edges("path"), lambda e: F.concat_ws(">", e["a"].cast("string"), e["b"].cast("string")))
    shut = closed.groupBy("dataset").agg(F.collect_set(F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string"))).alias("_shut"))
    marked = candidates.join(shut, "dataset", "left").withColumn("_open", ~F.coalesce(F.arrays_overlap(steps, "_shut"), F.lit(False)))
    some = marked.groupBy(*keys).agg(F.max("_open").alias("_some"))
    return marked.join(some, keys).where("_open or not _some").select(candidates.columns)


def changed(swept: DataFrame, default: DataFrame, keys: list[str], route: str) -> DataFrame:
    """``swept`` with changed_vs_default: whether its route differs from the default one of its group."""
    own = default.select(*keys, F.col(route).alias("_default"))
    return swept.join(own, keys, "left").withColumn("changed_vs_default", ~F.col(route).eqNullSafe(F.col("_default"))).drop("_default")


def continuous(candidates: DataFrame, anchor: DataFrame, keys: list[str], steps: int = 10) -> DataFrame:
    """keys, lambda, c1..c5, path: after closures, the candidate of least time and least change from the anchor's route.

    Each step of lambda, from 0 to 1, weighs (time - best) / max(best, 1) by 1 - lambda and the
    share of steps that change by lambda; the largest lambda whose choice isn't slower than
    twice the best time is taken, and ties go by c1..c5 and path.  This definition is the library's own.
    """
    best = candidates.groupBy(*keys).agg(F.min("c2").alias("_best"))
    change = 1 - jaccard(path_edges("path"), path_edges("_anchor"))
    wide = candidates.join(anchor.select(*keys, F.col("path").alias("_anchor")), keys).join(best, keys).withColumn("_change", change).withColumn("_slow", (F.col("c2") - F.col("_best")) / F.greatest("_best", F.lit(1)))
    tried = wide.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("lambda", F.col("_i") / F.lit(float(steps)))
    score = F.round((1 - F.col("lambda")) * F.col("_slow") + F.col("lambda") * F.col("_change"), 12)
    chosen = tried.groupBy(*keys, "lambda").agg(F.min(F.struct(score.alias("s"), *COSTS, "path", "_slow")).alias("r"))
    taken = chosen.where("r._slow <= 1").groupBy(*keys).agg(F.max_by("r", "lambda").alias("r"), F.max("lambda").alias("lambda"))
    return taken.select(*keys, "lambda", *[F.col(f"r.{c}").alias(c) for c in COSTS], F.col("r.path").alias("path"))


def diversity(recommended: DataFrame, keys: list[str], route: str) -> DataFrame:
    """keys, n_schemes, n_unique, all_same; a null route counts as one."""
    text = F.coalesce(F.col(route).cast("string"), F.lit(""))
    out = recommended.groupBy(*keys).agg(F.count("*").alias("n_schemes"), F.count_distinct(text).alias("n_unique"))
    return out.withColumn("all_same", F.col("n_unique") == 1)


def compared(original: DataFrame, replanned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feasible, relative changes delta_c1..c5 and path_change (1 - edge Jaccard) after closures; nulls where there is no route."""
    new = replanned.select(*keys, *[F.col(c).alias(f"n_{c}") for c in COSTS], F.col("path").alias("n_path"))
    both = original.join(new, keys, "left")
    changes = [relative_delta(F.col(f"n_{c}"), F.col(c)).alias(f"delta_{c}") for c in COSTS]
    return both.select(*keys, F.col("n_path").isNotNull().alias("feasible"), *changes, F.when(F.col("n_path").isNotNull(), 1 - jaccard(path_edges("path"), path_edges("n_path"))).alias("path_change"))


def city_summary(comparison: DataFrame) -> DataFrame:
    """city, n, and means of feasibility, path change, and changes of the first two costs."""
    return comparison.groupBy("city").agg(F.count("*").alias("n"), F.avg(F.col("feasible").cast("double")).alias("mean_feasible"), F.avg("path_change").alias("mean_path_change"), F.avg("delta_c1").alias("mean_delta_c1"), F.avg("delta_c2").alias("mean_delta_c2"))


def result4(original: DataFrame, replanned: DataFrame, queries: DataFrame) -> DataFrame:
    """Both states of every (query, scheme) in contract order; infeasible ones have null costs and path."""
    keys = ["dataset", "query_id", "source", "target", "scheme"]
    wanted = original.select("dataset", "query_id", "scheme").join(queries, ["dataset", "query_id"])
    states = []
    for state, rows in (("original", original), ("disrupted", replanned)):
        own = rows.select("dataset", "query_id", "scheme", *COSTS, "path")
        states.append(wanted.join(own, ["dataset", "query_id", "scheme"], "left").select(*keys, F.lit(state).alias("network_state"), F.col("path").isNotNull().alias("feasible"), *COSTS, "path"))
    return states[0].unionByName(states[1])


def merge_order(rows: DataFrame) -> DataFrame:
    """Result rows by dataset, query, state (original first) and scheme."""
    scheme = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col("scheme")), F.lit(99))
    return rows.orderBy("dataset", "query_id", F.when(F.col("network_state") == "original", 0).otherwise(1), scheme)

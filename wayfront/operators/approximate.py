"""Approximate fronts: weights, cells, coverage, hypervolume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import HALTON_BASES, cell, costs, normalized, radical_inverse, score, weakly_dominates
from .skyline import skyline


#: Rows of a table of parameters (points, weights) that every group meets; more are refused.
MAX_PARAMETERS = 100_000


def every(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """``rows``, each with every row of a table of parameters, whose size is checked before it is sent to all tasks."""
    table = parameters.limit(MAX_PARAMETERS + 1).collect()
    if len(table) > MAX_PARAMETERS:
        raise ValueError(f"more than {MAX_PARAMETERS} parameters")
    names = parameters.columns
    known = rows.sparkSession.createDataFrame(table, parameters.schema).agg(F.collect_list(F.struct(*names)).alias("_all")).withColumn("_one", F.lit(1))
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(known), "_one").drop("_one").withColumn("_p", F.explode("_all")).select(*rows.columns, "_p.*")


def weight_grid(spark: SparkSession, k: int) -> DataFrame:
    """weight_id, w1..w3: all (a, b, c) of whole numbers from 0 that sum to k."""
    a = spark.range(k + 1).select(F.col("id").alias("w1"))
    b = a.withColumn("w2", F.explode(F.sequence(F.lit(0).cast("long"), k - F.col("w1"))))
    return b.select(F.format_string("%d-%d-%d", "w1", "w2", k - F.col("w1") - F.col("w2")).alias("weight_id"), "w1", "w2", (k - F.col("w1") - F.col("w2")).alias("w3"))


def halton(spark: SparkSession, n: int, m: int) -> DataFrame:
    """i (from 1), u1..um: the first n points of the Halton sequence."""
    return spark.range(1, n + 1).select(F.col("id").alias("i"), *[radical_inverse("id", b).alias(f"u{k + 1}") for k, b in enumerate(HALTON_BASES[:m])])


def simplex_weights(spark: SparkSession, n: int, m: int) -> DataFrame:
    """i, w1..wm: unit weights, equal weights, then interior ones (steps of 1 / (n - 1) on a line for m = 2, else -log of Halton points, scaled to 1)."""
    units = spark.range(m).select(F.col("id").alias("i"), *[(F.col("id") == k).cast("double").alias(f"w{k + 1}") for k in range(m)])
    equal = spark.range(1).select(F.lit(m).cast("long").alias("i"), *[F.lit(1.0 / m).alias(f"w{k + 1}") for k in range(m)])
    inside = max(n - m - 1, 0)
    if m == 2:
        share = F.col("id") / F.lit(float(max(n - 1, 1)))
        more = spark.range(inside).select((F.col("id") + m + 1).alias("i"), share.alias("w1"), (1 - share).alias("w2"))
    else:
        logs = halton(spark, inside, m).select("i", *[(-F.log(F.greatest(f"u{k + 1}", F.lit(1e-12)))).alias(f"v{k + 1}") for k in range(m)])
        total = sum((F.col(f"v{k + 1}") for k in range(1, m)), F.col("v1"))
        more = logs.select((F.col("i") + m).alias("i"), *[(F.col(f"v{k + 1}") / total).alias(f"w{k + 1}") for k in range(m)])
    return units.unionByName(equal).unionByName(more)


def ranges(rows: DataFrame, keys: list[str], m: int) -> DataFrame:
    """Ideal and nadir values lo1.., hi1.. of each group."""
    return rows.groupBy(*keys).agg(*[F.min(c).alias(f"lo{k + 1}") for k, c in enumerate(costs(m))], *[F.max(c).alias(f"hi{k + 1}") for k, c in enumerate(costs(m))])


def normalize(rows: DataFrame, keys: list[str], m: int, within: DataFrame | None = None) -> DataFrame:
    """``rows`` with z1..zm in the ranges of their group, or of ``within``."""
    wide = rows.join(within if within is not None else ranges(rows, keys, m), keys)
    for k, c in enumerate(costs(m)):
        wide = wide.withColumn(f"z{k + 1}", normalized(c, F.col(f"lo{k + 1}"), F.col(f"hi{k + 1}")))
    return wide.drop(*[f"{p}{k + 1}" for p in ("lo", "hi") for k in range(m)])


def _z(m: int) -> list[Column]:
    return [F.col(f"z{k + 1}") for k in range(m)]


def cells(rows: DataFrame, keys: list[str], m: int, eps: float, within: DataFrame | None = None) -> DataFrame:
    """``rows`` with k1..km, their cell, and score."""
    out = normalize(rows, keys, m, within)
    return out.withColumns({f"k{k + 1}": cell(z, eps) for k, z in enumerate(_z(m))} | {"score": score(_z(m), F.col("c1"))})


def representatives(celled: DataFrame, keys: list[str], m: int, order: list[str]) -> DataFrame:
    """The row of least score in each cell; ties go by ``order``."""
    others = [c for c in celled.columns if c not in (*keys, *[f"k{k + 1}" for k in range(m)])]
    best = F.min_by(F.struct(*others), F.struct("score", *order))
    return celled.groupBy(*keys, *[f"k{k + 1}" for k in range(m)]).agg(best.alias("r")).select(*keys, *[f"k{k + 1}" for k in range(m)], "r.*")


def eps_front(rows: DataFrame, keys: list[str], m: int, eps: float, order: list[str]) -> DataFrame:
    """Skyline, one representative for each cell of the skyline's own ranges, and the skyline of those."""
    first = skyline(rows, keys, m)
    reps = representatives(cells(first, keys, m, eps), keys, m, order)
    return skyline(reps.select(rows.columns), keys, m)


def coverage(approx: DataFrame, reference: DataFrame, keys: list[str], m: int, eps: float, within: DataFrame) -> DataFrame:
    """keys, n_reference, eps_coverage: share of reference vectors within eps of one of ``approx`` (normalised, additive)."""
    a, r = normalize(approx.select(*keys, *costs(m)).distinct(), keys, m, within).alias("a"), normalize(reference, keys, m, within).alias("r")
    near = [F.col(f"a.z{k + 1}") <= F.col(f"r.z{k + 1}") + F.lit(eps) for k in range(m)]
    on = [F.col(f"a.{k}") == F.col(f"r.{k}") for k in keys]
    condition = on[0]
    for c in [*on[1:], *near]:
        condition = condition & c
    covered = r.join(a, condition, "left_semi").groupBy(*keys).agg(F.count("*").alias("covered"))
    return reference.groupBy(*keys).agg(F.count("*").alias("n_reference")).join(covered, keys, "left").select(*keys, "n_reference", (F.coalesce("covered", F.lit(0)) / F.col("n_reference")).alias("eps_coverage"))


def hypervolume(front: DataFrame, keys: list[str], m: int, points: DataFrame, within: DataFrame) -> DataFrame:
    """keys, hv: share of the unit cube's ``points`` (i, u1..um) that a vector of the front dominates.

    The points are a parameter; every group meets the same ones.
    """
    asked = every(front.select(*keys).distinct(), points).withColumnsRenamed({f"u{k + 1}": f"c{k + 1}" for k in range(m)})
    z = normalize(front.select(*keys, *costs(m)).distinct(), keys, m, within)
    unit = z.select(*keys, *[F.least(F.greatest(f"z{k + 1}", F.lit(0.0)), F.lit(1.0)).alias(f"c{k + 1}") for k in range(m)]).alias("f")
    p = asked.alias("p")
    on = weakly_dominates("f", "p", costs(m))
    for k in keys:
        on = (F.col(f"p.{k}") == F.col(f"f.{k}")) & on
    hit = p.join(unit, on, "left_semi").groupBy(*keys).agg(F.count("*").alias("hit"))
    total = asked.groupBy(*keys).agg(F.count("*").alias("n"))
    return total.join(hit, keys, "left").select(*keys, (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("hv"))


def quality(front: DataFrame, keys: list[str], m: int, eps: float, points: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """keys, n, hv, eps_coverage, z_min_sum and z_max_sum of each group's front, in the ranges of front and reference together.

    Without a reference a front covers itself.
    """
    both = front if reference is None else front.select(*keys, *costs(m)).unionByName(reference.select(*keys, *costs(m)))
    within = ranges(both, keys, m)
    sums = within.select(*keys, *[sum((F.col(f"{p}{k}") for k in range(2, m + 1)), F.col(f"{p}1")).alias(n) for p, n in (("lo", "z_min_sum"), ("hi", "z_max_sum"))])
    out = front.groupBy(*keys).agg(F.count("*").alias("n")).join(hypervolume(front, keys, m, points, within), keys).join(sums, keys)
    if reference is None:
        return out.withColumn("eps_coverage", F.lit(1.0))
    return out.join(coverage(front, reference, keys, m, eps, within).drop("n_reference"), keys, "left").withColumn("eps_coverage", F.coalesce("eps_coverage", F.lit(1.0)))


def shortest_by_cost(candidates: DataFrame, keys: list[str], m: int) -> DataFrame:
    """One path for each first-m vector: the one of fewest nodes, then the least."""
    others = [c for c in candidates.columns if c not in (*keys, *costs(m))]
    best = F.min_by(F.struct(*others), F.struct(F.size("path"), F.col("path")))
    return candidates.groupBy(*keys, *costs(m)).agg(best.alias("r")).select(*keys, *costs(m), "r.*")

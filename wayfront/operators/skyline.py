"""Skylines of cost vectors within groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..functions.stored import cut
from ..functions.columns import costs, strictly_dominates, weakly_dominates

#: Vectors of one block, whose own skyline is found before blocks meet.
BLOCK_ROWS = 4096


def local_front(v: np.ndarray) -> np.ndarray:
    """Mask of the rows that no row strictly dominates; equal rows all stay."""
    keep = np.zeros(len(v), bool)
    front = np.zeros((0, v.shape[1]), v.dtype)
    order = np.lexsort(v.T[::-1])
    for at in range(0, len(order), 64):  # a row is dominated by rows before it only
        some = order[at : at + 64]
        own = v[some]
        pool = np.concatenate([front, own])
        worse = ((pool[:, None, :] <= own[None, :, :]).all(2) & (pool[:, None, :] < own[None, :, :]).any(2)).any(0)
        keep[some] = ~worse
        front = np.concatenate([front, own[~worse]])
    return keep


def distinct_skyline(rows: DataFrame, keys: list[str], m: int) -> DataFrame:
    """Distinct first-m vectors of each group that no other one dominates.

    Blocks of a group are thinned on their own first, so that a large group is not
    compared row by row in one task; the join then compares what is left.
    """
    names = costs(m)
    vectors = rows.select(*keys, *names).distinct()
    sizes = vectors.groupBy(*keys).agg(F.greatest(F.lit(1), F.expr(f"count(1) div {BLOCK_ROWS}")).alias("_blocks"))
    salted = vectors.join(sizes, keys).withColumn("_block", F.expr(f"pmod(xxhash64({', '.join(names)}), _blocks)")).drop("_blocks")

    ship(rows.sparkSession)

    def thin(group: pd.DataFrame) -> pd.DataFrame:
        return group[local_front(group[names].to_numpy())]

    thinned = cut(salted.groupBy(*keys, "_block").applyInPandas(thin, salted.schema).drop("_block"))
    return _undominated(thinned, thinned, keys, names)


def _undominated(rows: DataFrame, against: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    a, b = rows.alias("a"), against.select(*keys, *names).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    on = strictly_dominates("b", "a", names)
    for s in same:
        on = s & on
    return a.join(b, on, "left_anti")


def skyline(rows: DataFrame, keys: list[str], m: int) -> DataFrame:
    """All rows (equal ones and other columns too) whose first-m vector is in the skyline."""
    return rows.join(distinct_skyline(rows, keys, m), [*keys, *costs(m)], "left_semi").select(rows.columns)


def dominated(points: DataFrame, front: DataFrame, keys: list[str], m: int) -> DataFrame:
    """``points`` that some vector of ``front`` in their group weakly dominates."""
    a, b = points.alias("a"), front.select(*keys, *costs(m)).distinct().alias("b")
    on = weakly_dominates("b", "a", costs(m))
    for k in keys:
        on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
    return a.join(b, on, "left_semi")


def numbered(front: DataFrame, keys: list[str], m: int) -> DataFrame:
    """``front`` with solution_id, its place in lexicographic order within the group, from 1."""
    return front.withColumn("solution_id", F.expr(f"cast(row_number() over (partition by {', '.join(keys)} order by {', '.join(costs(m))}) as bigint)"))


def violations(front: DataFrame, keys: list[str], m: int) -> DataFrame:
    """By group: vectors, duplicates, and vectors that another one dominates."""
    names = costs(m)
    bad = distinct_skyline(front, keys, m)
    sizes = front.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(*names).alias("n_distinct"))
    good = bad.groupBy(*keys).agg(F.count("*").alias("n_good"))
    return sizes.join(good, keys).select(*keys, "n", (F.col("n") - F.col("n_distinct")).alias("n_duplicates"), (F.col("n_distinct") - F.col("n_good")).alias("n_dominated"))

"""Column expressions for cost vectors, paths and weights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COSTS = ("c1", "c2", "c3", "c4", "c5")

# Names of the five costs in order, difficulty limits of the batch and the
# scan classifier (queue, pending), bases of the low-discrepancy sequence.
OBJECTIVES = ("distance", "travel_time", "elevation", "avg_degree", "hop_count")
BATCH_LIMITS = ((2000, 200_000), (8000, 1_000_000))
SCAN_LIMITS = ((1500, 150_000), (6000, 800_000))
HALTON_BASES = (2, 3, 5, 7, 11)
BUCKETS = ("easy", "medium", "hard", "extreme")


def costs(m: int) -> list[str]:
    """Names of the first ``m`` costs."""
    return list(COSTS[:m])


def query_key(c: Column | str) -> Column:
    """Query ids as four digits at least; longer ones stay whole."""
    text = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


def path_text(path: Column | str) -> Column:
    """``1->2->3``."""
    return F.array_join(F.transform(path, lambda x: x.cast("string")), "->")


def path_parse(text: Column | str) -> Column:
    """Node ids of a path's text; null for null or blank text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.trim(text) != "", F.transform(F.split(text, "->"), lambda x: F.trim(x).cast("long")))


def path_edges(path: Column | str) -> Column:
    """Distinct directed steps of a path."""
    path = F.col(path) if isinstance(path, str) else path
    n = F.size(path)
    steps = F.zip_with(F.slice(path, 1, F.greatest(n - 1, F.lit(0))), F.slice(path, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.array_distinct(F.when(n > 1, steps).otherwise(F.slice(steps, 1, 0)))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over the union of two arrays; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _pairs(left: str, right: str, names: Sequence[str]) -> list[tuple[Column, Column]]:
    return [(F.col(f"{left}.{c}"), F.col(f"{right}.{c}")) for c in names]


def weakly_dominates(left: str, right: str, names: Sequence[str]) -> Column:
    """No cost of ``left`` is above that of ``right``."""
    return reduce(Column.__and__, [a <= b for a, b in _pairs(left, right, names)])


def strictly_dominates(left: str, right: str, names: Sequence[str]) -> Column:
    """Weakly, and some cost is below."""
    return weakly_dominates(left, right, names) & reduce(Column.__or__, [a < b for a, b in _pairs(left, right, names)])


def normalized(c: str, low: Column, high: Column) -> Column:
    """(c - low) / max(high - low, 1)."""
    return (F.col(c) - low) / F.greatest((high - low).cast("double"), F.lit(1.0))


def padded(rows, m: int):
    """``rows`` with c1..cm and zeros for the costs from there to the fifth."""
    return rows.withColumns({c: F.lit(0).cast("long") for c in COSTS[m:]})


def cell(z: Column, eps: float) -> Column:
    return F.floor(z / F.lit(max(eps, 1e-12))).cast("long")


def score(zs: Sequence[Column], first_cost: Column) -> Column:
    """Representative's score: distance to the ideal point, then the first cost."""
    return reduce(Column.__add__, zs) + F.lit(1e-9) * first_cost


def scalarized(names: Sequence[str], weights: Sequence[Column], scales: Sequence[Column]) -> Column:
    return reduce(Column.__add__, [w * F.col(c) / s for c, w, s in zip(names, weights, scales, strict=True)])


def percent_delta(new: Column, old: Column) -> Column:
    return F.when(old != 0, F.round(100 * (new - old) / old, 2))


def relative_delta(new: Column, old: Column) -> Column:
    return F.when(old != 0, (new - old) / old)


def progress(done: Column, left: Column) -> Column:
    """Share of the way that is done; null where both parts are 0."""
    return F.when(done + left != 0, done / (done + left))


def radical_inverse(n: str, base: int, digits: int = 40) -> Column:
    """Digits of ``n`` to ``base``, mirrored at the point."""
    step = f"named_struct('n', s.n div {base}, 'f', s.f / {base}, 'r', s.r + s.f / {base} * (s.n % {base}))"
    zero = f"named_struct('n', cast({n} as bigint), 'f', 1.0D, 'r', 0.0D)"
    return F.expr(f"aggregate(sequence(1, {digits}), {zero}, (s, i) -> case when s.n > 0 then {step} else s end, s -> s.r)")


def difficulty(exact: Column, queue: Column, pending: Column, limits=SCAN_LIMITS) -> Column:
    """easy, medium, hard or extreme, by what a budgeted search left behind."""
    (q1, p1), (q2, p2) = limits
    return F.when(exact, "easy").when((queue <= q1) & (pending <= p1), "medium").when((queue <= q2) & (pending <= p2), "hard").otherwise("extreme")


def status(exact: Column, mode: Column, early: Column) -> Column:
    return F.when(F.coalesce(mode, F.lit("")).contains("RESOURCE"), "RESOURCE_LIMIT").when(exact, "EXACT").when(early, "EARLY_STOP").otherwise("INCOMPLETE")

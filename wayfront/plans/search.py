"""Graph searches as grouped kernels: one task holds one network and a share of its queries.

Queries are dealt over ``shards`` groups for each network, and each group gets a copy of
the network's edges; so many queries on one network run side by side.  A network must
fit into a task (``MAX_EDGES``); a larger one raises an error there, and is searched by
``plans.fixpoint`` instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations
from operator import add, mul

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import COSTS, OBJECTIVES, costs
from ..functions.ship import ship
from ..functions.stored import cut
from ..operators import corridor, networks
from ..operators.skyline import distinct_skyline
from . import kernels

MAX_EDGES = 20_000_000
#: Nodes times weights whose sums a task holds at once.
PLACES = 4_000_000


def per_network(edges: DataFrame, queries: DataFrame, search: Callable[[kernels.Network, dict], Iterator[tuple]], schema: str, shards: int = 1) -> DataFrame:
    """Rows that ``search(network, query)`` yields for each row of ``queries`` (which has dataset)."""
    ship(edges.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]
    copied = edges.select(*[F.col(c).alias(c) for c in ("dataset", "src", "dst", *COSTS)]).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = queries.select(*[F.col(c).alias(c) for c in queries.columns]).withColumn("_shard", F.expr(f"cast(pmod(xxhash64({', '.join(queries.columns)}), {shards}) as int)"))

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if len(own) > MAX_EDGES:
            raise ValueError(f"a network of {len(own)} edges is too large for one task")
        if not len(asked):
            return pd.DataFrame([], columns=names)
        c = own[list(COSTS)].to_numpy().tolist()
        net = kernels.network((s, d, tuple(v)) for s, d, v in zip(own["src"].tolist(), own["dst"].tolist(), c, strict=True))
        # what searches for one target share is kept from one query to the next
        asked = asked.sort_values([c for c in ("target", "source") if c in asked])
        rows = [row for q in asked.to_dict("records") for row in search(net, q)]
        return pd.DataFrame(rows, columns=names)

    return copied.groupBy("dataset", "_shard").cogroup(dealt.groupBy("dataset", "_shard")).applyInPandas(run, schema)


VECTORS = ", ".join(f"{c} long" for c in COSTS)


def single_objective(edges: DataFrame, queries: DataFrame, shards: int = 1) -> DataFrame:
    """dataset, query_id, source, target, objective, c1..c5, path: for each objective the path of
    least cost; ties go to the least vector, then to the least path.  Unreachable targets give no row."""

    def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
        for k, name in enumerate(OBJECTIVES):
            found = kernels.shortest(net, q["source"], lambda c, k=k: (c[k], *c), q["target"]).get(q["target"])
            if found or q["source"] == q["target"]:
                vector, path = (found[1], found[2]) if found and found[1] else ((0,) * 5, (q["source"],))
                yield (q["dataset"], q["query_id"], q["source"], q["target"], name, *vector, list(path))

    return per_network(edges, queries, search, f"dataset string, query_id string, source long, target long, objective string, {VECTORS}, path array<long>", shards)


def distances(edges: DataFrame, queries: DataFrame, objective: int, shards: int = 1) -> DataFrame:
    """dataset, source, node, distance for every node reached from each source (1-based objective)."""

    def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
        for node, d in kernels.distances(net, q["source"], objective - 1).items():
            yield q["dataset"], q["source"], node, d

    return per_network(edges, queries.select("dataset", "source").distinct(), search, "dataset string, source long, node long, distance long", shards)


def fewest_hops(edges: DataFrame, queries: DataFrame, shards: int = 1) -> DataFrame:
    """dataset, source, node, hops."""

    def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
        for node, d in kernels.hops(net, q["source"]).items():
            yield q["dataset"], q["source"], node, d

    return per_network(edges, queries.select("dataset", "source").distinct(), search, "dataset string, source long, node long, hops long", shards)


def to_go(edges: DataFrame, queries: DataFrame, m: int = 3, shards: int = 1) -> DataFrame:
    """dataset, target, node, h1..hm: least costs from each node to each distinct target, searched once."""

    def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
        found = net.to_go(q["target"], m)
        for node in found[0]:
            yield (q["dataset"], q["target"], node, *(f[node] for f in found))

    return per_network(edges, queries.select("dataset", "target").distinct(), search, "dataset string, target long, node long, " + ", ".join(f"h{k + 1} long" for k in range(m)), shards)


def so_far(edges: DataFrame, queries: DataFrame, m: int = 3, shards: int = 1) -> DataFrame:
    """dataset, source, node, d1..dm: least costs from each distinct source."""
    found = to_go(networks.reverse(edges), queries.select("dataset", F.col("source").alias("target")), m, shards)
    return found.withColumnRenamed("target", "source").withColumnsRenamed({f"h{k + 1}": f"d{k + 1}" for k in range(m)})


def lexicographic(edges: DataFrame, queries: DataFrame, shards: int = 1) -> DataFrame:
    """dataset, query_id, ord (as ``213``), c1..c3: least vectors in each order of three objectives."""

    def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
        for order in permutations(range(3)):
            found = kernels.shortest(net, q["source"], lambda c, o=order: tuple(c[k] for k in o), q["target"]).get(q["target"])
            if found and found[1]:
                yield (q["dataset"], q["query_id"], "".join(str(k + 1) for k in order), *found[1][:3])

    return per_network(edges, queries, search, "dataset string, query_id string, ord string, c1 long, c2 long, c3 long", shards)


def weighted(edges: DataFrame, queries: DataFrame, weights: DataFrame, shards: int = 1) -> DataFrame:
    """``queries`` x ``weights`` (weight_id, w1..w5, whole numbers): least weighted sum, its vector and path.

    Ties go to the least vector, then to the least path.  The weights are parameters, at
    most ``MAX_WEIGHTS``, and every task has them.
    """
    table = [tuple(w) for w in weights.select("weight_id", *[f"w{k + 1}" for k in range(5)]).limit(MAX_WEIGHTS + 1).collect()]
    if len(table) > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights")

    def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
        for name, *w in table:
            found = kernels.shortest(net, q["source"], lambda c, w=w: (sum(map(mul, w, c)),), q["target"]).get(q["target"])
            if found and found[1]:
                yield (q["dataset"], q["query_id"], name, found[0][0], *found[1], list(found[2]))

    return per_network(edges, queries, search, f"dataset string, query_id string, weight_id string, total long, {VECTORS}, path array<long>", shards)


#: A table of weights is a parameter; beyond this number it is refused.
MAX_WEIGHTS = 100_000


def pareto(edges: DataFrame, queries: DataFrame, m: int, seeds: DataFrame | None = None, bounds: bool = True, max_expanded: int | None = None, shards: int = 1) -> DataFrame:
    """dataset, query_id, status, solution (array<long>) of all efficient vectors; one row with null
    solution if there is none.  status is EXACT, or RESOURCE_LIMIT if ``max_expanded`` ended the search.

    ``seeds`` (dataset, query_id, c1..cm) are vectors of known paths.
    """
    asked = queries.select("dataset", "query_id", "source", "target")
    if seeds is not None:
        known = seeds.groupBy("dataset", "query_id").agg(F.collect_set(F.array(*costs(m))).alias("seeds"))
        asked = asked.join(known, ["dataset", "query_id"], "left")

    def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
        own = q.get("seeds")
        found, stats = kernels.pareto(net, q["source"], q["target"], m, bounds, [tuple(s) for s in own] if own is not None else (), max_expanded)
        state = "EXACT" if stats["exact"] else "RESOURCE_LIMIT"
        counters = (stats["expanded"], stats["generated"], stats["open_peak"])
        for v in found or [None]:
            yield (q["dataset"], q["query_id"], state, *counters, list(v) if v else None)

    return per_network(edges, asked, search, "dataset string, query_id string, status string, expanded long, generated long, open_peak long, solution array<long>", shards)


def front(edges: DataFrame, queries: DataFrame, m: int, **options) -> DataFrame:
    """dataset, query_id, c1..cm of the exact front; only queries whose search ended."""
    rows = pareto(edges, queries, m, **options).where("status = 'EXACT' and solution is not null")
    return rows.select("dataset", "query_id", *[F.col("solution")[k].alias(c) for k, c in enumerate(costs(m))])


def trees(edges: DataFrame, sources: DataFrame, objective: int, shards: int = 1) -> DataFrame:
    """dataset, source, node, distance, before: least sums from each source, and the least node before on such a path (null at the source)."""

    def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
        dist, before = kernels.tree(net, q["source"], objective - 1)
        for node, d in dist.items():
            yield q["dataset"], q["source"], node, d, before.get(node)

    return per_network(edges, sources.select("dataset", "source").distinct(), search, "dataset string, source long, node long, distance long, before long", shards)


def point_to_point(edges: DataFrame, queries: DataFrame, objectives: list[int], ways: int = 2, shards: int = 1) -> DataFrame:
    """dataset, query_id, objective (1-based), cost, path: one search for each objective, that stops at the target.

    ``ways`` is 2 for searches from both ends, 1 for one from the source.  Hops (objective
    5) are searched by levels.  Unreachable targets give a row with null cost and path; a
    source or target that no edge names is an error.
    """

    def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
        s, t = q["source"], q["target"]
        for end in (s, t):
            if end not in net and end not in net.back:
                raise ValueError(f"node {end} isn't in network {q['dataset']}")
        for k in objectives:
            if ways == 2:
                found = kernels.hops_both_ways(net, s, t) if k == 5 else kernels.both_ways(net, s, t, k - 1)
                path, cost = (found[0], found[1]) if found else (None, None)
            else:
                dist, before = kernels.tree(net, s, k - 1, t)
                path, cost = (kernels.walk(before, t)[::-1], dist[t]) if t in dist else (None, None)
            yield q["dataset"], q["query_id"], k, cost, path

    return per_network(edges, queries, search, "dataset string, query_id string, objective int, cost long, path array<long>", shards)


def bounds_and_seeds(edges: DataFrame, queries: DataFrame, shards: int = 1) -> DataFrame:
    """What corridors need of three objectives, in one pass over each network: rows of kind ``ahead`` (dataset, source, node, v1..v3),
    ``behind`` (dataset, target, node, v1..v3) and ``seed`` (dataset, query_id, ord, v1..v3)."""

    def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
        name, s, t = q["dataset"], q["source"], q["target"]
        ahead = [kernels.distances(net, s, k) for k in range(3)]
        for node in ahead[0]:
            yield ("ahead", name, None, s, None, node, None, *(d[node] for d in ahead))
        behind = net.to_go(t, 3)
        for node in behind[0]:
            yield ("behind", name, None, None, t, node, None, *(d[node] for d in behind))
        for order in permutations(range(3)):
            found = kernels.shortest(net, s, lambda c, o=order: tuple(c[k] for k in o), t).get(t)
            if found and found[1]:
                yield ("seed", name, q["query_id"], s, t, None, "".join(str(k + 1) for k in order), *found[1][:3])

    return per_network(edges, queries, search, "kind string, dataset string, query_id string, source long, target long, node long, ord string, v1 long, v2 long, v3 long", shards)


def _scaled(weights: list[tuple], scales: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Whole coefficients in the ratio of weight over scale."""
    whole = [1] * len(scales)
    for i in range(len(scales)):
        for j, s in enumerate(scales):
            whole[i] *= s if i != j else 1
    return [tuple(w * x for w, x in zip(own, whole, strict=True)) for own in weights]


def seed_vectors(edges: DataFrame, queries: DataFrame, weights: list[tuple[int, int, int]], scales: DataFrame | None = None, shards: int = 1) -> DataFrame:
    """dataset, query_id, c1..c3: vectors of the least weighted sums of three costs, weights over ``scales`` (dataset, s1..s3).

    One reverse tree for each target and weight serves all queries of that target.
    """
    asked = queries.select("dataset", "query_id", "source", "target")
    if scales is not None:
        asked = asked.join(scales.select("dataset", "s1", "s2", "s3"), "dataset")

    def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
        if net.kept[0] != q["target"]:
            coefficients = _scaled(weights, (q["s1"], q["s2"], q["s3"])) if "s1" in q else weights
            net.kept = q["target"], [kernels.reverse_tree(net, q["target"], lambda c, w=w: sum(map(mul, w, c)))[0] for w in dict.fromkeys(coefficients)]
        for v in {tree[q["source"]][1:] for tree in net.kept[1] if q["source"] in tree}:
            yield (q["dataset"], q["query_id"], *v)

    return per_network(edges, asked, search, "dataset string, query_id string, c1 long, c2 long, c3 long", shards)


def suffixes(edges: DataFrame, queries: DataFrame, shards: int = 1) -> DataFrame:
    """dataset, target, node, objective (1..3), c1..c3: what remains to the target on the tree of each objective."""

    def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
        for k in range(3):
            for node, label in kernels.reverse_tree(net, q["target"], lambda c, k=k: c[k])[0].items():
                yield (q["dataset"], q["target"], node, k + 1, *label[1:])

    return per_network(edges, queries.select("dataset", "target").distinct(), search, "dataset string, target long, node long, objective int, c1 long, c2 long, c3 long", shards)


def generated(edges: DataFrame, queries: DataFrame, weights: list[tuple], m: int, unit: int = 1_000_000, shards: int = 1) -> DataFrame:
    """dataset, query_id, c1..c5, path: candidates of weighted runs, scaled by the spans of the m anchors (single-objective routes).

    ``weights`` are shares; a run's coefficients are whole numbers, round(unit * w / span),
    so that ties don't hang on rounding.  Anchors are candidates themselves.
    """

    shares = np.array(weights, np.float64).reshape(-1, m)

    def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
        s, t = q["source"], q["target"]
        anchors = [kernels.shortest(net, s, lambda c, k=k: (c[k],), t).get(t) for k in range(m)]
        if not anchors[0] or not anchors[0][1]:
            return
        ends = [(min(a[1][k] for a in anchors), max(a[1][k] for a in anchors)) for k in range(m)]
        out = {a[1:] for a in anchors}
        scaled = np.floor(unit * shares / np.array([max(hi - lo, 1) for lo, hi in ends]) + 0.5).astype(np.int64)
        step = max(1, PLACES // len(net))
        for at in range(0, len(scaled), step):
            out |= kernels.shortest_each(net, s, t, scaled[at : at + step])
        for vector, path in out:
            yield (q["dataset"], q["query_id"], *vector, list(path))

    return per_network(edges, queries, search, f"dataset string, query_id string, {VECTORS}, path array<long>", shards)


def all_routes(edges: DataFrame, queries: DataFrame, shards: int = 1) -> DataFrame:
    """dataset, query_id, source, target, c1..c5, path of every route without a node twice: for small networks."""

    def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
        stack = [((q["source"],), (0,) * 5)]
        while stack:
            path, vector = stack.pop()
            if path[-1] == q["target"]:
                yield (q["dataset"], q["query_id"], q["source"], q["target"], *vector, list(path))
                continue
            stack += [((*path, other), tuple(map(add, vector, c))) for other, c in net.get(path[-1], ()) if other not in path]

    return per_network(edges, queries, search, f"dataset string, query_id string, source long, target long, {VECTORS}, path array<long>", shards)


def pareto_front(edges: DataFrame, queries: DataFrame, m: int, mode: str = "exact", **options) -> DataFrame:
    """dataset, query_id, c1..cm of the exact front by one of the searches: ``exact`` (bounds, any m), ``unbounded`` (no bounds),
    ``one_label`` (a queue with one label for each node) or ``corridor`` (three objectives: seeds, and the edges that they leave)."""
    if mode in ("exact", "unbounded"):
        return front(edges, queries, m, bounds=mode == "exact", **options)
    if mode == "one_label":

        def search(net: kernels.Network, q: dict) -> Iterator[tuple]:
            for v in kernels.one_label_each(net, q["source"], q["target"], m)[0]:
                yield (q["dataset"], q["query_id"], *v)

        return per_network(edges, queries, search, "dataset string, query_id string, " + ", ".join(f"{c} long" for c in costs(m)), **options)
    if mode == "corridor" and m == 3:
        known = cut(bounds_and_seeds(edges, queries, **options))
        incumbents = distinct_skyline(seeds_of(known), ["dataset", "query_id"], 3)
        kept = corridor.edges(queries, edges, *bounds_of(known), incumbents).select(edges.columns)
        found = front(kept, queries, 3, seeds=incumbents, **options)
        return distinct_skyline(found.unionByName(incumbents.select(found.columns)), ["dataset", "query_id"], 3)
    raise ValueError(f"no search {mode!r} for {m} objectives")


def bounds_of(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distances from sources and to targets, of ``bounds_and_seeds``; a source or target of several queries counts once."""
    side = lambda kind, end, v: known.where(f"kind = '{kind}'").select("dataset", end, "node", *[F.col(f"v{k}").alias(f"{v}{k}") for k in (1, 2, 3)]).distinct()
    return side("ahead", "source", "d"), side("behind", "target", "h")


def seeds_of(known: DataFrame) -> DataFrame:
    """dataset, query_id, ord, c1..c3 of ``bounds_and_seeds``."""
    return known.where("kind = 'seed'").select("dataset", "query_id", "ord", *[F.col(f"v{k}").alias(f"c{k}") for k in (1, 2, 3)])

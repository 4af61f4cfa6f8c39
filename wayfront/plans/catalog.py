"""Queries over the star-schema tables, one for each operator, and SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.stored import cut
from ..operators import analysis, approximate, corridor, jobs, networks, preference, skyline
from ..sources import files, tables
from . import fixpoint, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUERY = ["dataset", "query_id"]
C3, C5 = ", ".join(X.COSTS[:3]), ", ".join(X.COSTS)
EPS, POINTS, GRID_K = 0.1, 256, 6

# ---------------------------------------------------------------- tables in SQL

W, T = tables.WIDTH, tables.TILE


def _tile(x: str) -> str:
    return f"((({x} - 1) // {W} // {T}) * {W // T} + (({x} - 1) % {W}) // {T})"


def _sums(edge: str) -> str:
    return ", ".join(f"r.{c} + {edge}.{c}" for c in X.COSTS)


def _dominates(a: str, b: str, m: int) -> str:
    return " and ".join(f"{a}.c{k} <= {b}.c{k}" for k in range(1, m + 1)) + " and (" + " or ".join(f"{a}.c{k} < {b}.c{k}" for k in range(1, m + 1)) + ")"


SQL: dict[str, str] = {
    "nodes": "select p_partkey + 1 as id, p_size::bigint as size from part",
    "edges": f"""select 'GRID' as dataset, a.id as src, b.id as dst, 1 + (a.id * 7919 + b.id * 104729) % 97 + a.size as c1, 1 + (a.id * 31 + b.id * 17) % 53 + b.size as c2,
        (a.id * 13 + b.id * 29) % 11 as c3, (a.id + b.id) % 4 + 2 as c4, 1::bigint as c5, a.id * 100000000 + b.id as edge_seq
        from (select *, unnest([id + 1, id - 1, id + {W}, id - {W}]) as other from nodes) a join nodes b on b.id = a.other where abs(a.id - b.id) = {W} or (a.id - 1) // {W} = (b.id - 1) // {W}""",
    "districts": f"select 'D' || lpad(({_tile('src')})::varchar, 6, '0') as dataset, * exclude (dataset) from edges where dst > src and {_tile('src')} = {_tile('dst')}",
    "od": f"select 'D' || lpad(({_tile('id')})::varchar, 6, '0') as dataset, lpad(({_tile('id')} + 1)::varchar, 6, '0') as query_id, min(id) as source, max(id) as target from nodes group by all",
    "routes": f"""select dataset, query_id, source, target, source as node, [source] as path, 0::bigint as c1, 0::bigint as c2, 0::bigint as c3, 0::bigint as c4, 0::bigint as c5 from od
        union all select r.dataset, r.query_id, r.source, r.target, e.dst, list_append(r.path, e.dst), {_sums('e')} from routes r join districts e on e.dataset = r.dataset and e.src = r.node""",
    "full_routes": "select * from routes where node = target",
    "vectors": " union all ".join(f"(select dataset, query_id, source, target, '{name}' as objective, {C5}, path from full_routes qualify row_number() over (partition by dataset, query_id order by c{k + 1}, {C5}, path) = 1)" for k, name in enumerate(X.OBJECTIVES)),
    "closed": "select e.dataset, src, dst from districts e join od using (dataset) where (src * 31 + dst * 17) % 23 = 0 and src <> source and dst <> target",
    "open_edges": "select * from districts e where not exists (from closed c where c.dataset = e.dataset and c.src = e.src and c.dst = e.dst)",
    "pool": "select l_suppkey as dataset, l_orderkey, round(l_quantity)::bigint as c1, round(l_extendedprice * 100)::bigint as c2, round(l_discount * 100)::bigint as c3, round(l_tax * 100)::bigint as c4, l_linenumber::bigint as c5 from lineitem",
    "searches": "select 'C' || (l_orderkey % 3) as dataset, lpad(l_orderkey::varchar, 8, '0') as query_id, n <= 2 as exact, n = 3 as early, case when n >= 7 then 'RESOURCE_LABELS' else 'run' end as mode, n * 1000 as expanded, n * 1700 + q as generated, q * 40 as open_peak, p * 3 as nqp_live, q::double as wall from (select l_orderkey, count(*) as n, sum(l_quantity)::bigint as q, sum(round(l_extendedprice))::bigint as p from lineitem group by l_orderkey)",
    "open_routes": f"""select dataset, query_id, source, target, source as node, [source] as path, 0::bigint as c1, 0::bigint as c2, 0::bigint as c3, 0::bigint as c4, 0::bigint as c5 from od
        union all select r.dataset, r.query_id, r.source, r.target, e.dst, list_append(r.path, e.dst), {_sums('e')} from open_routes r join open_edges e on e.dataset = r.dataset and e.src = r.node""",
    "ahead": "select dataset, source, node, min(c1) as d1, min(c2) as d2, min(c3) as d3 from routes group by all",
    "back": "select dataset, target, target as node, 0::bigint as c1, 0::bigint as c2, 0::bigint as c3 from od union all select r.dataset, r.target, e.src, r.c1 + e.c1, r.c2 + e.c2, r.c3 + e.c3 from back r join districts e on e.dataset = r.dataset and e.dst = r.node",
    "behind": "select dataset, target, node, min(c1) as h1, min(c2) as h2, min(c3) as h3 from back group by all",
    "lexmin": " union all ".join(f"(select dataset, query_id, '{o}' as ord, {C3} from full_routes qualify row_number() over (partition by dataset, query_id order by {', '.join(f'c{d}' for d in o)}) = 1)" for o in ("123", "132", "213", "231", "312", "321")),
    "incumbents": f"select distinct dataset, query_id, {C3} from lexmin a where not exists (from lexmin b where b.dataset = a.dataset and b.query_id = a.query_id and {_dominates('b', 'a', 3)})",
    "node_bounds": "select o.dataset, query_id, source, target, node, d1 + h1 as l1, d2 + h2 as l2, d3 + h3 as l3 from od o join ahead using (dataset, source) join behind using (dataset, target, node)",
    "kept_nodes": "select dataset, query_id, node, l1, l2, l3 from node_bounds a where node in (source, target) or not exists (from incumbents b where b.dataset = a.dataset and b.query_id = a.query_id and b.c1 <= l1 and b.c2 <= l2 and b.c3 <= l3)",
    "edge_bounds": "select o.dataset, query_id, src, dst, c1, c2, c3, c4, c5, edge_seq, d1 + c1 + h1 as l1, d2 + c2 + h2 as l2, d3 + c3 + h3 as l3 from od o join districts e using (dataset) join ahead a on a.dataset = o.dataset and a.source = o.source and a.node = src join behind b on b.dataset = o.dataset and b.target = o.target and b.node = dst",
    "kept_edges": "select * from edge_bounds a where not exists (from incumbents b where b.dataset = a.dataset and b.query_id = a.query_id and b.c1 <= l1 and b.c2 <= l2 and b.c3 <= l3)",
    "schemes": "select * from (values " + ", ".join(f"('{k}', " + ", ".join(f"{x}::double" for x in v) + ")" for k, v in preference.SCHEMES.items()) + ") s(scheme, w1, w2, w3, w4, w5)",
    "pool_z": "select *, " + ", ".join(f"(c{k} - min(c{k}) over p) / greatest((max(c{k}) over p - min(c{k}) over p)::double, 1.0) as z{k}" for k in range(1, 6)) + " from pool window p as (partition by dataset)",
    "matrix": "select dataset, query_id, i, j, cost, max(case when i = j then cost end) over (partition by dataset, query_id, j) as best, max(cost) over (partition by dataset, query_id, j) as worst from (select dataset, query_id, list_position([" + ", ".join(f"'{o}'" for o in X.OBJECTIVES) + f"], objective) as i, unnest([1, 2, 3, 4, 5]) as j, unnest([{C5}]) as cost from vectors)",
    "regret": "select dataset, query_id, i, j, (cost - best) / greatest(best, 1) as regret from matrix",
    "overlap": """select a.dataset, a.query_id, a.i, b.i as j, a.path = b.path as identical,
        case when len(list_distinct(a.e || b.e)) = 0 then 1.0 else len(list_intersect(a.e, b.e)) / len(list_distinct(a.e || b.e)) end as edge_jaccard, len(list_intersect(a.path, b.path)) / len(list_distinct(a.path || b.path)) as node_jaccard
        from ways a join ways b on a.dataset = b.dataset and a.query_id = b.query_id and a.i < b.i""",
    "ways": "select dataset, query_id, list_position([" + ", ".join(f"'{o}'" for o in X.OBJECTIVES) + "], objective) as i, path, list_transform(range(1, len(path)), lambda k: path[k] || '-' || path[k + 1]) as e from vectors",
}

for _m in (2, 3, 5):
    _c = ", ".join(X.COSTS[:_m])
    SQL[f"front{_m}"] = f"select distinct dataset, query_id, {_c} from full_routes a where not exists (from full_routes b where b.dataset = a.dataset and b.query_id = a.query_id and {_dominates('b', 'a', _m)})"
    SQL[f"sky{_m}"] = f"select * from pool a where not exists (from pool b where b.dataset = a.dataset and {_dominates('b', 'a', _m)})"

NEEDS = {name: [other for other in SQL if other != name and re.search(rf"\b(from|join) {other}\b", text)] for name, text in SQL.items()}


def sql(text: str) -> str:
    """``text`` with the tables that it reads as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in NEEDS[name]:
                visit(other)
            order.append(name)

    for name in SQL:
        if re.search(rf"\b(from|join) {name}\b", text):
            visit(name)
    return "with recursive " + ", ".join(f"{n} as ({SQL[n]})" for n in order) + " " + text if order else text


def query(oracle: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = sql(oracle)
        return f

    return add


# ---------------------------------------------------------------- tables in Spark


def _districts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tables.districts(tables.grid(spark, d)), tables.queries(spark, d)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return search.single_objective(*_districts(spark, d))


def _origin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("GRID", 1, 1)], "dataset string, source long, target long")


CITY = "'C' || (substr(dataset, 2)::bigint % 3)"

# ---------------------------------------------------------------- networks


@query("select * from edges")
def edges_build(spark, d):
    return tables.grid(spark, d)


@query("select dataset, dst as src, src as dst, c1, c2, c3, c4, c5, edge_seq from edges")
def edges_reverse(spark, d):
    return networks.reverse(tables.grid(spark, d))


@query("select dataset, src, dst, c1, c2, c3, c4, c5, edge_seq from edges where src <> dst qualify row_number() over (partition by dataset, src, dst order by edge_seq) = 1")
def edges_canonical(spark, d):
    return networks.canonical(tables.grid(spark, d))


@query("select dataset, node, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from (select dataset, src as node, 1 as o, 0 as i from edges union all select dataset, dst, 0, 1 from edges) group by all")
def node_degree(spark, d):
    return networks.degrees(tables.grid(spark, d))


@query("select dataset, " + ", ".join(f"greatest(1, coalesce(trunc(quantile_cont({c}, 0.5) filter (where {c} > 0)), 1))::bigint as s{k + 1}" for k, c in enumerate(X.COSTS)) + " from districts group by dataset")
def positive_median_scales(spark, d):
    return networks.positive_medians(_districts(spark, d)[0])


@query("select c.* from closed c where exists (from districts e where e.dataset = c.dataset and e.src = c.src and e.dst = c.dst)")
def edge_exists(spark, d):
    own, asked = _districts(spark, d)
    return networks.existing(tables.closed(own, asked), own)


@query("select * from open_edges")
def closed_delete(spark, d):
    own, asked = _districts(spark, d)
    return networks.without(own, tables.closed(own, asked))


def _sssp_sql(cost: str, src: str = "src", dst: str = "dst", start: str = "1", column: str = "distance") -> str:
    base = f"with recursive nodes as ({SQL['nodes']}), edges as ({SQL['edges']}), "
    return base + f"""best(node, distance) using key (node) as (select {start}::bigint, 0::bigint union
        (select e.{dst}, min(r.distance + e.{cost}) from best r join edges e on e.{src} = r.node left join recurring.best k on k.node = e.{dst} where k.distance is null or r.distance + e.{cost} < k.distance group by e.{dst}))
        select 'GRID' as dataset, {start}::bigint as source, node, distance as {column} from best"""


for _k in range(1, 5):
    QUERIES[f"sssp_c{_k}"] = partial(lambda spark, d, k: search.distances(tables.grid(spark, d), _origin(spark), k), k=_k)
    ORACLES[f"sssp_c{_k}"] = _sssp_sql(f"c{_k}")


@query()
def bfs_hops(spark, d):
    return search.fewest_hops(tables.grid(spark, d), _origin(spark))


ORACLES["bfs_hops"] = _sssp_sql("c5", column="hops")


@query("select o.dataset, o.source, a.node, d1 as distance from od o join ahead a using (dataset, source)")
def sssp_fixpoint(spark, d):
    """The distributed form, on all districts at once."""
    own, asked = _districts(spark, d)
    return fixpoint.distances(own, asked, "c1")


@query("select dataset, source, node, min(len(path)) - 1 as hops from routes group by all")
def bfs_fixpoint(spark, d):
    return fixpoint.hops(*_districts(spark, d))


@query("select * from behind")
def heuristics3(spark, d):
    return search.to_go(*_districts(spark, d))


@query("select * from ahead")
def forward_distances3(spark, d):
    return search.so_far(*_districts(spark, d))


for _k in range(1, 4):
    QUERIES[f"reverse_sssp_c{_k}"] = partial(lambda spark, d, k: search.distances(networks.reverse(tables.grid(spark, d)), _origin(spark), k), k=_k)
    ORACLES[f"reverse_sssp_c{_k}"] = _sssp_sql(f"c{_k}", "dst", "src")


@query(f"select dataset, query_id, source, target, objective, {C5}, array_to_string(path, '->') as path from vectors")
def single_objective_vectors(spark, d):
    return _vectors(spark, d).withColumn("path", X.path_text("path"))


@query(f"select dataset, query_id, objective, {C5}, true as valid from vectors")
def path_eval(spark, d):
    return networks.path_costs(_vectors(spark, d), _districts(spark, d)[0], [*QUERY, "objective"])


@query("select dataset, query_id, objective, not list_bool_or(list_transform(range(1, len(path)), lambda k: (path[k] * 31 + path[k + 1] * 17) % 23 = 0 and path[k] <> source and path[k + 1] <> target)) as valid from vectors where len(path) > 1 union all select dataset, query_id, objective, true from vectors where len(path) = 1")
def path_validate(spark, d):
    """Whether each best route is still one after the closures."""
    own, asked = _districts(spark, d)
    left = networks.without(own, tables.closed(own, asked))
    return networks.path_costs(search.single_objective(own, asked), left, [*QUERY, "objective"]).select(*QUERY, "objective", "valid")


@query("select dataset, query_id, objective, array_to_string(path, '->') as path, len(path)::int as n_nodes, list_sum(path)::bigint as node_sum from vectors")
def path_text_round_trip(spark, d):
    text = _vectors(spark, d).select(*QUERY, "objective", X.path_text("path").alias("path"))
    back = text.withColumn("nodes", X.path_parse("path"))
    return back.select(*QUERY, "objective", "path", F.size("nodes").alias("n_nodes"), F.expr("aggregate(nodes, 0L, (s, x) -> s + x)").alias("node_sum"))


@query("select * from lexmin")
def lexmin_orders(spark, d):
    return search.lexicographic(*_districts(spark, d))


# ---------------------------------------------------------------- corridor and seeds


def _corridor(spark, d):
    own, asked = _districts(spark, d)
    own, asked = cut(own), cut(asked)
    known = cut(search.bounds_and_seeds(own, asked))
    incumbents = cut(skyline.distinct_skyline(search.seeds_of(known), QUERY, 3))
    return own, asked, *search.bounds_of(known), incumbents


@query("select * from incumbents")
def lexmin_seeds(spark, d):
    return _corridor(spark, d)[4]


@query("select * from kept_nodes")
def corridor_nodes(spark, d):
    own, asked, ahead, behind, incumbents = _corridor(spark, d)
    return corridor.nodes(asked, ahead, behind, incumbents)


@query("select * from kept_edges")
def corridor_edges(spark, d):
    own, asked, ahead, behind, incumbents = _corridor(spark, d)
    return corridor.edges(asked, own, ahead, behind, incumbents)


@query("select dataset, query_id, n_nodes, coalesce(kept_nodes, 0) as kept_nodes, coalesce(n_edges, 0) as n_edges, coalesce(kept_edges, 0) as kept_edges from (select dataset, query_id, count(*) as n_nodes from node_bounds group by all) left join (select dataset, query_id, count(*) as kept_nodes from kept_nodes group by all) using (dataset, query_id) left join (select dataset, query_id, count(*) as n_edges from edge_bounds group by all) using (dataset, query_id) left join (select dataset, query_id, count(*) as kept_edges from kept_edges group by all) using (dataset, query_id)")
def corridor_counts(spark, d):
    own, asked, ahead, behind, incumbents = _corridor(spark, d)
    nodes = asked.join(ahead, ["dataset", "source"]).join(behind, ["dataset", "target", "node"])
    inside = asked.join(own, "dataset")
    return corridor.counts(nodes, corridor.nodes(asked, ahead, behind, incumbents), inside, corridor.edges(asked, own, ahead, behind, incumbents))


WEIGHTS_SQL = f"(select format('{{}}-{{}}-{{}}', a, b, {GRID_K} - a - b) as weight_id, a as w1, b as w2, {GRID_K} - a - b as w3 from range(0, {GRID_K + 1}) x(a), range(0, {GRID_K + 1}) y(b) where a + b <= {GRID_K})"


@query(f"select * from {WEIGHTS_SQL}")
def weight_grid(spark, d):
    return approximate.weight_grid(spark, GRID_K)


def _weighted(spark, d):
    w = approximate.weight_grid(spark, GRID_K).withColumns({"w4": F.lit(0).cast("long"), "w5": F.lit(0).cast("long")})
    return search.weighted(*_districts(spark, d), w)


BY_WEIGHT = f"(select dataset, query_id, weight_id, w1 * c1 + w2 * c2 + w3 * c3 as total, {C5}, path from full_routes, {WEIGHTS_SQL} qualify row_number() over (partition by dataset, query_id, weight_id order by total, {C5}, path) = 1)"


@query(f"select dataset, query_id, weight_id, total, {C5}, array_to_string(path, '->') as path from {BY_WEIGHT}".replace("from full_routes,", "from full_routes ,"))
def candidates_weighted(spark, d):
    return _weighted(spark, d).withColumn("path", X.path_text("path"))


def _grid_weights(k):
    return [(a, b, k - a - b) for a in range(k + 1) for b in range(k + 1 - a)]


SEEDS = f"(select distinct dataset, query_id, {C3} from {BY_WEIGHT} union select dataset, query_id, {C3} from lexmin)"


@query(f"select dataset, query_id, {C3} from {SEEDS} a where not exists (from {SEEDS} b where b.dataset = a.dataset and b.query_id = a.query_id and {_dominates('b', 'a', 3)})")
def seed_bank(spark, d):
    own, asked = _districts(spark, d)
    found = search.seed_vectors(own, asked, _grid_weights(GRID_K))
    return skyline.distinct_skyline(found.unionByName(search.lexicographic(own, asked).select(found.columns)), QUERY, 3)


@query(f"select dataset, query_id, c1, c2, c3, c4, c5, array_to_string(path, '->') as path from {BY_WEIGHT} qualify row_number() over (partition by dataset, query_id, {C3} order by len(path), path) = 1")
def candidates_dedupe(spark, d):
    own = _weighted(spark, d).select(*QUERY, *X.COSTS, "path")
    return approximate.shortest_by_cost(own, QUERY, 3).select(*QUERY, *X.COSTS, X.path_text("path").alias("path"))


# ---------------------------------------------------------------- exact fronts

for _m in (2, 3, 5):
    QUERIES[f"front_exact_m{_m}"] = partial(lambda spark, d, m: search.front(*_districts(spark, d), m), m=_m)
    ORACLES[f"front_exact_m{_m}"] = sql(f"select * from front{_m}")


@query("select * from front3")
def front_without_bounds(spark, d):
    """The same front with lower bounds of 0."""
    return search.front(*_districts(spark, d), 3, bounds=False)


@query("select * from front3")
def front_in_corridor(spark, d):
    """The front from the corridor's edges and the seeds."""
    return search.pareto_front(*_districts(spark, d), 3, mode="corridor")


@query(f"select *, row_number() over (partition by dataset, query_id order by {C3}) as solution_id from front3")
def front_ids(spark, d):
    return skyline.numbered(search.front(*_districts(spark, d), 3), QUERY, 3)


@query("select dataset, query_id, count(*) as n, 0::bigint as n_duplicates, 0::bigint as n_dominated from front3 group by all")
def front_mutual_check(spark, d):
    return skyline.violations(search.front(*_districts(spark, d), 3), QUERY, 3)


@query("select dataset, query_id, min(c1) = h1 and min(c2) = h2 and min(c3) = h3 as ok from front3 join od using (dataset, query_id) join behind b on b.dataset = front3.dataset and b.target = od.target and b.node = od.source group by dataset, query_id, h1, h2, h3".replace("select dataset, query_id, min", "select front3.dataset, front3.query_id, min").replace("group by dataset, query_id,", "group by front3.dataset, front3.query_id,"))
def front_anchor_check(spark, d):
    own, asked = _districts(spark, d)
    least = search.front(own, asked, 3).groupBy(*QUERY).agg(*[F.min(c).alias(c) for c in X.costs(3)])
    bounds = asked.join(search.to_go(own, asked).withColumnRenamed("node", "source"), ["dataset", "target", "source"])
    return least.join(bounds, QUERY).select(*QUERY, ((F.col("c1") == F.col("h1")) & (F.col("c2") == F.col("h2")) & (F.col("c3") == F.col("h3"))).alias("ok"))


def _by_count(spark, d):
    own, asked = _districts(spark, d)
    parts = [search.front(own, asked, m).select(*QUERY, F.lit(m).alias("objective_count")) for m in (2, 3, 5)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select objective_count, count(*) as groups, avg(n) as mean, min(n) as min, max(n) as max from (" + " union all ".join(f"(select {m} as objective_count, dataset, query_id, count(*) as n from front{m} group by all)" for m in (2, 3, 5)) + ") group by objective_count")
def front_by_m_summary(spark, d):
    return analysis.sizes_by_objectives(_by_count(spark, d))


@query(f"select city, count(*) as n_queries, avg(n) as mean, quantile_cont(n, 0.5) as median, max(n) as max, min(n) as min from (select {CITY} as city, dataset, query_id, count(*) as n from front3 group by all) group by city")
def front_size_summary(spark, d):
    return analysis.front_sizes(search.front(*_districts(spark, d), 3).withColumn("city", tables.city()))


@query(f"select city, dataset, query_id, n from (select *, row_number() over (partition by city order by n, dataset, query_id) as r, count(*) over (partition by city) as k from (select {CITY} as city, dataset, query_id, count(*) as n from front3 group by all)) where r = k // 2 + 1")
def median_size_query(spark, d):
    return analysis.median_query(search.front(*_districts(spark, d), 3).withColumn("city", tables.city()))


@query("select dataset, query_id, count(*) as n, left(sha256(string_agg(c1 || ',' || c2 || ',' || c3, chr(10) order by c1, c2, c3)), 16) as digest from front3 group by all")
def fragment_digest(spark, d):
    return jobs.digest(search.front(*_districts(spark, d), 3), QUERY)


@query("select dataset, query_id, 0::bigint as only_a, 0::bigint as only_b, true as ok from front3 group by all")
def front_differential(spark, d):
    own, asked = _districts(spark, d)
    return jobs.differential(search.front(own, asked, 3), search.front(own, asked, 3, bounds=False), QUERY, X.costs(3))


# ---------------------------------------------------------------- skylines of pools

for _m in (2, 3, 5):
    QUERIES[f"skyline_distinct_m{_m}"] = partial(lambda spark, d, m: skyline.distinct_skyline(tables.pool(spark, d), ["dataset"], m), m=_m)
    ORACLES[f"skyline_distinct_m{_m}"] = sql(f"select distinct dataset, {', '.join(X.COSTS[:_m])} from sky{_m}")


@query(f"select dataset, l_orderkey, {C5} from sky5")
def skyline_keepdups_m5(spark, d):
    return skyline.skyline(tables.pool(spark, d), ["dataset"], 5)


@query("select a.dataset, count(*) as n from pool a where exists (from sky3 b where b.dataset = a.dataset and b.c1 <= a.c1 and b.c2 <= a.c2 and b.c3 <= a.c3) group by a.dataset")
def skyline_dominated_by_set(spark, d):
    own = tables.pool(spark, d)
    return skyline.dominated(own, skyline.distinct_skyline(own, ["dataset"], 3), ["dataset"], 3).groupBy("dataset").agg(F.count("*").alias("n"))


@query("select dataset, l_orderkey, " + ", ".join(f"round(z{k}, 9) as z{k}" for k in range(1, 6)) + " from pool_z")
def minmax_normalize(spark, d):
    return approximate.normalize(tables.pool(spark, d), ["dataset"], 5).select("dataset", "l_orderkey", *[F.round(f"z{k}", 9).alias(f"z{k}") for k in range(1, 6)])


CELLS = f"(select dataset, l_orderkey, {C5}, " + ", ".join(f"floor(z{k} / {EPS})::bigint as k{k}" for k in (1, 2, 3)) + ", z1 + z2 + z3 + 1e-9 * c1 as score from pool_z)"
ORDER = [*X.COSTS, "l_orderkey"]


@query(f"select dataset, l_orderkey, k1, k2, k3, round(score, 9) as score from {CELLS}")
def eps_cells(spark, d):
    return approximate.cells(tables.pool(spark, d), ["dataset"], 3, EPS).select("dataset", "l_orderkey", "k1", "k2", "k3", F.round("score", 9).alias("score"))


@query(f"select dataset, k1, k2, k3, {C5}, l_orderkey from {CELLS} qualify row_number() over (partition by dataset, k1, k2, k3 order by score, {C5}, l_orderkey) = 1")
def eps_representatives(spark, d):
    celled = approximate.cells(tables.pool(spark, d), ["dataset"], 3, EPS)
    return approximate.representatives(celled, ["dataset"], 3, ORDER).select("dataset", "k1", "k2", "k3", *X.COSTS, "l_orderkey")


EPS_CTE = ("(select dataset, " + C5 + ", l_orderkey from (select *, " + ", ".join(f"(c{k} - min(c{k}) over p) / greatest((max(c{k}) over p - min(c{k}) over p)::double, 1.0) as z{k}" for k in (1, 2, 3)) + " from sky3 window p as (partition by dataset)) "
           + f"qualify row_number() over (partition by dataset, floor(z1 / {EPS}), floor(z2 / {EPS}), floor(z3 / {EPS}) order by z1 + z2 + z3 + 1e-9 * c1, {C5}, l_orderkey) = 1)")


@query(f"select * from {EPS_CTE} a where not exists (from {EPS_CTE} b where b.dataset = a.dataset and {_dominates('b', 'a', 3)})")
def eps_front(spark, d):
    return approximate.eps_front(tables.pool(spark, d), ["dataset"], 3, EPS, ORDER).select("dataset", *X.COSTS, "l_orderkey")


RANGE3 = "(select dataset, " + ", ".join(f"min(c{k}) as lo{k}, max(c{k}) as hi{k}" for k in (1, 2, 3)) + " from sky3 group by dataset)"
NEAR = " and ".join(f"(a.c{k} - lo{k}) / greatest((hi{k} - lo{k})::double, 1.0) <= (r.c{k} - lo{k}) / greatest((hi{k} - lo{k})::double, 1.0) + {EPS}" for k in (1, 2, 3))


@query(f"select dataset, count(*) as n_reference, avg(covered::int) as eps_coverage from (select r.dataset, exists (from {EPS_CTE} a where a.dataset = r.dataset and {NEAR}) as covered from (select distinct dataset, {C3} from sky3) r join {RANGE3} using (dataset)) group by dataset")
def eps_coverage(spark, d):
    own = tables.pool(spark, d)
    reference = skyline.distinct_skyline(own, ["dataset"], 3)
    return approximate.coverage(approximate.eps_front(own, ["dataset"], 3, EPS, ORDER), reference, ["dataset"], 3, EPS, approximate.ranges(reference, ["dataset"], 3))


SWEEP = (0.02, 0.05, 0.1, 0.2)


@query(" union all ".join(f"(select {e}::double as eps, dataset, count(*) as n from {EPS_CTE.replace(f'/ {EPS}', f'/ {e}')} a where not exists (from {EPS_CTE.replace(f'/ {EPS}', f'/ {e}')} b where b.dataset = a.dataset and {_dominates('b', 'a', 3)}) group by dataset)" for e in SWEEP))
def eps_sweep_sizes(spark, d):
    own = tables.pool(spark, d)
    parts = [approximate.eps_front(own, ["dataset"], 3, e, ORDER).groupBy("dataset").agg(F.count("*").alias("n")).select(F.lit(e).alias("eps"), "dataset", "n") for e in SWEEP]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _inverse(n: str, b: int) -> str:
    return f"round(list_sum(list_transform(range(0, 20), lambda k: (({n} // ({b} ** k)::bigint) % {b}) / ({b}::double ** (k + 1)))), 9)"


POINTS_SQL = f"(select i, {_inverse('i', 2)} as u1, {_inverse('i', 3)} as u2, {_inverse('i', 5)} as u3 from range(1, {POINTS + 1}) t(i))"


def _points(spark):
    return approximate.halton(spark, POINTS, 3).select("i", *[F.round(f"u{k}", 9).alias(f"u{k}") for k in (1, 2, 3)])


@query(f"select i, u1, u2, u3 from {POINTS_SQL}")
def halton_points(spark, d):
    return _points(spark)


@query(f"select dataset, avg(hit::int) as hv from (select s.dataset, exists (from (select distinct dataset, {C3} from sky3) a where a.dataset = s.dataset and " + " and ".join(f"(a.c{k} - lo{k}) / greatest((hi{k} - lo{k})::double, 1.0) <= u{k}" for k in (1, 2, 3)) + f") as hit from {RANGE3} s, {POINTS_SQL} p) group by dataset")
def hypervolume(spark, d):
    front = skyline.distinct_skyline(tables.pool(spark, d), ["dataset"], 3)
    return approximate.hypervolume(front, ["dataset"], 3, _points(spark), approximate.ranges(front, ["dataset"], 3))


# ---------------------------------------------------------------- conflict and overlap


@query("select * from regret")
def regret_directional(spark, d):
    return analysis.regret(analysis.cost_matrix(_vectors(spark, d)))


@query("select dataset, query_id, i, j, case when worst > best then (cost - best) / (worst - best) else 0 end::double as loss from matrix")
def range_loss(spark, d):
    return analysis.range_loss(analysis.cost_matrix(_vectors(spark, d)))


STATS = "avg({0}) as mean, quantile_cont({0}, 0.5) as median, quantile_cont({0}, 0.25) as q25, quantile_cont({0}, 0.75) as q75, max({0}) as max"
SUMMARY = f"(select {CITY} as city, i, j, {STATS.format('regret')} from regret group by all)"


@query(f"select * from {SUMMARY}")
def regret_summary(spark, d):
    return analysis.directional(analysis.regret(analysis.cost_matrix(_vectors(spark, d))).withColumn("city", tables.city()), "regret")


@query(f"select a.city, a.i, a.j, case when a.i = a.j then 0 else (a.median + b.median) / 2 end::double as conflict from {SUMMARY} a join {SUMMARY} b on a.city = b.city and a.i = b.j and a.j = b.i where a.i <= a.j")
def regret_symmetric(spark, d):
    return analysis.symmetric(regret_summary(spark, d), "median")


@query("select dataset, query_id, i, j, edge_jaccard, node_jaccard, identical from overlap")
def route_jaccard(spark, d):
    return analysis.route_overlap(_vectors(spark, d))


@query(f"select {CITY} as city, i, j, {STATS.format('edge_jaccard')} from overlap group by all")
def jaccard_summary(spark, d):
    return analysis.directional(analysis.route_overlap(_vectors(spark, d)).withColumn("city", tables.city()), "edge_jaccard")


@query(f"select {CITY} as city, i, j, count(*) as n, sum(identical::int)::bigint as n_same, avg(identical::int) as rate from overlap group by all")
def identical_rate(spark, d):
    return analysis.identical_rate(analysis.route_overlap(_vectors(spark, d)).withColumn("city", tables.city()))


@query(f"select {CITY} as city, j, avg(best) as mean_best from matrix where i = j group by all")
def mean_optimal_cost(spark, d):
    return analysis.mean_best(analysis.cost_matrix(_vectors(spark, d)).withColumn("city", tables.city()))


@query("select dataset, query_id, " + ", ".join(f"max(case when i = {i} and j = {j} then edge_jaccard end) as j{i}{j}" for i in range(1, 6) for j in range(i + 1, 6)) + " from overlap group by all")
def wide_metrics(spark, d):
    return analysis.wide_metrics(analysis.route_overlap(_vectors(spark, d)))


# ---------------------------------------------------------------- preference and replanning

SCORED = f"(select dataset, scheme, round(w1 * z1 + w2 * z2 + w3 * z3 + w4 * z4 + w5 * z5, 12) as score, {C5}, l_orderkey from pool_z , schemes)"
BEST = f"(select * from {SCORED} qualify row_number() over (partition by dataset, scheme order by score, {C5}, l_orderkey) = 1)"


def _recommended(spark, d):
    return preference.recommend(tables.pool(spark, d), preference.schemes(spark), ["dataset"], ["l_orderkey"])


def _with_schemes(text: str) -> str:
    return sql(text.replace("from pool_z , schemes", "from pool_z join schemes on true"))


@query()
def pref_recommend(spark, d):
    return _recommended(spark, d).withColumn("score", F.round("score", 9))


ORACLES["pref_recommend"] = _with_schemes(f"select dataset, scheme, round(score, 9) as score, {C5}, l_orderkey from {BEST}")


@query()
def pref_diversity(spark, d):
    return preference.diversity(_recommended(spark, d), ["dataset"], "l_orderkey")


ORACLES["pref_diversity"] = _with_schemes(f"select dataset, count(*) as n_schemes, count(distinct l_orderkey) as n_unique, count(distinct l_orderkey) = 1 as all_same from {BEST} group by dataset")


@query()
def pref_disagreement(spark, d):
    return preference.diversity(_recommended(spark, d), ["dataset"], "l_orderkey").agg(F.avg((~F.col("all_same")).cast("double")).alias("share"))


ORACLES["pref_disagreement"] = _with_schemes(f"select avg((k > 1)::int) as share from (select dataset, count(distinct l_orderkey) as k from {BEST} group by dataset)")

FOCUS = "(select 'w' || format('{:.1f}', i / 10.0) as scheme, i / 10.0::double as w_focus, " + ", ".join(("i / 10.0::double" if k == 2 else "(1 - i / 10.0::double) / 4") + f" as w{k}" for k in range(1, 6)) + " from range(0, 11) t(i))"
SENSED = f"(select dataset, scheme, w_focus, round(w1 * z1 + w2 * z2 + w3 * z3 + w4 * z4 + w5 * z5, 12) as score, {C5}, l_orderkey from pool_z join {FOCUS} f on true qualify row_number() over (partition by dataset, scheme order by score, {C5}, l_orderkey) = 1)"


def _sensed(spark, d):
    return preference.recommend(tables.pool(spark, d), preference.sensitivity_weights(spark, 2), ["dataset"], ["l_orderkey"])


@query(f"select dataset, w_focus, {C5}, l_orderkey from {SENSED}")
def pref_sensitivity(spark, d):
    return _sensed(spark, d).select("dataset", "w_focus", *X.COSTS, "l_orderkey")


@query("select w_focus, " + ", ".join(f"avg({c}) as {c}" for c in X.COSTS) + f" from {SENSED} group by w_focus")
def pref_sensitivity_means(spark, d):
    return _sensed(spark, d).groupBy("w_focus").agg(*[F.avg(c).alias(c) for c in X.COSTS])


@query()
def pref_robust(spark, d):
    """The candidate that wins most often over a line of weights."""
    return preference.robust(tables.pool(spark, d), preference.sensitivity_weights(spark, 2), ["dataset"], ["l_orderkey"]).select("dataset", "wins", *X.COSTS, "l_orderkey")


ORACLES["pref_robust"] = sql(f"select dataset, count(*) as wins, {C5}, l_orderkey from {SENSED} group by dataset, {C5}, l_orderkey qualify row_number() over (partition by dataset order by count(*) desc, {C5}, l_orderkey) = 1")

REPLAN_W = {"time": (0, 1, 0, 0, 0), "distance": (1, 0, 0, 0, 0), "stable": (1, 1, 4, 3, 1), "balanced": (2, 2, 2, 2, 2)}


def _schemes(spark):
    return spark.createDataFrame([(k, *v) for k, v in REPLAN_W.items()], "weight_id string, " + ", ".join(f"w{k} long" for k in range(1, 6)))


def _replanned(spark, d):
    own, asked = _districts(spark, d)
    left = networks.without(own, tables.closed(own, asked))
    rows = [search.weighted(e, asked, _schemes(spark)).withColumnRenamed("weight_id", "scheme").drop("total") for e in (own, left)]
    return rows[0], rows[1], asked


def _planned_sql(routes: str) -> str:
    values = ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in REPLAN_W.items())
    return f"(select dataset, query_id, scheme, {C5}, path from {routes} join (values {values}) s(scheme, w1, w2, w3, w4, w5) on true where node = target qualify row_number() over (partition by dataset, query_id, scheme order by w1 * c1 + w2 * c2 + w3 * c3 + w4 * c4 + w5 * c5, {C5}, path) = 1)"


@query(f"select dataset, query_id, scheme, {C5}, array_to_string(path, '->') as path from {_planned_sql('open_routes')}")
def replan_weighted(spark, d):
    return _replanned(spark, d)[1].withColumn("path", X.path_text("path"))


EDGES_OF = "list_transform(range(1, len({0})), lambda k: {0}[k] || '-' || {0}[k + 1])"
COMPARED = f"""(select a.dataset, a.query_id, a.scheme, b.path is not null as feasible, {', '.join(f'(b.{c} - a.{c}) / nullif(a.{c}, 0) as delta_{c}' for c in X.COSTS)},
    case when b.path is null then null when len(list_distinct({EDGES_OF.format('a.path')} || {EDGES_OF.format('b.path')})) = 0 then 0
         else 1 - len(list_intersect({EDGES_OF.format('a.path')}, {EDGES_OF.format('b.path')})) / len(list_distinct({EDGES_OF.format('a.path')} || {EDGES_OF.format('b.path')})) end::double as path_change
    from {_planned_sql('routes')} a left join {_planned_sql('open_routes')} b using (dataset, query_id, scheme))"""


def _comparison(spark, d):
    original, new, _ = _replanned(spark, d)
    return preference.compared(original, new, [*QUERY, "scheme"])


@query(f"select * from {COMPARED}")
def replan_compare(spark, d):
    return _comparison(spark, d)


@query(f"select {CITY} as city, count(*) as n, avg(feasible::int) as mean_feasible, avg(path_change) as mean_path_change, avg(delta_c1) as mean_delta_c1, avg(delta_c2) as mean_delta_c2 from {COMPARED} group by all")
def city_summary(spark, d):
    return preference.city_summary(_comparison(spark, d).withColumn("city", tables.city()))


@query(f"select {CITY} as city, scheme, sum(feasible::int)::bigint as n_feasible, count(*) as n from {COMPARED} group by all")
def reachability(spark, d):
    return _comparison(spark, d).groupBy(tables.city().alias("city"), "scheme").agg(F.sum(F.col("feasible").cast("long")).alias("n_feasible"), F.count("*").alias("n"))


@query(f"select dataset, query_id, source, target, scheme, network_state, path is not null as feasible, {C5}, array_to_string(path, '->') as path from (select a.dataset, a.query_id, a.scheme, 'original' as network_state, {', '.join(f'a.{c}' for c in X.COSTS)}, a.path from {_planned_sql('routes')} a union all select a.dataset, a.query_id, a.scheme, 'disrupted', {', '.join(f'b.{c}' for c in X.COSTS)}, b.path from {_planned_sql('routes')} a left join {_planned_sql('open_routes')} b using (dataset, query_id, scheme)) join od using (dataset, query_id)")
def result4(spark, d):
    return preference.merge_order(preference.result4(*_replanned(spark, d))).withColumn("path", X.path_text("path"))


# ---------------------------------------------------------------- bookkeeping

BUCKET = "case when exact then 'easy' when open_peak <= {0[0][0]} and nqp_live <= {0[0][1]} then 'medium' when open_peak <= {0[1][0]} and nqp_live <= {0[1][1]} then 'hard' else 'extreme' end"


def _buckets(spark, d, limits=X.SCAN_LIMITS):
    return tables.searches(spark, d).withColumn("bucket", X.difficulty(F.col("exact"), F.col("open_peak"), F.col("nqp_live"), limits))


@query(f"select dataset, query_id, {BUCKET.format(X.SCAN_LIMITS)} as bucket, {BUCKET.format(X.BATCH_LIMITS)} as batch_bucket from searches")
def difficulty_bucket(spark, d):
    rows = _buckets(spark, d)
    return rows.select(*QUERY, "bucket", X.difficulty(F.col("exact"), F.col("open_peak"), F.col("nqp_live"), X.BATCH_LIMITS).alias("batch_bucket"))


@query(f"select b as bucket, count(dataset) as n from (select unnest(['easy', 'medium', 'hard', 'extreme']) as b) left join (select *, {BUCKET.format(X.SCAN_LIMITS)} as bucket from searches) s on s.bucket = b group by b")
def bucket_counts(spark, d):
    return jobs.bucket_counts(_buckets(spark, d))


@query(f"select dataset, query_id, bucket, wave, row_number() over (partition by wave order by list_position(['easy', 'medium', 'hard', 'extreme'], bucket), dataset, query_id)::int as place from (select dataset, query_id, bucket, case when bucket in ('easy', 'medium') then 1 else 2 end as wave from (select *, {BUCKET.format(X.SCAN_LIMITS)} as bucket from searches))")
def job_waves(spark, d):
    return jobs.waves(_buckets(spark, d).select(*QUERY, "bucket"))


@query("select dataset, query_id, case when contains(mode, 'RESOURCE') then 'RESOURCE_LIMIT' when exact then 'EXACT' when early then 'EARLY_STOP' else 'INCOMPLETE' end as status from searches")
def status_resolve(spark, d):
    return tables.searches(spark, d).select(*QUERY, X.status(F.col("exact"), F.col("mode"), F.col("early")).alias("status"))


@query("select dataset, query_id from searches where not exact")
def pending_jobs(spark, d):
    rows = tables.searches(spark, d)
    return jobs.pending(rows.select(*QUERY), rows.where("exact"), QUERY)


@query("select sum(exact::int)::bigint as done, count(*) as total, bool_and(exact) as complete from searches")
def jobs_complete(spark, d):
    rows = tables.searches(spark, d)
    return jobs.complete(rows, rows.where("exact"), QUERY)


@query("select l_suppkey as dataset, max_by(l_orderkey, l_orderkey * 10000 + l_partkey % 10000) as l_orderkey, max(l_orderkey * 10000 + l_partkey % 10000) as seq from lineitem group by l_suppkey")
def last_wins_dedupe(spark, d):
    rows = tables.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("dataset"), "l_orderkey", F.expr("l_orderkey * 10000 + l_partkey % 10000").alias("seq"))
    return jobs.last_wins(rows, ["dataset"], "seq")


@query("select dataset, query_id, wall from searches qualify row_number() over (partition by dataset order by wall desc, query_id) <= 10")
def limit_per_city(spark, d):
    return jobs.first_n(tables.searches(spark, d).select(*QUERY, "wall"), ["dataset"], "wall desc, query_id", 10)


@query("select query_id, open_peak, nqp_live, row_number() over (order by open_peak desc, nqp_live desc, query_id)::int as rank from searches order by open_peak desc, nqp_live desc, query_id limit 100")
def top_wide_nodes(spark, d):
    return analysis.widest(tables.searches(spark, d), "open_peak", "nqp_live", "query_id").select("query_id", "open_peak", "nqp_live", "rank")


@query("select sum(nqp_live) filter (where r <= 10) / max(t) as r10, sum(nqp_live) filter (where r <= 100) / max(t) as r100 from (select *, row_number() over (order by open_peak desc, nqp_live desc, query_id) as r, greatest(sum(nqp_live) over (), 1) as t from searches)")
def dominance_concentration(spark, d):
    return analysis.concentration(tables.searches(spark, d), "open_peak", "nqp_live", "query_id")


@query("select dataset, n, avg, " + ", ".join(f"v[floor((n - 1) * {p})::int + 1] as p{str(p)[2:].ljust(2, '0')}" for p in (0.5, 0.9, 0.95, 0.99, 0.999)) + ", max from (select dataset, count(*) as n, avg(open_peak) as avg, list(open_peak order by open_peak) as v, max(open_peak) as max from searches group by dataset)")
def scan_percentiles(spark, d):
    return analysis.truncated_percentiles(tables.searches(spark, d), ["dataset"], "open_peak")


@query("select dataset, sum(expanded / wall) as aggregate from searches where wall > 0 group by dataset")
def throughput(spark, d):
    return jobs.throughput(tables.searches(spark, d), ["dataset"], "expanded", "wall")


@query("select dataset, b as before, a as after, case when a <> 0 and b <> 0 then b / a end as speedup from (select dataset, sum(wall) as b, sum(wall) filter (where exact) as a from searches group by dataset)")
def timing_merge(spark, d):
    rows = tables.searches(spark, d)
    total = lambda df: df.groupBy("dataset").agg(F.sum("wall").alias("wall"))
    return jobs.before_after(total(rows), total(rows.where("exact")), "dataset", "wall")


@query("with recursive by_n as (select l_linenumber::bigint as n_workers, sum(l_quantity) as aggregate from lineitem group by all), ordered as (select *, row_number() over (order by n_workers) as r from by_n), steps(r, best, prev, going) as (select r, n_workers, aggregate, true from ordered where r = 1 union all select o.r, case when s.going and (o.aggregate - s.prev) / greatest(s.prev, 1.0) >= 0.08 then o.n_workers else s.best end, case when s.going and (o.aggregate - s.prev) / greatest(s.prev, 1.0) >= 0.08 then o.aggregate else s.prev end, s.going and (o.aggregate - s.prev) / greatest(s.prev, 1.0) >= 0.08 from steps s join ordered o on o.r = s.r + 1) select best as n_workers from steps order by r desc limit 1")
def worker_count(spark, d):
    rows = tables.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("n_workers")).agg(F.sum("l_quantity").alias("aggregate"))
    return jobs.recommended_workers(rows)


GATES = "(select query_id as case_id, nqp_live as live_a, nqp_live * (expanded % 7 + 4) // 10 as live_b, open_peak as open_a, open_peak * (expanded % 5 + 5) // 10 as open_b, wall as wall_a, wall * (expanded % 4 + 7) / 10 as wall_b, not early as same from searches)"


@query(f"select case_id, case when wall_a <> 0 then round(100 * (wall_b - wall_a) / wall_a, 2) end as wall_delta, live_b <= 0.7 * live_a or (open_a > 0 and open_b <= 0.7 * open_a) as memory_gate, same and coalesce(round(100 * (live_b - live_a) / nullif(live_a, 0), 2) <= -10, false) and coalesce(round(100 * (wall_b - wall_a) / nullif(wall_a, 0), 2) <= 8, true) as sweep_gate, same and wall_a - wall_b >= 0.2 * wall_a as speed_gate from {GATES}")
def gate_rules(spark, d):
    rows = tables.searches(spark, d)
    runs = rows.selectExpr("query_id as case_id", "nqp_live as live_a", "nqp_live * (expanded % 7 + 4) div 10 as live_b", "open_peak as open_a", "open_peak * (expanded % 5 + 5) div 10 as open_b", "wall as wall_a", "wall * (expanded % 4 + 7) / 10 as wall_b", "not early as same")
    return jobs.gates(runs)


@query("select expanded as exp, max(generated) as gen, max(generated) / greatest(expanded, 1) as rg from searches group by expanded")
def progress_log(spark, d):
    """Progress lines of searches, parsed back from their text."""
    last = tables.searches(spark, d).groupBy(F.col("expanded").alias("exp")).agg(F.max("generated").alias("gen"))
    lines = last.select(F.format_string(files.LOG_PREFIX + " exp=%d gen=%d live=1 open=2 |S|=3 node_pr=4 goal_pr=5 dup=6 stale=7 max_node=8", "exp", "gen").alias("value"))
    return jobs.slopes(files.parse_progress(lines)).select("exp", "gen", "rg")


from . import catalog_more  # noqa: E402, F401 - adds its queries to these

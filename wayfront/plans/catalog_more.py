"""More queries: predecessors, searches from both ends, dispatch, seeds by trees, candidates, quality, files and bookkeeping."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.stored import cut, shared_path
from ..operators import analysis, approximate, jobs, networks, preference, skyline
from ..sources import files, tables
from . import search
from .catalog import BUCKET, C3, C5, EPS, GRID_K, ORACLES, POINTS_SQL, QUERIES, QUERY, SQL, _buckets, _districts, _dominates, _grid_weights, _origin, _planned_sql, _points, _replanned, _sssp_sql, query, sql

# ---------------------------------------------------------------- trees and searches from both ends

GRID_SQL = f"nodes as ({SQL['nodes']}), edges as ({SQL['edges']})"


@query()
def sssp_tree_c1(spark, d):
    """Distances with predecessors."""
    return search.trees(tables.grid(spark, d), _origin(spark), 1)


ORACLES["sssp_tree_c1"] = f"with {GRID_SQL}, b as ({_sssp_sql('c1')}) select b.*, (select min(e.src) from edges e join b p on p.node = e.src where e.dst = b.node and p.distance + e.c1 = b.distance) as before from b"


@query()
def reverse_tree_c2(spark, d):
    """Distances to a target, with the next node on the way."""
    return search.trees(networks.reverse(tables.grid(spark, d)), _origin(spark), 2).withColumnsRenamed({"source": "target", "before": "next"})


ORACLES["reverse_tree_c2"] = f"with {GRID_SQL}, b as ({_sssp_sql('c2', 'dst', 'src')}) select b.dataset, b.source as target, b.node, b.distance, (select min(e.dst) from edges e join b p on p.node = e.dst where e.src = b.node and p.distance + e.c2 = b.distance) as next from b"

LAST, MIDDLE = "(select max(id) from nodes)", "(select (max(id) + 1) // 2 from nodes)"
PAIRS = (("0001", "1", LAST), ("0002", LAST, "1"), ("0003", "1", MIDDLE), ("0004", MIDDLE, MIDDLE))


def _pairs(spark, d):
    ends = tables.table(spark, d, "part").agg((F.max("p_partkey") + 1).cast("long").alias("last"))
    middle, last, one = F.expr("(last + 1) div 2"), F.col("last"), F.lit(1).cast("long")
    rows = [F.struct(F.lit("GRID").alias("dataset"), F.lit(i).alias("query_id"), s.alias("source"), t.alias("target")) for i, s, t in (("0001", one, last), ("0002", last, one), ("0003", one, middle), ("0004", middle, middle))]
    return ends.select(F.inline(F.array(*rows)))


def _point_sql(ks) -> str:
    one = "(select 'GRID' as dataset, '{i}' as query_id, {k} as objective, distance as cost, true as same from ({tree}) where node = (with nodes as ({nodes}) select {end}))"
    return " union all ".join(one.format(i=i, k=k, tree=_sssp_sql(f"c{k}", start=s), nodes=SQL["nodes"], end=t if t.startswith("(") else t) for i, s, t in PAIRS for k in ks)


def _point_to_point(spark, d, ways):
    own = tables.grid(spark, d)
    found = cut(search.point_to_point(own, _pairs(spark, d), [1, 2, 5], ways=ways))
    priced = networks.path_costs(found, own, [*QUERY, "objective"])
    again = F.element_at(F.array(*X.COSTS), F.col("objective"))
    return found.join(priced, [*QUERY, "objective"]).select(*QUERY, "objective", "cost", (F.col("valid") & (again == F.col("cost"))).alias("same"))


for _ways, _name in ((1, "point_to_point"), (2, "point_to_point_both_ways")):
    QUERIES[_name] = partial(lambda spark, d, ways: _point_to_point(spark, d, ways), ways=_ways)
    ORACLES[_name] = _point_sql([1, 2, 5])

# ---------------------------------------------------------------- dispatch

for _m in (2, 3, 5):
    QUERIES[f"front_one_label_m{_m}"] = partial(lambda spark, d, m: search.pareto_front(*_districts(spark, d), m, mode="one_label"), m=_m)
    ORACLES[f"front_one_label_m{_m}"] = sql(f"select * from front{_m}")


@query("select * from front2")
def front_unbounded_m2(spark, d):
    return search.pareto_front(*_districts(spark, d), 2, mode="unbounded")


@query()
def budgeted_scan(spark, d):
    """Searches that a budget of expansions may end, and the bucket of what they left."""
    rows = search.pareto(*_districts(spark, d), 3, max_expanded=40).groupBy(*QUERY, "status", "expanded", "generated", "open_peak").agg(F.count("solution").alias("found"))
    exact = F.col("status") == "EXACT"
    return rows.withColumn("bucket", X.difficulty(exact, F.col("open_peak"), F.col("generated") - F.col("expanded")))


@query("select dataset, query_id from od")
def planted_differences(spark, d):
    """Queries in which the comparison of two runs and the check of a front find planted faults."""
    front = cut(search.front(*_districts(spark, d), 3))
    worse = front.groupBy(*QUERY).agg(F.max("c1").alias("c1"), F.max("c2").alias("c2"), F.max("c3").alias("c3")).select(*QUERY, *[(F.col(c) + 1).alias(c) for c in X.costs(3)])
    spoiled = front.unionByName(worse)
    diff = jobs.differential(front, spoiled, QUERY, X.costs(3)).where("not ok and only_a = 0 and only_b = 1").select(*QUERY)
    bad = skyline.violations(spoiled.unionByName(worse), QUERY, 3).where("n_duplicates = 1 and n_dominated = 1").select(*QUERY)
    return diff.join(bad, QUERY)


# ---------------------------------------------------------------- seeds and candidates

SCALES = "(select dataset, " + ", ".join(f"greatest(1, coalesce(trunc(quantile_cont({c}, 0.5) filter (where {c} > 0)), 1))::bigint as s{k + 1}" for k, c in enumerate(X.COSTS[:3])) + " from districts group by dataset)"
GRID_WEIGHTS = f"(select a as w1, b as w2, {GRID_K} - a - b as w3 from range(0, {GRID_K + 1}) x(a), range(0, {GRID_K + 1}) y(b) where a + b <= {GRID_K})"
SCALED = f"(select dataset, query_id, {C3} from (select r.dataset, r.query_id, w1, w2, w3, {C3}, w1 * c1 * s2 * s3 + w2 * c2 * s1 * s3 + w3 * c3 * s1 * s2 as total from full_routes r join {SCALES} s on s.dataset = r.dataset join {GRID_WEIGHTS} w on true) qualify row_number() over (partition by dataset, query_id, w1, w2, w3 order by total, {C3}) = 1 union select dataset, query_id, {C3} from lexmin)"


@query(f"select dataset, query_id, {C3} from {SCALED} a where not exists (from {SCALED} b where b.dataset = a.dataset and b.query_id = a.query_id and {_dominates('b', 'a', 3)})")
def seed_bank_scaled(spark, d):
    """Seeds of weights over median scales, by one reverse tree for each target and weight."""
    own, asked = _districts(spark, d)
    found = search.seed_vectors(own, asked, _grid_weights(GRID_K), networks.positive_medians(own, 3))
    return skyline.distinct_skyline(found.unionByName(search.lexicographic(own, asked).select(found.columns)), QUERY, 3)


ANCHORS = " union all ".join(f"(select dataset, query_id, {C3} from full_routes qualify row_number() over (partition by dataset, query_id order by c{k}, {C3}) = 1)" for k in (1, 2, 3))


@query(f"select distinct dataset, query_id, {C3} from ({ANCHORS}) a where not exists (from ({ANCHORS}) b where b.dataset = a.dataset and b.query_id = a.query_id and {_dominates('b', 'a', 3)})")
def anchor_seeds(spark, d):
    """The skyline of the three single-objective vectors."""
    return skyline.distinct_skyline(search.seed_vectors(*_districts(spark, d), [(1, 0, 0), (0, 1, 0), (0, 0, 1)]), QUERY, 3)


@query()
def seed_variants(spark, d):
    """Seeds found by size of the grid of weights, with and without scales."""
    own, asked = (cut(t) for t in _districts(spark, d))
    scales = cut(networks.positive_medians(own, 3))
    parts = []
    for k, used in ((5, None), (5, scales), (10, None), (10, scales)):
        found = skyline.distinct_skyline(search.seed_vectors(own, asked, _grid_weights(k), used), QUERY, 3)
        parts.append(found.groupBy(*QUERY).agg(F.count("*").alias("n_seeds")).select(F.lit(k).alias("k"), F.lit(used is not None).alias("scaled"), *QUERY, "n_seeds"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(" union all ".join(f"(select dataset, target, node, {k} as objective, c1, c2, c3 from back qualify row_number() over (partition by dataset, target, node order by c{k}, c1, c2, c3) = 1)" for k in (1, 2, 3)))
def suffix_vectors(spark, d):
    return search.suffixes(*_districts(spark, d))


SAMPLES = {2: 256, 3: 1024, 5: 4096}


def _simplex_sql(n: int, m: int) -> str:
    names = [f"w{k + 1}" for k in range(m)]
    units = "select i, " + ", ".join(f"(i = {k})::int::double as {c}" for k, c in enumerate(names)) + f" from range(0, {m}) t(i)"
    equal = f"select {m} as i, " + ", ".join(f"1 / {m}::double as {c}" for c in names)
    inside = n - m - 1
    if m == 2:
        more = f"select k + 3 as i, k / {n - 1}::double as w1, 1 - k / {n - 1}::double as w2 from range(0, {inside}) t(k)"
    else:
        raw = lambda b: f"list_sum(list_transform(range(0, 40), lambda j: ((k // ({b}::hugeint ** least(j, 12))::bigint) % {b}) * (j <= 12)::int / ({b}::double ** (j + 1))))"
        logs = ", ".join(f"-ln(greatest({raw(b)}, 1e-12)) as v{i + 1}" for i, b in enumerate(X.HALTON_BASES[:m]))
        total = " + ".join(f"v{k + 1}" for k in range(m))
        more = f"select k + {m} as i, " + ", ".join(f"v{k + 1} / ({total}) as w{k + 1}" for k in range(m)) + f" from (select k, {logs} from range(1, {inside + 1}) t(k))"
    return "select i, " + ", ".join(f"round({c}, 9) as {c}" for c in names) + f" from ({units} union all {equal} union all {more})"


def _simplex(spark, m):
    return approximate.simplex_weights(spark, SAMPLES[m], m)


for _m in (2, 3, 5):
    QUERIES[f"simplex_weights_m{_m}"] = partial(lambda spark, d, m: _simplex(spark, m).select("i", *[F.round(f"w{k + 1}", 9).alias(f"w{k + 1}") for k in range(m)]), m=_m)
    ORACLES[f"simplex_weights_m{_m}"] = _simplex_sql(SAMPLES[_m], _m)


def _candidates(spark, d, m):
    weights = [tuple(r)[1:] for r in _simplex(spark, m).collect()]  # SAMPLES rows
    return search.generated(*_districts(spark, d), weights, m)


def _generated(spark, d, m):
    return approximate.shortest_by_cost(_candidates(spark, d, m), QUERY, m)


for _m in (2, 3):
    QUERIES[f"candidates_generated_m{_m}"] = partial(lambda spark, d, m: _generated(spark, d, m).select(*QUERY, *X.costs(m)), m=_m)
    _names = ", ".join(X.COSTS[:_m])
    _anchor = " union all ".join(f"(select dataset, query_id, {C5}, path from full_routes qualify row_number() over (partition by dataset, query_id order by c{k}, {C5}, path) = 1)" for k in range(1, _m + 1))
    _span = "(select dataset, query_id, " + ", ".join(f"greatest(max(c{k}) - min(c{k}), 1) as s{k}" for k in range(1, _m + 1)) + f" from ({_anchor}) group by all)"
    _total = " + ".join(f"floor(1000000 * w{k} / s{k} + 0.5)::bigint * c{k}" for k in range(1, _m + 1))
    _weights = _simplex_sql(SAMPLES[_m], _m).replace("round(", "(").replace(", 9)", ")")
    ORACLES[f"candidates_generated_m{_m}"] = sql(f"select distinct dataset, query_id, {_names} from (select * from (select r.dataset, r.query_id, {C5} from full_routes r join {_span} s on s.dataset = r.dataset and s.query_id = r.query_id join ({_weights}) w on true qualify row_number() over (partition by r.dataset, r.query_id, w.i order by {_total}, {C5}, path) = 1) union all select dataset, query_id, {C5} from ({_anchor}))")


@query()
def candidates_generated_m5(spark, d):
    return _generated(spark, d, 5).select(*QUERY, *X.COSTS)


# ---------------------------------------------------------------- quality


def _quality_sql(front: str, reference: str | None, m: int) -> str:
    ks = range(1, m + 1)
    both = front if reference is None else f"(select dataset, {C3} from {front} union all select dataset, {C3} from {reference})"
    span = "(select dataset, " + ", ".join(f"min(c{k}) as lo{k}, max(c{k}) as hi{k}" for k in ks) + f" from {both} group by dataset)"
    z = lambda t, k: f"({t}.c{k} - lo{k}) / greatest((hi{k} - lo{k})::double, 1.0)"
    hv = f"(select dataset, avg(hit::int) as hv from (select s.dataset, exists (from {front} a where a.dataset = s.dataset and " + " and ".join(f"{z('a', k)} <= u{k}" for k in ks) + f") as hit from {span} s join {POINTS_SQL} p on true) group by dataset)"
    near = " and ".join(f"{z('a', k)} <= {z('r', k)} + {EPS}" for k in ks)
    covered = f"(select dataset, avg(ok::int) as eps_coverage from (select r.dataset, exists (from {front} a where a.dataset = r.dataset and {near}) as ok from {reference} r join {span} s on s.dataset = r.dataset) group by dataset)" if reference else f"(select distinct dataset, 1.0::double as eps_coverage from {front})"
    return f"select f.dataset, n, hv, lo1 + lo2 + lo3 as z_min_sum, hi1 + hi2 + hi3 as z_max_sum, eps_coverage from (select dataset, count(*) as n from {front} group by dataset) f join {hv} h on h.dataset = f.dataset join {span} s on s.dataset = f.dataset join {covered} c on c.dataset = f.dataset"


REFERENCE = f"(select distinct dataset, {C3} from sky3)"
#: One representative of each coarse cell stands for a front that approximates.
PART = f"(select dataset, {C3} from {REFERENCE} where (c1 + c2 + c3) % 3 = 0)"


@query(_quality_sql(PART, REFERENCE, 3))
def front_quality(spark, d):
    """Size, hypervolume, coverage and ranges of a part of each skyline against the whole one."""
    reference = cut(skyline.distinct_skyline(tables.pool(spark, d), ["dataset"], 3))
    return approximate.quality(reference.where("(c1 + c2 + c3) % 3 = 0"), ["dataset"], 3, EPS, _points(spark), reference)


@query(_quality_sql(REFERENCE, None, 3))
def front_quality_alone(spark, d):
    reference = cut(skyline.distinct_skyline(tables.pool(spark, d), ["dataset"], 3))
    return approximate.quality(reference, ["dataset"], 3, EPS, _points(spark))


@query()
def dimension_effect(spark, d):
    """By number of objectives: candidates, solutions, hypervolume and coverage of each query's approximate front."""
    parts = []
    for m in (2, 3, 5):
        found = cut(_generated(spark, d, m))
        front = skyline.distinct_skyline(found, QUERY, m) if m < 5 else approximate.eps_front(found, QUERY, 5, EPS, [*X.COSTS, "path"])
        points = approximate.halton(spark, 256, m)
        measured = approximate.quality(cut(front.select(*QUERY, *X.costs(m))), QUERY, m, EPS, points)
        sizes = found.groupBy(*QUERY).agg(F.count("*").alias("n_candidates"))
        parts.append(measured.join(sizes, QUERY).select(*QUERY, F.lit(m).alias("objective_count"), F.lit("eps_grid" if m == 5 else "weighted_nd").alias("mode"), "n_candidates", F.col("n").alias("n_solutions"), F.round("hv", 6).alias("hv"), F.round("eps_coverage", 6).alias("eps_coverage")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- preference and replanning

@query(f"select dataset, query_id, scheme, path is not null and path <> default_path as changed_vs_default from (select a.dataset, a.query_id, a.scheme, a.path, b.path as default_path from {_planned_sql('routes')} a join {_planned_sql('routes')} b on a.dataset = b.dataset and a.query_id = b.query_id and b.scheme = 'time')")
def pref_changed(spark, d):
    """Whether a scheme's route differs from that of the time scheme."""
    original = cut(_replanned(spark, d)[0])
    return preference.changed(original, original.where("scheme = 'time'"), QUERY, "path").select(*QUERY, "scheme", "changed_vs_default")


SHUT = "exists (from closed k where k.dataset = v.dataset and list_contains(list_transform(range(1, len(v.path)), lambda i: v.path[i] || '>' || v.path[i + 1]), k.src || '>' || k.dst))"


@query(f"select dataset, query_id, objective from (select *, max(free) over (partition by dataset, query_id) as any_free from (select v.*, (not {SHUT})::int as free from vectors v)) where free = 1 or any_free = 0")
def pref_avoiding(spark, d):
    """Candidates without a closed edge."""
    own, asked = _districts(spark, d)
    return preference.avoiding(search.single_objective(own, asked), tables.closed(own, asked), QUERY).select(*QUERY, "objective")


@query()
def replan_continuous(spark, d):
    """After closures, the route nearest to the balanced one that isn't much slower."""
    own, asked = _districts(spark, d)
    original, replanned, _ = _replanned(spark, d)
    left = networks.without(own, tables.closed(own, asked))
    candidates = search.single_objective(left, asked).select(*QUERY, *X.COSTS, "path").unionByName(replanned.select(*QUERY, *X.COSTS, "path")).distinct()
    return preference.continuous(candidates, original.where("scheme = 'balanced'").select(*QUERY, "path"), QUERY).withColumn("path", X.path_text("path"))


# ---------------------------------------------------------------- expressions


@query("select dataset, query_id, c1, c2, 0::bigint as c3, 0::bigint as c4, 0::bigint as c5 from front2")
def padded_vectors(spark, d):
    return X.padded(search.front(*_districts(spark, d), 2), 2)


@query(f"select r.dataset, query_id, objective, round(2 * c1 / s1 + 3 * c2 / s2 + c3 / s3, 9) as total from vectors r join {SCALES} s on s.dataset = r.dataset")
def scalarized_costs(spark, d):
    own, asked = _districts(spark, d)
    both = search.single_objective(own, asked).join(networks.positive_medians(own, 3), "dataset")
    return both.select(*QUERY, "objective", F.round(X.scalarized(X.costs(3), [F.lit(float(w)) for w in (2, 3, 1)], [F.col(f"s{k}") for k in (1, 2, 3)]), 9).alias("total"))


@query("select dataset, target, source, node, round(case when d1 + h1 <> 0 then d1 / (d1 + h1) end, 9) as progress from ahead join behind using (dataset, node) where case when d1 + h1 <> 0 then d1 / (d1 + h1) end >= 0.93")
def target_band(spark, d):
    """Nodes by which 93 % of the way is done."""
    own, asked = _districts(spark, d)
    both = search.so_far(own, asked).join(search.to_go(own, asked), ["dataset", "node"])
    share = X.progress(F.col("d1"), F.col("h1"))
    return both.where(share >= 0.93).select("dataset", "target", "source", "node", F.round(share, 9).alias("progress"))


# ---------------------------------------------------------------- bookkeeping


@query(f"select dataset, query_id from (select *, {BUCKET.format(X.SCAN_LIMITS)} as bucket from searches) where bucket in ('medium', 'hard') and not exact and expanded <> 4000")
def selected_jobs(spark, d):
    rows = _buckets(spark, d)
    return jobs.selected(rows, ["medium", "hard"], rows.where("expanded = 4000"), rows.where("exact"), QUERY).select(*QUERY)


@query("select distinct dataset, query_id from searches where expanded <> 2000")
def held_jobs(spark, d):
    """Names of jobs as texts, parsed back."""
    text = F.when(F.col("expanded") == 1000, F.concat_ws(":", F.lower("dataset"), "query_id")).when(F.col("expanded") == 2000, F.col("query_id")).otherwise(F.concat_ws("_", "dataset", "query_id"))
    return jobs.parse_held(tables.searches(spark, d).select(text.alias("value")))


@query("select dataset, query_id from searches where dataset in ('C2', 'C1') order by list_position(['C2', 'C1'], dataset), query_id limit 25")
def spread_jobs(spark, d):
    return jobs.spread(tables.searches(spark, d).select(*QUERY), ["C2", "C1"], 25)


@query("select query_id as name, nqp_live / expanded as speedup, open_peak / nqp_live as scan_ratio, 0 as mismatch from searches where not early order by speedup desc, scan_ratio, name limit 1")
def best_configuration(spark, d):
    rows = tables.searches(spark, d).selectExpr("query_id as name", "nqp_live / expanded as speedup", "open_peak / nqp_live as scan_ratio", "cast(early as int) as mismatch")
    return jobs.best_configuration(rows)


@query("select dataset, avg(wall) as runtime_mean_sec, max(wall) as runtime_max_sec, avg(generated) as labels_gen_mean, avg(nqp_live) as pending_mean from searches group by dataset")
def run_statistics(spark, d):
    return jobs.run_statistics(tables.searches(spark, d), ["dataset"])


@query("select dataset, " + ", ".join(f"sum({p}) / greatest(sum(expanded) + sum(generated) + sum(open_peak), 1) as {p}_frac" for p in ("expanded", "generated", "open_peak")) + " from searches group by dataset")
def time_shares(spark, d):
    return jobs.time_shares(tables.searches(spark, d), ["dataset"], ["expanded", "generated", "open_peak"])


@query("select dataset, query_id, wall from searches qualify dense_rank() over (partition by dataset order by query_id) <= 7")
def first_ids(spark, d):
    return jobs.first_ids(tables.searches(spark, d).select(*QUERY, "wall"), ["dataset"], "query_id", 7)


@query("select count(*) as compared, count(*)::bigint as equal, 0::bigint as missing, true as passed from od")
def regression_check(spark, d):
    """Optimal distances of one search against those of another."""
    own, asked = _districts(spark, d)
    base = search.single_objective(own, asked).where("objective = 'distance'").select(*QUERY, F.col("c1").alias("cost"))
    new = search.point_to_point(own, asked.where("source <> target"), [1]).select(*QUERY, "cost")
    alone = asked.where("source = target").select(*QUERY, F.lit(0).cast("long").alias("cost"))
    return jobs.regressions(base, new.unionByName(alone), QUERY, "cost")


# ---------------------------------------------------------------- files: written, read back, compared


@query("select dataset, src, dst, c1, c2, c3, c4, c5 from edges")
def edge_file(spark, d):
    path = shared_path(spark, "edges")
    lines = tables.grid(spark, d).select(F.concat_ws(" ", "src", "dst", *X.COSTS).alias("value"))
    lines.unionByName(spark.createDataFrame([("# a comment",), ("",), ("  ",)], "value string")).write.text(path)
    return files.read_edges(spark, path, "GRID").drop("edge_seq")


@query("select 'D' as dataset, query_id, source, target from od")
def query_file(spark, d):
    path = shared_path(spark, "queries")
    tables.queries(spark, d).select(F.col("query_id").cast("int").alias("query_id"), "source", "target").write.option("header", True).csv(path)
    found = files.read_queries(spark, path, "D")
    return found.withColumn("query_id", F.lpad("query_id", 6, "0"))


@query("select distinct 'D' as dataset, src, dst from closed")
def closed_file(spark, d):
    path = shared_path(spark, "closed")
    tables.closed(*_districts(spark, d)).select("src", "dst").write.option("header", True).csv(path)
    return files.read_closed(spark, path, "D")


@query("select dataset, src, dst, c1 from edges")
def cached_network(spark, d):
    path = shared_path(spark, "network")
    files.cached(spark, path, lambda: tables.grid(spark, d))
    return files.cached(spark, path, lambda: tables.grid(spark, d).where("false")).select("dataset", "src", "dst", "c1")


@query("select dataset, target, node, h1, h2, h3 from behind")
def cached_heuristics(spark, d):
    """Lower bounds kept by dataset and number of objectives, written once."""
    path = shared_path(spark, "bounds")
    build = lambda: search.to_go(*_districts(spark, d)).withColumn("m", F.lit(3))
    files.cached(spark, path, build, partitions=["m"])
    return files.cached(spark, path, lambda: build().where("false"), partitions=["m"]).where("m = 3").drop("m")


@query(f"select dataset, query_id, objective_count, solution_id, {C3} from (select dataset, query_id, 3 as objective_count, row_number() over (partition by dataset, query_id order by {C3}, c4, c5, path) as solution_id, {C5}, path from full_routes)")
def result_file(spark, d):
    """Routes as a result file with a byte-order mark, read back."""
    own, asked = _districts(spark, d)
    path = shared_path(spark, "result3")
    routes = search.all_routes(own, asked)
    order = ", ".join([*X.COSTS, "path"])
    rows = routes.withColumn("solution_id", F.expr(f"cast(row_number() over (partition by dataset, query_id order by {order}) as bigint)"))
    header = "﻿" + ",".join(c.split()[0] for c in files.RESULT3_SCHEMA.split(", "))
    text = rows.select(F.lit(1).alias("at"), F.concat_ws(",", "dataset", "query_id", "source", "target", F.lit("3"), "solution_id", *X.COSTS, X.path_text("path")).alias("value"))
    first = spark.createDataFrame([(0, header)], "at int, value string")
    # a report for people is one file, and its header comes first
    first.unionByName(text).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    return files.read_result3(spark, path).select(*QUERY, "objective_count", "solution_id", *X.costs(3))


@query("select dataset, query_id, source, target from od")
def exported_csv(spark, d):
    path = shared_path(spark, "export")
    files.export_csv(tables.queries(spark, d).drop("tile"), path, ["dataset", "query_id"])
    return spark.read.schema("dataset string, query_id string, source long, target long").option("header", True).csv(path)


@query("select dataset, query_id, status from (select dataset, query_id, case when contains(mode, 'RESOURCE') then 'RESOURCE_LIMIT' when exact then 'EXACT' when early then 'EARLY_STOP' else 'INCOMPLETE' end as status from searches) where status = 'EXACT'")
def committed_results(spark, d):
    """Only exact results are committed; a second commit replaces its own partitions."""
    path = shared_path(spark, "commits")
    rows = tables.searches(spark, d).select(*QUERY, X.status(F.col("exact"), F.col("mode"), F.col("early")).alias("status"))
    files.commit(rows.where("dataset <> 'C1'"), path, ["dataset"])
    files.commit(rows, path, ["dataset"])
    return files.committed(spark, path, "query_id string, status string, dataset string").select(*QUERY, "status")


@query("select dataset, query_id, wall from searches union all select dataset, query_id, wall from searches where exact")
def appended_stats(spark, d):
    path = shared_path(spark, "stats")
    rows = tables.searches(spark, d).select(*QUERY, "wall")
    files.append_stats(rows, path)
    files.append_stats(tables.searches(spark, d).where("exact").select(*QUERY, "wall"), path)
    return spark.read.parquet(path)


@query("select dataset, query_id, expanded from searches")
def json_report(spark, d):
    path = shared_path(spark, "report")
    files.report(tables.searches(spark, d).select(*QUERY, "expanded")).write.text(path)
    return spark.read.schema("dataset string, query_id string, expanded long").json(path).select(*QUERY, "expanded")


@query(f"select dataset, query_id, case when expanded = 1000 then 'medium' else {BUCKET.format(X.SCAN_LIMITS)} end as bucket from searches")
def scan_file(spark, d):
    """Buckets of a scan's file; jobs that it lacks are medium."""
    path = shared_path(spark, "scan")
    rows = _buckets(spark, d)
    rows.where("expanded <> 1000").select(*QUERY, "bucket").write.option("header", True).csv(path)
    return files.read_scan(spark, path, rows.select(*QUERY)).select(*QUERY, "bucket")


def trace_replay(spark, d):
    """Steps of skyline traces whose naive front differs from the kernel's: none."""
    rows = tables.pool(spark, d).selectExpr("dataset", "l_orderkey as step", "c1 as g1", "c2 as g2", "c3 as g3")
    return analysis.replay(rows, "dataset", "step")


QUERIES["trace_replay"] = trace_replay
ORACLES["trace_replay"] = "select l_suppkey as dataset, count(*) as n_steps, 0::bigint as n_different from lineitem group by l_suppkey"

"""Bookkeeping of jobs: what is done, what is left, in which order, and how runs compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BUCKETS, percent_delta, query_key


def pending(expected: DataFrame, committed: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a committed result."""
    return expected.join(committed.select(*keys).distinct(), keys, "left_anti")


def complete(expected: DataFrame, committed: DataFrame, keys: list[str]) -> DataFrame:
    """One row: jobs done, jobs in all, and whether all are done."""
    done = committed.select(*keys).distinct().withColumn("_done", F.lit(1))
    out = expected.select(*keys).distinct().join(done, keys, "left").agg(F.count("_done").alias("done"), F.count("*").alias("total"))
    return out.withColumn("complete", F.col("done") == F.col("total"))


def last_wins(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row of highest ``sequence`` for each key."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.col(sequence))
    return rows.groupBy(*keys).agg(best.alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others]).select(rows.columns)


def first_n(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """At most n rows for each key, in order: a limit that the caller asks for."""
    return rows.withColumn("_n", F.expr(f"row_number() over (partition by {', '.join(keys)} order by {order})")).where(F.col("_n") <= n).drop("_n")


def bucket_counts(rows: DataFrame) -> DataFrame:
    """bucket, n for all four buckets, zeros too."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return names.join(rows.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bucket_rank(bucket: str = "bucket") -> Column:
    """Easiest first."""
    return F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col(bucket))


def waves(jobs: DataFrame) -> DataFrame:
    """Jobs with their wave (1: easy and medium, 2: the others) and place in it, by bucket, dataset and query.

    Jobs are numbered within a dataset and bucket; what stands before comes from the
    counts of datasets, so a wave is not put in order by one task.
    """
    wave = F.when(F.col("bucket").isin("easy", "medium"), 1).otherwise(2)
    ranked = jobs.withColumn("wave", wave).withColumn("_rank", bucket_rank()).withColumn("_own", F.expr("row_number() over (partition by wave, _rank, dataset order by query_id)"))
    counts = ranked.groupBy("wave", "_rank", "dataset").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.expr("coalesce(sum(_n) over (partition by wave order by _rank, dataset rows between unbounded preceding and 1 preceding), 0)")).drop("_n")
    return ranked.join(before, ["wave", "_rank", "dataset"]).select(*jobs.columns, "wave", (F.col("_before") + F.col("_own")).cast("int").alias("place"))


def digest(front: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, digest: the first 16 hex digits of the SHA-256 of the sorted vectors' lines.

    A group is one query's front, in the order of its numbers.
    """
    lines = F.transform(F.sort_array(F.collect_list(F.struct("c1", "c2", "c3"))), lambda s: F.concat_ws(",", s["c1"], s["c2"], s["c3"]))
    text = F.array_join(lines, "\n")
    return front.groupBy(*keys).agg(F.count("*").alias("n"), F.left(F.sha2(text, 256), F.lit(16)).alias("digest"))


def differential(a: DataFrame, b: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, only_a, only_b, ok: whether two runs found the same set of vectors."""
    side = lambda df, s: df.select(*keys, *names).distinct().withColumn(s, F.lit(1))
    both = side(a, "in_a").join(side(b, "in_b"), [*keys, *names], "full_outer")
    out = both.groupBy(*keys).agg(F.sum(F.when(F.col("in_b").isNull(), 1).otherwise(0)).alias("only_a"), F.sum(F.when(F.col("in_a").isNull(), 1).otherwise(0)).alias("only_b"))
    return out.withColumn("ok", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def before_after(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after, speedup; null without both or with 0."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    both = a.join(b, key, "full_outer")
    return both.withColumn("speedup", F.when((F.col("after") != 0) & (F.col("before") != 0), F.col("before") / F.col("after")))


def throughput(rows: DataFrame, keys: list[str], work: str, seconds: str) -> DataFrame:
    """keys, aggregate: sum of work by time, over rows that took time."""
    return rows.where(F.col(seconds) > 0).groupBy(*keys).agg(F.sum(F.col(work) / F.col(seconds)).alias("aggregate"))


def recommended_workers(configurations: DataFrame, least_gain: float = 0.08) -> DataFrame:
    """One row, n_workers: the last of the configurations, in order, that still gained enough over the best before."""
    ordered = configurations.agg(F.sort_array(F.collect_list(F.struct("n_workers", "aggregate"))).alias("all")).where("size(all) > 0")
    gained = f"(x.aggregate - s.prev) / greatest(s.prev, 1.0D) >= {least_gain}"
    start = "named_struct('best', all[0].n_workers, 'prev', all[0].aggregate, 'on', true)"
    step = f"case when s.on and {gained} then named_struct('best', x.n_workers, 'prev', x.aggregate, 'on', true) else named_struct('best', s.best, 'prev', s.prev, 'on', false) end"
    return ordered.select(F.expr(f"aggregate(slice(all, 2, size(all)), {start}, (s, x) -> {step}, s -> s.best)").alias("n_workers"))


def gates(runs: DataFrame) -> DataFrame:
    """Verdicts on pairs of runs (case_id, live_a, live_b, open_a, open_b, wall_a, wall_b, same)."""
    wall = percent_delta(F.col("wall_b"), F.col("wall_a"))
    smaller = (F.col("live_b") <= 0.7 * F.col("live_a")) | ((F.col("open_a") > 0) & (F.col("open_b") <= 0.7 * F.col("open_a")))
    pending_down = percent_delta(F.col("live_b"), F.col("live_a")) <= -10
    return runs.select("case_id", wall.alias("wall_delta"), smaller.alias("memory_gate"), (F.col("same") & F.coalesce(pending_down, F.lit(False)) & F.coalesce(wall <= 8, F.lit(True))).alias("sweep_gate"), (F.col("same") & ((F.col("wall_a") - F.col("wall_b")) >= 0.2 * F.col("wall_a"))).alias("speed_gate"))


def slopes(log: DataFrame) -> DataFrame:
    """Rates for each expansion of a search's progress rows, the last row of each exp."""
    per = lambda c: (F.col(c) / F.greatest("exp", F.lit(1))).alias(f"{c}_per_exp")
    return log.select("*", (F.col("gen") / F.greatest("exp", F.lit(1))).alias("rg"), (F.col("live") / F.greatest("exp", F.lit(1))).alias("rl"), *map(per, ("node_pr", "goal_pr", "s", "max_node")))


def selected(jobs: DataFrame, buckets: list[str] | None, hold: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs of the wanted buckets that are neither held back nor done."""
    wanted = jobs.where(F.col("bucket").isin(buckets)) if buckets else jobs
    return pending(pending(wanted, hold, keys), done, keys)


def parse_held(items: DataFrame) -> DataFrame:
    """dataset (upper case) and query_id (four digits) of texts ``DS:QID`` or ``DS_QID``; others go."""
    at = F.when(F.col("value").contains(":"), F.lit(":")).when(F.col("value").contains("_"), F.lit("_"))
    parts = F.split("value", at, 2)
    return items.where(at.isNotNull()).select(F.upper(parts[0]).alias("dataset"), query_key(parts[1]).alias("query_id")).distinct()


def spread(jobs: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n jobs, datasets in the given order, then by query: a limit that the caller asks for."""
    rank = F.array_position(F.array(*[F.lit(d) for d in order]), F.col("dataset"))
    return jobs.where(rank > 0).orderBy(rank, "query_id").limit(n)


def best_configuration(configurations: DataFrame) -> DataFrame:
    """The configuration without mismatch of most speedup, then of least scan ratio, then by name."""
    return configurations.where("mismatch = 0").orderBy(F.desc("speedup"), "scan_ratio", "name").limit(1)


def regressions(baseline: DataFrame, candidate: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: compared, equal, missing (in the candidate) and passed, by the optimal value of each key."""
    both = baseline.select(*keys, F.col(value).alias("_a")).join(candidate.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_there")), keys, "left")
    same, missing = F.col("_a").eqNullSafe(F.col("_b")) & F.col("_there").isNotNull(), F.col("_there").isNull()
    out = both.agg(F.count("*").alias("compared"), F.sum(same.cast("long")).alias("equal"), F.sum(missing.cast("long")).alias("missing"))
    return out.withColumn("passed", F.col("compared") == F.col("equal"))


def run_statistics(stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean and largest runtime, and mean labels of searches."""
    return stats.groupBy(*keys).agg(F.avg("wall").alias("runtime_mean_sec"), F.max("wall").alias("runtime_max_sec"), F.avg("generated").alias("labels_gen_mean"), F.avg("nqp_live").alias("pending_mean"))


def time_shares(profiles: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """keys and the share of each part in the sum of all, whose least value is 1."""
    total = F.greatest(sum((F.sum(p) for p in parts[1:]), F.sum(parts[0])), F.lit(1))
    return profiles.groupBy(*keys).agg(*[(F.sum(p) / total).alias(f"{p}_frac") for p in parts])


def first_ids(rows: DataFrame, keys: list[str], column: str, n: int) -> DataFrame:
    """Rows of the first n values of ``column`` in each group, in order."""
    return rows.withColumn("_n", F.expr(f"dense_rank() over (partition by {', '.join(keys)} order by {column})")).where(F.col("_n") <= n).drop("_n")

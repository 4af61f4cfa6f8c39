"""Readers of networks, queries, results and logs, and the writers of results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import COSTS, path_parse, path_text, query_key

# The formats of files that users already have.
QUERY_SCHEMA = "query_id string, source long, target long"
RESULT3_SCHEMA = "dataset string, query_id string, source long, target long, objective_count int, solution_id long, c1 long, c2 long, c3 long, c4 long, c5 long, path string"
RESULT4_COLUMNS = ("dataset", "query_id", "source", "target", "scheme", "network_state", "feasible", "c1", "c2", "c3", "c4", "c5", "path")
LOG_FIELDS = (("exp", "exp"), ("gen", "gen"), ("live", "live"), ("open", "open"), ("|S|", "s"), ("node_pr", "node_pr"), ("goal_pr", "goal_pr"), ("dup", "dup"), ("stale", "stale"), ("max_node", "max_node"))
LOG_PREFIX = "[namoa]"


def read_edges(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Edges of one network's text file: seven whole numbers a line, ``#`` begins a comment line.

    edge_seq keeps the order of lines within a file part; parallel edges are settled by it.
    """
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')").withColumn("edge_seq", F.monotonically_increasing_id())
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(F.lit(dataset).alias("dataset"), *[parts[i].cast("long").alias(c) for i, c in enumerate(("src", "dst", *COSTS))], "edge_seq")


def read_queries(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """dataset, query_id (four digits), source, target of a CSV file with header."""
    rows = spark.read.schema(QUERY_SCHEMA).option("header", True).csv(path)
    return rows.select(F.lit(dataset).alias("dataset"), query_key("query_id").alias("query_id"), "source", "target")


def read_closed(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Distinct directed pairs of a CSV file whose first two columns are ends of closed edges."""
    rows = spark.read.option("header", True).csv(path)
    src, dst = rows.columns[:2]
    return rows.select(F.lit(dataset).alias("dataset"), F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).distinct()


def cached(spark: SparkSession, path: str, build, rebuild: bool = False, partitions: list[str] | None = None) -> DataFrame:
    """The Parquet table at ``path``, written from ``build()`` (by ``partitions``, if any) if it isn't there or ``rebuild`` is set."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if rebuild or not there:
        build().write.mode("overwrite").partitionBy(*(partitions or [])).parquet(path)
    return spark.read.parquet(path)


def read_result3(spark: SparkSession, path: str, datasets: list[str] | None = None, merge_objectives: bool = True) -> DataFrame:
    """Candidates of a result3 CSV (a byte-order mark is no part of the header): rows with a path and all five costs.

    ``merge_objectives`` unites the pools of all objective counts; else only five count.
    """
    rows = spark.read.schema(RESULT3_SCHEMA).option("header", True).option("enforceSchema", True).csv(path)
    rows = rows.withColumn("path", path_parse("path")).where("path is not null")
    rows = rows if merge_objectives else rows.where("objective_count = 5")
    return (rows.where(F.col("dataset").isin(datasets)) if datasets else rows).withColumn("query_id", query_key("query_id"))


def parse_progress(lines: DataFrame) -> DataFrame:
    """Progress counters of a search's log lines (column value), the last line for each exp."""
    lines = lines.withColumn("_at", F.monotonically_increasing_id()).where(F.col("value").contains(LOG_PREFIX))
    found = lines.select("_at", *[F.regexp_extract("value", rf"(?:^|\s){re.escape(text)}=(\d+)", 1).cast("long").alias(name) for text, name in LOG_FIELDS])
    found = found.where(" and ".join(f"{name} is not null" for _, name in LOG_FIELDS))
    others = [name for _, name in LOG_FIELDS if name != "exp"]
    return found.groupBy("exp").agg(F.max_by(F.struct(*others), "_at").alias("r")).select("exp", "r.*")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """file, step, g1, g2, g3 of binary traces: a count and then triples, all 64-bit little-endian."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    number = lambda at: f"cast(conv(hex(reverse(substring(content, {at}, 8))), 16, -10) as bigint)"
    rows = files.withColumn("n", F.expr(number(1))).where("n > 0").select("file", "content", F.explode(F.expr("sequence(1L, n)")).alias("step"))
    return rows.select("file", "step", *[F.expr(number(f"cast(9 + 24 * (step - 1) + {8 * k} as int)")).alias(f"g{k + 1}") for k in range(3)])


def read_scan(spark: SparkSession, path: str, jobs: DataFrame) -> DataFrame:
    """``jobs`` with the bucket of their scan; those that were not scanned count as medium."""
    scan = spark.read.option("header", True).csv(path).select("dataset", query_key("query_id").alias("query_id"), "bucket")
    return jobs.join(scan, ["dataset", "query_id"], "left").withColumn("bucket", F.coalesce("bucket", F.lit("medium")))


def toy(spark: SparkSession, kind: str) -> DataFrame:
    """Small hand-written networks: diamond, zero_elevation, many_in, unreachable, parallel."""
    rows = {
        "diamond": [(1, 2, 1, 9, 1, 2, 1), (1, 3, 9, 1, 1, 2, 1), (2, 4, 1, 9, 1, 2, 1), (3, 4, 9, 1, 1, 2, 1)],
        "zero_elevation": [(1, 2, 2, 3, 0, 1, 1), (2, 4, 2, 3, 0, 1, 1), (1, 3, 1, 5, 0, 1, 1), (3, 4, 1, 5, 0, 1, 1)],
        "many_in": [(1, 2, 1, 4, 3, 1, 1), (1, 3, 2, 2, 2, 1, 1), (1, 4, 4, 1, 1, 1, 1), (2, 5, 1, 4, 3, 1, 1), (3, 5, 2, 2, 2, 1, 1), (4, 5, 4, 1, 1, 1, 1)],
        "unreachable": [(1, 2, 1, 1, 1, 1, 1), (4, 3, 1, 1, 1, 1, 1)],
        "parallel": [(1, 2, 5, 5, 5, 5, 1), (1, 2, 1, 1, 1, 1, 1), (2, 2, 1, 1, 1, 1, 1), (2, 3, 1, 1, 1, 1, 1)],
    }[kind]
    schema = "dataset string, src long, dst long, c1 long, c2 long, c3 long, c4 long, c5 long, edge_seq long"
    return spark.createDataFrame([(kind, *r, i) for i, r in enumerate(rows)], schema)


def random_dag(spark: SparkSession, n: int, seed: int, name: str = "dag") -> DataFrame:
    """Edges from each node to some later ones, with costs from a hash of seed and ends; node n is reached from 1."""
    pairs = spark.range(1, n).select(F.col("id").alias("src")).withColumn("dst", F.explode(F.sequence(F.col("src") + 1, F.lit(n).cast("long"))))
    draw = lambda k: F.pmod(F.xxhash64("src", "dst", F.lit(seed), F.lit(k)), F.lit(20))
    kept = pairs.where((F.col("dst") == F.col("src") + 1) | (F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(100)) < 45))
    return kept.select(F.lit(name).alias("dataset"), "src", "dst", *[(draw(k) + int(k != 3)).cast("long").alias(f"c{k}") for k in range(1, 5)], F.lit(1).cast("long").alias("c5"), (F.col("src") * n + F.col("dst")).alias("edge_seq"))


def commit(rows: DataFrame, path: str, keys: list[str], exact_only: bool = True) -> None:
    """Write result rows as partitions of ``keys``, replacing those partitions only; with ``exact_only``, rows whose status is EXACT."""
    rows = rows.where("status = 'EXACT'") if exact_only else rows
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def committed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What has been committed so far; nothing if there is no such folder yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def export_csv(rows: DataFrame, path: str, order: list) -> None:
    """One ordered CSV with header, paths as text; a report for people, so it is one file."""
    rows = rows.orderBy(*order)
    rows = rows.withColumn("path", path_text("path")) if dict(rows.dtypes).get("path", "").startswith("array") else rows
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_stats(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def report(rows: DataFrame) -> DataFrame:
    """Each row as a JSON text."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))

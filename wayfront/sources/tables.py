"""Networks, queries and candidate pools derived from the star-schema tables.

The parts are the nodes of a grid of ``WIDTH`` columns.  GRID is the whole network, with
edges both ways; districts are its tiles of ``TILE`` x ``TILE`` nodes with edges to the
right and down, each a network of its own with a query from its first to its last node.
Every part is in the grid, and in one district.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, TILE = 20, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the whole network."""
    nodes = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).cast("long").alias("src"), F.col("p_size").cast("long").alias("size"))
    steps = nodes.withColumn("step", F.explode(F.array(*[F.lit(s).cast("long") for s in (1, -1, WIDTH, -WIDTH)]))).withColumn("dst", F.col("src") + F.col("step"))
    steps = steps.where(f"abs(step) <> 1 or (src - 1) div {WIDTH} = (dst - 1) div {WIDTH}").where("dst > 0")
    ends = nodes.select(F.col("src").alias("dst"), F.col("size").alias("dst_size"))
    both = steps.join(ends, "dst")
    c = ("1 + (src * 7919 + dst * 104729) % 97 + size", "1 + (src * 31 + dst * 17) % 53 + dst_size", "(src * 13 + dst * 29) % 11", "(src + dst) % 4 + 2", "1L")
    return both.select(F.lit("GRID").alias("dataset"), "src", "dst", *[F.expr(e).cast("long").alias(f"c{k + 1}") for k, e in enumerate(c)], F.expr("src * 100000000 + dst").alias("edge_seq"))


def tile(node: str) -> str:
    return f"(({node} - 1) div {WIDTH} div {TILE}) * {WIDTH // TILE} + (({node} - 1) % {WIDTH}) div {TILE}"


def district_name(node: str) -> F.Column:
    return F.concat(F.lit("D"), F.lpad(F.expr(tile(node)).cast("string"), 6, "0"))


def districts(edges: DataFrame) -> DataFrame:
    """Edges of all districts."""
    own = edges.where("dst > src").where(f"{tile('src')} = {tile('dst')}")
    return own.withColumn("dataset", district_name("src"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, query_id, source, target: one query for each district."""
    nodes = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).cast("long").alias("id"))
    out = nodes.select(district_name("id").alias("dataset"), F.expr(tile("id")).alias("tile"), "id").groupBy("dataset", "tile").agg(F.min("id").alias("source"), F.max("id").alias("target"))
    return out.select("dataset", F.lpad((F.col("tile") + 1).cast("string"), 6, "0").alias("query_id"), "source", "target")


def city() -> F.Column:
    """Districts are dealt over three cities."""
    return F.concat(F.lit("C"), F.expr("cast(substring(dataset, 2) as bigint) % 3").cast("string"))


def closed(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Closed edges of the districts: none that leaves the source or enters the target."""
    marked = edges.where("(src * 31 + dst * 17) % 23 = 0").join(asked.select("dataset", "source", "target"), "dataset")
    return marked.where("src <> source and dst <> target").select("dataset", "src", "dst")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with five whole costs, by supplier: dataset, l_orderkey, c1..c5."""
    cost = ("l_quantity", "l_extendedprice * 100", "l_discount * 100", "l_tax * 100", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("dataset"), "l_orderkey", *[F.expr(f"cast(round({e}) as bigint)").alias(f"c{k + 1}") for k, e in enumerate(cost)])


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of budgeted searches, one for each order: dataset, query_id, exact, early, mode, expanded, generated, open_peak, nqp_live, wall."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"), F.expr("cast(sum(round(l_extendedprice)) as bigint)").alias("p"))
    return lines.select(F.expr("concat('C', l_orderkey % 3)").alias("dataset"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0").alias("query_id"), (F.col("n") <= 2).alias("exact"), (F.col("n") == 3).alias("early"), F.expr("case when n >= 7 then 'RESOURCE_LABELS' else 'run' end").alias("mode"), F.expr("n * 1000").alias("expanded"), F.expr("n * 1700 + q").alias("generated"), F.expr("q * 40").alias("open_peak"), F.expr("p * 3").alias("nqp_live"), F.expr("cast(q as double)").alias("wall"))

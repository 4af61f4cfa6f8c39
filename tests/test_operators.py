"""Readers, writers, skylines and streams on small hand-written data."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from wayfront.functions import columns as X
from wayfront.operators import approximate, jobs, networks, preference, skyline
from wayfront.plans import fixpoint, search
from wayfront.sources import files
from wayfront.streaming import fronts


def queries(spark, name, source, target):
    return spark.createDataFrame([(name, "0001", source, target)], "dataset string, query_id string, source long, target long")


@pytest.mark.parametrize("kind, target, expected", [("diamond", 4, {(2, 18, 2), (18, 2, 2)}), ("zero_elevation", 4, {(4, 6, 0), (2, 10, 0)}), ("many_in", 5, {(2, 8, 6), (4, 4, 4), (8, 2, 2)}), ("unreachable", 3, set())])
def test_toy_fronts(spark, kind, target, expected):
    rows = search.front(files.toy(spark, kind), queries(spark, kind, 1, target), 3).collect()
    assert {tuple(r)[2:] for r in rows} == expected


@pytest.mark.parametrize("seed", [0, 100])
def test_random_networks_agree(spark, seed):
    edges = files.random_dag(spark, 14, seed)
    asked = queries(spark, "dag", 1, 14)
    a, b = search.front(edges, asked, 3), search.front(edges, asked, 3, bounds=False)
    assert jobs.differential(a, b, ["dataset", "query_id"], X.costs(3)).where("not ok").count() == 0
    near = {r["node"]: r["distance"] for r in fixpoint.distances(edges, asked, "c2").collect()}
    assert near == {r["node"]: r["distance"] for r in search.distances(edges, asked, 2).collect()}


def test_parallel_edges_and_loops(spark):
    rows = networks.canonical(files.toy(spark, "parallel")).orderBy("src").collect()
    assert [(r["src"], r["dst"], r["c1"]) for r in rows] == [(1, 2, 5), (2, 3, 1)]


def test_paths(spark):
    df = spark.createDataFrame([("1->2->3",), ("",), (None,), ("7",)], "t string").select(X.path_parse("t").alias("p"), "t")
    got = [(r["p"], r["t"], r["e"]) for r in df.withColumn("e", F.size(X.path_edges("p"))).collect()]
    assert got[0][0] == [1, 2, 3] and got[0][2] == 2 and got[1][0] is None and got[2][0] is None and got[3] == ([7], "7", 0)


def test_skyline_keeps_or_drops_equals(spark):
    rows = spark.createDataFrame([("a", 1, 2, 9), ("a", 1, 2, 8), ("a", 2, 1, 7), ("a", 2, 2, 6), ("b", 5, 5, 5)], "k string, c1 long, c2 long, x long")
    assert skyline.distinct_skyline(rows, ["k"], 2).count() == 3
    assert {r["x"] for r in skyline.skyline(rows, ["k"], 2).collect()} == {9, 8, 7, 5}
    assert skyline.distinct_skyline(rows.where("false"), ["k"], 2).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("# src dst\n1 2   3 4 5 6 1\n\n  2 3 1 1 1 1 1\n")
    edges = files.read_edges(spark, str(tmp_path / "edges.txt"), "NET")
    assert edges.count() == 2 and edges.agg(F.sum("c1")).first()[0] == 4
    (tmp_path / "q.csv").write_text("query_id,source,target\n7,1,3\n")
    assert files.read_queries(spark, str(tmp_path / "q.csv"), "NET").first()["query_id"] == "0007"
    (tmp_path / "closed.csv").write_text("u,v\n1,2\n1,2\n")
    left = networks.without(edges, files.read_closed(spark, str(tmp_path / "closed.csv"), "NET"))
    assert left.count() == 1
    (tmp_path / "r3.csv").write_text("﻿dataset,query_id,source,target,objective_count,solution_id,c1,c2,c3,c4,c5,path\nNET,1,1,3,5,1,1,2,3,4,5,1->2->3\nNET,1,1,3,2,1,1,2,0,0,0,\n")
    assert files.read_result3(spark, str(tmp_path / "r3.csv")).collect()[0]["path"] == [1, 2, 3]
    (tmp_path / "trace.bin").write_bytes(struct.pack("<q", 2) + struct.pack("<6q", 1, 2, 3, 4, 5, 1 << 40))
    assert [tuple(r)[1:] for r in files.read_trace(spark, str(tmp_path / "trace.bin")).orderBy("step").collect()] == [(1, 1, 2, 3), (2, 4, 5, 1 << 40)]


def test_commit_and_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    schema = "c1 long, status string, dataset string, query_id string"
    rows = spark.createDataFrame([(1, "EXACT", "A", "0001"), (2, "EARLY_STOP", "A", "0002")], schema)
    assert files.committed(spark, path, schema).count() == 0
    files.commit(rows, path, ["dataset", "query_id"])
    left = jobs.pending(rows.select("dataset", "query_id"), files.committed(spark, path, schema), ["dataset", "query_id"])
    assert [r["query_id"] for r in left.collect()] == ["0002"]
    built = files.cached(spark, str(tmp_path / "cache"), lambda: rows)
    assert built.count() == 2 and files.cached(spark, str(tmp_path / "cache"), lambda: rows.limit(0)).count() == 2


def test_coverage_of_nothing_and_weights(spark):
    w = approximate.simplex_weights(spark, 9, 2).orderBy("i").collect()
    assert len(w) == 9 and all(abs(r["w1"] + r["w2"] - 1) < 1e-9 for r in w) and w[-1]["w1"] == 5 / 8
    assert approximate.simplex_weights(spark, 20, 5).count() == 20
    assert approximate.weight_grid(spark, 10).count() == 66


def test_recommendation_ties(spark):
    pool = spark.createDataFrame([("a", 1, 5, 5, 5, 5, 5), ("a", 2, 5, 5, 5, 5, 5)], "dataset string, id long, c1 long, c2 long, c3 long, c4 long, c5 long")
    got = preference.recommend(pool, preference.schemes(spark), ["dataset"], ["id"]).collect()
    assert len(got) == 4 and {r["id"] for r in got} == {1}


def test_stream_of_candidates(spark, tmp_path):
    schema = "k string, c1 long, c2 long"
    source = str(tmp_path / "in")
    for rows in ([("a", 1, 9), ("a", 5, 5)], [("a", 4, 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = fronts.maintain(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], 2)
    q.awaitTermination(120)
    last = spark.read.parquet(f"{tmp_path}/out/1").collect()
    assert {(r["c1"], r["c2"]) for r in last} == {(1, 9), (4, 4)}

"""Neighbour graph search against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scholion.operators import graph_search as gs


def vectors(spark, n, dims=16, seed=1, centres=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    m = middle[rng.integers(0, centres, n)] + 0.4 * rng.normal(size=(n, dims))
    rows = [(f"v{k:05d}", [float(x) for x in v]) for k, v in enumerate(m)]
    return m, spark.createDataFrame(rows, "chunk_id string, embedding array<double>")


def test_most_neighbours_are_found_in_few_steps(spark):
    m, frame = vectors(spark, 900)
    graph = gs.build_graph(frame, shard_rows=500)
    assert graph.select("shard").distinct().count() == 2
    assert graph.agg(F.max(F.size("neighbours"))).first()[0] <= 2 * gs.DEGREE
    q = frame.where("chunk_id like '%0'").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    got = {}
    for r in gs.graph_search(q, graph, k=5).collect():
        assert r.scored_share <= 0.2
        got.setdefault(r.query_id, []).append((r.vector_rank, r.chunk_id, r.vector_similarity))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = 0
    for query, rows in got.items():
        score = unit @ unit[int(query[1:])]
        best = {f"v{k:05d}" for k in np.argsort(-score)[:5]}
        hits += len(best & {c for _, c, _ in rows})
        assert [n for n, _, _ in sorted(rows)] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[int(c[1:])]) < 1e-9 for _, c, s in rows)
    assert len(got) == 90 and hits >= 0.9 * 5 * 90


def test_building_reaches_nearly_the_exact_lists(spark):
    m, frame = vectors(spark, 400)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -2)
    near = {r.id: set(r.neighbours) for r in gs.build_graph(frame).collect()}
    found = sum(len({f"v{k:05d}" for k in np.argsort(-score[i])[: gs.DEGREE]} & near[f"v{i:05d}"]) for i in range(400))
    assert found >= 0.95 * 400 * gs.DEGREE


def test_small_odd_and_empty_tables(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, 1.0]), ("d", [1.0, 1.0]), (None, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    graph = gs.build_graph(frame)
    q = spark.createDataFrame([("q", [2.0, 0.1]), ("none", None)], "query_id string, query_embedding array<double>")
    got = [(r.query_id, r.chunk_id, r.vector_rank) for r in gs.graph_search(q, graph, k=5, share=1.0).collect()]
    assert sorted(got) == [("q", "a", 1), ("q", "d", 2)]
    assert gs.graph_search(q, gs.build_graph(frame.limit(0))).collect() == []
    assert gs.graph_search(q.limit(0), graph).collect() == []


def test_several_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(gs, "QUERIES_PER_BLOCK", 7)
    _, frame = vectors(spark, 200)
    q = frame.limit(40).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    got = gs.graph_search(q, gs.build_graph(frame), k=3).groupBy("query_id").count().collect()
    assert len(got) == 40 and {r["count"] for r in got} == {3}

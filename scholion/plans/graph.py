"""Search over a neighbour graph of the given vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.operators import graph_search as gs
from scholion.operators import vector_search as vs
from scholion.plans.base import Registry, table
from scholion.plans.search import vectors_as_chunks

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

K = 5


@R.add(
    "q3_graph_recall",
    """SELECT count(*) AS queries, true AS found_nine_of_ten, true AS scored_under_a_fifth, true AS exact_similarities
    FROM embeddings WHERE vec_id % 50 = 0""",
)
def q3_graph(spark, sf):
    """Walks for every fiftieth vector against all: recall, share of vectors scored, and their cosines."""
    e = table(spark, sf, "embeddings")
    rows = vectors_as_chunks(e)
    q = e.where("vec_id % 50 = 0").select(
        F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query_embedding")
    )
    found = gs.graph_search(q, gs.build_graph(rows), K)
    exact = vs.vector_topk(q, rows, K).select("query_id", "chunk_id", F.col("vector_similarity").alias("exact"))
    both = exact.join(found, ["query_id", "chunk_id"], "left")
    each = both.groupBy("query_id").agg(
        (F.count("vector_similarity") / F.count("*")).alias("recall"),
        F.max("scored_share").alias("share"),
        F.bool_and(F.coalesce(F.abs(F.col("vector_similarity") - F.col("exact")) < 1e-9, F.lit(True))).alias("exact"),
    )
    return each.agg(
        F.count("*").alias("queries"),
        (F.avg("recall") >= 0.9).alias("found_nine_of_ten"),
        (F.max("share") < 0.2).alias("scored_under_a_fifth"),
        F.bool_and("exact").alias("exact_similarities"),
    )

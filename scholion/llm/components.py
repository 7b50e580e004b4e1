"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.session import persist_shared


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    digest = F.pmod(F.xxhash64("u", "v"), F.lit(2**40))
    return tuple(edges.agg(F.count("*"), F.sum(digest)).first())


def components(links: DataFrame, max_rounds: int = 30) -> DataFrame:
    """node, component_id (the smallest reachable id) of every node that has a link.

    links holds ids u and v; nulls and self links are ignored, repeated and reversed links count
    once, no links give an empty table. A round moves at most as many rows as there are links, and
    each is stored in the shared folder.
    """
    edges = persist_shared(
        links.where("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    mark = _mark(edges)
    for _ in range(max_rounds):
        edges = persist_shared(_small_star(_large_star(edges)), "links")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(
        roots.select("node", F.col("node").alias("component_id"))
    )

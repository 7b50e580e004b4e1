"""Approximate nearest neighbours by walking a neighbour graph: most vectors are never scored.

The graph is built in rounds: every vector starts with the best of two small random blocks, then meets the
neighbours of its neighbours and one more random block a round, until few lists change. Vectors are dealt over shards of bounded size, and
edges stay within a shard; a search walks each shard from a few entry points, always on from the best
vector that has not been left yet, all queries of a block in step, and merges the shards' best.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.vectors import normalise
from scholion.operators.filters import searchable_vectors
from scholion.session import persist_shared

DEGREE = 10
SHARD_ROWS = 20_000
START_ROWS = 128
PIVOTS_PER_TASK = 20_000
QUERIES_PER_BLOCK = 1024
ENTRIES = 16
BEAM = 24
EDGES = "shard int, u string, v string, s double"
HITS = "query_id string, chunk_id string, vector_similarity double, scored bigint, vectors bigint"


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _best(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the n highest finite scores of each row."""
    n = min(n, scores.shape[1])
    top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    row = np.repeat(np.arange(len(scores)), n)
    column = top.ravel()
    keep = np.isfinite(scores[row, column])
    return row[keep], column[keep]


def _start(degree: int):
    """Each vector's best neighbours in one random block."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        m = _matrix(frame["vec"])
        scores = m @ m.T
        np.fill_diagonal(scores, -np.inf)
        row, column = _best(scores, degree)
        ids = frame["id"].to_numpy()
        return pd.DataFrame(
            {"shard": frame["shard"].iat[0], "u": ids[row], "v": ids[column], "s": scores[row, column]}
        )

    return run


def _meet(degree: int):
    """The members of many pivots: each member's best others at the same pivot."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["shard", "pivot", "id"], ignore_index=True)
        pivot = frame.groupby(["shard", "pivot"], sort=False).ngroup().to_numpy()
        sizes = np.bincount(pivot)
        place = np.arange(len(frame)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        m, ids, shard = _matrix(frame["vec"]), frame["id"].to_numpy(), frame["shard"].to_numpy()
        out = []
        # A bounded number of pivots at a time, as blocks of equal width.
        step = max(1, 2_000_000 // (int(sizes.max()) * max(m.shape[1], int(sizes.max()))))
        for at in range(0, len(sizes), step):
            mine = np.flatnonzero((pivot >= at) & (pivot < at + step))
            width = int(sizes[at : at + step].max())
            cells = np.zeros((len(sizes[at : at + step]), width, m.shape[1]))
            number = np.full(cells.shape[:2], -1)
            cells[pivot[mine] - at, place[mine]] = m[mine]
            number[pivot[mine] - at, place[mine]] = mine
            scores = np.einsum("pid,pjd->pij", cells, cells)
            scores[np.broadcast_to((number < 0)[:, None, :], scores.shape)] = -np.inf
            scores[:, np.arange(width), np.arange(width)] = -np.inf
            flat = scores.reshape(-1, width)
            row, column = _best(flat, degree)
            u, v = number.ravel()[row], number[row // width, column]
            real = u >= 0
            out.append(
                pd.DataFrame(
                    {"shard": shard[u[real]], "u": ids[u[real]], "v": ids[v[real]], "s": flat[row, column][real]}
                )
            )
        return pd.concat(out, ignore_index=True)

    return run


def _top(edges: DataFrame, of: str, n: int) -> DataFrame:
    """The n best edges of each end; a crowded end is cut before its edges are gathered."""
    other = "v" if of == "u" else "u"
    order = Window.partitionBy("shard", of).orderBy(F.desc("s"), other)
    return edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def _both_ways(edges: DataFrame, n: int) -> DataFrame:
    """Each end's neighbours, by its own list and by others' lists, the n best of them."""
    turned = edges.select("shard", F.col("v").alias("u"), F.col("u").alias("v"), "s")
    return _top(edges.unionByName(turned).dropDuplicates(["shard", "u", "v"]), "u", n)


def build_graph(
    chunks: DataFrame, degree: int = DEGREE, rounds: int = 8, settled: float = 0.01, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """shard, id, vec, neighbours of every searchable vector of chunks (chunk_id, embedding).

    Neighbours are at most twice `degree`: a vector's own best and those that list it. Rounds end when at
    most the share `settled` of the lists' entries is new. Rows without a usable vector are left out; of rows with
    one chunk_id one stays; an empty table gives an empty graph.
    """
    rows = searchable_vectors(chunks).select(
        F.col("chunk_id").alias("id"), normalise(F.col("embedding")).alias("vec")
    ).where(F.col("id").isNotNull())
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    stored = persist_shared(rows, "graph-vectors")
    n = stored.count()
    shards = max(1, math.ceil(n / shard_rows))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    vectors = stored.withColumn("shard", shard)
    blocks = max(1, math.ceil(n / shards / START_ROWS))

    def dealt(salt: int) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(blocks))
        return vectors.withColumn("block", block).groupBy("shard", "block").applyInPandas(_start(degree), EDGES)

    # Two ways to deal the blocks: within those of a single one, no neighbour's neighbour is new.
    first = dealt(0).unionByName(dealt(1)).dropDuplicates(["shard", "u", "v"])
    edges = persist_shared(_top(first, "u", degree), "graph-edges")
    tasks = max(1, math.ceil(n / PIVOTS_PER_TASK))
    for round_no in range(rounds):
        members = _both_ways(edges, 2 * degree).select("shard", F.col("u").alias("pivot"), F.col("v").alias("id"))
        own = vectors.select("shard", F.col("id").alias("pivot"), "id")
        met = (
            members.unionByName(own)
            .join(vectors, ["shard", "id"])
            .withColumn("task", F.pmod(F.xxhash64("shard", "pivot"), F.lit(tasks * shards)))
            .groupBy("task")
            .applyInPandas(_meet(degree), EDGES)
        )
        met = met.unionByName(dealt(round_no + 2))
        merged = edges.withColumn("old", F.lit(1)).unionByName(met.withColumn("old", F.lit(0)))
        merged = merged.groupBy("shard", "u", "v").agg(F.max("s").alias("s"), F.max("old").alias("old"))
        kept = persist_shared(_top(merged, "u", degree), "graph-edges")
        total, fresh = kept.agg(F.count("*"), F.count_if(F.col("old") == 0)).first()
        edges = kept.drop("old")
        if fresh <= settled * total:
            break
    listed = _both_ways(edges, 2 * degree).groupBy("shard", F.col("u").alias("id")).agg(
        F.collect_list("v").alias("neighbours")
    )
    return persist_shared(
        vectors.join(listed, ["shard", "id"], "left").withColumn(
            "neighbours", F.coalesce("neighbours", F.array().cast("array<string>"))
        ),
        "graph",
    )


def walk(
    m: np.ndarray, links: np.ndarray, asked: np.ndarray, entries: np.ndarray, k: int, beam: int, share: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and similarities of the k best vectors found for each query, and how many were scored.

    links holds each vector's neighbours, -1 where there is none. A query ends when the `beam` best that it
    has seen were all left, or before its next step could score more than the share of all vectors.
    """
    q, n = len(asked), len(m)
    seen = np.zeros((q, n), dtype=bool)
    seen[:, entries] = True
    width = max(beam, k)
    pool = np.broadcast_to(entries, (q, len(entries))).copy()
    score = asked @ m[entries].T
    left = np.zeros(pool.shape, dtype=bool)
    scored = np.full(q, len(entries))
    allowed = max(int(share * n), len(entries))
    every = np.arange(q)
    while True:
        ahead = np.where(left, -np.inf, score)
        at = ahead.argmax(axis=1)
        go = np.isfinite(ahead[every, at]) & (scored < allowed)
        if not go.any():
            break
        rows = every[go]
        left[rows, at[go]] = True
        near = links[pool[rows, at[go]]]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        # What the share still allows, nearest neighbours first.
        fresh &= np.cumsum(fresh, axis=1) <= (allowed - scored[rows])[:, None]
        seen[np.repeat(rows, fresh.sum(axis=1)), near[fresh]] = True
        got = np.einsum("qd,qjd->qj", asked[rows], m[near])
        got[~fresh] = -np.inf
        scored[rows] += fresh.sum(axis=1)
        new_score = np.full((q, near.shape[1]), -np.inf)
        new_pool = np.zeros((q, near.shape[1]), dtype=pool.dtype)
        new_score[rows], new_pool[rows] = got, near
        score = np.concatenate([score, new_score], axis=1)
        pool = np.concatenate([pool, new_pool], axis=1)
        left = np.concatenate([left, ~np.isfinite(new_score)], axis=1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :width]
        score, pool, left = (np.take_along_axis(x, order, axis=1) for x in (score, pool, left))
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(pool, order, axis=1), np.take_along_axis(score, order, axis=1), scored


def _walks(k: int, beam: int, share: float, n_entries: int):
    def run(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if graph.empty or queries.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in HITS.split(", ")])
        graph = graph.sort_values("id", ignore_index=True)
        m = _matrix(graph["vec"])
        number = {x: i for i, x in enumerate(graph["id"])}
        width = max(1, int(graph["neighbours"].map(len).max()))
        links = np.full((len(graph), width), -1)
        for i, near in enumerate(graph["neighbours"]):
            links[i, : len(near)] = [number[x] for x in near]
        # Entry points: evenly spread over the vectors by id.
        entries = np.unique(np.linspace(0, len(graph) - 1, min(n_entries, len(graph))).astype(int))
        queries = queries.sort_values("query_id", ignore_index=True)
        asked = _matrix(queries["vec"])
        ids, names, found = graph["id"].to_numpy(), queries["query_id"].to_numpy(), []
        for at in range(0, len(asked), 256):
            place, score, scored = walk(m, links, asked[at : at + 256], entries, k, beam, share)
            row = np.repeat(np.arange(len(place)), place.shape[1])
            found.append(
                pd.DataFrame(
                    {
                        "query_id": names[at : at + 256][row],
                        "chunk_id": ids[place.ravel()],
                        "vector_similarity": np.round(score.ravel(), 12),
                        "scored": scored[row],
                        "vectors": len(graph),
                    }
                )
            )
        out = pd.concat(found, ignore_index=True)
        return out[np.isfinite(out["vector_similarity"])]

    return run


def graph_search(
    queries: DataFrame, graph: DataFrame, k: int = 10, beam: int = BEAM, share: float = 0.18, entries: int = ENTRIES
) -> DataFrame:
    """query_id, chunk_id, vector_similarity, vector_rank, scored_share: the k best that the walks found.

    queries holds query_id and query_embedding; those without a usable vector give no row. Similarities are exact cosines,
    ties go to the smaller chunk id. scored_share is the largest share of a shard's vectors that was scored for the query.
    Blocks of queries meet the shards in a shuffle; neither is held by the driver.
    """
    usable = searchable_vectors(queries.select("query_id", F.col("query_embedding").alias("embedding")))
    asked = usable.select("query_id", normalise(F.col("embedding")).alias("vec"))
    blocks = max(1, math.ceil(asked.count() / QUERIES_PER_BLOCK))
    shards = (graph.agg(F.max("shard")).first()[0] or 0) + 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = asked.withColumn("block", block).select("*", each(shards).alias("shard"))
    found = (
        graph.select("*", each(blocks).alias("block"))
        .groupBy("shard", "block")
        .cogroup(dealt.groupBy("shard", "block"))
        .applyInPandas(_walks(k, beam, share, entries), HITS)
    )
    mine = Window.partitionBy("query_id")
    order = mine.orderBy(F.desc("vector_similarity"), "chunk_id")
    return (
        found.withColumn("vector_rank", F.row_number().over(order))
        .withColumn("scored_share", F.max(F.col("scored") / F.col("vectors")).over(mine))
        .where(F.col("vector_rank") <= k)
        .select("query_id", "chunk_id", "vector_similarity", "vector_rank", "scored_share")
    )

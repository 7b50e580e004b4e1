"""Rank fusion, dispatch over search types, enrichment of the hits, paging metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.present import author_names
from scholion.operators.asked import Asked, ask, page_of
from scholion.operators.filters import visible_side
from scholion.operators.keyword import keyword_matches, keyword_search, keyword_topk
from scholion.operators.vector_search import candidates, vector_search, vector_topk
from scholion.session import BROADCAST_ROWS, is_bounded, persist_shared, small_side

# Fusion weights and constants.
VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
RANK_OFFSET, MISSING_RANK, FANOUT = 60, 1000, 2
PAGE_SIZE = 10


def fuse(
    vector_hits: DataFrame,
    keyword_hits: DataFrame,
    wv: float = VECTOR_WEIGHT,
    wk: float = KEYWORD_WEIGHT,
    k0: int = RANK_OFFSET,
    miss: int = MISSING_RANK,
) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists per query.

    Both sides hold at most fanout * depth rows per query when they get here.
    """
    v = vector_hits.select(
        "query_id", "chunk_id", F.col("document_id").alias("_vd"), "vector_rank", "vector_similarity"
    )
    w = keyword_hits.select(
        "query_id", "chunk_id", F.col("document_id").alias("_kd"), "keyword_rank"
    )
    joined = v.join(w, ["query_id", "chunk_id"], "full_outer")
    vr = F.coalesce("vector_rank", F.lit(miss))
    kr = F.coalesce("keyword_rank", F.lit(miss))
    return joined.select(
        "query_id",
        "chunk_id",
        F.coalesce("_vd", "_kd").alias("document_id"),
        vr.cast("int").alias("vector_rank"),
        kr.cast("int").alias("keyword_rank"),
        "vector_similarity",
        (F.lit(wv) / (k0 + vr) + F.lit(wk) / (k0 + kr)).alias("score"),
    )


def hybrid_search(
    queries: DataFrame | Asked,
    chunks: DataFrame,
    docs: DataFrame,
    k: int = 10,
    offset: int = 0,
    wv: float = VECTOR_WEIGHT,
    wk: float = KEYWORD_WEIGHT,
    k0: int = RANK_OFFSET,
    miss: int = MISSING_RANK,
    fanout: int = FANOUT,
    article_type_filter: bool = False,
    seen: DataFrame | None = None,
    texts: DataFrame | None = None,
    **keyword_options,
) -> DataFrame:
    """Vector and keyword hits fused by rank, one page per query.

    Each branch keeps its best fanout * (limit + offset) hits. The article type filter is off
    by default: fused search only knows journals and dates. texts are the chunks without their vectors, if
    they can be read apart: the keyword branch then moves no text to meet a vector.
    """
    if not (0 <= wv <= 1 and 0 <= wk <= 1):
        raise ValueError("weights must lie in [0, 1]")
    asked = ask(queries)
    if not article_type_filter and "article_types" in asked.queries.columns:
        asked = asked.without("article_types")
    seen = visible_side(docs) if seen is None else seen
    depth = asked.depth(k, offset)
    v = vector_topk(asked, candidates(chunks, docs, seen), fanout * depth)
    w = keyword_topk(
        keyword_matches(asked, chunks if texts is None else texts, docs, seen=seen, **keyword_options),
        fanout * depth,
    )

    def capped(hits: DataFrame, rank: str) -> DataFrame:
        own = fanout * (F.col("_k") + F.col("_off"))
        return hits.join(asked.limits(k, offset), "query_id").where(F.col(rank) <= own)

    fused = fuse(capped(v, "vector_rank"), capped(w, "keyword_rank"), wv, wk, k0, miss)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = fused.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= depth)
    return page_of(ranked, asked, "_rank", k, offset).drop("_rank")


def search(
    queries: DataFrame | Asked,
    chunks: DataFrame,
    docs: DataFrame,
    k: int = 10,
    offset: int = 0,
    texts: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Each query by its own search_type; an unknown type runs as hybrid. texts as in hybrid_search."""
    asked = ask(queries)
    seen = visible_side(docs)
    kind = F.coalesce(F.lower("search_type"), F.lit("hybrid"))
    nothing = {
        "vector_rank": F.lit(None).cast("int"),
        "keyword_rank": F.lit(None).cast("int"),
        "vector_similarity": F.lit(None).cast("double"),
    }
    cols = ["query_id", "rank", "chunk_id", "document_id", "score", *nothing]

    def of(name: str) -> Asked:
        if name == "hybrid":
            return asked.only(
                ~kind.isin("vector", "keyword"),
                lambda f: ~f["search_type"].str.lower().isin(["vector", "keyword"]),
            )
        return asked.only(kind == name, lambda f: f["search_type"].str.lower() == name)

    def shaped(df: DataFrame, name: str) -> DataFrame:
        full = df.withColumns({c: e for c, e in nothing.items() if c not in df.columns})
        return full.select(*cols).withColumn("search_type", F.lit(name))

    v = vector_search(of("vector"), chunks, docs, k, offset, seen=seen)
    w = keyword_search(of("keyword"), chunks if texts is None else texts, docs, k, offset, seen=seen, **options)
    h = hybrid_search(of("hybrid"), chunks, docs, k, offset, seen=seen, texts=texts, **options)
    return (
        shaped(v, "vector").unionByName(shaped(w, "keyword")).unionByName(shaped(h, "hybrid"))
    )


def _few(hits: DataFrame, max_rows: int | None) -> DataFrame:
    """Hits ready to be broadcast, if there are few of them.

    max_rows is the caller's proof (queries times page size). Without one the hits are written
    to the shared folder once, so that measuring them does not run the search twice.
    """
    if max_rows is not None:
        return F.broadcast(hits) if max_rows <= BROADCAST_ROWS else hits
    return small_side(persist_shared(hits, "hits"))


def _of_hits(rows: DataFrame, hits: DataFrame, key: str, few: bool) -> DataFrame:
    """The rows some hit names, if hits are few: no other one is moved to meet a hit."""
    return rows.join(F.broadcast(hits.select(key)), key, "left_semi") if few else rows


def enrich(
    hits: DataFrame, chunks: DataFrame, docs: DataFrame, max_rows: int | None = None
) -> DataFrame:
    """Hits with chunk text and document columns, joined only after the top-k.

    The hits are stored once, being used three times. Where they are few they are broadcast, and only the
    texts and titles of their chunks and documents are shuffled.
    """
    stored = persist_shared(hits, "hits")
    few = is_bounded(stored) if max_rows is None else max_rows <= BROADCAST_ROWS
    have = [c for c in ("section_title",) if c in chunks.columns]
    text = _of_hits(chunks.select("chunk_id", "content", *have), stored, "chunk_id", few)
    text = text.join(F.broadcast(stored) if few else stored, "chunk_id")
    meta_cols = ["title", "authors", "journal", "publication_date", "doi", "pmcid"]
    meta = docs.select("document_id", *[c for c in meta_cols if c in docs.columns])
    out = text.join(_of_hits(meta, stored, "document_id", few), "document_id")
    if "authors" in meta.columns:
        out = out.withColumn("authors", author_names(F.col("authors")))
    return out


def with_context(hits: DataFrame, chunks: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Text of the chunk before and after each hit, found by the stored links.

    Two passes over the chunk table against few rows: first the links of the hits, then the
    texts of all neighbours at once.
    """
    few = _few(hits, max_rows)
    hint = F.broadcast if max_rows is not None and max_rows <= BROADCAST_ROWS // 2 else (lambda d: d)
    links = chunks.select("chunk_id", "previous_chunk_id", "next_chunk_id").join(
        hint(few.select("chunk_id").distinct()), "chunk_id"
    )
    sides = links.select(
        "chunk_id",
        F.explode(
            F.array(
                F.struct(F.lit("p").alias("side"), F.col("previous_chunk_id").alias("id")),
                F.struct(F.lit("n").alias("side"), F.col("next_chunk_id").alias("id")),
            )
        ).alias("s"),
    ).select("chunk_id", "s.side", F.col("s.id").alias("_id"))
    text = chunks.select(F.col("chunk_id").alias("_id"), F.col("content").alias("_text"))
    found = (
        text.join(hint(sides.where(F.col("_id").isNotNull())), "_id")
        .groupBy("chunk_id")
        .agg(
            F.max(F.when(F.col("side") == "p", F.col("_text"))).alias("previous_chunk"),
            F.max(F.when(F.col("side") == "n", F.col("_text"))).alias("next_chunk"),
        )
    )
    return (
        hits.join(found, "chunk_id", "left")
        .withColumn("context", F.struct("previous_chunk", "next_chunk"))
        .drop("previous_chunk", "next_chunk")
    )


def page_metadata(queries: DataFrame, results: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Per query: rows on the page, strategy, filters in use, and all matches where counted."""
    shown = results.groupBy("query_id").agg(F.count("*").alias("result_count"))
    values = {
        "date_from": F.col("date_from").cast("string"),
        "date_to": F.col("date_to").cast("string"),
        "journals": F.to_json("journals"),
        "article_types": F.to_json("article_types"),
    }
    entries = [x for name, value in values.items() for x in (F.lit(name), value)]
    used = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
    out = (
        queries.select("query_id", F.col("search_type").alias("strategy"), used.alias("filters_applied"))
        .join(shown, "query_id", "left")
        .withColumn("result_count", F.coalesce("result_count", F.lit(0)))
    )
    if totals is not None:
        out = out.join(totals, "query_id", "left").withColumn(
            "total_matches", F.coalesce("total_matches", F.lit(0))
        )
    return out


def page_number_to_offset(page, size: int = PAGE_SIZE):
    return (page - 1) * size


def page_count(total, size: int = PAGE_SIZE):
    return F.ceil(total / F.lit(size))

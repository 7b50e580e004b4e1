"""Visibility, metadata filters, query validation, point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.vectors import norm
from scholion.schemas import SEARCH_TYPES
from scholion.session import small_side

# Request limits.
MAX_SEARCH_CHARS, MAX_CHAT_CHARS, MAX_CHARS = 1000, 2000, 10_000
MAX_LIMIT, MAX_CHAT_CHUNKS, MAX_PAGE = 100, 20, 200

FILTER_COLUMNS = ("date_from", "date_to", "journals", "article_types")


def visible_documents(docs: DataFrame) -> DataFrame:
    """Only completed documents take part in a search."""
    return docs.where(F.col("processing_status") == "completed")


def visible_side(docs: DataFrame) -> DataFrame:
    """Ids and filter columns of the visible documents, broadcast where proven small."""
    return small_side(
        visible_documents(docs).select(
            "document_id", "journal", "article_type", "publication_date"
        )
    )


def searchable_vectors(chunks: DataFrame) -> DataFrame:
    """Chunks with a vector that has a direction."""
    return chunks.where(
        F.col("embedding").isNotNull() & (norm(F.col("embedding").cast("array<double>")) > 0)
    )


def exclude_retracted(docs: DataFrame, enabled: bool = True) -> DataFrame:
    return docs.where(~F.coalesce(F.col("retracted"), F.lit(False))) if enabled else docs


def filter_predicate(
    date_from: Column, date_to: Column, journals: Column, article_types: Column
) -> Column:
    """NULL or an empty list means no filter; a NULL column fails an active filter."""

    def among(values: Column, column: str) -> Column:
        inactive = values.isNull() | (F.size(values) <= 0)
        return inactive | F.coalesce(F.array_contains(values, F.col(column)), F.lit(False))

    day = F.col("publication_date")
    return (
        (date_from.isNull() | F.coalesce(day >= date_from, F.lit(False)))
        & (date_to.isNull() | F.coalesce(day <= date_to, F.lit(False)))
        & among(journals, "journal")
        & among(article_types, "article_type")
    )


def apply_filters(
    docs: DataFrame, date_from=None, date_to=None, journals=None, article_types=None
) -> DataFrame:
    """The same filters for one request with literal values: plain predicates Parquet can use."""
    if date_from is not None:
        docs = docs.where(F.col("publication_date") >= F.lit(date_from))
    if date_to is not None:
        docs = docs.where(F.col("publication_date") <= F.lit(date_to))
    if journals:
        docs = docs.where(F.col("journal").isin(list(journals)))
    if article_types:
        docs = docs.where(F.col("article_type").isin(list(article_types)))
    return docs


def with_filter_columns(queries: DataFrame) -> DataFrame:
    """Queries with every filter column present."""
    kinds = dict(zip(FILTER_COLUMNS, ("date", "date", "array<string>", "array<string>"), strict=True))
    return queries.withColumns(
        {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in queries.columns}
    )


def validate_queries(queries: DataFrame, chat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Queries within the request limits, and the others with a reason.

    An unknown search type becomes hybrid.
    """
    size = F.length(F.coalesce("query_text", F.lit("")))
    cap = MAX_CHAT_CHARS if chat else MAX_SEARCH_CHARS
    top = MAX_CHAT_CHUNKS if chat else MAX_LIMIT
    k = F.col("k")
    off = F.coalesce("off", F.lit(0)) if "off" in queries.columns else F.lit(0)
    reason = (
        F.when(size == 0, F.lit("empty query"))
        .when(size > MAX_CHARS, F.lit("query too long"))
        .when(size > cap, F.lit("query longer than the request model allows"))
        .when(k.isNull() | (k < 1) | (k > top), F.lit("limit out of range"))
        .when(off < 0, F.lit("negative offset"))
    )
    marked = queries.withColumn("reason", reason)
    if "search_type" in queries.columns:
        marked = marked.withColumn(
            "search_type",
            F.when(F.col("search_type").isin(SEARCH_TYPES), F.col("search_type")).otherwise(
                F.lit("hybrid")
            ),
        )
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


# Fixed value: the columns of a document lookup.
DOCUMENT_COLUMNS = [
    "document_id", "title", "abstract", "authors", "journal", "publication_date", "doi", "pmcid",
    "article_type", "processing_status", "quality_score", "created_at", "updated_at",
]


def get_documents(docs: DataFrame, ids: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Metadata of the asked documents."""
    cols = [c for c in (columns or DOCUMENT_COLUMNS) if c in docs.columns]
    asked = ids.select("document_id").distinct()
    return docs.select(*cols).join(small_side(asked), "document_id", "left_semi")


def get_document_chunks(
    chunks: DataFrame, ids: DataFrame | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of chunks per document in index order, with the document's total.

    The total is a pre-combined count; the page is a top-n, so only offset + limit rows per
    document and task are shuffled.
    """
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("limit must be 1..200 and offset >= 0")
    wanted = chunks
    if ids is not None:
        wanted = chunks.join(
            small_side(ids.select("document_id").distinct()), "document_id", "left_semi"
        )
    totals = wanted.groupBy("document_id").agg(F.count("*").alias("total"))
    order = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    page = (
        wanted.select(
            "document_id", "chunk_id", "content", "section_title", "chunk_index", "token_count"
        )
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= offset + limit)
        .where(F.col("position") > offset)
    )
    return page.join(totals, "document_id")

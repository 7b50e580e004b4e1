"""Stored tables: writing, upserting, replacing, cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.session import small_side


def write_table(
    df: DataFrame, path: str, partition_cols: list[str] | None = None, mode: str = "append"
) -> None:
    """Parquet, one directory per partition value.

    The rebalance step lets AQE split a partition value that holds most rows and merge small
    ones, so neither one huge task nor many tiny files result.
    """
    cols = partition_cols or []
    out = df.hint("rebalance", *cols) if cols else df.hint("rebalance")
    writer = out.write.mode(mode)
    if cols:
        writer = writer.partitionBy(*cols)
    writer.parquet(path)


def newest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Newest row of each key; Spark keeps one row per key and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def _without_duplicates(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows that hold their identifier (or have none), and the others with a reason.

    Rows without an identifier, which may be most, take no part in the join.
    """
    named = df.where(F.col(column).isNotNull())
    holders = (
        named.groupBy(column)
        .agg(F.min(F.struct("_new", "created_at", "document_id")).alias("_h"))
        .select(column, F.col("_h.document_id").alias("_holder"))
    )
    checked = named.join(holders, column)
    kept = checked.where(F.col("_holder") == F.col("document_id")).select(*df.columns)
    lost = checked.where(F.col("_holder") != F.col("document_id")).select(*df.columns)
    return (
        kept.unionByName(df.where(F.col(column).isNull())),
        lost.withColumn("reason", F.lit(f"duplicate {column}")),
    )


def unique_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of which no other holds the doi or pmcid, and the others with the reason.

    The stored one (where _new tells) goes before the new one, then the older, then the smaller id.
    """
    marked = docs if "_new" in docs.columns else docs.withColumn("_new", F.lit(False))
    left, no_doi = _without_duplicates(marked, "doi")
    good, no_pmcid = _without_duplicates(left, "pmcid")
    bad = no_doi.unionByName(no_pmcid).select("document_id", "doi", "pmcid", "reason")
    return good.drop("_new"), bad


def upsert_documents(
    existing: DataFrame, incoming: DataFrame, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Merge by document_id; a doi or pmcid held by another document is a conflict.

    An update keeps created_at, adds one attempt and sets updated_at to the time given or else to
    the current one; every other column is taken from the incoming row. Of documents sharing an
    identifier the stored one stays, then the older, then the smaller id; the others are returned
    as conflicts. Pmcids are compared among the documents that dois have left, so that no document
    has to give way to one that is not stored.
    """
    order = "updated_at"
    new = newest_per_key(incoming, "document_id", order)
    e, n = existing.alias("e"), new.alias("n")
    key = F.coalesce("n.document_id", "e.document_id")
    is_new = F.col("e.document_id").isNull()
    changed = F.col("n.document_id").isNotNull()

    def merged(c: str):
        if c == "document_id":
            return key.alias(c)
        if c == "created_at":
            return F.coalesce("e.created_at", "n.created_at").alias(c)
        if c == "processing_attempts":
            old = F.coalesce("e.processing_attempts", F.lit(0))
            return (
                F.when(changed & ~is_new, old + 1)
                .when(is_new, F.coalesce("n.processing_attempts", F.lit(0)))
                .otherwise(old)
                .cast("int")
                .alias(c)
            )
        if c == "updated_at":
            return F.when(changed, F.current_timestamp() if now is None else now).otherwise(
                F.col(f"e.{c}")
            ).cast(existing.schema[c].dataType).alias(c)
        return F.when(changed, F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")).alias(c)

    joined = e.join(n, F.col("e.document_id") == F.col("n.document_id"), "full_outer").select(
        *[merged(c) for c in existing.columns], is_new.alias("_new")
    )
    good, bad = unique_documents(joined)
    return good.select(*existing.columns), bad


def replace_chunks(existing: DataFrame, new: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """All chunks of the reprocessed documents give way to the new ones.

    documents lists the reprocessed ids where some may have yielded no chunk at all.
    """
    ids = (documents if documents is not None else new).select("document_id").distinct()
    return existing.join(small_side(ids), "document_id", "left_anti").unionByName(
        new, allowMissingColumns=True
    )


def delete_documents(
    documents: DataFrame, chunks: DataFrame, jobs: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove documents with their chunks and jobs; links to removed chunks become NULL."""
    gone = small_side(ids.select("document_id").distinct())
    lost = chunks.join(gone, "document_id", "left_semi").select(F.col("chunk_id").alias("_lost"))
    rest = chunks.join(gone, "document_id", "left_anti")
    for link in ("previous_chunk_id", "next_chunk_id"):
        rest = (
            rest.join(lost, F.col(link) == F.col("_lost"), "left")
            .withColumn(link, F.when(F.col("_lost").isNull(), F.col(link)))
            .drop("_lost")
        )
    return (
        documents.join(gone, "document_id", "left_anti"),
        rest.select(*chunks.columns),
        jobs.join(gone, "document_id", "left_anti"),
    )

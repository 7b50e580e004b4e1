"""Statistics, quality scores, audits, corpus selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.operators.filters import get_document_chunks
from scholion.schemas import DOCUMENT_STATUSES, JOB_STATUSES, LENGTH_CAPS
from scholion.session import small_side

# What each quality aspect is worth and when it is fully met.
QUALITY = {"abstract": 0.3, "full_text": 0.3, "sections": (0.2, 5), "references": (0.2, 20)}
PER_TOPIC, TOTAL = 7, 30


def quality_score(
    has_abstract: Column, has_full_text: Column, section_count: Column, reference_count: Column
) -> Column:
    def share(count: Column, aspect: str) -> Column:
        worth, full = QUALITY[aspect]
        return F.least(F.coalesce(count, F.lit(0)) / full, F.lit(1.0)) * worth

    def flag(c: Column, aspect: str) -> Column:
        return F.when(c, F.lit(QUALITY[aspect])).otherwise(F.lit(0.0))

    return F.round(
        flag(has_abstract, "abstract")
        + flag(has_full_text, "full_text")
        + share(section_count, "sections")
        + share(reference_count, "references"),
        2,
    )


def with_quality(docs: DataFrame) -> DataFrame:
    return docs.withColumn(
        "quality_score",
        quality_score(
            F.col("has_abstract"), F.col("has_full_text"), F.col("section_count"), F.col("reference_count")
        ),
    )


def document_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("processing_status").agg(
        F.count("*").alias("count"),
        F.avg("quality_score").alias("avg_quality_score"),
        F.avg("section_count").alias("avg_section_count"),
        F.avg("word_count").alias("avg_word_count"),
    )


def chunk_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per status: chunks, average tokens, embedded chunks; statuses without chunks included.

    Chunks are summed per document before the join, so a document with very many chunks joins
    as one row and no chunk row is shuffled on its document.
    """
    per_doc = chunks.groupBy("document_id").agg(
        F.count("chunk_id").alias("n"),
        F.sum("token_count").alias("tokens"),
        F.count("token_count").alias("counted"),
        F.count_if(F.col("embedding").isNotNull()).alias("embedded"),
    )
    sums = (
        docs.select("document_id", "processing_status")
        .join(per_doc, "document_id", "left")
        .groupBy("processing_status")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "tokens", "counted", "embedded")])
    )
    return sums.select(
        "processing_status",
        F.col("n").alias("total_chunks"),
        F.when(F.col("counted") > 0, F.col("tokens") / F.col("counted")).alias("avg_token_count"),
        F.col("embedded").alias("chunks_with_embeddings"),
    )


def ingestion_metrics(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals; a status nobody is in counts 0; queue depth is the pending count."""

    def status(name: str) -> Column:
        return F.count_if(F.col("processing_status") == name)

    total = chunks.agg(F.count("*")).scalar()
    return docs.agg(
        status("completed").alias("documents_completed"),
        status("failed").alias("documents_failed"),
        status("pending").alias("documents_pending"),
    ).select(
        "*", total.alias("chunks_total"), F.col("documents_pending").alias("queue_depth")
    )


def chunks_by_section(chunks: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Each document's chunks, or one page of them, grouped by section in order of appearance."""
    page = chunks if limit is None else get_document_chunks(chunks, None, limit, offset)
    section = F.coalesce(F.nullif("section_title", F.lit("")), F.lit("Content"))
    return (
        page.groupBy("document_id", section.alias("section"))
        .agg(
            F.min("chunk_index").alias("first_index"),
            F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content"))).alias("chunks"),
        )
    )


def section_totals(chunks: DataFrame) -> DataFrame:
    """The same grouping over all chunks of a document, as counts."""
    section = F.coalesce(F.nullif("section_title", F.lit("")), F.lit("Content"))
    return chunks.groupBy("document_id", section.alias("section")).agg(
        F.min("chunk_index").alias("first_index"),
        F.count("*").alias("chunks"),
        F.sum("token_count").alias("tokens"),
    )


def corpus_summary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    documents = docs.agg(F.count("*")).scalar()
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("embedding").isNotNull()).alias("embedded_chunks"),
        F.sum("token_count").alias("tokens"),
        F.avg("token_count").alias("avg_tokens"),
    ).select(documents.alias("documents"), "*")


def batch_summary(results: DataFrame) -> DataFrame:
    """Outcome of one ingestion batch: successes, failures, chunks made."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum("chunks_created"), F.lit(0)).alias("chunks_created"),
    )


def batch_errors(results: DataFrame) -> DataFrame:
    return results.where(~F.col("success")).select("document_id", "error_message")


def audit(documents: DataFrame, chunks: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Rows that break a constraint of the data model: table, constraint, key.

    Each table is read once for all constraints on single rows and once for all unique columns,
    which are counted in one pre-combined aggregate; the foreign key is an anti join on document ids.
    """

    def broken(df: DataFrame, table: str, key: str, tests: dict[str, Column]) -> DataFrame:
        names = F.array(*[F.when(bad, F.lit(name)) for name, bad in tests.items()])
        return df.select(
            F.col(key).cast("string").alias("row_key"), F.explode(F.array_compact(names)).alias("name")
        ).select(F.lit(table).alias("table_name"), F.col("name").alias("constraint_name"), "row_key")

    def duplicated(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
        values = F.array(
            *[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]
        )
        return (
            df.select(F.explode(values).alias("x"))
            .where(F.col("x.v").isNotNull())
            .groupBy("x.c", "x.v")
            .agg(F.count("*").alias("n"))
            .where("n > 1")
            .select(
                F.lit(table).alias("table_name"),
                F.concat(F.lit("unique "), "c").alias("constraint_name"),
                F.col("v").alias("row_key"),
            )
        )

    have = set(documents.columns)
    tests = {f"not null {c}": F.col(c).isNull() for c in ("title", "object_key") if c in have}
    tests["status domain"] = ~F.col("processing_status").isin(DOCUMENT_STATUSES)
    if "quality_score" in have:
        tests["quality range"] = ~F.col("quality_score").between(0, 1)
    tests |= {f"length {c}": F.length(c) > cap for c, cap in LENGTH_CAPS.items() if c in have}
    orphans = chunks.where(F.col("document_id").isNotNull()).join(
        documents.select("document_id"), "document_id", "left_anti"
    )
    required = ("content", "chunk_index", "document_id")
    checks = [
        broken(documents, "documents", "document_id", tests),
        duplicated(documents, "documents", [c for c in ("document_id", "doi", "pmcid") if c in have]),
        broken(chunks, "chunks", "chunk_id", {f"not null {c}": F.col(c).isNull() for c in required}),
        duplicated(chunks, "chunks", ["chunk_id"]),
        broken(orphans, "chunks", "chunk_id", {"foreign key document_id": F.lit(True)}),
    ]
    if jobs is not None:
        status = ~F.col("status").isin(JOB_STATUSES)
        checks.append(
            broken(jobs, "jobs", "job_id", {"status domain": status, "not null job_type": F.col("job_type").isNull()})
        )
    return reduce(DataFrame.unionByName, checks)


def search_analytics(history: DataFrame) -> DataFrame:
    """Requests, results and latency by search type."""
    return history.groupBy("search_type").agg(
        F.count("*").alias("requests"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.percentile_approx("latency_ms", F.lit([0.5, 0.95, 0.99]), 10000).alias("latency_quantiles"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.avg("result_count").alias("avg_results"),
        F.count_if(F.col("result_count") == 0).alias("empty_results"),
    )


def select_corpus(
    topic_hits: DataFrame, per_topic: int = PER_TOPIC, total: int = TOTAL
) -> DataFrame:
    """Best per_topic hits of each topic, distinct ids in (topic, rank) order, total at most.

    Both cuts are top-n: tasks pass on at most that many rows.
    """
    order = Window.partitionBy("topic").orderBy("rank", "id")
    best = topic_hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_topic)
    first = best.groupBy("id").agg(F.min(F.struct("topic", "_r")).alias("f"))
    return (
        first.select("id", F.col("f.topic").alias("topic"), F.col("f._r").alias("topic_rank"))
        .orderBy("topic", "topic_rank", "id")
        .limit(total)
    )

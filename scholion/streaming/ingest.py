"""Incremental ingest: arriving files become documents, chunks, references and job rows.

Every table is written as one partition per micro-batch, which a repeated batch overwrites, so
the job is idempotent and no batch rewrites older data. Readers take the newest version of
each document (current_documents, current_chunks).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholion.operators import articles as ar
from scholion.operators import chunking as ch
from scholion.operators import embedding as em
from scholion.operators import plaintext as pt
from scholion.operators import routing as rt
from scholion.operators.jobs import STEPS
from scholion.operators.stats import with_quality
from scholion.session import scratch_path
from scholion.sources.current import merge_batch, read_current
from scholion.sources.raw import to_archive
from scholion.sources.tables import newest_per_key, unique_documents

RAW_SCHEMA = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"
Embed = Callable[[DataFrame], DataFrame]


def default_embed(chunks: DataFrame) -> DataFrame:
    return em.stamp(em.hashing_embed(chunks, "content"), em.HASHING_MODEL_ID)


def _write(df: DataFrame, base: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{base}/{table}/batch_id={batch_id}")


def _job_events(rows: DataFrame, failed: bool) -> DataFrame:
    """What a job goes through, in order: pending, each step being worked on, then its end."""

    def event(seq: int, status: str, step: str | None, done: int, error: Column) -> Column:
        return F.struct(
            F.lit(seq).alias("seq"), F.lit(status).alias("status"),
            F.lit(step).cast("string").alias("current_step"), F.lit(done).alias("completed_steps"),
            error.cast("string").alias("error_message"),
        )

    none = F.lit(None)
    reached = STEPS[:2] if failed else STEPS
    events = [event(0, "pending", None, 0, none)]
    events += [event(k + 1, "processing", step, k, none) for k, step in enumerate(reached)]
    last = len(reached) + 1
    if failed:
        events.append(event(last, "failed", reached[-1], len(reached) - 1, F.col("reason")))
    else:
        events.append(event(last, "completed", None, len(STEPS), none))
    return rows.select("document_id", F.explode(F.array(*events)).alias("e")).select(
        F.col("document_id").alias("job_id"), "document_id", "e.*",
        F.lit(len(STEPS)).alias("total_steps"), F.current_timestamp().alias("ts"),
    )


def _store(
    good: DataFrame, bad: DataFrame, base: str, batch_id: int, embed: Embed, max_tokens: int, overlap: int
) -> None:
    """Write one batch of parsed documents and of quarantine rows, each table as one partition."""
    now = F.current_timestamp()
    documents = with_quality(good).select(
        "document_id", "object_key", "title", "abstract", "authors", "journal", "publication_date",
        "doi", "pmcid", "pmid", "mesh_terms", "keywords", "article_type", "has_abstract",
        "has_full_text", "section_count", "reference_count", "word_count", "quality_score",
        F.lit("completed").alias("processing_status"), now.alias("processed_at"),
    )
    _write(documents, base, "documents", batch_id)
    _write(ar.reference_rows(good), base, "references", batch_id)
    _write(bad, base, "quarantine", batch_id)
    _write(embed(ch.chunk_documents(good, max_tokens, overlap)), base, "chunks", batch_id)
    done = _job_events(good.select("document_id"), failed=False)
    failed = _job_events(bad.select(F.col("object_key").alias("document_id"), "reason"), failed=True)
    _write(done.unionByName(failed), base, "job_events", batch_id)


def ingest_batch(
    raw: DataFrame,
    base: str,
    batch_id: int,
    embed: Embed = default_embed,
    max_tokens: int = ch.MAX_TOKENS,
    overlap: int = ch.OVERLAP_TOKENS,
    parser: Callable[[DataFrame], DataFrame] = ar.parse_articles,
) -> None:
    """Fetch, parse, chunk, embed, archive and store one batch of (object_key, content) rows."""
    known = F.col("object_key")
    tagged = raw.select("object_key", "content", rt.sniff_format(F.col("content"), known).alias("format"))
    xml = tagged.where(F.col("format") == "article_xml").select("object_key", "content")
    # Parsed once, written once, below the output and overwritten if the batch is repeated.
    _write(parser(xml), base, "parsed", batch_id)
    parsed = raw.sparkSession.read.parquet(f"{base}/parsed/batch_id={batch_id}")
    good, bad = rt.split_valid(parsed)
    unmatched = tagged.where(~F.col("format").eqNullSafe("article_xml")).select(
        "object_key",
        F.lit("no parser takes this object").alias("reason"),
        rt.preview(F.col("content")).alias("preview"),
    )
    _, unread = rt.split_valid(unmatched)
    _store(good, bad.unionByName(unread), base, batch_id, embed, max_tokens, overlap)
    # A file is archived once, under the first of its documents.
    owners = good.groupBy("object_key").agg(F.min("document_id").alias("document_id"))
    kept = raw.select("object_key", "content").join(owners, "object_key").drop("object_key")
    _write(to_archive(kept), base, "archive", batch_id)


def ingest_pages(
    pages: DataFrame,
    base: str,
    batch_id: int,
    meta: DataFrame | None = None,
    embed: Embed = default_embed,
    max_tokens: int = ch.MAX_TOKENS,
    overlap: int = ch.OVERLAP_TOKENS,
) -> None:
    """The same for one batch of page texts (document_id, page_no, text)."""
    parsed = pt.parse_pages(pages, meta).withColumn("object_key", F.col("document_id"))
    named = F.transform(
        "references",
        lambda r: F.struct(
            *[
                (r[f] if f in ("id", "year", "doi", "raw") else F.lit(None).cast("string")).alias(f)
                for f in ("id", "type", "title", "source", "year", "volume", "fpage", "lpage", "doi", "raw")
            ]
        ),
    )
    _write(parsed.withColumn("references", named), base, "parsed", batch_id)
    good = pages.sparkSession.read.parquet(f"{base}/parsed/batch_id={batch_id}")
    empty = pt.empty_documents(pages, good).select(
        F.col("document_id").alias("object_key"), "reason", F.lit("").alias("preview")
    )
    _store(good, rt.split_valid(empty)[1], base, batch_id, embed, max_tokens, overlap)


def ingest_stream(
    spark: SparkSession,
    in_path: str,
    base: str,
    checkpoint: str | None = None,
    files_per_batch: int = 10_000,
    **options,
) -> StreamingQuery:
    """Start ingesting all files available below in_path; the caller awaits the query."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(RAW_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(in_path)
        .select(F.col("path").alias("object_key"), "content")
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, base, batch_id, **options)

    return (
        files.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "ingest-state"))
        .trigger(availableNow=True)
        .start()
    )


def read_versions(spark: SparkSession, base: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{table}")


def _newest(spark: SparkSession, base: str) -> DataFrame:
    """Newest version of each document, with its number of versions and its first batch."""
    all_versions = read_versions(spark, base, "documents")
    known = all_versions.groupBy("document_id").agg(
        F.count("*").cast("int").alias("processing_attempts"), F.min("batch_id").alias("created_at")
    )
    return newest_per_key(all_versions, "document_id", "batch_id").join(known, "document_id")


def current_documents(spark: SparkSession, base: str) -> DataFrame:
    """Newest version of each document, with how often it was processed. Of documents with one doi
    or pmcid the one that came first stays (see document_conflicts)."""
    return unique_documents(_newest(spark, base))[0]


def document_conflicts(spark: SparkSession, base: str) -> DataFrame:
    """Documents whose doi or pmcid an earlier one holds, with the reason."""
    return unique_documents(_newest(spark, base))[1]


def current_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Chunks of the current documents' newest versions: older ones are replaced as a whole."""
    last = current_documents(spark, base).select("document_id", "batch_id")
    return read_versions(spark, base, "chunks").join(
        last, ["document_id", "batch_id"], "left_semi"
    )


def merge_documents(spark: SparkSession, base: str, batch_id: int) -> bool:
    """Take a stored batch into the table of current documents; False if it was taken in before.

    To be called after ingest_batch or ingest_pages, batch by batch; stored_documents then reads one version of
    each document, however many batches there were.
    """
    rows = spark.read.parquet(f"{base}/documents/batch_id={batch_id}")
    return merge_batch(rows, f"{base}/current_documents", "document_id", batch_id)


def stored_documents(spark: SparkSession, base: str) -> DataFrame:
    """What current_documents gives, of the batches that were merged."""
    return unique_documents(read_current(spark, f"{base}/current_documents"))[0]

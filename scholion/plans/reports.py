"""Statistics over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.operators import stats as st
from scholion.plans.base import (
    CHUNKS,
    DESCRIBED,
    DOCS,
    QUALITY_SQL,
    Registry,
    chunks,
    described,
    documents,
    rounded,
    table,
    with_sql,
    words_sql,
)
from scholion.plans.chunks import pack_sql, stored
from scholion.functions.text import word_count

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def scored(spark, sf):
    return st.with_quality(described(documents(spark, sf)))


def sized(spark, sf):
    return chunks(spark, sf).withColumn("token_count", word_count("content"))


SCORED = f"scored AS (SELECT *, {QUALITY_SQL} AS quality_score FROM described)"
SIZED = f"sized AS (SELECT *, len({words_sql('content')}) AS token_count FROM chunks)"


@R.add("g4_quality_score", with_sql(DOCS, DESCRIBED, SCORED, select="SELECT document_id, quality_score FROM scored"))
def g4(spark, sf):
    return scored(spark, sf).select("document_id", "quality_score")


@R.add(
    "g1_document_stats",
    with_sql(
        DOCS, DESCRIBED, SCORED,
        select="""SELECT processing_status, count(*) AS count, round(avg(quality_score), 6) AS avg_quality_score,
  round(avg(section_count), 6) AS avg_section_count, round(avg(word_count), 6) AS avg_word_count FROM scored GROUP BY 1""",
    ),
)
def g1(spark, sf):
    return st.document_stats(scored(spark, sf)).select(
        "processing_status", "count", rounded("avg_quality_score"), rounded("avg_section_count"), rounded("avg_word_count")
    )


@R.add(
    "g2_chunk_stats",
    with_sql(
        DOCS, CHUNKS, SIZED,
        select="""SELECT d.processing_status, count(c.chunk_id) AS total_chunks, round(avg(c.token_count), 6) AS avg_token_count,
  count(c.embedding) AS chunks_with_embeddings FROM docs d LEFT JOIN sized c ON d.document_id = c.document_id GROUP BY 1""",
    ),
)
def g2(spark, sf):
    return st.chunk_stats(documents(spark, sf), sized(spark, sf)).select(
        "processing_status", "total_chunks", rounded("avg_token_count"), "chunks_with_embeddings"
    )


@R.add(
    "g3_ingestion_metrics",
    with_sql(
        DOCS,
        select="""SELECT count(*) FILTER (processing_status = 'completed') AS documents_completed,
  count(*) FILTER (processing_status = 'failed') AS documents_failed, count(*) FILTER (processing_status = 'pending') AS documents_pending,
  (SELECT count(*) FROM documents) AS chunks_total, count(*) FILTER (processing_status = 'pending') AS queue_depth FROM docs""",
    ),
)
def g3(spark, sf):
    return st.ingestion_metrics(documents(spark, sf), chunks(spark, sf))


def titled_chunks(spark, sf):
    """Packed chunks under section titles A, B or none, by turns."""
    i = F.col("chunk_index") % 3
    return stored(spark, sf).withColumn("section_title", F.when(i == 0, "A").when(i == 1, "B"))


SECTION = "CASE chunk_index % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'Content' END"


@R.add(
    "g5_chunks_by_section",
    pack_sql(
        f"""SELECT document_id, {SECTION} AS section, CAST(min(chunk_index) AS INTEGER) AS first_index,
      string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY chunk_index) AS members FROM chunked GROUP BY ALL"""
    ),
)
def g5(spark, sf):
    out = st.chunks_by_section(titled_chunks(spark, sf))
    members = F.transform("chunks", lambda c: c["chunk_index"].cast("string"))
    return out.select("document_id", "section", "first_index", F.array_join(members, ",").alias("members"))


@R.add(
    "g5_section_totals",
    pack_sql(
        f"""SELECT document_id, {SECTION} AS section, CAST(min(chunk_index) AS INTEGER) AS first_index, count(*) AS chunks,
      sum(len({words_sql('content')}))::BIGINT AS tokens FROM chunked GROUP BY ALL"""
    ),
)
def g5_totals(spark, sf):
    return st.section_totals(titled_chunks(spark, sf))


@R.add(
    "g6_corpus_summary",
    with_sql(
        CHUNKS, SIZED,
        select="""SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks, count(embedding) AS embedded_chunks,
  sum(token_count)::BIGINT AS tokens, round(avg(token_count), 6) AS avg_tokens FROM sized""",
    ),
)
def g6(spark, sf):
    return st.corpus_summary(documents(spark, sf), sized(spark, sf)).select(
        "documents", "chunks", "embedded_chunks", "tokens", rounded("avg_tokens")
    )


def outcomes(spark, sf):
    i = F.col("doc_id")
    return documents(spark, sf).select(
        "document_id", (F.col("processing_status") == "completed").alias("success"),
        F.when(F.col("processing_status") == "completed", i % 9).otherwise(0).alias("chunks_created"),
        F.when(F.col("processing_status") != "completed", F.concat(F.lit("not done: "), "processing_status")).alias("error_message"),
    )


@R.add(
    "g7_batch_summary",
    with_sql(
        DOCS,
        select="""SELECT count(*) AS total, count(*) FILTER (processing_status = 'completed') AS succeeded,
  count(*) FILTER (processing_status <> 'completed') AS failed,
  sum(CASE WHEN processing_status = 'completed' THEN doc_id % 9 ELSE 0 END)::BIGINT AS chunks_created FROM docs""",
    ),
)
def g7(spark, sf):
    return st.batch_summary(outcomes(spark, sf))


@R.add(
    "g7_batch_errors",
    with_sql(DOCS, select="SELECT document_id, 'not done: ' || processing_status AS error_message FROM docs WHERE processing_status <> 'completed'"),
)
def g7_errors(spark, sf):
    return st.batch_errors(outcomes(spark, sf))


@R.add(
    "g13_select_corpus",
    """WITH t AS (SELECT source AS topic, doc_id AS rank, sha256(text) AS id FROM documents),
    b AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY rank, id) AS r FROM t QUALIFY r <= 7),
    f AS (SELECT id, min({'t': topic, 'r': r}) AS f FROM b GROUP BY id)
    SELECT id, f.t AS topic, CAST(f.r AS INTEGER) AS topic_rank FROM f ORDER BY topic, topic_rank, id LIMIT 30""",
)
def g13(spark, sf):
    """Topics are the sources; equal texts are one paper."""
    hits = table(spark, sf, "documents").select(
        F.col("source").alias("topic"), F.col("doc_id").alias("rank"), F.sha2("text", 256).alias("id")
    )
    return st.select_corpus(hits)

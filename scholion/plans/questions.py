"""Question contexts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.operators import context as cx
from scholion.operators import hybrid
from scholion.operators.asked import ask
from scholion.plans.base import Registry, chunk_texts, chunks, document_texts, documents, hybrid_ctes, requests, rounded, table, with_sql
from scholion.plans.chunks import pack_sql, stored
from scholion.plans.search import TITLE_SQL, titled

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def results(spark, sf, asking=requests):
    """Fused hits of every request with text and document columns."""
    asked = ask(asking(spark, sf))
    texts = chunk_texts(spark, sf)
    hits = hybrid.hybrid_search(asked, chunks(spark, sf), documents(spark, sf), texts=texts)
    most = None if asked.frame is None else 5 * len(asked.frame)
    rows = hybrid.enrich(hits, texts, titled(document_texts(spark, sf)), most)
    return asked, rows.withColumn("section_title", F.lit(None).cast("string")).withColumn(
        "pmcid", F.lit(None).cast("string")
    )


RES = f"""res AS (SELECT h.query_id, h.rank, h.chunk_id, h.document_id, h.score, c.content, {TITLE_SQL} AS title,
    '10.1234/' || d.document_id AS doi
  FROM hyb h JOIN chunks c ON h.chunk_id = c.chunk_id JOIN docs d ON h.document_id = d.document_id)"""
CTX = RES + """,
ctx AS (SELECT query_id, string_agg('Source [' || rank || ']: ' || title || ' (DOI: ' || doi || ')' || chr(10) || content,
    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context,
    string_agg(rank || '=' || chunk_id || '@' || doi, ';' ORDER BY rank) AS citations, CAST(count(*) AS INTEGER) AS chunks_used,
    least(greatest(avg(score) * 0.5::DOUBLE + least(count(DISTINCT document_id) / 3.0::DOUBLE, 1) * 0.3::DOUBLE
      + least(count(*) / 5.0::DOUBLE, 1) * 0.2::DOUBLE, 0), 1) AS confidence
  FROM res GROUP BY query_id)"""


@R.add(
    "r1_context",
    with_sql(*hybrid_ctes(), CTX, select="SELECT query_id, context, chunks_used FROM ctx"),
)
def r1(spark, sf, asking=requests):
    return cx.build_context(results(spark, sf, asking)[1]).select("query_id", "context", "chunks_used")


@R.add(
    "r2_citations",
    with_sql(*hybrid_ctes(), CTX, select="SELECT query_id, citations FROM ctx"),
)
def r2(spark, sf, asking=requests):
    flat = F.transform(
        "citations",
        lambda c: F.concat(c["number"].cast("string"), F.lit("="), c["chunk_id"], F.lit("@"), c["doi"]),
    )
    return cx.build_context(results(spark, sf, asking)[1]).select(
        "query_id", F.array_join(flat, ";").alias("citations")
    )


LAST_TURN = """last_turn AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id)"""


@R.add(
    "r3_prompt_history",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    SELECT conv_id, string_agg(upper(role[1]) || lower(role[2:]) || ': ' || text, chr(10) ORDER BY turn) AS history
    FROM r WHERE back BETWEEN 2 AND 6 GROUP BY conv_id""",
)
def r3(spark, sf):
    return cx.history_text(cx.recent_turns(table(spark, sf, "conversations")))


@R.add(
    "r4_recent_turns",
    """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
      FROM conversations) WHERE back BETWEEN 2 AND 10""",
)
def r4(spark, sf):
    return cx.recent_turns(table(spark, sf, "conversations")).select("conv_id", "turn", "role")


@R.add(
    "r5_confidence",
    with_sql(*hybrid_ctes(), CTX, select="SELECT query_id, round(confidence, 6) AS confidence FROM ctx"),
)
def r5(spark, sf, asking=requests):
    texts = chunk_texts(spark, sf)
    hits = hybrid.hybrid_search(asking(spark, sf), chunks(spark, sf), documents(spark, sf), texts=texts)
    return cx.confidence(hits).select("query_id", rounded("confidence"))


@R.add(
    "r7_rag_requests",
    with_sql(
        *hybrid_ctes(), CTX,
        """hist AS (SELECT conv_id, string_agg(upper(role[1]) || lower(role[2:]) || ': ' || text, chr(10) ORDER BY turn) AS history
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    WHERE back BETWEEN 2 AND 6 GROUP BY conv_id)""",
        select="""SELECT q.query_id, CASE WHEN context IS NOT NULL THEN
    coalesce('Previous conversation:' || chr(10) || history || chr(10) || chr(10), '')
    || 'Research paper excerpts:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query_text || chr(10) || chr(10)
    || 'Please answer the question based on the provided excerpts. Include citation numbers [1], [2], etc. for any claims you make.' END AS prompt,
  CASE WHEN context IS NULL THEN 'I couldn''t find any relevant information in the knowledge base to answer your question.' END AS answer,
  round(coalesce(confidence, 0), 6) AS confidence, coalesce(chunks_used, 0) AS chunks_used,
  CASE WHEN context IS NOT NULL AND q.item_id % 2 = 0 THEN 'complex' ELSE 'simple' END AS model
FROM requests q LEFT JOIN ctx USING (query_id) LEFT JOIN hist ON hist.conv_id = q.item_id""",
    ),
)
def r7(spark, sf, asking=requests):
    """Every request in the conversation of the same number, with its recent turns."""
    asked, rows = results(spark, sf, asking)
    q = asked.queries.withColumn("conv_id", F.col("item_id")).withColumn(
        "use_complex_model", F.col("item_id") % 2 == 0
    )
    history = cx.history_text(cx.recent_turns(table(spark, sf, "conversations")))
    return cx.rag_requests(q, rows, history).select(
        "query_id", "prompt", "answer", rounded("confidence"), "chunks_used", "model"
    )


@R.add(
    "r6_empty_fallback",
    """SELECT CAST(item_id AS VARCHAR) AS query_id, 'I couldn''t find any relevant information in the knowledge base to answer your question.' AS answer,
      0.0::DOUBLE AS confidence, 0 AS chunks_used FROM benchmark""",
)
def r6(spark, sf, asking=requests):
    """All requests against a corpus none of which is visible."""
    q = asking(spark, sf)
    hidden = documents(spark, sf).withColumn("processing_status", F.lit("pending"))
    texts = chunk_texts(spark, sf)
    hits = hybrid.hybrid_search(q, chunks(spark, sf), hidden, texts=texts)
    rows = hybrid.enrich(hits, texts, titled(document_texts(spark, sf)), 0).withColumns(
        {"section_title": F.lit(None).cast("string"), "pmcid": F.lit(None).cast("string")}
    )
    return cx.rag_requests(q, rows).select("query_id", "answer", "confidence", "chunks_used")


@R.add(
    "q12_neighbour_context",
    pack_sql(
        """SELECT chunk_id, md5(p) AS previous_digest, md5(nx) AS next_digest FROM (
      SELECT sha256(document_id || '|' || chunk_index) AS chunk_id, content,
        lag(content) OVER o AS p, lead(content) OVER o AS nx
      FROM chunked WINDOW o AS (PARTITION BY document_id ORDER BY chunk_index))
    WHERE contains(lower(content), 'license')"""
    ),
)
def q12(spark, sf):
    """Chunks naming a license, with the chunk before and after."""
    c = stored(spark, sf)
    hits = c.where(F.lower("content").contains("license")).select("chunk_id")
    out = hybrid.with_context(hits, c)
    return out.select(
        "chunk_id", F.md5("context.previous_chunk").alias("previous_digest"),
        F.md5("context.next_chunk").alias("next_digest"),
    )

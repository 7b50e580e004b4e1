"""Scans, sinks and table maintenance over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.operators import filters as flt
from scholion.operators import jobs as jb
from scholion.operators import stats as st
from scholion.plans.base import CHUNKS, DOCS, Registry, chunks, documents, table, with_sql
from scholion.plans.chunks import pack_sql, packed, stored
from scholion.session import scratch_path
from scholion.sources import raw as rw
from scholion.sources import tables as tb
from scholion.sources.articles import read_articles
from scholion.sources.current import merge_batch, read_current

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add(
    "s1_raw_scan",
    "SELECT sum(strlen(text) + 1)::BIGINT AS bytes, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents",
)
def s1_scan(spark, sf):
    """Texts written out as files of a bounded number of lines and scanned back as raw objects."""
    path = scratch_path(spark, "raw")
    rows = table(spark, sf, "documents").select("text")
    rows.write.option("maxRecordsPerFile", 1000).text(path)
    objects = rw.read_raw(spark, path, "*.txt")
    newlines = F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))
    return objects.select("length", F.col("content").cast("string").alias("t")).agg(
        F.sum("length").alias("bytes"), F.sum(newlines).cast("long").alias("lines")
    )


@R.add(
    "s2_list_objects",
    "SELECT source || '/' || doc_id || '.txt' AS object_key, strlen(text) AS length FROM documents WHERE starts_with(source, 'src1')",
)
def s2(spark, sf):
    """Keys below a prefix in a table of objects: one per document, in its source's folder."""
    raw = table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("object_key"),
        F.lit(None).cast("timestamp").alias("modified_at"),
        F.octet_length("text").cast("long").alias("length"),
    )
    return rw.list_objects(raw, "src1").select("object_key", "length")


@R.add(
    "s2_object_exists",
    """SELECT 'documents/' || doc_id || '.xml' AS object_key, doc_id IN (SELECT doc_id FROM labels) AS found FROM documents""",
)
def s2_exists(spark, sf):
    key = rw.archive_key(F.col("doc_id").cast("string")).alias("object_key")
    have = table(spark, sf, "labels").select(
        key, F.current_timestamp().alias("modified_at"), F.col("doc_id").alias("length")
    )
    return rw.object_exists(have, table(spark, sf, "documents").select(key)).select("object_key", "found")


@R.add(
    "s3_article_scan",
    """SELECT '10.1234/' || doc_id AS doi, lang AS article_type, source AS journal,
      len(string_split(text, chr(10))) AS paragraphs FROM documents""",
)
def s3(spark, sf):
    """Article files, written by Spark's XML sink, scanned one row per article element."""
    path = scratch_path(spark, "articles")
    num = F.col("doc_id").cast("string")
    ids = F.array(
        *[
            F.struct(F.lit(kind).alias("_pub-id-type"), value.alias("_VALUE"))
            for kind, value in (("pmid", num), ("doi", F.concat(F.lit("10.1234/"), num)))
        ]
    )
    journal = F.struct(F.struct(F.col("source").alias("journal-title")).alias("journal-title-group"))
    front = F.struct(journal.alias("journal-meta"), F.struct(ids.alias("article-id")).alias("article-meta"))
    body = F.struct(F.array(F.struct(F.lit("Text").alias("title"), F.split("text", "\n").alias("p"))).alias("sec"))
    table(spark, sf, "documents").select(
        F.col("lang").alias("_article-type"), front.alias("front"), body.alias("body")
    ).write.format("xml").option("rootTag", "articles").option("rowTag", "article").save(path)
    a = read_articles(spark, path)
    meta = F.col("front")["article-meta"]
    return a.select(
        F.element_at(F.filter(meta["article-id"], lambda x: x["_pub-id-type"] == "doi"), 1)["_VALUE"].alias("doi"),
        F.col("_article-type").alias("article_type"),
        F.col("front")["journal-meta"]["journal-title-group"]["journal-title"].alias("journal"),
        F.size(F.col("body.sec")[0]["p"]).cast("long").alias("paragraphs"),
    )


@R.add("s4_fetched_pages", "SELECT url AS source_url, sha256(html) AS digest FROM pages")
def s4(spark, sf):
    return rw.read_pages(spark, f"{sf}/pages.parquet").select("source_url", F.sha2("content", 256).alias("digest"))


@R.add(
    "s6_written_table",
    with_sql(DOCS, select="SELECT processing_status, count(*) AS n, sum(length(text))::BIGINT AS chars FROM docs GROUP BY 1"),
)
def s6(spark, sf):
    path = scratch_path(spark, "documents")
    tb.write_table(documents(spark, sf), path, ["processing_status"])
    back = spark.read.parquet(path)
    return back.groupBy("processing_status").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")
    )


@R.add(
    "s7_archive",
    """SELECT 'documents/' || doc_id || '.xml' AS object_key, 'application/xml' AS content_type, CAST(doc_id AS VARCHAR) AS document_id,
      md5(text) AS digest FROM documents""",
)
def s7(spark, sf):
    """Archive the labelled documents first, then all: only missing ones are added."""
    path = scratch_path(spark, "archive")
    d = table(spark, sf, "documents")
    key = F.col("doc_id").cast("string").alias("document_id")
    rw.archive_raw(
        d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(key, F.col("text").alias("content")), path
    )
    rw.archive_raw(d.select(key, F.col("text").alias("content")), path)
    return spark.read.parquet(path).select(
        "object_key", "content_type", F.element_at("metadata", "document_id").alias("document_id"),
        F.md5("content").alias("digest"),
    )


def job_rows(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").cast("string").alias("job_id"),
        F.col("user_id").cast("string").alias("document_id"),
        F.lit("ingestion").alias("job_type"),
    )


@R.add(
    "s8_cascade_delete",
    pack_sql(
        """SELECT 'chunk' AS kind, sha256(document_id || '|' || chunk_index) AS id FROM chunked
      WHERE document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)
    UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
    UNION ALL SELECT 'job', CAST(event_id AS VARCHAR) FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
    ),
)
def s8(spark, sf):
    """Delete the toxic documents with their chunks and jobs."""
    ids = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    d, c, j = tb.delete_documents(documents(spark, sf), stored(spark, sf), job_rows(spark, sf), ids)
    part = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return part(c, "chunk", "chunk_id").unionByName(part(d, "document", "document_id")).unionByName(part(j, "job", "job_id"))


def _versions(spark, sf, offset):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + i + offset)
    return d.select(
        i.cast("string").alias("document_id"),
        F.concat(F.lit(f"v{offset} "), i.cast("string")).alias("title"),
        F.when(i % 5 != 0, F.concat(F.lit("10.1/"), (i % 150).cast("string"))).alias("doi"),
        F.when(i % 7 != 0, F.concat(F.lit("PMC"), (i % 120).cast("string"))).alias("pmcid"),
        F.lit(offset).alias("processing_attempts"),
        at.alias("created_at"),
        at.alias("updated_at"),
        i.alias("doc_id"),
    )


UPSERT_SQL = """WITH e AS (SELECT doc_id, 'v0 ' || doc_id AS title, 0 AS a, doc_id AS created FROM documents WHERE doc_id % 3 <> 0),
    n AS (SELECT doc_id, 'v9 ' || doc_id AS title, 9 AS a, doc_id + 9 AS created FROM documents WHERE doc_id % 2 = 0),
    m AS (SELECT coalesce(n.doc_id, e.doc_id) AS doc_id, coalesce(n.title, e.title) AS title,
        CASE WHEN n.doc_id IS NULL THEN e.a WHEN e.doc_id IS NULL THEN n.a ELSE e.a + 1 END AS attempts,
        e.doc_id IS NULL AS is_new, coalesce(e.created, n.created) AS created
      FROM e FULL OUTER JOIN n ON e.doc_id = n.doc_id),
    r AS (SELECT *, CASE WHEN doc_id % 5 <> 0 THEN '10.1/' || doc_id % 150 END AS doi, CASE WHEN doc_id % 7 <> 0 THEN 'PMC' || doc_id % 120 END AS pmcid,
        CASE WHEN doc_id % 5 = 0 THEN 1 ELSE row_number() OVER (PARTITION BY doc_id % 5 = 0, doc_id % 150
          ORDER BY is_new, created, CAST(doc_id AS VARCHAR)) END AS rn FROM m),
    q AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE row_number() OVER (PARTITION BY doc_id % 7 = 0, doc_id % 120
          ORDER BY is_new, created, CAST(doc_id AS VARCHAR)) END AS pn FROM r WHERE rn = 1)"""


def _upserted(spark, sf):
    old = _versions(spark, sf, 0).where("doc_id % 3 <> 0").drop("doc_id")
    new = _versions(spark, sf, 9).where("doc_id % 2 = 0").drop("doc_id")
    late = new.withColumn("title", F.lit("stale")).withColumn("updated_at", F.lit("2001-01-01").cast("timestamp"))
    return tb.upsert_documents(old, new.unionByName(late))


@R.add(
    "s9_upsert",
    UPSERT_SQL + " SELECT CAST(doc_id AS VARCHAR) AS document_id, title, CAST(attempts AS INTEGER) AS processing_attempts, is_new OR attempts = 1 AS touched FROM q WHERE pn = 1",
)
def s9(spark, sf):
    """Stored documents meet newer versions; dois and pmcids are shared by many or missing."""
    return _upserted(spark, sf)[0].select(
        "document_id", "title", "processing_attempts", (F.col("updated_at") > "2024-06-01").alias("touched")
    )


@R.add(
    "s9_upsert_conflicts",
    UPSERT_SQL + """ SELECT CAST(doc_id AS VARCHAR) AS document_id, doi, pmcid, 'duplicate doi' AS reason FROM r WHERE rn > 1
      UNION ALL SELECT CAST(doc_id AS VARCHAR), doi, pmcid, 'duplicate pmcid' FROM q WHERE pn > 1""",
)
def s9_conflicts(spark, sf):
    return _upserted(spark, sf)[1].select("document_id", "doi", "pmcid", "reason")


@R.add(
    "s10_replace_chunks",
    pack_sql(
        """SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(content) AS digest FROM chunked
      WHERE document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)
    UNION ALL SELECT CAST(d.doc_id AS VARCHAR), 0, md5(d.text) FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
    ),
)
def s10(spark, sf):
    """Labelled documents are reprocessed into one chunk each."""
    d = table(spark, sf, "documents")
    new = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id").select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content")
    )
    old = packed(spark, sf).select("document_id", "chunk_index", "content")
    return tb.replace_chunks(old, new).select("document_id", "chunk_index", F.md5("content").alias("digest"))


@R.add(
    "f4_documents_by_id",
    with_sql(DOCS, select="SELECT document_id, journal, article_type, processing_status FROM docs WHERE document_id IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark)"),
)
def f4(spark, sf):
    ids = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("document_id"))
    return flt.get_documents(documents(spark, sf), ids).select("document_id", "journal", "article_type", "processing_status")


@R.add(
    "f5_document_chunks_page",
    pack_sql(
        """SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index, n AS total, md5(content) AS digest FROM chunked
      WHERE chunk_index >= 2 AND chunk_index < 7"""
    ),
)
def f5(spark, sf):
    return flt.get_document_chunks(stored(spark, sf), None, 5, 2).select(
        "document_id", "chunk_index", "total", F.md5("content").alias("digest")
    )


@R.add("f6_not_retracted", "SELECT doc_id FROM labels WHERE toxic = 0")
def f6(spark, sf):
    l = table(spark, sf, "labels").withColumn("retracted", F.col("toxic") == 1)  # noqa: E741
    return flt.exclude_retracted(l).select("doc_id")


@R.add(
    "f14_allowed_paths",
    """SELECT event_id FROM events WHERE event_type IN ('view', 'click')""",
)
def f14(spark, sf):
    """Paths below an allowed folder, beside it, and leaving it again."""
    kind = F.col("event_type")
    path = (
        F.when(kind == "view", "/data/uploads/")
        .when(kind == "click", "/tmp/ingestion/")
        .when(kind == "error", "/data/uploads_x/")
        .when(kind == "purchase", "/data/uploads/../")
        .otherwise("/etc/")
    )
    e = table(spark, sf, "events").select("event_id", F.concat(path, F.col("event_id").cast("string")).alias("object_key"))
    return rw.allowed_paths(e, ["/data/uploads", "/tmp/ingestion"]).select("event_id")


@R.add(
    "g8_audit",
    """WITH d AS (SELECT *, doc_id % 50 AS m FROM documents)
    SELECT 'documents' AS table_name, 'not null title' AS constraint_name, CAST(doc_id AS VARCHAR) AS row_key FROM d WHERE m = 1
    UNION ALL SELECT 'documents', 'status domain', CAST(doc_id AS VARCHAR) FROM d WHERE m = 2
    UNION ALL SELECT 'documents', 'quality range', CAST(doc_id AS VARCHAR) FROM d WHERE m = 3
    UNION ALL SELECT 'documents', 'length doi', CAST(doc_id AS VARCHAR) FROM d WHERE m = 4
    UNION ALL SELECT 'documents', 'unique pmcid', p FROM (SELECT sha256(text) AS p FROM d) GROUP BY p HAVING count(*) > 1
    UNION ALL SELECT 'documents', 'length pmcid', CAST(doc_id AS VARCHAR) FROM d
    UNION ALL SELECT 'chunks', 'not null content', 'c' || doc_id FROM d WHERE m = 5
    UNION ALL SELECT 'chunks', 'foreign key document_id', 'c' || doc_id FROM d WHERE m = 6""",
)
def g8(spark, sf):
    """Each constraint broken by the documents of one residue."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    m = i % 50
    docs = d.select(
        i.cast("string").alias("document_id"),
        F.when(m != 1, F.lit("t")).alias("title"),
        F.lit("k").alias("object_key"),
        F.when(m == 2, "broken").otherwise("completed").alias("processing_status"),
        F.when(m == 3, 1.5).otherwise(0.5).alias("quality_score"),
        F.concat(F.when(m == 4, F.repeat(F.lit("x"), 256)).otherwise("10.1/"), i.cast("string")).alias("doi"),
        F.sha2("text", 256).alias("pmcid"),
    )
    parts = d.select(
        F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"), F.lit(0).alias("chunk_index"),
        F.when(m == 6, F.concat(F.lit("gone"), i.cast("string"))).otherwise(i.cast("string")).alias("document_id"),
        F.when(m != 5, F.lit("x")).alias("content"),
    )
    return st.audit(docs, parts)


@R.add(
    "j4_mark_failed",
    with_sql(DOCS, select="""SELECT document_id, CASE WHEN x.doc_id IS NOT NULL THEN 'failed' ELSE processing_status END AS processing_status,
  CASE WHEN x.doc_id IS NOT NULL THEN 'toxic' END AS processing_error, CASE WHEN x.doc_id IS NOT NULL THEN 3 ELSE 2 END AS processing_attempts
FROM docs LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) x ON docs.doc_id = x.doc_id"""),
)
def j4(spark, sf):
    d = documents(spark, sf).withColumns({"processing_error": F.lit(None).cast("string"), "processing_attempts": F.lit(2)})
    bad = table(spark, sf, "labels").where("quality = 0").select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit("toxic").alias("error_message")
    )
    return jb.mark_failed(d, bad).select("document_id", "processing_status", "processing_error", "processing_attempts")


@R.add(
    "s9_current_table",
    """WITH b AS (SELECT user_id, event_id % 4 AS batch, arg_max(event_type, event_id) AS kind, max(event_id) AS last FROM events GROUP BY ALL)
    SELECT user_id, arg_max(kind, batch) AS kind, arg_max(last, batch) AS last, max(batch) AS batch_id, CAST(count(*) AS INTEGER) AS processing_attempts,
      min(batch) AS created_at FROM b GROUP BY user_id""",
)
def s9_current(spark, sf):
    """Four batches of users' last events, one of them repeated, merged into a current table."""
    path, e = scratch_path(spark, "current"), table(spark, sf, "events")
    for n in (0, 1, 2, 2, 3):
        rows = e.where(F.col("event_id") % 4 == n).groupBy("user_id").agg(
            F.max_by("event_type", "event_id").alias("kind"), F.max("event_id").alias("last")
        )
        merge_batch(rows, path, "user_id", n, buckets=8)
    return read_current(spark, path).select(
        "user_id", "kind", "last", "batch_id", "processing_attempts", "created_at"
    )

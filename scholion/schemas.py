"""Column layouts of the stored tables, as Spark DDL."""

AUTHOR = (
    "STRUCT<given_names:STRING,surname:STRING,email:STRING,affiliations:ARRAY<STRING>,orcid:STRING>"
)
SECTION = "STRUCT<title:STRING,type:STRING,content:STRING>"

DOCUMENTS = f"""document_id STRING, title STRING, abstract STRING, authors ARRAY<{AUTHOR}>,
 journal STRING, publication_date DATE, doi STRING, pmcid STRING, pmid STRING,
 mesh_terms ARRAY<STRING>, keywords ARRAY<STRING>, article_type STRING,
 source_url STRING, object_key STRING, object_bucket STRING,
 processing_status STRING, processing_error STRING, processing_attempts INT,
 quality_score DOUBLE, has_abstract BOOLEAN, has_full_text BOOLEAN,
 section_count INT, reference_count INT, word_count INT,
 retracted BOOLEAN, retraction_date DATE, retraction_reason STRING,
 extra_metadata MAP<STRING,STRING>, created_at TIMESTAMP, updated_at TIMESTAMP,
 processed_at TIMESTAMP"""

CHUNKS = """chunk_id STRING, document_id STRING, chunk_index INT, section_title STRING,
 section_type STRING, page_number INT, content STRING, content_hash STRING, token_count INT,
 embedding ARRAY<FLOAT>, embedding_model_id STRING, embedding_version INT,
 embedding_created_at TIMESTAMP, previous_chunk_id STRING, next_chunk_id STRING,
 extra_metadata MAP<STRING,STRING>"""

REFERENCES = """document_id STRING, ref_ord INT, id STRING, type STRING, title STRING,
 source STRING, year STRING, volume STRING, fpage STRING, lpage STRING, doi STRING, raw STRING"""

JOBS = """job_id STRING, document_id STRING, job_type STRING, status STRING, priority INT,
 total_steps INT, completed_steps INT, current_step STRING, error_message STRING,
 error_details STRING, retry_count INT, max_retries INT, created_at TIMESTAMP,
 started_at TIMESTAMP, completed_at TIMESTAMP"""

SEARCH_HISTORY = """id STRING, query_text STRING, search_type STRING, filters MAP<STRING,STRING>,
 result_count INT, result_ids ARRAY<STRING>, latency_ms INT, user_id STRING, session_id STRING,
 created_at TIMESTAMP"""

QUARANTINE = """object_key STRING, reason STRING, details MAP<STRING,STRING>, attempts INT,
 ts TIMESTAMP"""

# Fixed values of the data model.
DOCUMENT_STATUSES = ["pending", "processing", "completed", "failed", "retrying"]
JOB_STATUSES = ["pending", "processing", "completed", "failed"]
JOB_TYPES = ["ingestion", "embedding", "reindex"]
SEARCH_TYPES = ["vector", "keyword", "hybrid"]
LENGTH_CAPS = {"journal": 500, "doi": 255, "pmcid": 50, "pmid": 50, "article_type": 100}

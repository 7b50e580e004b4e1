"""The data model laid over the given tables, once as DataFrames and once as SQL.

documents -> documents and, one each, chunks; labels -> processing status; embeddings -> chunk
and query vectors; benchmark -> search requests; conversations -> chat history; events ->
request log, jobs, searches and bookmarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.functions.text import STOP_WORDS, lexemes, lines, strip, word_count
from scholion.session import small_side, spread

WS_SQL = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
DAY_ZERO = "2024-01-01"


class Registry:
    """Queries and SQL statements of one family."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        if sql is not None:
            self.oracles[name] = sql

        def keep(fn):
            self.queries[name] = fn
            return fn

        return keep


_SPLITS: dict[tuple[str, str], int] = {}
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; the ones holding text are spread over all cores if they are one small file."""
    path = f"{sf.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    if name not in TEXT_KEYS:
        return df
    seen = (spark.sparkContext.applicationId, path)
    if seen not in _SPLITS:
        _SPLITS[seen] = df.rdd.getNumPartitions()
    return spread(df, TEXT_KEYS[name], splits=_SPLITS[seen])


def rounded(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


def as_often(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows a left join with the doc_ids of another table gives, without moving one of them where no id is
    listed twice there."""
    known = listed.where(F.col("doc_id").isNotNull())
    repeated = known.groupBy("doc_id").agg(F.count("*").cast("int").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return rows
    times = F.array_repeat(F.lit(0), F.coalesce("n", F.lit(1)))
    return rows.join(small_side(repeated), "doc_id", "left").select(*rows.columns, F.explode(times)).drop("col")


# ---- documents ---------------------------------------------------------------------------


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    status = (
        F.when(F.col("toxic").isNull(), F.lit("pending"))
        .when(F.col("toxic") == 1, F.lit("failed"))
        .otherwise(F.lit("completed"))
    )
    return d.join(labels, "doc_id", "left").select(*_described_columns(), status.alias("processing_status"))


def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of documents without their status, so that no text is moved to meet a label."""
    d = table(spark, sf, "documents")
    return as_often(d, table(spark, sf, "labels").select("doc_id")).select(*_described_columns())


def _described_columns() -> list:
    day = F.date_add(F.lit(DAY_ZERO).cast("date"), (F.col("doc_id") % 365).cast("int"))
    return [
        F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id"), F.col("text"),
        F.col("lang").alias("article_type"), F.col("source").alias("journal"), day.alias("publication_date"),
    ]


DOCS = f"""docs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS document_id, d.doc_id, d.text, d.lang AS article_type,
    d.source AS journal,
    CAST(DATE '{DAY_ZERO}' + CAST(d.doc_id % 365 AS INTEGER) AS DATE) AS publication_date,
    CASE WHEN l.toxic IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'failed' ELSE 'completed' END
      AS processing_status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '^[{WS_SQL}]+|[{WS_SQL}]+$', '', 'g')"


def words_sql(e: str) -> str:
    return f"regexp_extract_all({e}, '[^{WS_SQL}]+')"


def lines_sql(e: str) -> str:
    return f"string_split({e}, chr(10))"


STOP_SQL = "[" + ",".join(f"'{w}'" for w in STOP_WORDS) + "]"


def singular_sql(t: str) -> str:
    return (
        f"CASE WHEN regexp_matches({t}, '[^ea]ies$') THEN regexp_replace({t}, 'ies$', 'y') "
        f"WHEN regexp_matches({t}, '[^aeo]es$') THEN regexp_replace({t}, 'es$', 'e') "
        f"WHEN regexp_matches({t}, '[^us]s$') THEN regexp_replace({t}, 's$', '') ELSE {t} END"
    )


def lexemes_sql(e: str, conf: str = "english") -> str:
    tokens = f"regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}]+')"
    if conf == "simple":
        return tokens
    kept = f"list_filter({tokens}, lambda t: NOT list_contains({STOP_SQL}, t))"
    return f"list_transform({kept}, lambda t: {singular_sql('t')})" if conf == "english" else kept


def described(docs: DataFrame) -> DataFrame:
    """Documents with the indicator columns statistics are made of, derived from the text."""
    rows = F.size(F.filter(lines(F.col("text")), lambda x: strip(x) != ""))
    return docs.withColumns(
        {
            "has_abstract": rows > 1,
            "has_full_text": F.length("text") > 200,
            "section_count": rows,
            "reference_count": F.length("text") - F.length(F.replace("text", F.lit("."), F.lit(""))),
            "word_count": word_count("text"),
        }
    )


DESCRIBED = f"""described AS (
  SELECT *, n_lines > 1 AS has_abstract, length(text) > 200 AS has_full_text,
    n_lines AS section_count, length(text) - length(replace(text, '.', '')) AS reference_count,
    len({words_sql('text')}) AS word_count
  FROM (SELECT *, len(list_filter({lines_sql('text')}, lambda x: {strip_sql('x')} <> '')) AS n_lines
    FROM docs))"""

QUALITY_SQL = """round(CASE WHEN has_abstract THEN 0.3::DOUBLE ELSE 0 END
  + CASE WHEN has_full_text THEN 0.3::DOUBLE ELSE 0 END
  + least(section_count / 5.0::DOUBLE, 1) * 0.2::DOUBLE
  + least(reference_count / 20.0::DOUBLE, 1) * 0.2::DOUBLE, 2)"""


# ---- chunks ------------------------------------------------------------------------------


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as one chunk; documents without a row in embeddings have no vector."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return d.join(e, "doc_id", "left").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("text").alias("content"),
        "embedding",
    )


def chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of chunks without their vectors, so that no text is moved to meet one.

    A vector adds no row and leaves none out, unless its id is listed several times: then it repeats the chunk.
    """
    d = table(spark, sf, "documents").select("doc_id", "text")
    return as_often(d, table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))).select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("text").alias("content"),
    )


CHUNKS = """chunks AS (
  SELECT 'c' || d.doc_id AS chunk_id, CAST(d.doc_id AS VARCHAR) AS document_id, d.text AS content,
    e.embedding
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""


# ---- search requests ---------------------------------------------------------------------


def requests(spark: SparkSession, sf: str, with_filters: bool = True, whole: bool = False) -> DataFrame:
    """Every benchmark row as a request: its two shortest longer words (or its whole text) and the vector of its id."""
    b = table(spark, sf, "benchmark")
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_embedding")
    )
    ranked = F.array_sort(
        F.transform(
            F.filter(F.array_distinct(lexemes("text", "stop")), lambda t: F.length(t) >= 4),
            lambda t: F.struct(F.length(t).alias("n"), t.alias("t")),
        )
    )
    words = F.array_join(F.slice(F.transform(ranked, lambda r: r["t"]), 1, 2), " ")
    text = F.col("text") if whole else words
    i = F.col("item_id")
    q = b.join(e, "item_id", "left").select(
        i.cast("string").alias("query_id"),
        text.alias("query_text"),
        "query_embedding",
        F.element_at(F.array(*map(F.lit, ("hybrid", "vector", "keyword"))), (i % 3 + 1).cast("int")).alias(
            "search_type"
        ),
        F.lit(5).alias("k"),
        (i % 3).cast("int").alias("off"),
        "item_id",
    )
    if not with_filters:
        return q
    none = F.lit(None).cast("array<string>")
    return q.select(
        "*",
        F.when(i % 4 == 1, F.lit("2024-03-01").cast("date")).alias("date_from"),
        F.when(i % 4 == 2, F.lit("2024-10-31").cast("date")).alias("date_to"),
        F.when(i % 5 == 3, F.array(*[F.lit(f"src{n}") for n in range(1, 13)])).otherwise(none).alias("journals"),
        F.when(i % 6 == 5, F.array(F.lit("en"), F.lit("fr"))).otherwise(none).alias("article_types"),
    )


def whole_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The same requests, each asking with its whole passage."""
    return requests(spark, sf, whole=True)


_LONGER = f"list_filter(list_distinct({lexemes_sql('b.text', 'stop')}), lambda t: length(t) >= 4)"
REQUESTS = f"""requests AS (
  SELECT CAST(b.item_id AS VARCHAR) AS query_id, b.item_id,
    array_to_string(list_slice(list_transform(list_sort(list_transform({_LONGER},
      lambda t: {{'n': length(t), 't': t}})), lambda r: r.t), 1, 2), ' ') AS query_text,
    e.embedding AS query_embedding,
    (['hybrid', 'vector', 'keyword'])[CAST(b.item_id % 3 + 1 AS INTEGER)] AS search_type,
    5 AS k, CAST(b.item_id % 3 AS INTEGER) AS off,
    CASE WHEN b.item_id % 4 = 1 THEN DATE '2024-03-01' END AS date_from,
    CASE WHEN b.item_id % 4 = 2 THEN DATE '2024-10-31' END AS date_to,
    CASE WHEN b.item_id % 5 = 3 THEN [{','.join(f"'src{n}'" for n in range(1, 13))}] END AS journals,
    CASE WHEN b.item_id % 6 = 5 THEN ['en', 'fr'] END AS article_types
  FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id)"""

WHOLE_REQUESTS = """requests AS (
  SELECT two_words.* REPLACE (b.text AS query_text)
  FROM two_words JOIN benchmark b USING (item_id))"""

FILTER_SQL = """(q.date_from IS NULL OR d.publication_date >= q.date_from)
    AND (q.date_to IS NULL OR d.publication_date <= q.date_to)
    AND (q.journals IS NULL OR list_contains(q.journals, d.journal))"""
TYPE_FILTER_SQL = "(q.article_types IS NULL OR list_contains(q.article_types, d.article_type))"


def vector_sql(type_filter: bool = True) -> str:
    """CTE vec: every visible pair with its similarity and rank."""
    extra = f" AND {TYPE_FILTER_SQL}" if type_filter else ""
    return f"""vec AS (
  SELECT query_id, chunk_id, document_id, vector_similarity,
    row_number() OVER (PARTITION BY query_id ORDER BY vector_similarity DESC, chunk_id) AS vector_rank
  FROM (SELECT q.query_id, c.chunk_id, c.document_id,
      round(list_cosine_similarity(c.embedding::DOUBLE[], q.query_embedding::DOUBLE[]), 12)
        AS vector_similarity
    FROM requests q, chunks c JOIN docs d ON c.document_id = d.document_id
    WHERE d.processing_status = 'completed' AND c.embedding IS NOT NULL
      AND q.query_embedding IS NOT NULL AND {FILTER_SQL}{extra}))"""


def keyword_sql(
    type_filter: bool = True, conf: str = "english", text: str = "content", rank_fn: str = "bm25"
) -> str:
    """CTEs up to kw: every matching pair with its score and rank."""
    extra = f" AND {TYPE_FILTER_SQL}" if type_filter else ""
    part = (
        "m.idf * m.tf * (1.2::DOUBLE + 1) / (m.tf + 1.2::DOUBLE * "
        "(1 - 0.75::DOUBLE + 0.75::DOUBLE * m.dl / m.avg_dl))"
        if rank_fn == "bm25"
        else "1 + ln(m.tf::DOUBLE)"
    )
    return f"""lex AS MATERIALIZED (
  SELECT c.chunk_id, c.document_id, {lexemes_sql('c.' + text, conf)} AS l
  FROM chunks c JOIN docs d ON c.document_id = d.document_id
  WHERE d.processing_status = 'completed'),
stats AS (SELECT count(*) AS n, avg(len(l)) AS avg_dl FROM lex),
terms AS (SELECT query_id, unnest(list_distinct({lexemes_sql('query_text', conf)})) AS term FROM requests),
n_terms AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY query_id),
tf AS (SELECT chunk_id, document_id, dl, term, count(*) AS tf
  FROM (SELECT chunk_id, document_id, len(l) AS dl, unnest(l) AS term FROM lex)
  WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
m AS (SELECT t.query_id, tf.chunk_id, tf.document_id, tf.tf, tf.dl, s.avg_dl,
    ln(1 + (s.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) AS idf
  FROM terms t JOIN tf ON t.term = tf.term JOIN df ON df.term = t.term CROSS JOIN stats s),
matched AS (SELECT m.query_id, m.chunk_id, m.document_id, round(sum({part}), 9) AS keyword_score
  FROM m JOIN n_terms x ON x.query_id = m.query_id
  GROUP BY m.query_id, m.chunk_id, m.document_id, x.n_terms HAVING count(*) = x.n_terms),
kw AS (SELECT a.*, row_number() OVER (PARTITION BY a.query_id ORDER BY keyword_score DESC, chunk_id)
    AS keyword_rank
  FROM matched a JOIN docs d ON a.document_id = d.document_id JOIN requests q ON q.query_id = a.query_id
  WHERE {FILTER_SQL}{extra})"""


HYBRID_TAIL = """fused AS (
  SELECT coalesce(v.query_id, w.query_id) AS query_id, coalesce(v.chunk_id, w.chunk_id) AS chunk_id,
    coalesce(v.document_id, w.document_id) AS document_id,
    coalesce(v.vector_rank, 1000) AS vector_rank, coalesce(w.keyword_rank, 1000) AS keyword_rank,
    v.vector_similarity,
    0.7::DOUBLE / (60 + coalesce(v.vector_rank, 1000))
      + 0.3::DOUBLE / (60 + coalesce(w.keyword_rank, 1000)) AS score
  FROM (SELECT vec.* FROM vec JOIN requests q USING (query_id) WHERE vector_rank <= 2 * (q.k + q.off)) v
  FULL OUTER JOIN
    (SELECT kw.* FROM kw JOIN requests q USING (query_id) WHERE keyword_rank <= 2 * (q.k + q.off)) w
  ON v.query_id = w.query_id AND v.chunk_id = w.chunk_id),
ranked AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY score DESC, chunk_id) AS pos
  FROM fused f),
hyb AS (SELECT r.*, r.pos - q.off AS rank FROM ranked r JOIN requests q USING (query_id)
  WHERE r.pos > q.off AND r.pos <= q.off + q.k)"""


def with_sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def hybrid_ctes(conf: str = "english") -> tuple[str, ...]:
    return (DOCS, CHUNKS, REQUESTS, vector_sql(False), keyword_sql(False, conf), HYBRID_TAIL)

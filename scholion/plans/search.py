"""Search over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.functions.text import lexemes, trigrams
from scholion.functions.vectors import cosine
from scholion.operators import filters as flt
from scholion.operators.asked import ask, page_of
from scholion.operators import fuzzy, hybrid, keyword
from scholion.operators import vector_search as vs
from scholion.plans.base import (
    CHUNKS,
    DOCS,
    FILTER_SQL,
    HYBRID_TAIL,
    REQUESTS,
    TYPE_FILTER_SQL,
    Registry,
    chunk_texts,
    chunks,
    document_texts,
    documents,
    hybrid_ctes,
    keyword_sql,
    lexemes_sql,
    lines_sql,
    requests,
    rounded,
    strip_sql,
    table,
    vector_sql,
    with_sql,
)
from scholion.operators.plaintext import title_from_text
from scholion.session import scratch_path

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add(
    "q1_cosine",
    """WITH centre AS (SELECT label, list(m ORDER BY pos) AS c FROM (
        SELECT label, pos, avg(x) AS m FROM (
          SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos
          FROM embeddings) GROUP BY label, pos) GROUP BY label)
    SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS similarity
    FROM embeddings JOIN centre USING (label)""",
)
def q1(spark, sf):
    """Similarity of every vector to the mean vector of its label."""
    e = table(spark, sf, "embeddings")
    means = (
        e.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda r: r["m"]).alias("c"))
    )
    return e.join(means, "label").select(
        "vec_id", "label", F.round(cosine(F.col("embedding"), F.col("c")), 6).alias("similarity")
    )


PAGE_VEC = """SELECT v.query_id, CAST(v.vector_rank - q.off AS INTEGER) AS rank, v.chunk_id, v.document_id,
  round(v.vector_similarity, 6) AS score
FROM vec v JOIN requests q USING (query_id)
WHERE v.vector_rank > q.off AND v.vector_rank <= q.off + q.k"""


@R.add("q2_vector_topk", with_sql(DOCS, CHUNKS, REQUESTS, vector_sql(), select=PAGE_VEC))
def q2(spark, sf):
    hits = vs.vector_search(requests(spark, sf), chunks(spark, sf), documents(spark, sf))
    return hits.select("query_id", "rank", "chunk_id", "document_id", rounded("score"))


@R.add(
    "q2_vector_many_queries",
    """SELECT query_id, chunk_id, CAST(rk AS INTEGER) AS vector_rank, round(s, 6) AS vector_similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rk FROM (
        SELECT CAST(ev.event_id AS VARCHAR) AS query_id, CAST(b.vec_id AS VARCHAR) AS chunk_id,
          round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS s
        FROM events ev JOIN embeddings a ON a.vec_id = ev.event_id % 400, embeddings b)) WHERE rk <= 2""",
)
def q2_many(spark, sf):
    """Two nearest vectors for a query of every event: more queries than are held in one piece."""
    e = table(spark, sf, "embeddings")
    asking = table(spark, sf, "events").select("event_id", (F.col("event_id") % 400).alias("vec_id"))
    q = asking.join(e, "vec_id").select(
        F.col("event_id").cast("string").alias("query_id"), F.col("embedding").alias("query_embedding")
    )
    return vs.vector_topk(q, vectors_as_chunks(e), 2).select(
        "query_id", "chunk_id", "vector_rank", rounded("vector_similarity")
    )


def vectors_as_chunks(e):
    return e.select(
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.col("vec_id").cast("string").alias("document_id"),
        "embedding",
        F.col("label").cast("string").alias("journal"),
        F.lit("vector").alias("article_type"),
        F.lit("2024-01-01").cast("date").alias("publication_date"),
    )


@R.add(
    "q2_vector_knn_all",
    """SELECT query_id, chunk_id, CAST(rk AS INTEGER) AS vector_rank, round(s, 6) AS vector_similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rk FROM (
        SELECT CAST(a.vec_id AS VARCHAR) AS query_id, CAST(b.vec_id AS VARCHAR) AS chunk_id,
          round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS s
        FROM embeddings a, embeddings b)) WHERE rk <= 5""",
)
def q2_all(spark, sf):
    """Five nearest vectors of every vector."""
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return vs.vector_topk(q, vectors_as_chunks(e), 5).select(
        "query_id", "chunk_id", "vector_rank", rounded("vector_similarity")
    )


@R.add(
    "q3_ann_recall",
    """SELECT count(*) AS queries, true AS found_nine_of_ten FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id""",
)
def q3(spark, sf):
    """Approximate search over k-means cells: its recall against the exact result, as a bound."""
    c, d, q = chunks(spark, sf), documents(spark, sf), requests(spark, sf)
    centres = vs.fit_cells(c, 16)
    approx = vs.ann_search(q, vs.assign_cells(c, centres), d, centres, nprobe=12)
    return vs.recall(approx, vs.vector_search(q, c, d)).agg(
        F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("found_nine_of_ten")
    )


@R.add(
    "q4_lexemes",
    f"""SELECT doc_id, array_to_string({lexemes_sql('text')}, ' ') AS lexemes FROM documents""",
)
def q4(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(lexemes("text"), " ").alias("lexemes")
    )


@R.add(
    "q5_postings",
    f"""SELECT term, chunk_id, document_id, dl, count(*) AS tf FROM (
      SELECT 'c' || doc_id AS chunk_id, CAST(doc_id AS VARCHAR) AS document_id,
        unnest(l) AS term, len(l) AS dl
      FROM (SELECT doc_id, {lexemes_sql('text')} AS l FROM documents)) GROUP BY ALL""",
)
def q5(spark, sf):
    return keyword.build_postings(chunk_texts(spark, sf)).select(
        "term", "chunk_id", "document_id", F.col("dl").cast("long").alias("dl"), "tf"
    )


@R.add(
    "q6_keyword_match_whole_texts",
    f"""WITH d AS (SELECT doc_id, list_distinct({lexemes_sql('text')}) AS l FROM documents),
    b AS (SELECT item_id, list_distinct({lexemes_sql('text')}) AS l FROM benchmark),
    s AS (SELECT d.doc_id FROM d JOIN labels USING (doc_id) WHERE toxic = 0)
    SELECT CAST(b.item_id AS VARCHAR) AS query_id, 'c' || d.doc_id AS chunk_id
    FROM b, d WHERE d.doc_id IN (SELECT doc_id FROM s)
      AND len(b.l) > 0 AND len(list_intersect(b.l, d.l)) = len(b.l)""",
)
def q6(spark, sf):
    """All lexemes of a whole benchmark passage must occur."""
    q = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query_text")
    )
    return keyword.keyword_matches(q, chunk_texts(spark, sf), documents(spark, sf)).select(
        "query_id", "chunk_id"
    )


@R.add(
    "q7_keyword_rank",
    with_sql(
        DOCS, CHUNKS, REQUESTS, keyword_sql(),
        select="SELECT query_id, chunk_id, CAST(keyword_rank AS INTEGER) AS keyword_rank, "
        "round(keyword_score, 6) AS keyword_score FROM kw WHERE keyword_rank <= 100",
    ),
)
def q7(spark, sf, asking=requests):
    m = keyword.keyword_matches(asking(spark, sf), chunk_texts(spark, sf), documents(spark, sf))
    return keyword.keyword_topk(m, 100).select(
        "query_id", "chunk_id", "keyword_rank", rounded("keyword_score")
    )


@R.add(
    "q7_keyword_rank_tf",
    with_sql(
        DOCS, CHUNKS, REQUESTS, keyword_sql(rank_fn="tf"),
        select="SELECT query_id, chunk_id, CAST(keyword_rank AS INTEGER) AS keyword_rank, "
        "round(keyword_score, 6) AS keyword_score FROM kw WHERE keyword_rank <= 100",
    ),
)
def q7_tf(spark, sf, asking=requests):
    m = keyword.keyword_matches(
        asking(spark, sf), chunk_texts(spark, sf), documents(spark, sf), rank_fn="tf"
    )
    return keyword.keyword_topk(m, 100).select(
        "query_id", "chunk_id", "keyword_rank", rounded("keyword_score")
    )


PAGE_KW = """SELECT v.query_id, CAST(v.keyword_rank - q.off AS INTEGER) AS rank, v.chunk_id, v.document_id,
  round(v.keyword_score, 6) AS score
FROM kw v JOIN requests q USING (query_id)
WHERE v.keyword_rank > q.off AND v.keyword_rank <= q.off + q.k"""


@R.add("q8_keyword_topk", with_sql(DOCS, CHUNKS, REQUESTS, keyword_sql(), select=PAGE_KW))
def q8(spark, sf, asking=requests):
    hits = keyword.keyword_search(asking(spark, sf), chunk_texts(spark, sf), documents(spark, sf))
    return hits.select("query_id", "rank", "chunk_id", "document_id", rounded("score"))


@R.add("q8_stored_index", with_sql(DOCS, CHUNKS, REQUESTS, keyword_sql(), select=PAGE_KW))
def q8_stored(spark, sf, asking=requests):
    """The same search over a stored index; its own plan reads no text."""
    c, path = chunk_texts(spark, sf), scratch_path(spark, "index")
    keyword.write_index(c, path)
    hits = keyword.keyword_search(
        asking(spark, sf), c, documents(spark, sf), **keyword.read_index(spark, path)
    )
    return hits.select("query_id", "rank", "chunk_id", "document_id", rounded("score"))


def hybrid_hits(spark, sf, asking=requests):
    texts = chunk_texts(spark, sf)
    return hybrid.hybrid_search(asking(spark, sf), chunks(spark, sf), documents(spark, sf), texts=texts)


@R.add(
    "q9_hybrid_rrf",
    with_sql(
        *hybrid_ctes(),
        select="""SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, document_id,
  CAST(vector_rank AS INTEGER) AS vector_rank, CAST(keyword_rank AS INTEGER) AS keyword_rank,
  round(vector_similarity, 6) AS vector_similarity, round(score, 9) AS score FROM hyb""",
    ),
)
def q9(spark, sf, asking=requests):
    return hybrid_hits(spark, sf, asking).select(
        "query_id", "rank", "chunk_id", "document_id", "vector_rank", "keyword_rank",
        rounded("vector_similarity"), rounded("score", 9),
    )


TITLE_SQL = f"""coalesce(list_filter(list_transform({lines_sql('text')}, lambda x: {strip_sql('x')}),
  lambda x: length(x) > 10 AND NOT starts_with(x, 'http') AND NOT starts_with(x, 'doi')
    AND NOT starts_with(x, 'DOI'))[1], 'Untitled Document')"""


def titled(docs):
    return docs.withColumn("title", title_from_text(F.col("text"))).withColumn(
        "doi", F.concat(F.lit("10.1234/"), F.col("document_id"))
    )


@R.add(
    "q10_enriched_hits",
    with_sql(
        *hybrid_ctes(),
        select=f"""SELECT h.query_id, CAST(h.rank AS INTEGER) AS rank, h.chunk_id, c.content, {TITLE_SQL} AS title,
  d.journal, CAST(d.publication_date AS VARCHAR) AS publication_date, '10.1234/' || d.document_id AS doi
FROM hyb h JOIN chunks c ON h.chunk_id = c.chunk_id JOIN docs d ON h.document_id = d.document_id""",
    ),
)
def q10(spark, sf, asking=requests):
    asked = ask(asking(spark, sf))
    texts = chunk_texts(spark, sf)
    hits = hybrid.hybrid_search(asked, chunks(spark, sf), documents(spark, sf), texts=texts)
    most = None if asked.frame is None else 5 * len(asked.frame)
    out = hybrid.enrich(hits, texts, titled(document_texts(spark, sf)), most)
    return out.select(
        "query_id", "rank", "chunk_id", "content", "title", "journal",
        F.col("publication_date").cast("string").alias("publication_date"), "doi",
    )


@R.add(
    "q12_hits_with_neighbours",
    with_sql(
        *hybrid_ctes(),
        select="""SELECT h.query_id, CAST(h.rank AS INTEGER) AS rank, h.chunk_id, md5(p.content) AS before, md5(n.content) AS after
FROM hyb h LEFT JOIN chunks p ON p.chunk_id = 'c' || (CAST(h.document_id AS BIGINT) - 1)
  LEFT JOIN chunks n ON n.chunk_id = 'c' || (CAST(h.document_id AS BIGINT) + 1)""",
    ),
)
def q12_hits(spark, sf, asking=requests):
    """Search hits with the texts before and after them; documents follow each other by their ids."""
    asked = ask(asking(spark, sf))
    texts = chunk_texts(spark, sf)
    hits = hybrid.hybrid_search(asked, chunks(spark, sf), documents(spark, sf), texts=texts)
    at = F.col("document_id").cast("long")
    linked = texts.select(
        "chunk_id", "content",
        F.concat(F.lit("c"), (at - 1).cast("string")).alias("previous_chunk_id"),
        F.concat(F.lit("c"), (at + 1).cast("string")).alias("next_chunk_id"),
    )
    most = None if asked.frame is None else 5 * len(asked.frame)
    out = hybrid.with_context(hits, linked, most)
    return out.select(
        "query_id", "rank", "chunk_id", F.md5("context.previous_chunk").alias("before"),
        F.md5("context.next_chunk").alias("after"),
    )


@R.add(
    "q11_paging",
    with_sql(
        DOCS, CHUNKS, REQUESTS, keyword_sql(),
        select="""SELECT query_id, count(*) AS total_matches, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages,
  CAST((ceil(count(*) / 10.0) - 1) * 10 AS BIGINT) AS last_offset FROM kw GROUP BY query_id""",
    ),
)
def q11(spark, sf, asking=requests):
    m = keyword.keyword_matches(asking(spark, sf), chunk_texts(spark, sf), documents(spark, sf))
    pages = hybrid.page_count(F.col("total_matches"))
    return keyword.match_totals(m).select(
        "query_id", "total_matches", pages.alias("pages"),
        hybrid.page_number_to_offset(pages).cast("long").alias("last_offset"),
    )


@R.add(
    "q13_page_metadata",
    with_sql(
        DOCS, CHUNKS, REQUESTS, keyword_sql(),
        select="""SELECT q.query_id, q.search_type AS strategy,
  (SELECT count(*) FROM kw WHERE kw.query_id = q.query_id AND keyword_rank > q.off
     AND keyword_rank <= q.off + q.k) AS result_count,
  (SELECT count(*) FROM kw WHERE kw.query_id = q.query_id) AS total_matches,
  array_to_string(list_filter([CASE WHEN q.article_types IS NOT NULL THEN 'article_types' END,
    CASE WHEN q.date_from IS NOT NULL THEN 'date_from' END, CASE WHEN q.date_to IS NOT NULL THEN 'date_to' END,
    CASE WHEN q.journals IS NOT NULL THEN 'journals' END], lambda x: x IS NOT NULL), ',') AS filters
FROM requests q""",
    ),
)
def q13(spark, sf, asking=requests):
    asked = ask(asking(spark, sf))
    m = keyword.keyword_matches(asked, chunk_texts(spark, sf), documents(spark, sf))
    page = page_of(keyword.keyword_topk(m, asked.depth(5, 0)), asked, "keyword_rank", 5, 0)
    out = hybrid.page_metadata(asked.queries, page, keyword.match_totals(m))
    return out.select(
        "query_id", "strategy", "result_count", "total_matches",
        F.array_join(F.array_sort(F.map_keys("filters_applied")), ",").alias("filters"),
    )


GRAMS = (
    "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: "
    "list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
)


@R.add(
    "q14_title_similarity",
    f"""WITH t AS (SELECT title, count(*) AS documents FROM (SELECT {TITLE_SQL} AS title FROM documents) GROUP BY title),
    g AS (SELECT *, {GRAMS.format('title')} AS grams FROM t),
    q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {GRAMS.format('text')} AS q FROM benchmark)
    SELECT query_id, title, documents, round(s, 6) AS similarity FROM (
      SELECT query_id, title, documents,
        len(list_intersect(q, grams)) / len(list_distinct(list_concat(q, grams)))::DOUBLE AS s FROM q, g)
    WHERE s >= 0.3""",
)
def q14(spark, sf):
    t = table(spark, sf, "documents").select(title_from_text(F.col("text")).alias("title"))
    q = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query_text")
    )
    return fuzzy.title_similarity(q, t).select(
        "query_id", "title", "documents", rounded("similarity")
    )


@R.add(
    "q15_document_keyword_topk",
    with_sql(
        DOCS,
        f"""chunks AS (SELECT document_id AS chunk_id, document_id,
          concat_ws(' ', {TITLE_SQL}, text) AS content FROM docs)""",
        REQUESTS, keyword_sql(),
        select="""SELECT v.query_id, CAST(v.keyword_rank - q.off AS INTEGER) AS rank, v.document_id,
  round(v.keyword_score, 6) AS score
FROM kw v JOIN requests q USING (query_id)
WHERE v.keyword_rank > q.off AND v.keyword_rank <= q.off + q.k""",
    ),
)
def q15(spark, sf, asking=requests):
    d = titled(documents(spark, sf)).withColumn("abstract", F.col("text"))
    hits = keyword.document_keyword_search(asking(spark, sf), d)
    return hits.select("query_id", "rank", "document_id", rounded("score"))


@R.add(
    "q16_search_dispatch",
    with_sql(
        DOCS, CHUNKS, REQUESTS, vector_sql(), keyword_sql(),
        vector_sql(False).replace("vec AS", "vec0 AS", 1),
        """kw0 AS (SELECT a.*, row_number() OVER (PARTITION BY a.query_id ORDER BY keyword_score DESC, chunk_id)
    AS keyword_rank
  FROM matched a JOIN docs d ON a.document_id = d.document_id JOIN requests q ON q.query_id = a.query_id
  WHERE """ + FILTER_SQL + ")",
        HYBRID_TAIL.replace(
            "vec.* FROM vec ", "vec0.* FROM vec0 "
        ).replace("kw.* FROM kw ", "kw0.* FROM kw0 "),
        select="""SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score, 'hybrid' AS search_type
FROM hyb JOIN requests q USING (query_id) WHERE search_type = 'hybrid'
UNION ALL SELECT v.query_id, CAST(v.vector_rank - q.off AS INTEGER), v.chunk_id, round(v.vector_similarity, 6), 'vector'
FROM vec v JOIN requests q USING (query_id)
WHERE v.vector_rank > q.off AND v.vector_rank <= q.off + q.k AND q.search_type = 'vector'
UNION ALL SELECT v.query_id, CAST(v.keyword_rank - q.off AS INTEGER), v.chunk_id, round(v.keyword_score, 6), 'keyword'
FROM kw v JOIN requests q USING (query_id)
WHERE v.keyword_rank > q.off AND v.keyword_rank <= q.off + q.k AND q.search_type = 'keyword'""",
    ),
)
def q16(spark, sf, asking=requests):
    texts = chunk_texts(spark, sf)
    out = hybrid.search(asking(spark, sf), chunks(spark, sf), documents(spark, sf), texts=texts)
    return out.select("query_id", "rank", "chunk_id", rounded("score"), "search_type")


@R.add(
    "f1_filtered_documents",
    with_sql(
        DOCS, REQUESTS,
        select=f"""SELECT q.query_id, count(*) AS documents, min(d.publication_date)::VARCHAR AS first_day,
  max(d.publication_date)::VARCHAR AS last_day
FROM requests q JOIN docs d ON {FILTER_SQL} AND {TYPE_FILTER_SQL} GROUP BY q.query_id""",
    ),
)
def f1(spark, sf):
    """How many documents each request's filters let through.

    Documents are first counted per day, journal and type; a request then meets the counts of
    its own journals, or those over all journals if it names none. An equi-join of summaries.
    """
    d = documents(spark, sf)
    cells = d.groupBy("publication_date", "journal", "article_type").agg(F.count("*").alias("n"))
    anywhere = d.groupBy("publication_date", "article_type").agg(F.count("*").alias("n"))
    keyed = cells.withColumn("key", F.col("journal")).unionByName(
        anywhere.withColumns({"journal": F.lit(None).cast("string"), "key": F.lit("*")})
    )
    q = requests(spark, sf).select("query_id", *flt.FILTER_COLUMNS)
    asked = q.withColumn("key", F.explode(F.coalesce("journals", F.array(F.lit("*")))))
    hit = flt.filter_predicate(
        F.col("date_from"), F.col("date_to"), F.col("journals"), F.col("article_types")
    )
    return (
        keyed.join(asked, "key")
        .where(hit)
        .groupBy("query_id")
        .agg(
            F.sum("n").alias("documents"),
            F.min("publication_date").cast("string").alias("first_day"),
            F.max("publication_date").cast("string").alias("last_day"),
        )
    )


@R.add(
    "f1_literal_filters",
    with_sql(
        DOCS,
        select="""SELECT document_id, journal, article_type, publication_date::VARCHAR AS publication_date FROM docs
WHERE publication_date BETWEEN DATE '2024-02-01' AND DATE '2024-11-30'
  AND journal IN ('src1', 'src2', 'src3', 'src5', 'src8', 'src13') AND article_type IN ('en', 'de')""",
    ),
)
def f1_literal(spark, sf):
    out = flt.apply_filters(
        documents(spark, sf), "2024-02-01", "2024-11-30",
        ["src1", "src2", "src3", "src5", "src8", "src13"], ["en", "de"],
    )
    return out.select(
        "document_id", "journal", "article_type",
        F.col("publication_date").cast("string").alias("publication_date"),
    )


@R.add(
    "f2_visible_vectors",
    with_sql(
        DOCS, CHUNKS,
        select="""SELECT c.chunk_id, d.journal FROM chunks c JOIN docs d ON c.document_id = d.document_id
WHERE d.processing_status = 'completed' AND c.embedding IS NOT NULL""",
    ),
)
def f2(spark, sf):
    return vs.candidates(chunks(spark, sf), documents(spark, sf)).select("chunk_id", "journal")


@R.add(
    "f3_validated_chats",
    """SELECT CAST(conv_id AS VARCHAR) || ':' || turn AS query_id,
      CASE WHEN length(text) = 0 THEN 'empty query' WHEN length(text) > 10000 THEN 'query too long'
        WHEN length(text) > 2000 THEN 'query longer than the request model allows'
        WHEN turn * 4 < 1 OR turn * 4 > 20 THEN 'limit out of range' ELSE 'ok' END AS outcome
    FROM conversations""",
)
def f3_chats(spark, sf):
    """Every turn as a chat request; chats may be longer and ask for fewer chunks."""
    q = table(spark, sf, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("query_text"), (F.col("turn") * 4).alias("k"),
    )
    good, bad = flt.validate_queries(q, chat=True)
    return good.select("query_id", F.lit("ok").alias("outcome")).unionByName(
        bad.select("query_id", F.col("reason").alias("outcome"))
    )


@R.add(
    "f3_validated_queries",
    """SELECT CAST(conv_id AS VARCHAR) || ':' || turn AS query_id,
      CASE WHEN length(text) = 0 THEN 'empty query' WHEN length(text) > 10000 THEN 'query too long'
        WHEN length(text) > 1000 THEN 'query longer than the request model allows'
        WHEN turn * 20 < 1 OR turn * 20 > 100 THEN 'limit out of range' ELSE 'ok' END AS outcome,
      CASE WHEN role IN ('vector', 'keyword', 'hybrid') THEN role ELSE 'hybrid' END AS search_type
    FROM conversations""",
)
def f3(spark, sf):
    q = table(spark, sf, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("query_text"),
        F.col("role").alias("search_type"),
        (F.col("turn") * 20).alias("k"),
    )
    ok, bad = flt.validate_queries(q)
    return ok.select("query_id", F.lit("ok").alias("outcome"), "search_type").unionByName(
        bad.select("query_id", F.col("reason").alias("outcome"), "search_type")
    )


@R.add(
    "q3_cells",
    """SELECT count(*) AS chunks, 16 AS cells, true AS apart FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def q3_cells(spark, sf):
    """Every chunk with a vector falls into one of the k-means cells."""
    c = chunks(spark, sf)
    celled = vs.assign_cells(c, vs.fit_cells(c, 16))
    per_cell = celled.groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"))
    return per_cell.agg(
        F.sum("n").alias("chunks"), F.count("*").cast("int").alias("cells"), (F.sum("n") == F.sum("ids")).alias("apart")
    )


@R.add(
    "q14_trigrams",
    f"""SELECT item_id, array_to_string(list_sort({GRAMS.format('text')}), '|') AS grams FROM benchmark""",
)
def q14_grams(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id", F.array_join(F.array_sort(trigrams(F.col("text"))), "|").alias("grams")
    )

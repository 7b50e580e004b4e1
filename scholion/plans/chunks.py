"""Chunking and embedding over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.functions.text import content_hash, word_count
from scholion.functions.vectors import fit_dimensions, normalise
from scholion.operators import chunking as ch
from scholion.operators import embedding as em
from scholion.session import persist_shared
from scholion.plans.base import (
    CHUNKS,
    Registry,
    chunks,
    lines_sql,
    rounded,
    strip_sql,
    table,
    with_sql,
    words_sql,
    lexemes_sql,
)

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

MAX, OVERLAP = 128, 40


def sectioned(spark, sf):
    """Each text as a document of one untitled section."""
    d = table(spark, sf, "documents")
    section = F.struct(
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("full_title"),
        F.lit(None).cast("string").alias("type"),
        F.col("text").alias("content"),
        F.lit(1).alias("depth"),
    )
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.array(section).alias("sections"))


def stored(spark, sf):
    """The packed chunks as a stored table, for plans that read chunks more than once."""
    return persist_shared(packed(spark, sf), "chunks")


def packed(spark, sf):
    return ch.chunk_documents(sectioned(spark, sf), MAX, OVERLAP, sep="\n")


PARAS = f"""paras AS MATERIALIZED (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, {strip_sql('text')} AS text,
    list_filter(list_transform({lines_sql(strip_sql('text'))}, lambda x: {strip_sql('x')}), lambda x: x <> '') AS ps
  FROM documents),
sized AS MATERIALIZED (SELECT *, list_transform(ps, lambda x: len({words_sql('x')})) AS ns,
  len({words_sql('text')}) AS total FROM paras)"""

# The fold over paragraphs, written down step by step: cur holds the open chunk's sizes.
PACK = f"""RECURSIVE fold AS (
  SELECT document_id, 0::BIGINT AS i, 1::BIGINT AS lo, []::BIGINT[] AS cur,
    []::STRUCT(lo BIGINT, n BIGINT, split BOOLEAN)[] AS pieces FROM sized WHERE total > {MAX}
  UNION ALL
  SELECT document_id, i + 1,
    CASE WHEN n > {MAX} THEN i + 2 WHEN over THEN i + 1 - keep WHEN len(cur) = 0 THEN i + 1 ELSE lo END,
    CASE WHEN n > {MAX} THEN []::BIGINT[]
      WHEN over THEN list_append(list_slice(cur, len(cur) - keep + 1, len(cur)), n)
      ELSE list_append(cur, n) END,
    CASE WHEN n > {MAX} THEN list_append(closed, {{'lo': i + 1, 'n': 1::BIGINT, 'split': true}})
      WHEN over THEN closed ELSE pieces END
  FROM (SELECT *, len(cur) > 0 AND coalesce(list_sum(cur), 0) + n > {MAX} AS over,
      CASE WHEN len(cur) > 0 THEN list_append(pieces, {{'lo': lo, 'n': len(cur), 'split': false}}) ELSE pieces END AS closed,
      coalesce(list_max(list_filter(range(1, len(cur) + 1),
        lambda j: list_sum(list_slice(cur, len(cur) - j + 1, len(cur))) <= {OVERLAP})), 0) AS keep
    FROM (SELECT f.*, s.ns[f.i + 1]::BIGINT AS n FROM fold f JOIN sized s USING (document_id)
      WHERE f.i < len(s.ns)))),
done AS (SELECT f.document_id, CASE WHEN len(cur) > 0
    THEN list_append(pieces, {{'lo': lo, 'n': len(cur), 'split': false}}) ELSE pieces END AS pieces
  FROM fold f JOIN sized s USING (document_id) WHERE f.i = len(s.ns)),
texts AS (SELECT document_id, list_transform(flatten(list_transform(pieces, lambda p:
    CASE WHEN p.split THEN list_transform(
        range(0, greatest(0, len(w(ps[p.lo])) - {OVERLAP} - 1) + 1, {MAX - OVERLAP}),
        lambda st: array_to_string(list_slice(w(ps[p.lo]), st + 1, st + {MAX}), ' '))
      ELSE [array_to_string(list_slice(ps, p.lo, p.lo + p.n - 1), chr(10) || chr(10))] END)), lambda x: x) AS cs
  FROM done JOIN sized USING (document_id)
  UNION ALL SELECT document_id, [text] FROM sized WHERE total <= {MAX} AND text <> ''),
chunked AS (SELECT document_id, unnest(cs) AS content, generate_subscripts(cs, 1) - 1 AS chunk_index, len(cs) AS n
  FROM texts)""".replace("w(ps[p.lo])", words_sql("ps[p.lo]"))


def pack_sql(select: str) -> str:
    return "WITH RECURSIVE " + PARAS + ",\n" + PACK.replace("RECURSIVE ", "", 1) + "\n" + select


@R.add(
    "c1_flatten_sections",
    f"""SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(ord - 1 AS INTEGER) AS section_ord, s.t AS section_title,
      s.k AS section_type, s.c AS content
    FROM (SELECT doc_id, unnest(list_filter([{{'t': 'Abstract', 'k': 'abstract', 'c': {lines_sql('text')}[1]}},
        {{'t': 'Text', 'k': 'body', 'c': text}}, {{'t': 'Text > Source', 'k': 'body', 'c': source}}],
        lambda x: {strip_sql('x.c')} <> '')) AS s,
      generate_subscripts(list_filter([{lines_sql('text')}[1], text, source], lambda x: {strip_sql('x')} <> ''), 1) AS ord
    FROM documents)""",
)
def c1(spark, sf):
    d = table(spark, sf, "documents")
    kind = "array<struct<title:string,full_title:string,type:string,content:string,depth:int>>"
    one = "struct<title:string,full_title:string,type:string,content:string,depth:int>"
    parts = F.array(
        F.struct(F.lit("Text"), F.lit("Text"), F.lit("body"), "text", F.lit(1)).cast(one),
        F.struct(F.lit("Source"), F.lit("Text > Source"), F.lit("body"), "source", F.lit(2)).cast(one),
    ).cast(kind)
    docs = d.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("abstract"),
        parts.alias("sections"),
    )
    return ch.flatten_sections(docs)


@R.add(
    "c2_paragraphs",
    f"""SELECT doc_id, count(*) AS paragraphs, max(length(p)) AS longest, md5(string_agg(p, '|' ORDER BY i)) AS digest
    FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id,
      list_filter(list_transform({lines_sql('text')}, lambda x: {strip_sql('x')}), lambda x: x <> '') AS ps
      FROM documents)) GROUP BY doc_id""",
)
def c2(spark, sf):
    p = ch.split_paragraphs(F.col("text"), "\n")
    return (
        table(spark, sf, "documents")
        .select("doc_id", p.alias("p"))
        .where(F.size("p") > 0)
        .select(
            "doc_id", F.size("p").cast("long").alias("paragraphs"),
            F.array_max(F.transform("p", lambda x: F.length(x))).cast("long").alias("longest"),
            F.md5(F.array_join("p", "|")).alias("digest"),
        )
    )


@R.add(
    "c3_pack_paragraphs",
    pack_sql(
        f"""SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index,
      CAST(len({words_sql('content')}) AS INTEGER) AS token_count, md5(content) AS digest FROM chunked"""
    ),
)
def c3(spark, sf):
    return packed(spark, sf).select(
        "document_id", "chunk_index", "token_count", F.md5("content").alias("digest")
    )


@R.add(
    "c4_token_windows",
    f"""WITH t AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 41) + 1, 88)) AS st FROM t WHERE len(w) > 0)
    SELECT doc_id, CAST(st AS INTEGER) AS window_start, CAST(len(list_slice(w, st + 1, st + 128)) AS INTEGER) AS tokens,
      md5(array_to_string(list_slice(w, st + 1, st + 128), ' ')) AS digest FROM s""",
)
def c4(spark, sf):
    from scholion.functions.text import words

    w = ch.window_tokens(words("text"), MAX, OVERLAP)
    return (
        table(spark, sf, "documents")
        .select("doc_id", F.posexplode_outer(w).alias("i", "w"))
        .where(F.col("i").isNotNull())
        .select(
            "doc_id", (F.col("i") * (MAX - OVERLAP)).alias("window_start"), F.size("w").alias("tokens"),
            F.md5(F.array_join("w", " ")).alias("digest"),
        )
    )


@R.add(
    "c5_fixed_size_chunks",
    f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, {words_sql('text')} AS w FROM documents),
    s AS (SELECT document_id, w, unnest(range(0, greatest(0, len(w) - 201) + 1, 312)) AS st FROM t WHERE len(w) > 0)
    SELECT document_id, CAST(st // 312 AS INTEGER) AS chunk_index, CAST(len(list_slice(w, st + 1, st + 512)) AS INTEGER) AS token_count,
      sha256(array_to_string(list_slice(w, st + 1, st + 512), ' ')) AS content_hash FROM s""",
)
def c5(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("full_text")
    )
    return ch.fixed_size_chunks(d).select("document_id", "chunk_index", "token_count", "content_hash")


@R.add(
    "c6_token_counts",
    f"""SELECT doc_id, CAST(len({words_sql('text')}) AS INTEGER) AS tokens FROM documents""",
)
def c6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", word_count("text").alias("tokens"))


@R.add("c7_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def c7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", content_hash("text").alias("content_hash"))


@R.add(
    "c8_chunk_numbering",
    f"""WITH p AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS section_ord
        FROM (SELECT doc_id, {lines_sql('text')} AS ls FROM documents)),
    q AS (SELECT doc_id, section_ord, unnest(ws) AS part, generate_subscripts(ws, 1) - 1 AS part_ord
        FROM (SELECT doc_id, section_ord, string_split(line, '. ') AS ws FROM p))
    SELECT CAST(doc_id AS VARCHAR) AS document_id, md5(part) AS digest, CAST(section_ord AS INTEGER) AS section_ord,
      CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_ord, part_ord) - 1 AS INTEGER) AS chunk_index FROM q""",
)
def c8(spark, sf):
    """Dense numbers over sentence parts that were cut line by line."""
    rows = (
        table(spark, sf, "documents")
        .select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("section_ord", "line"))
        .select("document_id", "section_ord", F.posexplode(F.split("line", "\\. ", -1)).alias("part_ord", "part"))
    )
    return ch.number_chunks(rows).select(
        "document_id", F.md5("part").alias("digest"), "section_ord", "chunk_index"
    )


@R.add(
    "c9_linked_chunks",
    pack_sql(
        """SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index, sha256(document_id || '|' || chunk_index) AS chunk_id,
      lag(sha256(document_id || '|' || chunk_index)) OVER o AS previous_chunk_id,
      lead(sha256(document_id || '|' || chunk_index)) OVER o AS next_chunk_id
    FROM chunked WINDOW o AS (PARTITION BY document_id ORDER BY chunk_index)"""
    ),
)
def c9(spark, sf):
    return ch.link_chunks(stored(spark, sf)).select(
        "document_id", "chunk_index", "chunk_id", "previous_chunk_id", "next_chunk_id"
    )


FIRST_SQL = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY document_id, chunk_index) AS rn,
  count(*) OVER (PARTITION BY content_hash) AS copies
  FROM (SELECT CAST(doc_id AS VARCHAR) AS document_id, 0 AS chunk_index, sha256(text) AS content_hash FROM documents)) WHERE rn = 1"""


def hashed(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.lit(0).alias("chunk_index"),
        content_hash("text").alias("content_hash"),
    )


@R.add("c10_dedup_chunks", f"SELECT 'c' || document_id AS chunk_id, content_hash FROM ({FIRST_SQL})")
def c10(spark, sf):
    return ch.dedup_chunks(hashed(spark, sf)).select("chunk_id", "content_hash")


@R.add(
    "c10_duplicate_report",
    f"SELECT content_hash, copies, 'c' || document_id AS kept_chunk_id FROM ({FIRST_SQL}) WHERE copies > 1",
)
def c10_report(spark, sf):
    return ch.duplicate_report(hashed(spark, sf))


# ---- embedding ---------------------------------------------------------------------------

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


class LetterProvider:
    """A model small enough to check by hand: how often each letter occurs. Fails on '%'."""

    model_id = "letters"
    dimensions = 26

    def load(self):
        def model(texts: list[str]) -> list[list[float]]:
            if any("%" in t for t in texts):
                raise ValueError("unsupported character")
            low = [t.lower() for t in texts]
            return [[float(t.count(a)) for a in ALPHABET] for t in low]

        return model


LETTERS_SQL = "[" + ", ".join(f"(length(t) - length(replace(t, '{a}', '')))" for a in ALPHABET) + "]"


@R.add(
    "e1_embed_batches",
    f"""SELECT doc_id, CASE WHEN contains(t, '%') THEN 'unsupported character' END AS embedding_error,
      CASE WHEN NOT contains(t, '%') THEN array_to_string({LETTERS_SQL}, ',') END AS vector
    FROM (SELECT doc_id, lower(text) AS t FROM documents)""",
)
def e1(spark, sf):
    out = em.embed(table(spark, sf, "documents").select("doc_id", "text"), "text", LetterProvider())
    ints = F.transform("embedding", lambda x: x.cast("int").cast("string"))
    return out.select("doc_id", "embedding_error", F.array_join(ints, ",").alias("vector"))


@R.add(
    "e4_failed_embeddings",
    """SELECT doc_id, 'unsupported character' AS embedding_error FROM documents WHERE contains(text, '%')""",
)
def e4(spark, sf):
    """Texts the model fails on; the others of their batches keep their vectors."""
    out = em.embed(table(spark, sf, "documents").select("doc_id", "text"), "text", LetterProvider())
    return out.where(F.col("embedding").isNull()).select("doc_id", "embedding_error")


@R.add(
    "e2_query_embedding",
    f"""SELECT item_id, CASE WHEN len(w) > 0 THEN 256 END AS dims, CASE WHEN len(w) > 0 THEN 1.0::DOUBLE END AS length
    FROM (SELECT item_id, {lexemes_sql('text', 'simple')} AS w FROM benchmark)""",
)
def e2(spark, sf):
    """Every benchmark passage through the default provider, the same as the chunks use."""
    from scholion.functions.vectors import norm

    q = em.hashing_embed(table(spark, sf, "benchmark"), "text", 256)
    return q.select(
        "item_id", F.size("embedding").alias("dims"),
        F.round(norm(F.col("embedding").cast("array<double>")), 4).alias("length"),
    )


@R.add(
    "e3_cut_texts",
    "SELECT doc_id, sha256(text) AS digest, length(text) AS n, sha256(substring(text, 1, 1000)) AS short FROM documents",
)
def e3(spark, sf):
    """The text a model is handed: whole by default, cut where the model has a limit."""
    whole = em.cut(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2(whole, 256).alias("digest"), F.length(whole).cast("long").alias("n"),
        F.sha2(em.cut(F.col("text"), 1000), 256).alias("short"),
    )


@R.add(
    "e5_normalise",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(n, lambda x: x * x))), 6) AS length, round(n[1], 6) AS first,
      round(n[64], 6) AS last FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS n
      FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + label)) AS v FROM embeddings))""",
)
def e5(spark, sf):
    from scholion.functions.vectors import norm

    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label")))
    n = table(spark, sf, "embeddings").select("vec_id", normalise(scaled).alias("n"))
    return n.select(
        "vec_id", F.round(norm(F.col("n")), 6).alias("length"),
        F.round(F.element_at("n", 1), 6).alias("first"), F.round(F.element_at("n", 64), 6).alias("last"),
    )


@R.add(
    "e6_fit_dimensions",
    """SELECT vec_id, 1536 AS wide, 16 AS narrow, round(list_sum(embedding::DOUBLE[]), 6) AS wide_sum,
      round(list_sum(list_slice(embedding::DOUBLE[], 1, 16)), 6) AS narrow_sum FROM embeddings""",
)
def e6(spark, sf):
    def total(v):
        return F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6)

    e = table(spark, sf, "embeddings")
    v = e.select(
        "vec_id", fit_dimensions(F.col("embedding"), em.WIDTH).alias("w"),
        fit_dimensions(F.col("embedding"), 16).alias("n"),
    )
    return v.select(
        "vec_id", F.size("w").alias("wide"), F.size("n").alias("narrow"),
        total("w").alias("wide_sum"), total("n").alias("narrow_sum"),
    )


@R.add(
    "e7_stale_embeddings",
    with_sql(
        CHUNKS,
        select="""SELECT c.chunk_id FROM chunks c LEFT JOIN embeddings e ON c.document_id = CAST(e.vec_id AS VARCHAR)
WHERE c.embedding IS NULL OR e.label % 3 <> 0 OR e.label % 2 = 1""",
    ),
)
def e7(spark, sf):
    """Vectors count as made by model m0..m2 in version 1 or 2, by label; current is m0 version 2."""
    label = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("document_id"), "label")
    made = chunks(spark, sf).join(label, "document_id", "left").select(
        "chunk_id", "embedding",
        F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("embedding_model_id"),
        (2 - F.col("label") % 2).alias("embedding_version"),
    )
    return em.stale_embeddings(made, "m0", 2).select("chunk_id")


@R.add(
    "e1_hashing_embed",
    f"""SELECT doc_id, CASE WHEN len(w) > 0 THEN 256 END AS dims, CASE WHEN len(w) > 0 THEN 1.0::DOUBLE END AS length
    FROM (SELECT doc_id, {lexemes_sql('text', 'simple')} AS w FROM documents)""",
)
def e1_hashing(spark, sf):
    """The offline default over all texts: width and unit length."""
    from scholion.functions.vectors import norm

    v = em.hashing_embed(table(spark, sf, "documents").select("doc_id", "text"), "text", 256)
    return v.select(
        "doc_id", F.size("embedding").alias("dims"),
        F.round(norm(F.col("embedding").cast("array<double>")), 4).alias("length"),
    )

"""Keyword search: postings, all-terms matching, BM25 ranking, top-k.

Work per query is driven by its rarest term: a term found in a third of all chunks is never
expanded unless every term of the query is that common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.functions.text import fold, kept_tokens, lexemes
from scholion.operators.asked import Asked, ask, page_of
from scholion.operators.filters import filter_predicate, visible_side, with_filter_columns
from scholion.operators.vocabulary import stem_table, stemmed, stemmed_in_parts
from scholion.session import dealt_by, persist_shared, small_side

# BM25 parameters (Robertson & Zaragoza 2009).
K1, B = 1.2, 0.75
SCORE_DECIMALS = 9
TERM_BUCKETS = 256


def query_terms(queries: DataFrame, conf: str = "english") -> DataFrame:
    """(query_id, term), distinct; a query without lexemes gives no row and matches nothing."""
    if conf == "stem":
        return stemmed(query_terms(queries, "stop")).distinct()
    found = F.array_distinct(lexemes(F.coalesce("query_text", F.lit("")), conf))
    return queries.select("query_id", F.explode_outer(found).alias("term")).where(
        F.col("term").isNotNull()
    )


def term_stream(
    chunks: DataFrame, conf: str = "english", text_col: str = "content", length_col: str | None = None
) -> DataFrame:
    """One row per token: chunk_id, document_id, dl (chunk length), term; and _part, where texts were dealt."""
    ids = [*(["_part"] if "_part" in chunks.columns else []), "chunk_id", "document_id"]
    kept = chunks.select(
        *ids,
        kept_tokens(F.coalesce(F.col(text_col), F.lit("")), conf).alias("kept"),
        *([F.col(length_col).alias("dl")] if length_col else []),
    )
    if not length_col:
        kept = kept.select(*ids, "kept", F.size("kept").alias("dl"))
    # Folding after the explode keeps it inside generated code.
    # The outer form keeps Spark from adding a size test that would tokenise the text twice.
    return (
        kept.select(*ids, "dl", F.explode_outer("kept").alias("t"))
        .where(F.col("t").isNotNull())
        .select(*ids, "dl", fold(F.col("t"), conf).alias("term"))
    )


def _counted(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(*tokens.columns).agg(F.count("*").alias("tf"))


def _summed(words: DataFrame) -> DataFrame:
    """Postings of stems from those of words."""
    return words.groupBy("chunk_id", "document_id", "dl", "term").agg(F.sum("tf").alias("tf"))


def build_postings(
    chunks: DataFrame, conf: str = "english", text_col: str = "content", length_col: str | None = None
) -> DataFrame:
    """term, chunk_id, document_id, tf, dl. Texts are dealt by chunk and counted there; no word is shuffled."""
    named = {"chunk_id", "document_id", text_col} | ({length_col} if length_col else set())
    texts = dealt_by(chunks.select(*sorted(named)), "chunk_id", text_col)
    if conf == "stem":
        words = _counted(term_stream(texts, "stop", text_col, length_col))
        found = stemmed_in_parts(words).groupBy(*words.columns[:-1]).agg(F.sum("tf").alias("tf"))
    else:
        found = _counted(term_stream(texts, conf, text_col, length_col))
    return found.drop("_part")


def term_bucket(term: Column, buckets: int = TERM_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def with_term_bucket(df: DataFrame, buckets: int = TERM_BUCKETS) -> DataFrame:
    return df.withColumn("term_bucket", term_bucket(F.col("term"), buckets))


def build_lengths(
    chunks: DataFrame, conf: str = "english", text_col: str = "content", length_col: str | None = None
) -> DataFrame:
    """chunk_id, document_id, dl of every chunk: what ranking needs beside the postings."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.col(length_col) if length_col else F.size(kept_tokens(text, conf))
    return chunks.select("chunk_id", "document_id", length.alias("dl"))


def write_index(
    chunks: DataFrame, path: str, conf: str = "english", buckets: int = TERM_BUCKETS
) -> None:
    """Postings and lengths below path; read_index gives them to any number of searches."""
    write_postings(build_postings(chunks, conf), f"{path}/postings", buckets)
    build_lengths(chunks, conf).write.parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The stored index, as options of keyword_search and hybrid_search."""
    return {
        "postings": spark.read.parquet(f"{path}/postings"),
        "lengths": spark.read.parquet(f"{path}/lengths"),
    }


def write_postings(postings: DataFrame, path: str, buckets: int = TERM_BUCKETS) -> None:
    """Postings partitioned by a hash of the term, sorted by term inside each file.

    A search prunes to the hash values of its terms and skips row groups by term. AQE splits
    the partition of a very common term.
    """
    (
        with_term_bucket(postings, buckets)
        .hint("rebalance", "term_bucket")
        .sortWithinPartitions("term_bucket", "term")
        .write.partitionBy("term_bucket")
        .parquet(path)
    )


def corpus_stats(lengths: DataFrame, seen: DataFrame) -> DataFrame:
    """One row: number of visible chunks and their average length."""
    return (
        lengths.select("document_id", "dl")
        .join(seen, "document_id", "left_semi")
        .agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    )


def _scanned(
    chunks: DataFrame, vocabulary: DataFrame, seen: DataFrame, conf: str, text_col: str, length_col: str | None
) -> DataFrame:
    """One stored row for each visible chunk: ids, dl, filter columns and its counts of the vocabulary's terms.

    Texts are read once and dealt by chunk, so that words are counted where they stand. An empty term
    stands for each chunk itself, so that chunks without a term of the vocabulary have a row too.
    """
    named = {"chunk_id", "document_id", text_col} | ({length_col} if length_col else set())
    texts = dealt_by(chunks.select(*sorted(named)), "chunk_id", text_col)
    ids = ["_part", "chunk_id", "document_id", "dl"]
    kept = texts.withColumn("kept", kept_tokens(F.coalesce(F.col(text_col), F.lit("")), conf))
    kept = kept.withColumn("dl", F.col(length_col) if length_col else F.size("kept"))
    tokens = kept.select(*ids, F.explode(F.concat(F.array(F.lit("")), "kept")).alias("t")).select(
        *ids, fold(F.col("t"), conf).alias("term")
    )
    wanted = vocabulary.unionByName(vocabulary.sparkSession.createDataFrame([("",)], "term string"))
    counted = _counted(tokens.join(F.broadcast(wanted), "term", "left_semi"))
    rows = counted.groupBy(*ids).agg(F.collect_list(F.struct("term", "tf")).alias("tfs"))
    rows = rows.withColumn("tfs", F.filter("tfs", lambda t: t["term"] != "")).drop("_part")
    stored = persist_shared(rows.join(seen, "document_id"), "postings")
    copies = stored.where(F.size("tfs") > 0).groupBy("chunk_id", "document_id", "dl").count()
    if not copies.where("count > 1").isEmpty():
        raise ValueError("a chunk's document is listed more than once")
    return stored


def keyword_matches(
    queries: DataFrame | Asked,
    chunks: DataFrame,
    docs: DataFrame,
    conf: str = "english",
    rank_fn: str = "bm25",
    text_col: str = "content",
    length_col: str | None = None,
    postings: DataFrame | None = None,
    term_buckets: int = TERM_BUCKETS,
    seen: DataFrame | None = None,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """Every (query, chunk) where all query terms occur, filters applied, with its rank score.

    With a stored index (postings and lengths) no text is read; without one, texts are read and
    tokenised once, and what the queries' terms need of them is stored.
    """
    asked = ask(queries)
    hint = asked.hint
    seen = visible_side(docs) if seen is None else seen
    terms = query_terms(asked.queries, conf)
    vocabulary = terms.select("term").distinct()
    held = None
    if postings is None and conf == "stem":
        # Of all distinct words, those with a stem that is asked for; only they are counted.
        kept = term_stream(chunks, "stop", text_col, length_col)
        table = persist_shared(
            stem_table(kept).join(hint(vocabulary.withColumnRenamed("term", "stem")), "stem", "left_semi"), "stems"
        )
        wanted = small_side(table.select("term"))
        found = _summed(stemmed(_counted(kept.join(wanted, "term", "left_semi")), table))
    elif postings is None and asked.frame is not None:
        held = _scanned(chunks, vocabulary, seen, conf, text_col, length_col)
        lengths = held.select("chunk_id", "document_id", "dl").distinct()
    elif postings is None:
        tokens = term_stream(chunks, conf, text_col, length_col)
        found = _counted(tokens.join(vocabulary, "term", "left_semi"))
    else:
        found = postings.join(hint(vocabulary), "term", "left_semi")
        if "term_bucket" in postings.columns:
            keyed = with_term_bucket(vocabulary, term_buckets)
            found = postings.join(hint(keyed), ["term_bucket", "term"], "left_semi")
    chunk = ["chunk_id", "document_id", "dl", "journal", "article_type", "publication_date"]
    if held is not None:
        found = held.select(F.explode("tfs").alias("t")).select("t.*")
        per_chunk = held.where(F.size("tfs") > 0).select(*chunk, F.map_from_entries("tfs").alias("tfs"))
    else:
        found = found.select("chunk_id", "document_id", "dl", "term", "tf").join(seen, "document_id")
        per_chunk = found.groupBy(*chunk).agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tfs"))
    # tf is read here too, so both uses of `found` share one exchange.
    df = found.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    if lengths is None:
        lengths = build_lengths(chunks, conf, text_col, length_col)
    stats = corpus_stats(lengths, seen).select(F.struct("n", "avg_dl").alias("s")).scalar()
    idf = F.log(1 + (stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    plans = (
        terms.join(df, "term", "left")
        .withColumn("idf", idf)
        .groupBy("query_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("terms"),
            F.min_by("term", F.struct("df", "term")).alias("term"),
            F.count_if(F.col("df").isNull()).alias("missing"),
        )
        .where("missing = 0")
        .drop("missing")
    )
    filters = with_filter_columns(asked.queries).select(
        "query_id", "date_from", "date_to", "journals", "article_types"
    )
    plans = plans.join(hint(filters), "query_id")
    by_term = per_chunk.select("*", F.explode(F.map_keys("tfs")).alias("term"))
    matched = by_term.join(hint(plans), "term").where(
        F.forall("terms", lambda t: F.map_contains_key("tfs", t["term"]))
        & filter_predicate(
            F.col("date_from"), F.col("date_to"), F.col("journals"), F.col("article_types")
        )
    )
    damp = K1 * (1 - B + B * F.col("dl") / stats["avg_dl"])
    return matched.withColumn("damp", damp).select(
        "query_id",
        "chunk_id",
        "document_id",
        F.round(_score(rank_fn), SCORE_DECIMALS).alias("keyword_score"),
    )


def _score(rank_fn: str) -> Column:
    def tf(t: Column) -> Column:
        return F.element_at("tfs", t["term"]).cast("double")

    if rank_fn == "tf":
        part = lambda t: 1 + F.log(tf(t))
    elif rank_fn == "bm25":
        part = lambda t: t["idf"] * tf(t) * (K1 + 1) / (tf(t) + F.col("damp"))
    else:
        raise ValueError(f"unknown rank function {rank_fn!r}")
    return F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + part(t))


def keyword_topk(matches: DataFrame, depth: int) -> DataFrame:
    """Best depth matches per query; per task only that many are shuffled."""
    order = Window.partitionBy("query_id").orderBy(F.desc("keyword_score"), "chunk_id")
    return matches.withColumn("keyword_rank", F.row_number().over(order)).where(
        F.col("keyword_rank") <= depth
    )


def keyword_search(
    queries: DataFrame | Asked,
    chunks: DataFrame,
    docs: DataFrame,
    k: int = 10,
    offset: int = 0,
    **options,
) -> DataFrame:
    """One page of keyword hits per query: ids, score and rank only."""
    asked = ask(queries)
    hits = keyword_topk(keyword_matches(asked, chunks, docs, **options), asked.depth(k, offset))
    return page_of(hits, asked, "keyword_rank", k, offset).withColumn(
        "score", F.col("keyword_score")
    )


def match_totals(matches: DataFrame) -> DataFrame:
    """How many chunks match each query in all, beyond the page that is returned."""
    return matches.groupBy("query_id").agg(F.count("*").alias("total_matches"))


def document_keyword_search(
    queries: DataFrame, docs: DataFrame, k: int = 10, offset: int = 0, **options
) -> DataFrame:
    """Full text over title and abstract instead of chunks."""
    text = F.concat_ws(" ", F.col("title"), F.coalesce("abstract", F.lit("")))
    as_chunks = docs.select(
        F.col("document_id").alias("chunk_id"), "document_id", text.alias("content")
    )
    return keyword_search(queries, as_chunks, docs, k, offset, **options).drop("chunk_id")

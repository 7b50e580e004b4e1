"""Question contexts: numbered excerpts, citations, prompts, confidence, request records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import capitalize, nullif_empty

# Texts and limits of the prompt.
SEPARATOR = "\n\n---\n\n"
NO_HITS = (
    "I couldn't find any relevant information in the knowledge base to answer your question."
)
INSTRUCTION = (
    "Please answer the question based on the provided excerpts. "
    "Include citation numbers [1], [2], etc. for any claims you make."
)
PROMPT_TURNS, HISTORY_TURNS = 5, 10
FULL_DIVERSITY, FULL_CHUNKS = 3, 5


def _excerpt(r: Column, i: Column) -> Column:
    section = F.concat(F.lit(" - "), nullif_empty(r["section_title"]))
    doi = F.concat(F.lit(" (DOI: "), nullif_empty(r["doi"]), F.lit(")"))
    return F.concat(
        F.lit("Source ["), (i + 1).cast("string"), F.lit("]: "), r["title"],
        F.coalesce(section, F.lit("")), F.coalesce(doi, F.lit("")), F.lit("\n"), r["content"],
    )


def build_context(results: DataFrame) -> DataFrame:
    """Per query: context text, citations in the same numbering, chunks used, confidence.

    results holds at most the page's k rows per query, so the collected group is bounded.
    """
    row = F.struct(
        "rank", "chunk_id", "document_id", "title", "section_title", "doi", "pmcid", "content", "score"
    )
    grouped = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), *_confidence_parts()
    )
    citations = F.transform(
        "rows",
        lambda r, i: F.struct(
            (i + 1).alias("number"),
            r["chunk_id"].alias("chunk_id"),
            r["document_id"].alias("document_id"),
            r["title"].alias("title"),
            r["doi"].alias("doi"),
            r["pmcid"].alias("pmcid"),
            r["score"].alias("relevance_score"),
        ),
    )
    return grouped.select(
        "query_id",
        F.array_join(F.transform("rows", _excerpt), SEPARATOR).alias("context"),
        citations.alias("citations"),
        F.size("rows").alias("chunks_used"),
        _confidence_value().alias("confidence"),
    )


def _confidence_parts() -> list[Column]:
    return [
        F.avg("score").alias("_avg"),
        F.size(F.collect_set("document_id")).alias("_docs"),
        F.count("*").alias("_n"),
    ]


def _confidence_value() -> Column:
    one = F.lit(1.0)
    raw = (
        F.col("_avg") * 0.5
        + F.least(F.col("_docs") / FULL_DIVERSITY, one) * 0.3
        + F.least(F.col("_n") / FULL_CHUNKS, one) * 0.2
    )
    return F.least(F.greatest(raw, F.lit(0.0)), one)


def confidence(results: DataFrame) -> DataFrame:
    """Average score, document spread and hit count as one number in [0, 1].

    Fused scores are at most 1/61, which caps the confidence of a fused search near 0.508.
    """
    return (
        results.groupBy("query_id")
        .agg(*_confidence_parts())
        .select("query_id", _confidence_value().alias("confidence"))
    )


def recent_turns(conversations: DataFrame, n: int = HISTORY_TURNS, exclude_last: bool = True) -> DataFrame:
    """Turns before the current one, among the last n entries of each conversation.

    A top-n per conversation: each task passes on at most n rows of it.
    """
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    ranked = conversations.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)
    return ranked.where(F.col("back") > 1) if exclude_last else ranked


def history_text(turns: DataFrame, n: int = PROMPT_TURNS) -> DataFrame:
    """The last n of the given turns as 'Role: text' lines, oldest first."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.withColumn("_b", F.row_number().over(order)).where(F.col("_b") <= n)
    line = F.concat(capitalize(F.coalesce("role", F.lit("user"))), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = last.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("rows")
    )
    return rows.select(
        "conv_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("history")
    )


def build_prompt(query: Column, context: Column, history: Column) -> Column:
    """History (if any), excerpts, question, instruction: one line each, blank lines between."""
    parts = F.concat(
        F.when(
            history.isNotNull(), F.array(F.lit("Previous conversation:"), history, F.lit(""))
        ).otherwise(F.array().cast("array<string>")),
        F.array(
            F.lit("Research paper excerpts:"), context, F.lit(""),
            F.concat(F.lit("Question: "), query), F.lit(""), F.lit(INSTRUCTION),
        ),
    )
    return F.array_join(parts, "\n")


def rag_requests(
    queries: DataFrame,
    results: DataFrame,
    history: DataFrame | None = None,
    simple_model: str = "simple",
    complex_model: str = "complex",
) -> DataFrame:
    """One generation request per query; a query without hits gets the fixed answer instead."""
    flag = F.col("use_complex_model") if "use_complex_model" in queries.columns else F.lit(False)
    asked = queries.select(
        "query_id",
        "query_text",
        F.coalesce(flag, F.lit(False)).alias("_complex"),
        *(["conv_id"] if "conv_id" in queries.columns else []),
    )
    out = asked.join(build_context(results), "query_id", "left")
    if history is not None:
        out = out.join(history, "conv_id", "left")
    else:
        out = out.withColumn("history", F.lit(None).cast("string"))
    found = F.col("context").isNotNull()
    citation_type = (
        "array<struct<number:int,chunk_id:string,document_id:string,title:string,doi:string,"
        "pmcid:string,relevance_score:double>>"
    )
    return out.select(
        "query_id",
        "query_text",
        F.when(found, build_prompt(F.col("query_text"), F.col("context"), F.col("history"))).alias("prompt"),
        F.when(~found, F.lit(NO_HITS)).alias("answer"),
        F.coalesce("citations", F.array().cast(citation_type)).alias("citations"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("chunks_used", F.lit(0)).alias("chunks_used"),
        F.when(found & F.col("_complex"), F.lit(complex_model))
        .otherwise(F.lit(simple_model))
        .alias("model"),
    )

"""Corpus manifest: one JSON object with an array of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAPER = (
    "STRUCT<filename:STRING,pmcid:STRING,title:STRING,authors:ARRAY<STRING>,doi:STRING,"
    "journal:STRING,pub_date:STRING,abstract:STRING>"
)
MANIFEST = f"download_date STRING, source STRING, papers ARRAY<{PAPER}>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per paper of the manifest."""
    return explode_papers(spark.read.schema(MANIFEST).json(path, multiLine=True))


def explode_papers(manifest: DataFrame) -> DataFrame:
    return manifest.select("download_date", "source", F.explode("papers").alias("p")).select(
        "download_date", "source", "p.*"
    )


def date_parts(year: Column, month: Column, day: Column) -> Column:
    """Present parts joined by '-', month and day padded to two digits."""

    def part(c: Column, pad: bool) -> Column:
        text = F.when(F.length(c) > 0, c)
        return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text) if pad else text

    return F.concat_ws("-", part(year, False), part(month, True), part(day, True))


def cut_abstract(text: Column, max_chars: int | None = None) -> Column:
    """The abstract, cut with dots behind it only if a length is asked for."""
    whole = F.coalesce(text, F.lit(""))
    if max_chars is None:
        return whole
    return F.when(
        F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("..."))
    ).otherwise(whole)


def manifest_rows(parsed: DataFrame, abstract_chars: int | None = None) -> DataFrame:
    """Parsed documents as manifest papers."""
    from scholion.functions.present import author_names

    d = F.col("publication_date")
    return parsed.select(
        F.concat(F.coalesce("pmcid", "document_id"), F.lit(".xml")).alias("filename"),
        "pmcid",
        "title",
        author_names(F.col("authors")).alias("authors"),
        "doi",
        "journal",
        date_parts(
            F.year(d).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string")
        ).alias("pub_date"),
        cut_abstract(F.col("abstract"), abstract_chars).alias("abstract"),
    )

"""Article-XML scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators.articles import SHAPE_DDL, article_elements


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """One row per article element with attributes and nested elements.

    Splits large files between tasks; a file need not fit one row.
    """
    return (
        spark.read.format("xml")
        .option("rowTag", "article")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_broken")
        .schema(SHAPE_DDL)
        .load(path)
    )


def explode_articles(raw: DataFrame) -> DataFrame:
    """Raw objects into one row per contained article, keyed object_key#n."""
    xml = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select(
        "object_key", F.posexplode(article_elements(xml)).alias("n", "content")
    ).select(
        F.concat("object_key", F.lit("#"), "n").alias("object_key"),
        F.concat(F.lit('<?xml version="1.0"?>'), "content").cast("binary").alias("content"),
    )

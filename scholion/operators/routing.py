"""Format routing and the quarantine split."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREVIEW_BYTES = 200


def _head(content: Column, n: int) -> Column:
    return F.make_valid_utf8(F.substring(content, 1, n).cast("string"))


def is_article_xml(content: Column, filename: Column | None = None) -> Column:
    # The whole object is looked at: a long prolog or comment may stand before the root.
    text = F.lower(F.make_valid_utf8(content.cast("string")))
    return text.contains("<?xml") & (text.contains("pmc-articleset") | text.contains("<article"))


def is_pdf(content: Column, filename: Column | None = None) -> Column:
    magic = F.substring(content, 1, 4) == F.lit(b"%PDF")
    if filename is None:
        return magic
    return magic | F.coalesce(F.lower(filename).endswith(".pdf"), F.lit(False))


@dataclass(frozen=True)
class Parser:
    """A named parser: which rows it takes and how it turns them into parsed rows."""

    name: str
    accepts: Callable[[Column, Column | None], Column]
    parse: Callable[[DataFrame], DataFrame] | None = None


DEFAULT_FORMATS = (Parser("article_xml", is_article_xml), Parser("pdf", is_pdf))


def sniff_format(
    content: Column, filename: Column | None = None, formats=DEFAULT_FORMATS
) -> Column:
    """Name of the first format that accepts the content, NULL if none does."""
    chain = F.lit(None).cast("string")
    for fmt in reversed(formats):
        chain = F.when(fmt.accepts(content, filename), F.lit(fmt.name)).otherwise(chain)
    return chain


def preview(content: Column) -> Column:
    return _head(content, PREVIEW_BYTES)


def split_valid(df: DataFrame, key: str = "object_key") -> tuple[DataFrame, DataFrame]:
    """Rows without a reason go on; the others become quarantine rows, the batch continues."""
    ok = df.where(F.col("reason").isNull()).drop("reason")
    details = (
        F.create_map(F.lit("content_preview"), F.col("preview"))
        if "preview" in df.columns
        else F.create_map().cast("map<string,string>")
    )
    bad = df.where(F.col("reason").isNotNull()).select(
        F.col(key).alias("object_key"),
        "reason",
        details.alias("details"),
        F.lit(1).alias("attempts"),
        F.current_timestamp().alias("ts"),
    )
    return ok, bad


def route(raw: DataFrame, parsers: list[Parser]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Run each row through the first parser that takes it; unmatched rows are quarantined."""
    name = F.col("object_key") if "object_key" in raw.columns else None
    tagged = raw.withColumn("format", sniff_format(F.col("content"), name, parsers))
    parsed = {
        p.name: p.parse(tagged.where(F.col("format") == p.name).drop("format"))
        for p in parsers
        if p.parse is not None
    }
    runnable = list(parsed)
    unmatched = tagged.where(F.col("format").isNull() | ~F.col("format").isin(runnable))
    _, bad = split_valid(
        unmatched.select(
            "object_key",
            F.lit("no parser takes this object").alias("reason"),
            preview(F.col("content")).alias("preview"),
        )
    )
    return parsed, bad

"""Raw objects: whole-file scans, listings and the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE_SCHEMA = "object_key STRING, content_type STRING, metadata MAP<STRING,STRING>, content BINARY"


def read_raw(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per object: object_key, modified_at, length, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        F.col("path").alias("object_key"),
        F.col("modificationTime").alias("modified_at"),
        "length",
        "content",
    )


def list_objects(raw: DataFrame, prefix: str = "", max_keys: int | None = None) -> DataFrame:
    """Keys below a prefix, or the first max_keys of them in key order; content is never read."""
    found = raw.select("object_key", "modified_at", "length").where(
        F.col("object_key").startswith(prefix)
    )
    return found if max_keys is None else found.orderBy("object_key").limit(max_keys)


def object_exists(raw: DataFrame, keys: DataFrame) -> DataFrame:
    """Each asked key with its length, modification time and whether it is there."""
    found = raw.select("object_key", "modified_at", "length")
    return keys.select("object_key").join(found, "object_key", "left").withColumn(
        "found", F.col("length").isNotNull()
    )


def allowed_paths(df: DataFrame, bases: list[str], path_col: str = "object_key") -> DataFrame:
    """Paths without '..' that lie below one of the base folders."""
    path = F.col(path_col)
    below = F.lit(False)
    for base in bases:
        clean = base.rstrip("/")
        below = below | (path == clean) | path.startswith(clean + "/")
    return df.where(~path.contains("..") & below)


def archive_key(document_id: Column) -> Column:
    return F.concat(F.lit("documents/"), document_id, F.lit(".xml"))


def to_archive(df: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Archive rows for contents that have no key yet and are not archived already."""
    if "object_key" in df.columns:
        df = df.where(F.col("object_key").isNull()).drop("object_key")
    new = df.select(
        archive_key(F.col("document_id")).alias("object_key"),
        F.lit("application/xml").alias("content_type"),
        F.create_map(F.lit("document_id"), F.col("document_id")).alias("metadata"),
        F.col("content").cast("binary").alias("content"),
    )
    if existing is not None:
        new = new.join(existing.select("object_key"), "object_key", "left_anti")
    return new


def archive_raw(df: DataFrame, path: str) -> DataFrame:
    """Append the missing contents to the archive table and return what was added."""
    spark = df.sparkSession
    try:
        existing = spark.read.schema(ARCHIVE_SCHEMA).parquet(path)
        existing.schema  # resolved lazily; a missing path raises here
    except Exception as error:  # noqa: BLE001 - only a missing table means "nothing archived"
        if "PATH_NOT_FOUND" not in str(error):
            raise
        existing = None
    new = to_archive(df, existing)
    new.write.mode("append").parquet(path)
    return new


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Already fetched pages: source_url and content, keyed by url."""
    return spark.read.parquet(path).select(
        F.col("url").alias("source_url"),
        F.col("url").alias("object_key"),
        F.col("html").cast("binary").alias("content"),
    )

"""Draining a streaming plan into files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholion.session import scratch_path


def read_table_stream(
    spark: SparkSession, folder: str, file: str, files_per_batch: int = 64
) -> DataFrame:
    """A given Parquet table as a stream of its files, a bounded number in each micro-batch."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{file}").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file)
        .option("recursiveFileLookup", "false")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def drain(stream: DataFrame, label: str, output_mode: str = "append") -> DataFrame:
    """Process everything available, write it to the shared folder and read it back.

    The file sink commits per batch, so a batch repeated after a failure is not doubled.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, f"{label}-state"))
        .outputMode(output_mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

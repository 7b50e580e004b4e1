"""Bounded samples of labelled rows, chosen by the hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


LEVELS = 64


def stratified(rows: DataFrame, key: str, by: str, per_value: int) -> DataFrame:
    """At most per_value rows of each value of `by`, as (key, by), the same in every run.

    The cut is a rank, which each task applies to its own rows before anything is shuffled. It is taken in two
    levels, so that the rows of one value meet in LEVELS tasks first and at most LEVELS * per_value of them in one,
    however many tasks there were.
    """
    order = (F.xxhash64(key), F.col(key))
    level = F.pmod(F.xxhash64(F.lit("level"), key), F.lit(LEVELS))
    part = Window.partitionBy(by, "_level").orderBy(*order)
    whole = Window.partitionBy(by).orderBy(*order)
    few = (
        rows.select(key, by)
        .withColumn("_level", level)
        .withColumn("_rank", F.row_number().over(part))
        .where(F.col("_rank") <= per_value)
        .drop("_level", "_rank")
    )
    ranked = few.withColumn("_rank", F.row_number().over(whole))
    return ranked.where(F.col("_rank") <= per_value).drop("_rank")

"""Words and their stems: the stemmer runs once for each distinct word and is joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.functions.stemming import stems
from scholion.session import persist_shared, small_side


def stem_table(words: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of each distinct word of a column. Distinct words combine before the shuffle.

    The table is stored, so that no filter on a stem is taken into the stemmer's long expressions.
    """
    distinct = words.select(F.col(column).alias("term")).where(F.col("term").isNotNull()).distinct()
    return persist_shared(stems(distinct), "stems")


def stemmed(words: DataFrame, table: DataFrame | None = None, column: str = "term") -> DataFrame:
    """words with each word replaced by its stem; rows stay, those without a word go.

    The table is broadcast if it was measured to be small, else words and stems meet in a shuffle.
    """
    table = stem_table(words, column) if table is None else table
    known = small_side(table.withColumnRenamed("term", "_word"))
    return (
        words.join(known, F.col(column) == F.col("_word"))
        .withColumn(column, F.col("stem"))
        .drop("_word", "stem")
    )


def stemmed_in_parts(words: DataFrame, column: str = "term") -> DataFrame:
    """words, dealt by _part (session.dealt_by), with each word replaced by its stem, without a shuffle.

    The stemmer runs once for each distinct word of a part; rows stay in their parts.
    """
    rest = [c for c in words.columns if c not in (column, "_part")]
    held = words.groupBy("_part", column).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    return (
        stems(held, column, ("_part", "_rows"))
        .select("_part", "stem", F.explode("_rows").alias("_row"))
        .select("_part", F.col("stem").alias(column), "_row.*")
    )

"""Fuzzy title match by character trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import trigrams
from scholion.operators.asked import Asked, ask


def similarity(a, b):
    """Jaccard similarity of the trigram sets."""
    ta, tb = trigrams(a), trigrams(b)
    union = F.size(F.array_union(ta, tb))
    return F.when(union > 0, F.size(F.array_intersect(ta, tb)) / union)


PAIR_SCHEMA = "query_id string, title string, similarity double, documents long"
# Cells of each 0/1 matrix of one step: titles, or queries, times the queries' trigrams.
MATRIX_CELLS = 16_000_000


def title_similarity(
    queries: DataFrame | Asked, titles: DataFrame, threshold: float = 0.3
) -> DataFrame:
    """(query_id, title, similarity, documents) for titles at least threshold similar.

    Equal titles are matched once and carry their number of documents. Few queries are
    broadcast and compared with each batch of titles in one matrix product; only similar
    enough pairs leave the task. Many queries are joined on their rarest trigrams instead.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    distinct = (
        titles.groupBy("title")
        .agg(F.count("*").alias("documents"))
        .withColumn("grams", trigrams(F.col("title")))
    )
    known = ask(queries)
    if known.frame is None:
        return _joined(known.queries, distinct, threshold)
    wanted = known.queries.select("query_id", trigrams(F.col("query_text")).alias("grams"))
    return _compared(wanted.toPandas(), distinct, threshold)


def _compared(wanted: pd.DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    shared = distinct.sparkSession.sparkContext.broadcast(wanted)
    bound = Fraction(str(threshold))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = shared.value["query_id"].to_numpy()
        sets = shared.value["grams"].tolist()
        vocabulary = {g: i for i, g in enumerate(sorted({g for s in sets for g in s}))}
        width = max(1, len(vocabulary))
        step = max(1, MATRIX_CELLS // width)
        q_size = np.array([len(s) for s in sets], dtype=np.float64)

        def query_block(first: int) -> np.ndarray:
            block = sets[first : first + step]
            q = np.zeros((width, len(block)), dtype=np.float32)
            for j, s in enumerate(block):
                q[[vocabulary[g] for g in s], j] = 1
            return q

        only = query_block(0) if len(sets) <= step else None
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step]
                size = part["grams"].map(len).to_numpy()
                at = pd.Series(np.concatenate(part["grams"].tolist())).map(vocabulary).to_numpy()
                row = np.repeat(np.arange(len(part)), size)
                t = np.zeros((len(part), width), dtype=np.float32)
                hit = ~pd.isna(at)
                t[row[hit], at[hit].astype(np.int64)] = 1
                for first in range(0, len(sets), step):
                    q = query_block(first) if only is None else only
                    common = (t @ q).astype(np.float64)
                    union = size[:, None] + q_size[None, first : first + step] - common
                    score = np.divide(common, union, out=np.zeros_like(common), where=union > 0)
                    i, j = np.nonzero((common * bound.denominator >= union * bound.numerator) & (common > 0))
                    yield pd.DataFrame(
                        {
                            "query_id": ids[first + j],
                            "title": part["title"].to_numpy()[i],
                            "similarity": score[i, j],
                            "documents": part["documents"].to_numpy()[i],
                        }
                    )

    return distinct.mapInPandas(run, PAIR_SCHEMA)


def _joined(queries: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """Two sets that similar share one of their rarest trigrams, so only those are joined
    (prefix filter), and sizes must be close; the survivors are compared exactly. All tests are
    between integers, as ceil(0.55 * 100) in floating point is 56."""
    bound = Fraction(str(threshold))
    top, low = F.lit(bound.numerator), F.lit(bound.denominator)
    distinct = distinct.withColumn("n", F.size("grams")).where("n > 0")
    asked = (
        queries.select("query_id", trigrams(F.col("query_text")).alias("q_grams"))
        .withColumn("qn", F.size("q_grams"))
        .where("qn > 0")
    )
    # Distinct trigrams, bounded by the alphabet.
    frequency = (
        distinct.select(F.explode_outer("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    )

    def rarest(df: DataFrame, key: list[str], grams: str, n: str) -> DataFrame:
        keep = F.col(n) - F.floor((top * F.col(n) + low - 1) / low) + 1
        order = Window.partitionBy(*key).orderBy(F.coalesce("df", F.lit(0)), "gram")
        return (
            df.select(*key, n, F.explode_outer(grams).alias("gram"))
            .join(frequency, "gram", "left")
            .withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= keep)
            .select(*key, n, "gram")
        )

    left = rarest(asked, ["query_id"], "q_grams", "qn")
    right = rarest(distinct, ["title"], "grams", "n")
    close = (low * F.col("qn") >= top * F.col("n")) & (low * F.col("n") >= top * F.col("qn"))
    pairs = (
        right.join(left, "gram").where(close).select("query_id", "title").distinct()
    )
    scored = (
        pairs.join(asked.select("query_id", "q_grams"), "query_id")
        .join(distinct.select("title", "documents", "grams"), "title")
        .withColumn("common", F.size(F.array_intersect("q_grams", "grams")))
        .withColumn("all", F.size("q_grams") + F.size("grams") - F.col("common"))
    )
    return scored.where(low * F.col("common") >= top * F.col("all")).select(
        "query_id", "title", (F.col("common") / F.col("all")).alias("similarity"), "documents"
    )

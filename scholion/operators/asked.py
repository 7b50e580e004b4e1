"""A query table together with what is known about its size."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.session import BROADCAST_BYTES

# At most this many queries are ever held in one piece; more are worked on in blocks.
MAX_QUERIES = 4096


@dataclass(frozen=True)
class Asked:
    """Queries, and their rows on the driver if they were proven few and small (else None)."""

    queries: DataFrame
    frame: pd.DataFrame | None

    def hint(self, df: DataFrame) -> DataFrame:
        """Broadcast a relation derived one-to-few from the queries, if those are small."""
        return F.broadcast(df) if self.frame is not None else df

    def only(self, condition: Column, keep: Callable[[pd.DataFrame], pd.Series]) -> Asked:
        """The queries fulfilling a condition, given for Spark and for the held rows."""
        frame = self.frame
        return Asked(
            self.queries.where(condition),
            None if frame is None else frame[keep(frame)].reset_index(drop=True),
        )

    def without(self, column: str) -> Asked:
        frame = self.frame
        return Asked(
            self.queries.drop(column),
            None if frame is None else frame.drop(columns=[column], errors="ignore"),
        )

    def depth(self, k: int, offset: int) -> int:
        """How deep the deepest page goes."""
        if "k" not in self.queries.columns:
            return k + offset
        if self.frame is not None:
            off = self.frame["off"].fillna(0) if "off" in self.frame else 0
            deepest = (self.frame["k"] + off).max()
            return 0 if pd.isna(deepest) else int(deepest)
        off = F.coalesce("off", F.lit(0)) if "off" in self.queries.columns else F.lit(0)
        return int(self.queries.agg(F.max(F.col("k") + off)).first()[0] or 0)

    def limits(self, k: int, offset: int) -> DataFrame:
        """query_id with its own page limits _k and _off."""
        have = self.queries.columns
        size = F.col("k") if "k" in have else F.lit(k)
        if "k" in have:
            off = F.coalesce("off", F.lit(0)) if "off" in have else F.lit(0)
        else:
            off = F.lit(offset)
        return self.hint(
            self.queries.select("query_id", size.alias("_k"), off.cast("int").alias("_off"))
        )


def ask(
    queries: DataFrame | Asked, max_rows: int = MAX_QUERIES, max_bytes: int = BROADCAST_BYTES
) -> Asked:
    """Look at no more than max_rows + 1 queries to learn whether they are few."""
    if isinstance(queries, Asked):
        return queries
    frame = queries.limit(max_rows + 1).toPandas()
    small = len(frame) <= max_rows and _bytes(frame) <= max_bytes
    return Asked(queries, frame if small else None)


def _bytes(frame: pd.DataFrame) -> int:
    total = int(frame.memory_usage(index=False, deep=True).sum())
    for column in frame.columns:
        first = frame[column].dropna().head(1)
        if len(first) and hasattr(first.iloc[0], "nbytes"):
            total += sum(getattr(v, "nbytes", 0) for v in frame[column])
    return total


def page_of(hits: DataFrame, asked: Asked, rank: str, k: int, offset: int) -> DataFrame:
    """Rows off+1 .. off+k of each query, numbered from 1 as rank."""
    if "k" not in asked.queries.columns:
        page = hits.where((F.col(rank) > offset) & (F.col(rank) <= offset + k))
        return page.withColumn("rank", (F.col(rank) - offset).cast("int"))
    return (
        hits.join(asked.limits(k, offset), "query_id")
        .where((F.col(rank) > F.col("_off")) & (F.col(rank) <= F.col("_off") + F.col("_k")))
        .withColumn("rank", (F.col(rank) - F.col("_off")).cast("int"))
        .drop("_k", "_off")
    )

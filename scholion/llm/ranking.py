"""Places in a total order over a whole table, without one task seeing it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.session import persist_shared, small_side

PART_BITS = 33


def with_row(df: DataFrame, label: str) -> DataFrame:
    """Store df with `row`, a number of its own for each row; equal rows stay apart by it."""
    return persist_shared(df.withColumn("row", F.monotonically_increasing_id()), label)


def numbered(stored: DataFrame, order: list[Column], within: tuple[str, ...] = (), label: str = "ranked") -> DataFrame:
    """stored (with `row`) and, for each row, `rank` (from 0 in its group, by order) and `n`, the group's rows.

    Rows are range-partitioned and sorted by group, order and row, so a crowded group or a crowded key
    spreads over as many partitions as it fills. Only the number of rows of each partition and group is
    summed up: a group's part in a partition begins where its parts in earlier ones end. A null is a
    group like another. An empty table gives an empty table.
    """
    groups = [F.col(c).asc_nulls_first() for c in within]
    placed = persist_shared(
        stored.orderBy(*groups, *order, "row").withColumn("_at", F.monotonically_increasing_id()), label
    ).withColumn("_part", F.shiftright("_at", PART_BITS))
    each = Window.partitionBy(*within)
    before = each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = persist_shared(
        placed.groupBy("_part", *within)
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
        .select(
            F.col("_part").alias("_p"),
            *[F.col(c).alias(f"_g_{c}") for c in within],
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_rows").over(each).alias("n"),
        ),
        label,
    )
    same = F.col("_part") == F.col("_p")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return placed.join(small_side(starts), same).select(
        *stored.columns, (F.col("_at") + F.col("_shift")).alias("rank"), "n"
    )

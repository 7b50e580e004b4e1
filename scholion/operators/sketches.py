"""Search statistics by period from stored sketches: any range is a merge, no raw row is read again.

An hour of a search type is one row: exact counts, sums and extremes, a quantile sketch of the latency and
a distinct-count sketch of the users. All of them merge, so days, weeks and late corrections are sums
of hours, and a range costs as many rows as it has hours, whatever happened in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sketch sizes: 2^LG_K registers (standard error about 1.04 / sqrt(2^LG_K)), and K items a level,
#: whose ranks are right within about RANK_ERROR.
LG_K, K = 12, 400
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.01


def hourly(history: DataFrame) -> DataFrame:
    """day, hour, search_type and the mergeable statistics of history (ts, search_type, user_id, latency_ms, result_count).

    Null latencies and users count as requests only; rows without a time are left out; a null type is a
    type like another. Sketches are built where the rows are, one for each hour and type moves.
    """
    latency = F.col("latency_ms").cast("double")
    return (
        history.where(F.col("ts").isNotNull())
        .groupBy(F.date_trunc("hour", "ts").alias("hour"), "search_type")
        .agg(
            F.count("*").alias("requests"),
            F.count("latency_ms").alias("timed"),
            F.sum(latency).alias("latency_sum"),
            F.max(latency).alias("latency_max"),
            F.sum(F.coalesce("result_count", F.lit(0))).alias("results"),
            F.count_if(F.col("result_count") == 0).alias("empty_results"),
            F.kll_sketch_agg_double(latency, K).alias("latency"),
            F.hll_sketch_agg(F.col("user_id").cast("string"), LG_K).alias("users"),
        )
        .withColumn("day", F.to_date("hour"))
    )


def write_hourly(history: DataFrame, path: str) -> None:
    """Store the hours of a batch, partitioned by day. A batch replaces the days that it holds."""
    hourly(history).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_hourly(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Stored hours from since (inclusive) until (exclusive), given as timestamps; days are pruned."""
    stored = spark.read.parquet(path)
    if since is not None:
        stored = stored.where((F.col("day") >= F.lit(since).cast("date")) & (F.col("hour") >= F.lit(since).cast("timestamp")))
    if until is not None:
        stored = stored.where((F.col("day") <= F.lit(until).cast("date")) & (F.col("hour") < F.lit(until).cast("timestamp")))
    return stored


def merged(hours: DataFrame, *by: str | Column, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The statistics of the hours put together, for each value of `by` (none: all of them).

    Counts, sums and extremes are exact; users is an estimate, latency_quantiles are ranks' estimates, null
    without any latency.
    """
    sketch = F.kll_merge_agg_double("latency", K)
    at = F.array(*map(F.lit, quantiles))
    return (
        hours.groupBy(*by)
        .agg(
            F.sum("requests").alias("requests"),
            F.sum("timed").alias("timed"),
            F.sum("latency_sum").alias("latency_sum"),
            F.max("latency_max").alias("max_latency_ms"),
            F.sum("results").alias("results"),
            F.sum("empty_results").alias("empty_results"),
            F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"),
            sketch.alias("latency"),
        )
        .withColumns(
            {
                "avg_latency_ms": F.col("latency_sum") / F.nullif(F.col("timed"), F.lit(0)),
                "avg_results": F.col("results") / F.col("requests"),
                "latency_quantiles": F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("latency", at)),
            }
        )
    )

"""Search statistics of a range of days, merged from stored hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.operators import sketches as sk
from scholion.plans.activity import pick
from scholion.plans.base import Registry, rounded, table
from scholion.session import scratch_path

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

HISTORY_SQL = """h AS (SELECT ts, (['vector', 'keyword', 'hybrid'])[CAST(user_id % 3 + 1 AS INTEGER)] AS search_type, user_id,
  CAST(floor(value * 100) AS INTEGER) AS l, event_id % 12 AS r FROM events)"""


def history(spark, sf):
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        pick(F.col("user_id"), "vector", "keyword", "hybrid").alias("search_type"),
        "user_id",
        F.floor(F.col("value") * 100).cast("int").alias("latency_ms"),
        (F.col("event_id") % 12).alias("result_count"),
    )


@R.add(
    "g9_analytics_by_period",
    f"""WITH {HISTORY_SQL}
    SELECT CAST(date_trunc('day', ts) AS VARCHAR)[:10] AS day, search_type, count(*) AS requests, max(l)::DOUBLE AS max_latency_ms,
      round(avg(l), 6) AS avg_latency_ms, count(*) FILTER (r = 0) AS empty_results, true AS users_near, true AS median_near
    FROM h GROUP BY 1, 2""",
)
def g9_by_period(spark, sf):
    """Each day's statistics from its hours; the estimates lie within their stated errors of the exact ones."""
    rows, path = history(spark, sf), scratch_path(spark, "hours")
    sk.write_hourly(rows, path)
    days = sk.merged(sk.read_hourly(spark, path), "day", "search_type", quantiles=(0.5,))
    day = F.to_date("ts").alias("day")
    exact = rows.groupBy(day, "search_type").agg(F.countDistinct("user_id").alias("exact_users"))
    bounds = rows.groupBy(day, "search_type").agg(
        F.expr(f"percentile_disc({0.5 - sk.RANK_ERROR}) within group (order by latency_ms)").alias("low"),
        F.expr(f"percentile_disc({0.5 + sk.RANK_ERROR}) within group (order by latency_ms)").alias("high"),
    )
    median = F.col("latency_quantiles")[0]
    return (
        days.join(exact, ["day", "search_type"])
        .join(bounds, ["day", "search_type"])
        .select(
            F.col("day").cast("string").alias("day"), "search_type", "requests", "max_latency_ms",
            rounded("avg_latency_ms"), "empty_results",
            (F.abs(F.col("users") - F.col("exact_users")) <= sk.DISTINCT_ERROR * F.col("exact_users") + 0.5).alias("users_near"),
            ((median >= F.col("low")) & (median <= F.col("high"))).alias("median_near"),
        )
    )

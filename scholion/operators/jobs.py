"""Processing jobs: state, progress, failures, retries, work order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Steps of an ingestion job, retry limit, batch size.
STEPS = ["fetch", "parse", "chunk", "embed", "store"]
MAX_RETRIES, BATCH = 3, 10
TERMINAL = ["completed", "failed"]


def job_state(events: DataFrame) -> DataFrame:
    """Latest state of each job from its events (job_id, ts, seq, status, ...).

    started_at is the first 'processing', completed_at the first terminal event; all of it is
    one pre-combined aggregate.
    """
    last = ["status", "completed_steps", "current_step", "error_message"]
    keep = [c for c in last if c in events.columns]
    order = F.struct("ts", "seq") if "seq" in events.columns else F.col("ts")
    return events.groupBy("job_id").agg(
        F.max_by(F.struct(*keep), order).alias("s"),
        F.min("ts").alias("created_at"),
        F.min(F.when(F.col("status") == "processing", F.col("ts"))).alias("started_at"),
        F.min(F.when(F.col("status").isin(TERMINAL), F.col("ts"))).alias("completed_at"),
    ).select("job_id", "s.*", "created_at", "started_at", "completed_at")


def progress(done: Column, total: Column) -> Column:
    share = F.coalesce(done, F.lit(0)) / F.greatest(F.coalesce(total, F.lit(0)), F.lit(1))
    return F.floor(share * 100 + 0.5).cast("int")


def job_progress(jobs: DataFrame) -> DataFrame:
    return jobs.withColumns(
        {
            "percent": progress(F.col("completed_steps"), F.col("total_steps")),
            "finished": F.col("status").isin(TERMINAL),
        }
    )


def mark_failed(docs: DataFrame, failures: DataFrame) -> DataFrame:
    """Failed documents get status, error text and one more attempt; each document once."""
    one = failures.groupBy("document_id").agg(F.max("error_message").alias("_error"), F.lit(True).alias("_hit"))
    joined = docs.join(one, "document_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return joined.withColumns(
        {
            "processing_status": F.when(hit, F.lit("failed")).otherwise(F.col("processing_status")),
            "processing_error": F.when(hit, F.col("_error")).otherwise(F.col("processing_error")),
            "processing_attempts": F.coalesce("processing_attempts", F.lit(0)) + hit.cast("int"),
        }
    ).drop("_error", "_hit")


def route_failures(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed jobs with retries left (status retrying, one retry counted), and dead letters."""
    failed = jobs.where(F.col("status") == "failed")
    left = F.coalesce("retry_count", F.lit(0)) < F.coalesce("max_retries", F.lit(MAX_RETRIES))
    retry = failed.where(left).withColumns(
        {"status": F.lit("retrying"), "retry_count": F.coalesce("retry_count", F.lit(0)) + 1}
    )
    return retry, failed.where(~left)


def next_batch(jobs: DataFrame, n: int = BATCH) -> DataFrame:
    """The n pending jobs to run next: highest priority, then oldest."""
    return (
        jobs.where(F.col("status") == "pending")
        .orderBy(F.desc("priority"), "created_at", "job_id")
        .limit(n)
    )

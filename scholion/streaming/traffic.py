"""Streaming forms of the traffic operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholion.operators.traffic import DECISION, PERIOD_SECONDS, WINDOW_SECONDS, decide, queue_periods

# Fixed value: idle time after which a client's state is forgotten.
EVICT_SECONDS = 300


def period_stream(events: DataFrame, delay: str = "5 minutes", period_s: int = PERIOD_SECONDS) -> DataFrame:
    """Closed tumbling periods per queue; late events within the delay are still counted."""
    return queue_periods(events.withWatermark("ts", delay), period_s)


def rate_limit_stream(
    requests: DataFrame, limit: int, window_s: int = WINDOW_SECONDS, delay: str = "1 minute"
) -> DataFrame:
    """Decisions per request (key, ts, request_id), state kept per key.

    State is the allowed times still in the window, at most limit of them. Requests of one
    micro-batch are decided in time order; batches are taken to arrive in order. A micro-batch
    is bounded by the source's rate option. A key's state is dropped once the watermark is
    past its last request by the window (at least five minutes).
    """
    micros = window_s * 1_000_000
    names = requests.columns
    kinds = dict(requests.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", " + DECISION

    def step(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(frames), ignore_index=True)
        batch = batch.sort_values(["ts", "request_id"], kind="stable")
        held = list(state.get[0]) if state.exists else []
        times = (batch["ts"].astype("datetime64[us]").astype("int64")).tolist()
        allowed, remaining, reset = decide(times, held, limit, micros)
        state.update((held,))
        idle = times[-1] // 1000 + max(EVICT_SECONDS, window_s) * 1000
        state.setTimeoutTimestamp(max(idle, state.getCurrentWatermarkMs() + 1))
        yield batch.assign(allowed=allowed, remaining=remaining, reset_seconds=reset)[
            [*names, "allowed", "remaining", "reset_seconds"]
        ]

    timed = requests.withWatermark("ts", delay)
    return timed.groupBy("key").applyInPandasWithState(
        step, schema, "held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


def pair_stream(log: DataFrame, delay: str = "10 minutes", longest: str = "5 minutes") -> DataFrame:
    """Starts joined with their completion within the longest duration, and both kinds of orphans,
    given once the watermark has passed: starts without a completion and completions without a start
    in that time. Repeated lines of an id count once."""
    seen = log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["correlation_id", "event"])
    start = seen.where(F.col("event") == "request_started").select(
        "correlation_id", F.col("ts").alias("started_at"), "method", "path"
    )
    end = seen.where(F.col("event") == "request_completed").select(
        F.col("correlation_id").alias("_cid"), F.col("ts").alias("completed_at"), "status_code"
    )
    within = (
        (F.col("correlation_id") == F.col("_cid"))
        & (F.col("completed_at") >= F.col("started_at"))
        & (F.col("completed_at") <= F.col("started_at") + F.expr(f"INTERVAL {longest}"))
    )
    outcome = (
        F.when(F.col("completed_at").isNull(), "not completed")
        .when(F.col("started_at").isNull(), "not started")
        .otherwise("paired")
    )
    return start.join(end, within, "full_outer").select(
        F.coalesce("correlation_id", "_cid").alias("correlation_id"),
        "started_at", "method", "path", "completed_at", "status_code", outcome.alias("outcome"),
    )

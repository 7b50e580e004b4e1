"""Request logs and queue metrics: client keys, rate limits, pairing, alarms."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import nullif_empty, strip

# Request limits per window, and the alarm thresholds.
SEARCH_LIMIT, CHAT_LIMIT, WINDOW_SECONDS = 100, 20, 60
PERIOD_SECONDS, DEAD_LETTER_LIMIT, BACKLOG_LIMIT, BACKLOG_PERIODS = 300, 10, 100, 3

DECISION = "allowed boolean, remaining int, reset_seconds int"


def client_key(forwarded: Column, real_ip: Column, direct: Column, path: Column | None = None) -> Column:
    """First forwarded address, else real address, else peer, else 'unknown'; plus the path."""
    first = F.when(F.length(forwarded) > 0, strip(F.split(forwarded, ",")[0]))
    who = F.coalesce(first, nullif_empty(real_ip), direct, F.lit("unknown"))
    return who if path is None else F.concat(who, F.lit(":"), path)


def decide(
    times: list[int], held: list[int], limit: int, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """allowed, remaining and reset_seconds of requests in time order (microseconds).

    The k-th admission has to lie a window behind the one limit places before it, so after a full
    window the next one is searched for and all requests before it are skipped at once: the loop
    runs over admissions. held are the last admitted times, at most limit; it is brought up to date.
    """
    admitted, places, at = list(held), [], 0
    while at < len(times):
        if len(admitted) >= limit:
            at = bisect_left(times, admitted[-limit] + window, at)
            if at == len(times):
                break
        admitted.append(times[at])
        places.append(at)
        at += 1
    now, known = np.asarray(times, dtype=np.int64), np.asarray(admitted, dtype=np.int64)
    allowed = np.zeros(len(now), dtype=bool)
    allowed[places] = True
    before = len(held) + np.cumsum(allowed) - allowed
    gone = np.searchsorted(known, now - window, side="right")
    remaining = np.where(allowed, limit - 1 - (before - gone), 0)
    reset = np.full(len(now), window // 1_000_000)
    late = ~allowed
    reset[late] = np.maximum((known[before[late] - limit] + window - now[late]) // 1_000_000, 1)
    held[:] = admitted[-limit:]
    return allowed, remaining, reset


def rate_limit(
    requests: DataFrame, limit: int = SEARCH_LIMIT, window_s: int = WINDOW_SECONDS
) -> DataFrame:
    """Sliding-window decision for every request (key, ts, request_id).

    A request is allowed when fewer than limit allowed ones of its key lie in the window before
    it, so decisions depend on order. A key's log is cut wherever the state is known without
    looking further back: after a window-long bucket without requests, or after one so quiet
    that all its requests were allowed (these are replayed as warm-up). A hot key thus falls
    into many independent stretches, each streamed through a task in batches.
    """
    micros = window_s * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    base = requests.withColumn("_t", at).withColumn("_b", F.floor(F.col("_t") / micros))
    counts = base.groupBy("key", "_b").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("key").orderBy("_b")

    def back(column: str, n: int) -> Column:
        near = F.lag("_b", n).over(order) == F.col("_b") - n
        return F.when(near, F.lag(column, n).over(order)).otherwise(F.lit(0))

    # One row per key and window-long bucket: bounded by time, not by requests.
    marked = counts.withColumn("_n1", back("_n", 1)).withColumn("_n2", back("_n", 2))
    quiet_before = (F.col("_n1") + F.col("_n2")) <= limit
    cut = (F.col("_n1") == 0) | (quiet_before & (F.col("_n1") * 16 <= F.col("_n")))
    cut = cut | (quiet_before & (F.pmod("_b", F.lit(64)) == 0))
    stretch = marked.withColumn("_first", F.when(cut, F.col("_b"))).withColumn(
        "_run", F.last("_first", ignorenulls=True).over(order)
    )
    stretch = stretch.select(
        "key", "_b", "_run", F.when(cut & (F.col("_n1") > 0), F.lit(True)).alias("_warm_next")
    )
    own = base.join(stretch.select("key", "_b", "_run"), ["key", "_b"]).withColumn(
        "_warm", F.lit(False)
    )
    warm_from = stretch.where("_warm_next").select(
        "key", (F.col("_b") - 1).alias("_b"), F.col("_run")
    )
    warm = base.join(warm_from, ["key", "_b"]).withColumn("_warm", F.lit(True))
    rows = own.unionByName(warm)
    keep = [f for f in requests.schema.fields]
    names = [f.name for f in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", " + DECISION

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for frame in frames:
            out = []
            ids = list(zip(frame["key"], frame["_run"], strict=True))
            times = frame["_t"].tolist()
            start = 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or ids[i] != ids[start]:
                    if ids[start] != current:
                        current, held = ids[start], []
                    out.append(decide(times[start:i], held, limit, micros))
                    start = i
            if not out:
                continue
            allowed, remaining, reset = (np.concatenate(part) for part in zip(*out, strict=True))
            frame = frame.assign(allowed=allowed, remaining=remaining, reset_seconds=reset)
            yield frame[~frame["_warm"]][[*names, "allowed", "remaining", "reset_seconds"]]

    ordered = rows.repartition("key", "_run").sortWithinPartitions("key", "_run", "_t", "request_id")
    return ordered.mapInPandas(run, schema)


def never_limited(
    requests: DataFrame, limit: int = SEARCH_LIMIT, window_s: int = WINDOW_SECONDS
) -> DataFrame:
    """Keys whose busiest pair of neighbouring windows stays within the limit: no row of theirs
    can be rejected. Pure aggregates, a cheap screen before rate_limit."""
    micros = window_s * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    counts = (
        requests.select("key", F.floor(at / micros).alias("b"))
        .groupBy("key", "b")
        .agg(F.count("*").alias("n"))
    )
    both = counts.select("key", F.explode(F.array("b", F.col("b") + 1)).alias("b"), "n")
    load = both.groupBy("key", "b").agg(F.sum("n").alias("load"))
    return load.groupBy("key").agg(F.max("load").alias("peak")).where(F.col("peak") <= limit)


def pair_requests(log: DataFrame) -> DataFrame:
    """Start and completion of each correlation id: duration, status, orphans.

    One pre-combined aggregate. An id a client used again and again is reported as repeated
    with its line counts instead of being joined with itself.
    """
    started = F.col("event") == "request_started"
    completed = F.col("event") == "request_completed"
    both = log.where(started | completed).groupBy("correlation_id").agg(
        F.min(F.when(started, F.col("ts"))).alias("started_at"),
        F.max(F.when(completed, F.col("ts"))).alias("completed_at"),
        F.max_by("status_code", F.when(completed, F.col("ts"))).alias("status_code"),
        F.min_by("method", "ts").alias("method"),
        F.min_by("path", "ts").alias("path"),
        F.count_if(started).alias("starts"),
        F.count_if(completed).alias("completions"),
    )
    micros = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(
        F.col("started_at").cast("timestamp")
    )
    outcome = (
        F.when((F.col("starts") > 1) | (F.col("completions") > 1), F.lit("repeated"))
        .when(F.col("completions") == 0, F.lit("not completed"))
        .when(F.col("starts") == 0, F.lit("not started"))
        .otherwise(F.lit("paired"))
    )
    return both.withColumn("duration_ms", micros / 1000).withColumn("outcome", outcome)


def queue_periods(events: DataFrame, period_s: int = PERIOD_SECONDS) -> DataFrame:
    """Sum and average of the visible-message metric per queue and tumbling period."""
    return (
        events.groupBy("queue", F.window("ts", f"{period_s} seconds").alias("w"))
        .agg(F.sum("visible").alias("total"), F.avg("visible").alias("mean"))
        .select("queue", F.col("w.start").alias("period_start"), "total", "mean")
    )


def queue_alarms(
    periods: DataFrame,
    dead_letter_queue: str,
    backlog_queue: str,
    period_s: int = PERIOD_SECONDS,
    dead_limit: float = DEAD_LETTER_LIMIT,
    backlog_limit: float = BACKLOG_LIMIT,
    consecutive: int = BACKLOG_PERIODS,
) -> DataFrame:
    """Alarms over closed periods: dead letters summed above the limit in one period; backlog
    average above its limit in that many periods without a gap.

    Windows run over one row per queue and period, never over raw events.
    """
    dead = periods.where((F.col("queue") == dead_letter_queue) & (F.col("total") > dead_limit)).select(
        F.lit("dead_letters").alias("alarm"), "queue", "period_start",
        F.col("total").cast("double").alias("value"),
    )
    index = F.floor(F.unix_micros(F.col("period_start").cast("timestamp")) / (period_s * 1_000_000))
    over = periods.where(
        (F.col("queue") == backlog_queue) & (F.col("mean") > backlog_limit)
    ).withColumn("i", index)
    order = Window.partitionBy("queue").orderBy("i")
    backlog = (
        over.withColumn("_far", F.lag("i", consecutive - 1).over(order))
        .where(F.col("_far") == F.col("i") - (consecutive - 1))
        .select(
            F.lit("backlog").alias("alarm"), "queue", "period_start",
            F.col("mean").cast("double").alias("value"),
        )
    )
    return dead.unionByName(backlog)

"""Queue alarms and job retries as streams: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scholion.operators.jobs import MAX_RETRIES
from scholion.operators.traffic import BACKLOG_LIMIT, BACKLOG_PERIODS, DEAD_LETTER_LIMIT, PERIOD_SECONDS

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALARMS = "alarm string, queue string, period_start timestamp, value double"
RETRIES = "job_id string, action string, attempt int, due_at timestamp, error_message string"
BACKOFF_SECONDS = 60


def keep_timers(spark: SparkSession) -> None:
    """Timers need the state store that keeps keys in order; others stay as they are set."""
    if "RocksDB" not in spark.conf.get(STATE_STORE):
        spark.conf.set(STATE_STORE, ROCKS)


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


class _Alarms(StatefulProcessor):
    """One queue: sums of its open periods, and how many periods in a row were over the limit."""

    def __init__(self, kinds: dict[str, tuple[str, str, float]], period_s: int, consecutive: int):
        self.kinds, self.period, self.consecutive = kinds, period_s * 1_000_000, consecutive

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "period bigint", "total double, n bigint")
        self.run = handle.getValueState("run", "last bigint, length int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            period = _micros(frame["ts"]) // self.period
            # What comes after its period's end has passed is late, whether or not the timer has run.
            timely = (period + 1) * self.period > mark
            frame, period = frame[timely], period[timely]
            sums = frame.groupby(period)["visible"].agg(["sum", "count"])
            for p, total, n in zip(sums.index, sums["sum"], sums["count"], strict=True):
                if self.open.containsKey((int(p),)):
                    before = self.open.getValue((int(p),))
                    total, n = total + before[0], n + before[1]
                else:
                    # Fires once the watermark has passed the period's end.
                    self.handle.registerTimer(int((p + 1) * self.period // 1000))
                self.open.updateValue((int(p),), (float(total), int(n)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        closed = sorted(p for (p,) in self.open.keys() if (p + 1) * self.period <= now)
        alarm, statistic, limit = self.kinds.get(key[0], (None, "mean", 0.0))
        out = []
        for p in closed:
            total, n = self.open.getValue((p,))
            self.open.removeKey((p,))
            value = total if statistic == "total" else total / n if n else 0.0
            length = 0
            if alarm and n and value > limit:
                last, before = self.run.get() if self.run.exists() else (None, 0)
                # A period without rows, or one under the limit, lies between: counting starts anew.
                length = before + 1 if last == p - 1 else 1
                needed = 1 if statistic == "total" else self.consecutive
                if length >= needed:
                    out.append((alarm, key[0], pd.Timestamp(p * self.period, unit="us"), float(value)))
                self.run.update((p, length))
                # Once the next period has closed without a row, the run is over and forgotten.
                self.handle.registerTimer(int((p + 2) * self.period // 1000))
            elif self.run.exists():
                self.run.clear()
        if self.run.exists() and (self.run.get()[0] + 2) * self.period <= now:
            self.run.clear()
        yield pd.DataFrame(out, columns=["alarm", "queue", "period_start", "value"])

    def close(self) -> None:
        pass


def alarm_stream(
    events: DataFrame,
    dead_letter_queue: str,
    backlog_queue: str,
    period_s: int = PERIOD_SECONDS,
    dead_limit: float = DEAD_LETTER_LIMIT,
    backlog_limit: float = BACKLOG_LIMIT,
    consecutive: int = BACKLOG_PERIODS,
    delay: str = "5 minutes",
) -> DataFrame:
    """queue_alarms over a stream of (ts, queue, visible): each alarm once its period has closed.

    A period closes when the watermark passes its end; rows that come later than the delay are dropped
    with it, rows within it are counted. Null metrics count nothing. State is the open periods' sums and
    one run for each queue; both go when their period closes or the run breaks.
    """
    keep_timers(events.sparkSession)
    kinds = {
        dead_letter_queue: ("dead_letters", "total", float(dead_limit)),
        backlog_queue: ("backlog", "mean", float(backlog_limit)),
    }
    timed = events.where("visible is not null and queue is not null").select(
        "queue", "ts", F.col("visible").cast("double").alias("visible")
    )
    return (
        timed.withWatermark("ts", delay)
        .groupBy("queue")
        .transformWithStateInPandas(
            statefulProcessor=_Alarms(kinds, period_s, consecutive),
            outputStructType=ALARMS,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


class _Retries(StatefulProcessor):
    """One job: tries that failed, and when the next one is due."""

    def __init__(self, max_retries: int, backoff_s: int):
        self.max_retries, self.backoff = max_retries, backoff_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "failed int, due bigint, error string")

    def _fire(self, key, until: int) -> list:
        """The retry that has become due by then, if one is waited for."""
        if not self.state.exists():
            return []
        failed, due, error = self.state.get()
        if due is None or due > until:
            return []
        self.state.update((failed, None, error))
        return [(key[0], "retry", failed, pd.Timestamp(due, unit="us"), error)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.assign(at=_micros(frame["ts"])).sort_values(["at", "seq"], kind="stable")
        # State is read and written once for all rows: each call to it goes through a socket.
        known = self.state.get() if self.state.exists() else None
        failed, due, reason = known or (0, None, None)
        out = []
        for at, status, error in zip(frame["at"].tolist(), frame["status"], frame["error_message"], strict=True):
            if due is not None and due <= at:
                out.append((key[0], "retry", failed, pd.Timestamp(due, unit="us"), reason))
                due = None
            if status in ("completed", "pending"):
                # Done, or started anew by hand: nothing is owed any more.
                failed, due, reason = 0, None, None
            elif status == "failed":
                if due is not None or failed > self.max_retries:
                    continue  # a repeated report of a failure that is known
                failed += 1
                reason = None if pd.isna(error) else error
                if failed > self.max_retries:
                    out.append((key[0], "dead_letter", failed, pd.Timestamp(at, unit="us"), reason))
                else:
                    due = int(at) + self.backoff * 2 ** (failed - 1)
        if failed:
            self.state.update((failed, due, reason))
            if due is not None and (known is None or known[1] != due):
                self.handle.registerTimer(-(-due // 1000))
        elif known is not None:
            self.state.clear()
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._frame(self._fire(key, expiredTimerInfo.getExpiryTimeInMs() * 1000))

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["job_id", "action", "attempt", "due_at", "error_message"])
        return out.astype({"attempt": "int32", "due_at": "datetime64[us]"})

    def close(self) -> None:
        pass


def retry_stream(
    events: DataFrame, max_retries: int = MAX_RETRIES, backoff_s: int = BACKOFF_SECONDS, delay: str = "1 minute"
) -> DataFrame:
    """Retries and dead letters of a stream of job events (job_id, ts, seq, status, error_message).

    The n-th failure of a job makes a retry due backoff_s * 2^(n-1) seconds later; it is given once event time has
    reached that, unless the job was completed or set pending again before. A failure beyond max_retries
    is a dead letter, once. Failures reported while a retry is waited for, or after the dead letter, are repeats and count
    nothing; completed and pending forget the job. Events of a micro-batch are taken in order of ts and seq, and a retry that falls
    due between two of them comes first, so that the cut into micro-batches changes nothing as long as
    they arrive in order.
    """
    keep_timers(events.sparkSession)
    timed = events.where("job_id is not null and ts is not null").select(
        "job_id", "ts", "seq", "status", "error_message"
    )
    return (
        timed.withWatermark("ts", delay)
        .groupBy("job_id")
        .transformWithStateInPandas(
            statefulProcessor=_Retries(max_retries, backoff_s),
            outputStructType=RETRIES,
            outputMode="Append",
            timeMode="EventTime",
        )
    )

"""Alarms and retries as streams: micro-batches, gaps, late rows, repeats and restarts."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scholion.operators import traffic as tr
from scholion.streaming import alarms
from scholion.streaming.run import drain

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def streamed(spark, tmp_path, batches, schema):
    """The batches as files that a stream takes in one after the other."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"b{k:03d}"))
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        .parquet(str(tmp_path))
    )


@pytest.mark.parametrize("parts", [1, 4])
def test_alarms_equal_the_batch_form(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = []
    for p in range(30):
        for queue, level in (("dead", 6), ("work", 120), ("other", 500)):
            if rng.random() < 0.85:
                rows += [(queue, at(300 * p + rng.randrange(300)), rng.uniform(0.6, 1.4) * level) for _ in range(3)]
    rows += [("work", at(40), None), ("work", at(300 * 40), 1.0), ("dead", at(300 * 40), 1.0)]
    rows.sort(key=lambda r: r[1])
    schema = "queue string, ts timestamp, visible double"
    size = -(-len(rows) // parts)
    stream = streamed(spark, tmp_path, [rows[k : k + size] for k in range(0, len(rows), size)], schema)
    got = drain(alarms.alarm_stream(stream, "dead", "work", 300, 15, 110, 3, delay="0 seconds"), "t").collect()
    frame = spark.createDataFrame([r for r in rows if r[1] < at(300 * 40)], schema)
    want = tr.queue_alarms(tr.queue_periods(frame, 300), "dead", "work", 300, 15, 110, 3).collect()
    as_rows = lambda found: sorted((r.alarm, r.queue, r.period_start, round(r.value, 6)) for r in found)
    assert as_rows(got) == as_rows(want)
    assert {r.alarm for r in want} == {"dead_letters", "backlog"}


def test_a_gap_resets_and_late_rows_are_dropped(spark, tmp_path):
    schema = "queue string, ts timestamp, visible double"
    high = lambda p: ("work", at(300 * p + 10), 200.0)
    batches = [
        [high(0), high(1)],
        [high(3), high(4)],  # period 2 has no row: counting starts anew
        [high(5), ("work", at(300 * 20), 0.0)],
        [("work", at(300 * 5 + 20), -10_000.0), high(21)],  # long closed, so it changes nothing
        [("work", at(300 * 40), 0.0)],
    ]
    stream = streamed(spark, tmp_path, batches, schema)
    got = drain(alarms.alarm_stream(stream, "dead", "work", 300, 15, 100, 3, delay="10 seconds"), "t").collect()
    assert [(r.alarm, r.period_start, r.value) for r in got] == [("backlog", at(1500), 200.0)]


def retries_by_hand(events, tries, backoff, mark):
    jobs, out = {}, []
    for job, ts, _, status, error in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        failed, due, why = jobs.get(job, (0, None, None))
        if due is not None and due <= ts:
            out.append((job, "retry", failed, due, why))
            due = None
        if status in ("completed", "pending"):
            failed, due, why = 0, None, None
        elif status == "failed" and due is None and failed <= tries:
            failed, why = failed + 1, error
            if failed > tries:
                out.append((job, "dead_letter", failed, ts, error))
            else:
                due = ts + dt.timedelta(seconds=backoff * 2 ** (failed - 1))
        jobs[job] = (failed, due, why)
    out += [(j, "retry", f, d, w) for j, (f, d, w) in jobs.items() if d is not None and d <= mark]
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_retries_equal_the_state_machine(spark, tmp_path, parts):
    rng = random.Random(9)
    events, now = [], 0
    for seq in range(300):
        now += rng.randrange(0, 50)
        status = rng.choices(["failed", "completed", "pending", "processing"], [7, 1, 1, 1])[0]
        events.append((f"j{rng.randrange(6)}", at(now), seq, status, rng.choice(["x", "y", None])))
    schema = "job_id string, ts timestamp, seq long, status string, error_message string"
    size = -(-len(events) // parts)
    stream = streamed(spark, tmp_path, [events[k : k + size] for k in range(0, len(events), size)], schema)
    got = drain(alarms.retry_stream(stream, 3, 60, delay="0 seconds"), "t").collect()
    found = sorted(((r.job_id, r.action, r.attempt, r.due_at, r.error_message) for r in got), key=repr)
    assert found == retries_by_hand(events, 3, 60, at(now))
    assert {f[1] for f in found} == {"retry", "dead_letter"}
    # Null jobs and an empty log give nothing.
    none = spark.createDataFrame([(None, at(1), 1, "failed", "x")], schema)
    assert none.where(F.col("job_id").isNotNull()).count() == 0


def test_state_of_a_job_is_read_and_written_once_for_all_its_rows():
    import pandas as pd

    from scholion.streaming.alarms import _Retries

    calls = []

    class State:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        timers = []

        def getValueState(self, *_):  # noqa: N802
            return State()

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    job = _Retries(3, 10)
    job.init(Handle())
    at = pd.to_datetime(range(0, 500), unit="s")
    rows = pd.DataFrame({"ts": at, "seq": range(500), "status": "failed", "error_message": "e"})
    out = pd.concat(job.handleInputRows(("a",), iter([rows]), None))
    assert list(zip(out["action"], out["attempt"])) == [("retry", 1), ("retry", 2), ("retry", 3), ("dead_letter", 4)]
    assert len(calls) <= 3 and job.state.value == (4, None, "e")

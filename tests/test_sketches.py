"""Search statistics from stored hours: merged ranges, replaced days, empty input."""

from __future__ import annotations

import datetime as dt
import random

from scholion.operators import sketches as sk

SCHEMA = "ts timestamp, search_type string, user_id long, latency_ms int, result_count long"


def log(seed, days, n=4000):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [
        (
            start + dt.timedelta(days=rng.choice(days), seconds=rng.randrange(86400)), rng.choice(["a", "b", None]),
            rng.choice([None, *range(900)]), rng.choice([None, *range(1000)]), rng.randrange(4),
        )
        for _ in range(n)
    ]


def test_ranges_are_merged_from_hours(spark, tmp_path):
    path = str(tmp_path / "hours")
    rows = log(1, [0, 1, 2]) + [(None, "a", 1, 1, 1)]
    sk.write_hourly(spark.createDataFrame(rows, SCHEMA), path)
    # A batch replaces the days that it holds, and only those.
    again = log(2, [1])
    sk.write_hourly(spark.createDataFrame(again, SCHEMA), path)
    kept = [r for r in rows if r[0] and r[0].day != 2] + again
    since, until = dt.datetime(2024, 1, 1, 6), dt.datetime(2024, 1, 3, 5)
    mine = [r for r in kept if since <= r[0] < until]
    hours = sk.read_hourly(spark, path, str(since), str(until))
    got = {r.search_type: r for r in sk.merged(hours, "search_type").collect()}
    assert got.keys() == {"a", "b", None}
    for kind, r in got.items():
        of = [x for x in mine if x[1] == kind]
        times = sorted(x[3] for x in of if x[3] is not None)
        assert (r.requests, r.timed, r.max_latency_ms) == (len(of), len(times), times[-1])
        assert abs(r.avg_latency_ms - sum(times) / len(times)) < 1e-9
        assert r.empty_results == sum(x[4] == 0 for x in of)
        users = len({x[2] for x in of if x[2] is not None})
        assert abs(r.users - users) <= sk.DISTINCT_ERROR * users
        for q, value in zip((0.5, 0.95, 0.99), r.latency_quantiles, strict=True):
            rank = sum(t <= value for t in times) / len(times)
            assert abs(rank - q) <= sk.RANK_ERROR + 2 / len(times)


def test_hours_without_latency_and_empty_logs(spark):
    rows = [(dt.datetime(2024, 1, 1), "a", None, None, None)]
    (r,) = sk.merged(sk.hourly(spark.createDataFrame(rows, SCHEMA))).collect()
    assert (r.requests, r.timed, r.users, r.avg_latency_ms, r.latency_quantiles) == (1, 0, 0, None, None)
    assert sk.merged(sk.hourly(spark.createDataFrame([], SCHEMA)), "search_type").collect() == []

"""History, jobs and traffic over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.operators import history as hs
from scholion.operators import jobs as jb
from scholion.operators import stats as st
from scholion.operators import traffic as tr
from scholion.operators.asked import ask
from scholion.operators.keyword import keyword_search
from scholion.plans.base import CHUNKS, DOCS, REQUESTS, Registry, chunk_texts, documents, keyword_sql, requests, rounded, table, with_sql

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def pick(column, *values):
    """One of the values, by column modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


# ---- searches ----------------------------------------------------------------------------


@R.add(
    "g9_search_analytics",
    """SELECT search_type, count(*) AS requests, round(avg(l), 6) AS avg_latency_ms, max(l) AS max_latency_ms, round(avg(r), 6) AS avg_results,
      count(*) FILTER (r = 0) AS empty_results, quantile_disc(l, 0.5) AS median_latency_ms
    FROM (SELECT (['vector', 'keyword', 'hybrid'])[CAST(user_id % 3 + 1 AS INTEGER)] AS search_type, CAST(floor(value * 100) AS INTEGER) AS l,
      event_id % 12 AS r FROM events) GROUP BY 1""",
)
def g9(spark, sf):
    h = table(spark, sf, "events").select(
        pick(F.col("user_id"), "vector", "keyword", "hybrid").alias("search_type"),
        F.floor(F.col("value") * 100).cast("int").alias("latency_ms"),
        (F.col("event_id") % 12).alias("result_count"),
    )
    return st.search_analytics(h).select(
        "search_type", "requests", rounded("avg_latency_ms"), "max_latency_ms", rounded("avg_results"), "empty_results",
        F.col("latency_quantiles")[0].alias("median_latency_ms"),
    )


def searches(spark, sf):
    """Blank, padded and differently cased queries of each user."""
    i = F.col("event_id")
    text = F.concat(F.col("event_type"), F.lit(" "), (i % 7).cast("string"))
    query = F.when(i % 11 == 0, "  ").when(i % 3 == 0, F.upper(text)).when(i % 3 == 1, F.concat(F.lit("  "), text)).otherwise(text)
    return table(spark, sf, "events").select("user_id", i.alias("id"), query.alias("query"), "ts")


SEARCHES = """searches AS (SELECT user_id, event_id AS id, ts, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 3 = 0
      THEN upper(event_type || ' ' || event_id % 7) ELSE event_type || ' ' || event_id % 7 END AS query FROM events)"""


@R.add(
    "g10_recent_searches",
    f"""WITH {SEARCHES}, d AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(query) ORDER BY ts DESC, id DESC) AS n
      FROM searches WHERE query <> '')
    SELECT user_id, id, query, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS position
      FROM d WHERE n = 1) WHERE position <= 10""",
)
def g10(spark, sf):
    return hs.recent_searches(searches(spark, sf)).select("user_id", "id", "query", "position")


@R.add(
    "g11_history_removal",
    f"""WITH {SEARCHES}, c AS (SELECT user_id, max(ts) AS cleared FROM events WHERE event_id % 131 = 0 GROUP BY user_id)
    SELECT s.user_id, s.id FROM searches s LEFT JOIN c USING (user_id)
    WHERE s.id % 5 <> 2 AND (cleared IS NULL OR s.ts > cleared)""",
)
def g11(spark, sf):
    """Every entry with id 2 modulo 5 is removed by its user; some users clear all."""
    s = searches(spark, sf)
    removed = s.where("id % 5 = 2").select("user_id", "id")
    clears = s.where("id % 131 = 0").select("user_id", "ts")
    return hs.apply_removals(s, removed, clears).select("user_id", "id")


def marks(spark, sf):
    i = F.col("event_id")
    kind = F.col("event_type")
    action = (
        F.when(i % 197 == 0, "clear")
        .when(kind.isin("view", "signup"), "add")
        .when(kind.isin("click", "purchase"), "toggle")
        .otherwise("remove")
    )
    return table(spark, sf, "events").select(
        "user_id", F.when(i % 197 != 0, (i % 4).cast("string")).alias("document_id"), action.alias("action"), "ts",
        i.alias("seq"),
    )


BOOKMARKS_SQL = """WITH a AS (SELECT user_id, event_id % 4 AS doc, ts, event_id AS seq, CASE WHEN event_id % 197 = 0 THEN 'clear'
      WHEN event_type IN ('view', 'signup') THEN 'add' WHEN event_type IN ('click', 'purchase') THEN 'toggle' ELSE 'remove' END AS act FROM events),
    c AS (SELECT user_id, max({'t': ts, 's': seq}) AS c FROM a WHERE act = 'clear' GROUP BY user_id),
    l AS (SELECT a.* FROM a LEFT JOIN c USING (user_id) WHERE act <> 'clear' AND (c.c IS NULL OR {'t': a.ts, 's': a.seq} > c.c)),
    g AS (SELECT user_id, doc, list({'on': act, 'ts': ts} ORDER BY ts, seq) AS es FROM l GROUP BY user_id, doc),
    f AS (SELECT user_id, doc, list_reduce(es, lambda s, e:
        CASE WHEN e.on = 'remove' OR (e.on = 'toggle' AND s.on = 'yes') THEN {'on': 'no', 'ts': e.ts}
          WHEN s.on = 'yes' THEN s ELSE {'on': 'yes', 'ts': e.ts} END, {'on': 'no', 'ts': TIMESTAMP '2000-01-01'}) AS s FROM g)"""


@R.add(
    "g12_bookmarks",
    BOOKMARKS_SQL + " SELECT user_id, CAST(doc AS VARCHAR) AS document_id, CAST(epoch_us(s.ts) AS BIGINT) AS bookmarked_us FROM f WHERE s.on = 'yes'",
)
def g12(spark, sf):
    return hs.bookmarks(marks(spark, sf)).select(
        "user_id", "document_id", F.unix_micros(F.col("bookmarked_at").cast("timestamp")).alias("bookmarked_us")
    )


@R.add(
    "g12_is_bookmarked",
    BOOKMARKS_SQL + """ SELECT e.user_id, CAST(e.doc AS VARCHAR) AS document_id, coalesce(f.s.on = 'yes', false) AS bookmarked
    FROM (SELECT DISTINCT user_id, event_id % 4 AS doc FROM events) e LEFT JOIN f ON e.user_id = f.user_id AND e.doc = f.doc""",
)
def g12_flag(spark, sf):
    pairs = table(spark, sf, "events").select("user_id", (F.col("event_id") % 4).cast("string").alias("document_id")).distinct()
    return hs.is_bookmarked(pairs, hs.bookmarks(marks(spark, sf)))


@R.add(
    "j11_append_history",
    with_sql(
        DOCS, CHUNKS, REQUESTS, keyword_sql(),
        select="""SELECT q.query_text, 'keyword' AS search_type, CAST(count(v.chunk_id) AS INTEGER) AS result_count,
  coalesce(string_agg(v.chunk_id, ',' ORDER BY v.keyword_rank), '') AS result_ids, 'u' || q.item_id AS user_id
FROM requests q LEFT JOIN kw v ON v.query_id = q.query_id AND v.keyword_rank > q.off AND v.keyword_rank <= q.off + q.k
GROUP BY q.query_id, q.query_text, q.item_id""",
    ),
)
def j11(spark, sf, asking=requests):
    q = asking(spark, sf).withColumn("search_type", F.lit("keyword"))
    asked = ask(q)
    hits = keyword_search(asked, chunk_texts(spark, sf), documents(spark, sf))
    named = q.withColumn("user_id", F.concat(F.lit("u"), F.col("item_id").cast("string")))
    return hs.append_history(named, hits).select(
        "query_text", "search_type", "result_count", F.array_join("result_ids", ",").alias("result_ids"), "user_id"
    )


# ---- jobs --------------------------------------------------------------------------------


def job_events(spark, sf):
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "pending").when(kind.isin("view", "click"), "processing").when(kind == "purchase", "completed").otherwise("failed")
    )
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"), "ts", F.col("event_id").alias("seq"), status.alias("status"),
        (F.col("event_id") % 6).cast("int").alias("completed_steps"), F.lit(5).alias("total_steps"), kind.alias("current_step"),
    )


JOB_STATUS = """CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing'
  WHEN 'purchase' THEN 'completed' ELSE 'failed' END"""
STATE_SQL = f"""SELECT CAST(user_id AS VARCHAR) AS job_id, arg_max({JOB_STATUS}, {{'t': ts, 's': event_id}}) AS status,
  arg_max(CAST(event_id % 6 AS INTEGER), {{'t': ts, 's': event_id}}) AS completed_steps,
  epoch_us(min(ts)) AS created_us, epoch_us(min(ts) FILTER (event_type IN ('view', 'click'))) AS started_us,
  epoch_us(min(ts) FILTER (event_type IN ('purchase', 'error'))) AS completed_us FROM events GROUP BY user_id"""


@R.add("j2_job_state", STATE_SQL)
def j2(spark, sf):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return jb.job_state(job_events(spark, sf)).select(
        "job_id", "status", "completed_steps", us("created_at").alias("created_us"), us("started_at").alias("started_us"),
        us("completed_at").alias("completed_us"),
    )


@R.add(
    "j3_job_progress",
    f"""SELECT job_id, CAST(floor(completed_steps / 5.0 * 100 + 0.5) AS INTEGER) AS percent, status IN ('completed', 'failed') AS finished
    FROM ({STATE_SQL})""",
)
def j3(spark, sf):
    s = jb.job_state(job_events(spark, sf)).withColumn("total_steps", F.lit(5))
    return jb.job_progress(s).select("job_id", "percent", "finished")


def all_jobs(spark, sf):
    """Every event as a job of its own."""
    i = F.col("event_id")
    return job_events(spark, sf).select(
        F.col("seq").cast("string").alias("job_id"), "status", (F.col("seq") % 5).cast("int").alias("retry_count"),
        F.lit(3).alias("max_retries"), (F.col("seq") % 11).cast("int").alias("priority"), F.col("ts").alias("created_at"),
    )


@R.add(
    "j5_route_failures",
    """SELECT CAST(event_id AS VARCHAR) AS job_id, CASE WHEN event_id % 5 < 3 THEN 'retrying' ELSE 'failed' END AS status,
      CAST(CASE WHEN event_id % 5 < 3 THEN event_id % 5 + 1 ELSE event_id % 5 END AS INTEGER) AS retry_count FROM events WHERE event_type = 'error'""",
)
def j5(spark, sf):
    retry, dead = jb.route_failures(all_jobs(spark, sf))
    return retry.unionByName(dead).select("job_id", "status", "retry_count")


@R.add(
    "j6_next_batch",
    """SELECT CAST(event_id AS VARCHAR) AS job_id, CAST(event_id % 11 AS INTEGER) AS priority FROM events WHERE event_type = 'signup'
    ORDER BY event_id % 11 DESC, ts, CAST(event_id AS VARCHAR) LIMIT 10""",
)
def j6(spark, sf):
    return jb.next_batch(all_jobs(spark, sf)).select("job_id", "priority")


# ---- traffic -----------------------------------------------------------------------------

LIMIT, WINDOW_S = 4, 86_400


def request_log(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("request_id")
    )


RATE_SQL = f"""WITH g AS (SELECT user_id, list(epoch_us(ts) ORDER BY ts, event_id) AS ts, list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id),
    f AS (SELECT ids, list_reduce(ts, lambda s, t: CASE WHEN len(list_filter(s.h, lambda x: x > t - {WINDOW_S * 1_000_000})) >= {LIMIT}
        THEN {{'h': list_filter(s.h, lambda x: x > t - {WINDOW_S * 1_000_000}), 'o': list_append(s.o, -greatest((list_filter(s.h, lambda x: x > t - {WINDOW_S * 1_000_000})[1]
          + {WINDOW_S * 1_000_000} - t) // 1000000, 1))}}
        ELSE {{'h': list_append(list_filter(s.h, lambda x: x > t - {WINDOW_S * 1_000_000}), t),
          'o': list_append(s.o, {LIMIT} - 1 - len(list_filter(s.h, lambda x: x > t - {WINDOW_S * 1_000_000})))}} END,
        {{'h': []::BIGINT[], 'o': []::BIGINT[]}}).o AS o FROM g),
    u AS (SELECT unnest(ids) AS request_id, unnest(o) AS o FROM f)
    SELECT request_id, o >= 0 AS allowed, CAST(greatest(o, 0) AS INTEGER) AS remaining,
      CAST(CASE WHEN o < 0 THEN -o ELSE {WINDOW_S} END AS INTEGER) AS reset_seconds FROM u"""


@R.add("j8_rate_limit", RATE_SQL)
def j8(spark, sf):
    """Four requests per user and day."""
    return tr.rate_limit(request_log(spark, sf), LIMIT, WINDOW_S).select(
        "request_id", "allowed", "remaining", "reset_seconds"
    )


@R.add(
    "j8_never_limited",
    """WITH c AS (SELECT user_id, epoch_us(ts) // 86400000000 AS b, count(*) AS n FROM events GROUP BY ALL),
    l AS (SELECT a.user_id, a.b, a.n + coalesce(p.n, 0) AS load FROM c a LEFT JOIN c p ON a.user_id = p.user_id AND p.b = a.b - 1)
    SELECT CAST(user_id AS VARCHAR) AS key, max(load)::BIGINT AS peak FROM l GROUP BY user_id HAVING max(load) <= 12""",
)
def j8_screen(spark, sf):
    return tr.never_limited(request_log(spark, sf), 12, WINDOW_S)


@R.add(
    "j9_client_key",
    """SELECT event_id, CASE event_type WHEN 'view' THEN '10.0.0.' || user_id WHEN 'click' THEN '10.1.0.' || user_id
      WHEN 'error' THEN 'host' || user_id ELSE 'unknown' END || ':/' || event_type AS key FROM events""",
)
def j9(spark, sf):
    kind, u = F.col("event_type"), F.col("user_id").cast("string")
    forwarded = F.when(kind == "view", F.concat(F.lit(" 10.0.0."), u, F.lit(" , 9.9.9.9"))).when(kind == "signup", "")
    real = F.when(kind == "click", F.concat(F.lit("10.1.0."), u))
    direct = F.when(kind.isin("click", "error"), F.concat(F.lit("host"), u))
    key = tr.client_key(forwarded, real, direct, F.concat(F.lit("/"), kind))
    return table(spark, sf, "events").select("event_id", key.alias("key"))


def http_log(spark, sf):
    """Two lines per request id; some ids miss a line, one id is used by many requests."""
    i = F.col("event_id")
    pair = F.floor(i / 2)
    cid = F.when(pair % 3 == 0, F.lit("fixed")).otherwise(F.concat(F.lit("r"), pair.cast("string")))
    return table(spark, sf, "events").where((i % 14 != 3) & (i % 22 != 4)).select(
        cid.alias("correlation_id"), "ts", F.when(i % 2 == 0, "request_started").otherwise("request_completed").alias("event"),
        F.lit("GET").alias("method"), F.concat(F.lit("/"), F.lit("p")).alias("path"),
        F.when(i % 2 == 1, (F.lit(200) + i % 3 * 100).cast("int")).alias("status_code"),
    )


@R.add(
    "j10_paired_requests",
    """WITH l AS (SELECT CASE WHEN (event_id // 2) % 3 = 0 THEN 'fixed' ELSE 'r' || (event_id // 2) END AS cid, ts, event_id % 2 AS c,
        CASE WHEN event_id % 2 = 1 THEN 200 + event_id % 3 * 100 END AS code FROM events WHERE event_id % 14 <> 3 AND event_id % 22 <> 4)
    SELECT cid AS correlation_id, count(*) FILTER (c = 0) AS starts, count(*) FILTER (c = 1) AS completions,
      CASE WHEN count(*) FILTER (c = 0) > 1 OR count(*) FILTER (c = 1) > 1 THEN 'repeated' WHEN count(*) FILTER (c = 1) = 0 THEN 'not completed'
        WHEN count(*) FILTER (c = 0) = 0 THEN 'not started' ELSE 'paired' END AS outcome,
      CAST(arg_max(code, ts) FILTER (c = 1) AS INTEGER) AS status_code,
      round((epoch_us(max(ts) FILTER (c = 1)) - epoch_us(min(ts) FILTER (c = 0))) / 1000.0, 3)::DOUBLE AS duration_ms
    FROM l GROUP BY cid""",
)
def j10(spark, sf):
    return tr.pair_requests(http_log(spark, sf)).select(
        "correlation_id", "starts", "completions", "outcome", "status_code", F.round("duration_ms", 3).alias("duration_ms")
    )


def queue_events(spark, sf):
    return table(spark, sf, "events").select("ts", F.col("event_type").alias("queue"), F.col("value").alias("visible"))


PERIOD_S = 7200
PERIODS_SQL = f"""SELECT event_type AS queue, epoch_us(ts) // {PERIOD_S * 1_000_000} AS p, sum(value) AS total, avg(value) AS mean FROM events GROUP BY ALL"""


@R.add(
    "j7_queue_alarms",
    f"""WITH w AS ({PERIODS_SQL}), o AS (SELECT *, lag(p, 2) OVER (ORDER BY p) AS far FROM w WHERE queue = 'view' AND mean > 10)
    SELECT 'dead_letters' AS alarm, queue, p * {PERIOD_S} AS period, round(total, 6) AS value FROM w WHERE queue = 'error' AND total > 120
    UNION ALL SELECT 'backlog', queue, p * {PERIOD_S}, round(mean, 6) FROM o WHERE far = p - 2""",
)
def j7(spark, sf):
    periods = tr.queue_periods(queue_events(spark, sf), PERIOD_S)
    out = tr.queue_alarms(periods, "error", "view", PERIOD_S, 120, 10)
    start = F.unix_seconds(F.col("period_start").cast("timestamp"))
    return out.select("alarm", "queue", start.alias("period"), rounded("value"))

"""Structured Streaming over the given tables, drained to files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.operators import traffic as tr
from scholion.plans.activity import LIMIT, PERIOD_S, PERIODS_SQL, RATE_SQL, WINDOW_S
from scholion.operators.jobs import job_state
from scholion.plans.base import Registry, rounded, strip_sql, table, words_sql
from scholion.plans.parsing import GOOD, article_xml
from scholion.plans.search import TITLE_SQL
from scholion.session import scratch_path
from scholion.streaming import alarms, ingest
from scholion.streaming import traffic as stt
from scholion.streaming.run import drain, read_table_stream

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def events(spark, sf):
    return read_table_stream(spark, sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@R.add(
    "j7_period_stream",
    f"""SELECT queue, p * {PERIOD_S} AS period, round(total, 6) AS total FROM ({PERIODS_SQL})
    WHERE (p + 1) * {PERIOD_S * 1_000_000} <= (SELECT epoch_us(max(ts)) - 300000000 FROM events)""",
)
def j7_stream(spark, sf):
    """Periods closed by the watermark."""
    q = events(spark, sf).select("ts", F.col("event_type").alias("queue"), F.col("value").alias("visible"))
    out = drain(stt.period_stream(q, "5 minutes", PERIOD_S), "periods")
    return out.select("queue", F.unix_seconds("period_start").alias("period"), rounded("total"))


@R.add(
    "j7_alarm_stream",
    f"""WITH w AS (SELECT * FROM ({PERIODS_SQL}) WHERE (p + 1) * {PERIOD_S * 1_000_000} <= (SELECT epoch_us(max(ts)) - 300000000 FROM events)),
    o AS (SELECT *, lag(p, 2) OVER (ORDER BY p) AS far FROM w WHERE queue = 'view' AND mean > 10)
    SELECT 'dead_letters' AS alarm, queue, p * {PERIOD_S} AS period, round(total, 6) AS value FROM w WHERE queue = 'error' AND total > 120
    UNION ALL SELECT 'backlog', queue, p * {PERIOD_S}, round(mean, 6) FROM o WHERE far = p - 2""",
)
def j7_alarms(spark, sf):
    """The alarms of all closed periods, raised by timers of the stream."""
    q = events(spark, sf).select("ts", F.col("event_type").alias("queue"), F.col("value").alias("visible"))
    out = drain(alarms.alarm_stream(q, "error", "view", PERIOD_S, 120, 10), "alarms")
    start = F.unix_seconds(F.col("period_start").cast("timestamp"))
    return out.select("alarm", "queue", start.alias("period"), rounded("value"))


TRIES, BACKOFF_S = 3, 3600


@R.add(
    "j5_retry_stream",
    f"""WITH l AS (
      SELECT 'j' || user_id % 20 AS job_id, {{'at': epoch_us(ts), 's': CASE event_id % 11 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending'
          WHEN 2 THEN 'processing' ELSE 'failed' END, 'e': event_type, 'f': 0, 'due': NULL::BIGINT,
          'out': []::STRUCT(action VARCHAR, attempt INTEGER, due BIGINT, error VARCHAR)[]}} AS x, ts, event_id FROM events),
    j AS (SELECT job_id, list(x ORDER BY ts, event_id) AS xs FROM l GROUP BY job_id),
    f AS (SELECT job_id, list_reduce(xs, lambda a, x:
        CASE WHEN x.s IN ('completed', 'pending') THEN {{'at': x.at, 's': x.s, 'e': NULL::VARCHAR, 'f': 0, 'due': NULL::BIGINT,
            'out': CASE WHEN a.due <= x.at THEN list_append(a.out, {{'action': 'retry', 'attempt': a.f, 'due': a.due, 'error': a.e}}) ELSE a.out END}}
          WHEN x.s = 'failed' AND (a.due IS NULL OR a.due <= x.at) AND a.f <= {TRIES} THEN
            {{'at': x.at, 's': x.s, 'e': x.e, 'f': a.f + 1,
              'due': CASE WHEN a.f < {TRIES} THEN x.at + {BACKOFF_S * 1_000_000} * CAST(2 ** a.f AS BIGINT) END,
              'out': list_concat(CASE WHEN a.due <= x.at THEN list_append(a.out, {{'action': 'retry', 'attempt': a.f, 'due': a.due, 'error': a.e}}) ELSE a.out END,
                CASE WHEN a.f >= {TRIES} THEN [{{'action': 'dead_letter', 'attempt': a.f + 1, 'due': x.at, 'error': x.e}}] ELSE [] END)}}
          ELSE {{'at': x.at, 's': x.s, 'e': a.e, 'f': a.f, 'due': CASE WHEN a.due > x.at THEN a.due END,
            'out': CASE WHEN a.due <= x.at THEN list_append(a.out, {{'action': 'retry', 'attempt': a.f, 'due': a.due, 'error': a.e}}) ELSE a.out END}} END,
        {{'at': 0::BIGINT, 's': '', 'e': NULL::VARCHAR, 'f': 0, 'due': NULL::BIGINT,
          'out': []::STRUCT(action VARCHAR, attempt INTEGER, due BIGINT, error VARCHAR)[]}}) AS a FROM j),
    o AS (SELECT job_id, unnest(CASE WHEN a.due <= (SELECT epoch_us(max(ts)) - 60000000 FROM events)
        THEN list_append(a.out, {{'action': 'retry', 'attempt': a.f, 'due': a.due, 'error': a.e}}) ELSE a.out END) AS r FROM f)
    SELECT job_id, r.action AS action, r.attempt AS attempt, r.due AS due_us, r.error AS error_message FROM o""",
)
def j5_retries(spark, sf):
    """Twenty jobs' logs with repeated failures, completions and restarts by hand."""
    i = F.col("event_id")
    status = (
        F.when(i % 11 == 0, "completed").when(i % 11 == 1, "pending").when(i % 11 == 2, "processing").otherwise("failed")
    )
    log = events(spark, sf).select(
        F.concat(F.lit("j"), (F.col("user_id") % 20).cast("string")).alias("job_id"), "ts", i.alias("seq"),
        status.alias("status"), F.col("event_type").alias("error_message"),
    )
    out = drain(alarms.retry_stream(log, TRIES, BACKOFF_S), "retries")
    return out.select(
        "job_id", "action", "attempt", F.unix_micros(F.col("due_at").cast("timestamp")).alias("due_us"), "error_message"
    )


@R.add("j8_rate_limit_stream", RATE_SQL)
def j8_stream(spark, sf):
    """The same decisions as the batch form."""
    q = events(spark, sf).select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("request_id"))
    out = drain(stt.rate_limit_stream(q, LIMIT, WINDOW_S), "decisions")
    return out.select("request_id", "allowed", "remaining", "reset_seconds")


@R.add(
    "j10_pair_stream",
    """WITH l AS (SELECT 'r' || (event_id // 2) AS cid, ts, event_id % 2 AS c FROM events WHERE event_id % 14 <> 3),
    p AS (SELECT a.cid, round((epoch_us(b.ts) - epoch_us(a.ts)) / 1000.0, 3)::DOUBLE AS duration_ms
      FROM l a JOIN l b ON a.cid = b.cid AND a.c = 0 AND b.c = 1 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 5 MINUTES),
    w AS (SELECT max(ts) - INTERVAL 10 MINUTES AS mark FROM l)
    SELECT cid AS correlation_id, 'paired' AS outcome, duration_ms FROM p
    UNION ALL SELECT cid, CASE c WHEN 0 THEN 'not completed' ELSE 'not started' END, NULL
    FROM l, w WHERE cid NOT IN (SELECT cid FROM p) AND ts < mark - CASE c WHEN 0 THEN INTERVAL 5 MINUTES ELSE INTERVAL 0 MINUTES END""",
)
def j10_stream(spark, sf):
    i = F.col("event_id")
    log = events(spark, sf).where(i % 14 != 3).select(
        F.concat(F.lit("r"), F.floor(i / 2).cast("string")).alias("correlation_id"), "ts",
        F.when(i % 2 == 0, "request_started").otherwise("request_completed").alias("event"),
        F.lit("GET").alias("method"), F.lit("/p").alias("path"), F.lit(200).alias("status_code"),
    )
    out = drain(stt.pair_stream(log), "pairs")
    micros = F.unix_micros("completed_at") - F.unix_micros("started_at")
    return out.select("correlation_id", "outcome", F.round(micros / 1000, 3).alias("duration_ms"))


@R.add(
    "j1_ingest_stream",
    f"""WITH {GOOD} SELECT document_id, CASE nth WHEN '' THEN 'completed' ELSE 'duplicate doi' END AS outcome,
      CASE nth WHEN '' THEN ls[1] END AS title, 1 AS attempts, 'completed' AS job, 5 AS steps, 7 AS events, nth = '' AS archived FROM art
    UNION ALL SELECT CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 10 = 7 THEN 'not well-formed XML' ELSE 'article has no front element' END, NULL, 1,
      'failed', 1, 4, false FROM documents WHERE doc_id % 10 IN (7, 8)""",
)
def j1(spark, sf):
    """Article XML arriving as table files: parsed, chunked, embedded, archived, stored, then read
    back with the jobs' states. A file's second article holds the doi of the first."""
    arrived, base = scratch_path(spark, "arrived"), scratch_path(spark, "ingested")
    article_xml(spark, sf).write.parquet(arrived)
    schema = spark.read.parquet(arrived).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(arrived)

    def parser(raw):
        from scholion.operators.articles import parse_articles

        return parse_articles(raw, "object_key")

    query = (
        stream.writeStream.foreachBatch(lambda df, n: ingest.ingest_batch(df, base, n, parser=parser))
        .option("checkpointLocation", scratch_path(spark, "ingest-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    docs = ingest.current_documents(spark, base).select(
        "document_id", F.col("processing_status").alias("outcome"), "title", F.col("processing_attempts").alias("attempts")
    )
    bad = ingest.read_versions(spark, base, "quarantine").select(
        F.col("object_key").alias("document_id"), F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("title"), "attempts"
    )
    twice = ingest.document_conflicts(spark, base).select(
        "document_id", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("attempts")
    )
    events = ingest.read_versions(spark, base, "job_events")
    jobs = job_state(events).join(events.groupBy("job_id").agg(F.count("*").cast("int").alias("events")), "job_id")
    kept = ingest.read_versions(spark, base, "archive").select(
        F.element_at("metadata", "document_id").alias("document_id"), F.lit(True).alias("archived")
    )
    return (
        docs.unionByName(bad)
        .unionByName(twice)
        .join(jobs.withColumnRenamed("job_id", "document_id"), "document_id", "left")
        .join(kept, "document_id", "left")
        .select(
            "document_id", "outcome", "title", "attempts", F.col("status").alias("job"),
            F.col("completed_steps").alias("steps"), "events", F.coalesce("archived", F.lit(False)).alias("archived"),
        )
    )


@R.add(
    "j1_ingest_pages",
    f"""WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn, {strip_sql("CASE WHEN conv_id % 9 = 0 THEN ' ' ELSE text END")} AS t FROM conversations),
    d AS (SELECT document_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS text FROM p WHERE t <> '' GROUP BY document_id)
    SELECT document_id, 'completed' AS outcome, {TITLE_SQL} AS title, CAST(len({words_sql('text')}) AS INTEGER) AS words, 'completed' AS job FROM d
    UNION ALL SELECT DISTINCT document_id, 'no page holds any text', NULL, NULL::INTEGER, 'failed' FROM p
    WHERE document_id NOT IN (SELECT document_id FROM d)""",
)
def j1_pages(spark, sf):
    """Conversations as documents of page texts, one page a turn, every ninth one blank."""
    base = scratch_path(spark, "ingested")
    c = F.col("conv_id")
    pages = table(spark, sf, "conversations").select(
        c.cast("string").alias("document_id"), F.col("turn").alias("page_no"),
        F.when(c % 9 == 0, F.lit(" ")).otherwise(F.col("text")).alias("text"),
    )
    ingest.ingest_pages(pages, base, 0)
    docs = ingest.current_documents(spark, base).select(
        "document_id", F.col("processing_status").alias("outcome"), "title", F.col("word_count").alias("words")
    )
    bad = ingest.read_versions(spark, base, "quarantine").select(
        F.col("object_key").alias("document_id"), F.col("reason").alias("outcome"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("words"),
    )
    jobs = job_state(ingest.read_versions(spark, base, "job_events")).select(
        F.col("job_id").alias("document_id"), F.col("status").alias("job")
    )
    return docs.unionByName(bad).join(jobs, "document_id", "left")

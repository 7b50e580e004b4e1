"""Search history and bookmarks from event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import stable_id, strip
from scholion.session import small_side

# Fixed value: how many recent searches are kept per user.
RECENT = 10
BUCKET_SECONDS = 86_400


def append_history(queries: DataFrame, results: DataFrame, latency_ms: Column | None = None) -> DataFrame:
    """One history row per completed search, ready to append."""
    hits = results.groupBy("query_id").agg(
        F.count("*").cast("int").alias("result_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda r: r["chunk_id"]).alias(
            "result_ids"
        ),
    )
    have = set(queries.columns)

    def opt(name: str, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)

    filters = [c for c in ("date_from", "date_to", "journals", "article_types") if c in have]
    texts = [
        F.to_json(c) if c in ("journals", "article_types") else F.col(c).cast("string") for c in filters
    ]
    entries = [x for c, t in zip(filters, texts, strict=True) for x in (F.lit(c), t)]
    used = (
        F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
        if entries
        else F.create_map().cast("map<string,string>")
    )
    created = F.col("created_at") if "created_at" in have else F.current_timestamp()
    base = queries.select(
        "query_id",
        stable_id(F.col("query_id"), created).alias("id"),
        "query_text",
        "search_type",
        used.alias("filters"),
        (latency_ms if latency_ms is not None else F.lit(None)).cast("int").alias("latency_ms"),
        opt("user_id", "string"),
        opt("session_id", "string"),
        created.alias("created_at"),
    )
    return (
        base.join(hits, "query_id", "left")
        .withColumn("result_count", F.coalesce("result_count", F.lit(0)))
        .withColumn("result_ids", F.coalesce("result_ids", F.array().cast("array<string>")))
        .drop("query_id")
    )


def recent_searches(history: DataFrame, n: int = RECENT) -> DataFrame:
    """Newest n searches per user; blank ones dropped, repeats (case ignored) keep the newest.

    Repeats collapse in a pre-combined maximum, the cut is a top-n: a very active user is
    never gathered in one task.
    """
    clean = history.withColumn("query", strip("query")).where(F.col("query") != "")
    newest = clean.groupBy("user_id", F.lower("query").alias("_q")).agg(
        F.max(F.struct("ts", "id", "query")).alias("m")
    )
    rows = newest.select("user_id", "m.*")
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def apply_removals(
    history: DataFrame, removals: DataFrame | None = None, clears: DataFrame | None = None
) -> DataFrame:
    """Drop removed entries, and everything a user had before their last clear."""
    out = history
    if removals is not None:
        out = out.join(removals.select("user_id", "id").distinct(), ["user_id", "id"], "left_anti")
    if clears is not None:
        last = clears.groupBy("user_id").agg(F.max("ts").alias("_cleared"))
        out = (
            out.join(small_side(last), "user_id", "left")
            .where(F.col("_cleared").isNull() | (F.col("ts") > F.col("_cleared")))
            .drop("_cleared")
        )
    return out


def bookmarks(events: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Final bookmarks (user_id, document_id, bookmarked_at) from add / remove / toggle / clear.

    events: user_id, document_id (NULL for clear), action, ts, seq; seq breaks ties in ts.
    An add of a bookmarked document changes nothing, so bookmarked_at is when it last became
    one. The order of events matters, yet no key is sorted as a whole: each key's events are
    cut into time buckets, a bucket is summed up as what it does to a key that enters it
    unmarked or marked, and only these summaries are folded in time order.
    """
    clears = (
        events.where(F.col("action") == "clear")
        .groupBy("user_id")
        .agg(F.max(F.struct("ts", "seq")).alias("_clear"))
    )
    acts = events.where(F.col("action").isin("add", "remove", "toggle"))
    live = (
        acts.join(small_side(clears), "user_id", "left")
        .where(F.col("_clear").isNull() | (F.struct("ts", "seq") > F.col("_clear")))
        .drop("_clear")
    )
    at = F.col("ts").cast("timestamp")
    keyed = live.withColumn(
        "_bucket", F.floor(F.unix_micros(at) / (bucket_seconds * 1_000_000))
    )
    key = ["user_id", "document_id", "_bucket"]
    w = Window.partitionBy(*key).orderBy("ts", "seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    absolute = F.col("action").isin("add", "remove")
    # last add/remove in the bucket so far, and toggles since
    stepped = (
        keyed.withColumn("_toggles", F.count_if(F.col("action") == "toggle").over(so_far))
        .withColumn(
            "_abs",
            F.last(
                F.when(absolute, F.struct((F.col("action") == "add").cast("int").alias("on"), F.col("_toggles").alias("t"))),
                ignorenulls=True,
            ).over(so_far),
        )
    )
    odd = (F.col("_toggles") - F.coalesce(F.col("_abs.t"), F.lit(0))) % 2
    states = stepped
    for entering in (0, 1):
        after = (F.coalesce(F.col("_abs.on"), F.lit(entering)) + odd) % 2
        states = states.withColumn(f"_s{entering}", after)
    for entering in (0, 1):
        before = F.lag(f"_s{entering}", 1, entering).over(w)
        states = states.withColumn(
            f"_on{entering}",
            F.when((F.col(f"_s{entering}") == 1) & (before == 0), F.col("ts")),
        )
    order = F.struct("ts", "seq")
    summary = states.groupBy(*key).agg(
        F.max_by("_s0", order).alias("exit0"),
        F.max_by("_s1", order).alias("exit1"),
        F.max("_on0").alias("since0"),
        F.max("_on1").alias("since1"),
    )
    parts = summary.groupBy("user_id", "document_id").agg(
        F.array_sort(F.collect_list(F.struct("_bucket", "exit0", "exit1", "since0", "since1"))).alias("parts")
    )
    ts_type = dict(events.dtypes)["ts"]
    state = f"struct<on:bigint,since:{ts_type}>"

    def fold(acc: Column, p: Column) -> Column:
        leaves = F.when(acc["on"] == 1, p["exit1"]).otherwise(p["exit0"])
        since = F.when(acc["on"] == 1, F.coalesce(p["since1"], acc["since"])).otherwise(p["since0"])
        return F.struct(
            leaves.cast("bigint").alias("on"), F.when(leaves == 1, since).alias("since")
        ).cast(state)

    start = F.struct(F.lit(0).cast("bigint").alias("on"), F.lit(None).cast(ts_type).alias("since")).cast(state)
    return (
        parts.select("user_id", "document_id", F.aggregate("parts", start, fold).alias("f"))
        .where(F.col("f.on") == 1)
        .select("user_id", "document_id", F.col("f.since").alias("bookmarked_at"))
    )


def is_bookmarked(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """(user_id, document_id) pairs with a flag."""
    have = marks.select("user_id", "document_id", F.lit(True).alias("bookmarked"))
    return pairs.join(have, ["user_id", "document_id"], "left").withColumn(
        "bookmarked", F.coalesce("bookmarked", F.lit(False))
    )

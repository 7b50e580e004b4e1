"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at many points of a ring, every row at the point of its key, and a row belongs to
the shard at the next point clockwise. A shard takes no more rows than its bound: what overflows
continues clockwise, to the next shard that it has not asked before, in rounds. Rows of one arc are in
a fixed order, so what an arc gives a shard is a stretch of that order, and the whole plan follows from
the number of rows of each arc: its size depends on shards and points alone. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.llm.ranking import numbered, with_row
from scholion.session import persist_shared

SHARDS = 16
REPLICAS = 128
POINT_BITS = 60
SLOT_BITS = 12


def point(text: Column) -> Column:
    """Place on the ring: the first 15 hex digits of the md5."""
    return F.conv(F.substring(F.md5(text), 1, POINT_BITS // 4), 16, 10).cast("bigint")


def ring(spark: SparkSession, shards: int, replicas: int) -> DataFrame:
    """One stored row: `points`, the ring in order, and `ask`, for each arc its shards in clockwise order."""
    arcs = shards * replicas + 1
    shard = (F.col("id") % shards).cast("int")
    at = point(F.concat_ws(":", shard, F.floor(F.col("id") / shards)))
    clockwise = lambda a: F.array_distinct(
        F.transform(
            F.concat(F.slice("points", a + 1, arcs), F.slice("points", F.lit(1), a)), lambda p: p["shard"]
        )
    )
    points = persist_shared(
        spark.range(shards * replicas).agg(
            F.array_sort(F.collect_list(F.struct(at.alias("at"), shard.alias("shard")))).alias("points")
        ),
        "ring-points",
    )
    ask = F.transform(F.sequence(F.lit(0), F.lit(arcs - 1)), clockwise)
    return persist_shared(points.select("points", ask.alias("ask")), "ring")


def _slots(circle: DataFrame) -> DataFrame:
    """slot, first, inside: the ring's equal parts, the points before each and those in it.

    A key's arc is the number of points before its place: those before its part and those in the part
    that lie below it. The arc behind the last point goes on to the first one's shard.
    """
    slot = F.shiftright("p.at", POINT_BITS - SLOT_BITS)
    points = circle.select(F.explode("points").alias("p")).groupBy(slot.alias("slot")).agg(
        F.collect_list("p.at").alias("inside")
    )
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce("inside", F.array().cast("array<bigint>"))
    return (
        circle.sparkSession.range(1 << SLOT_BITS)
        .select(F.col("id").alias("slot"))
        .join(points, "slot", "left")
        .select("slot", inside.alias("inside"))
        .withColumn("first", F.coalesce(F.sum(F.size("inside")).over(earlier), F.lit(0)))
    )


def _with_arc(rows: DataFrame, circle: DataFrame) -> DataFrame:
    """rows and `arc`. The slots are 4096, whatever the table, so they are broadcast."""
    slot = F.shiftright("at", POINT_BITS - SLOT_BITS)
    below = F.size(F.filter("inside", lambda p: p < F.col("at")))
    return (
        rows.withColumn("slot", slot)
        .join(F.broadcast(_slots(circle)), "slot")
        .withColumn("arc", (F.col("first") + below).cast("int"))
        .drop("slot", "inside", "first")
    )


def _rounds(shards: int) -> Column:
    """The stretches that each shard takes of each arc, from columns ask, waiting and bound.

    In round r every arc that has rows left asks the r-th shard clockwise, arcs in ring order; a shard
    takes what its room allows. ask holds each arc's shards, waiting each arc's stretch of rows.
    """
    waiting = F.array().cast("array<struct<arc:int,first:bigint,past:bigint>>")
    taken = F.array().cast("array<struct<arc:int,first:bigint,past:bigint,shard:int,slot:bigint>>")

    def ask(r: Column):
        def one(state: Column, row: Column) -> Column:
            shard = F.get(F.get("ask", row["arc"]), r)
            room = F.get(state["room"], shard)
            cut = row["first"] + F.least(row["past"] - row["first"], room)
            piece = F.struct(
                row["arc"].alias("arc"), row["first"].alias("first"), cut.alias("past"),
                shard.alias("shard"), (F.get("bound", shard) - room).alias("slot"),
            )
            rest = F.struct(row["arc"].alias("arc"), cut.alias("first"), row["past"].alias("past"))
            rooms = F.transform(
                state["room"], lambda x, s: F.when(s == shard, x + row["first"] - cut).otherwise(x)
            )
            return F.struct(
                rooms.alias("room"),
                F.when(cut < row["past"], F.concat(state["waiting"], F.array(rest)))
                .otherwise(state["waiting"])
                .alias("waiting"),
                F.when(cut > row["first"], F.concat(state["taken"], F.array(piece)))
                .otherwise(state["taken"])
                .alias("taken"),
            )

        return one

    def round_(state: Column, r: Column) -> Column:
        start = F.struct(state["room"].alias("room"), waiting.alias("waiting"), state["taken"].alias("taken"))
        return F.aggregate(state["waiting"], start, ask(r))

    start = F.struct(F.col("bound").alias("room"), F.col("waiting"), taken.alias("taken"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, round_)["taken"]


def plan(rows: DataFrame, circle: DataFrame, shards: int, slack: float = 0.0) -> DataFrame:
    """arc, pieces: who takes which stretch of each arc's rows.

    With a slack of 0 the bounds add up to the number of rows: every shard is filled, and the numbers
    of rows of two shards differ by one at most. Otherwise a bound is that share above the mean.
    """
    counts = rows.groupBy("arc").agg(F.count("*").alias("rows"))
    listed = counts.agg(
        F.array_sort(
            F.collect_list(F.struct("arc", F.lit(0).cast("bigint").alias("first"), F.col("rows").alias("past")))
        ).alias("waiting"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
    )
    each, rest = F.floor(F.col("total") / shards), F.col("total") % shards
    bound = lambda s: F.when(s < rest, each + 1).otherwise(each)
    if slack:
        bound = lambda s: F.ceil(F.col("total") * (1 + slack) / shards)
    # One row of a size that shards and replicas fix; stored, lest a lambda compute it anew.
    one = persist_shared(
        listed.select(
            circle.select("ask").scalar().alias("ask"),
            "waiting",
            F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), bound).alias("bound"),
        ),
        "ring-counts",
    )
    taken = one.select(F.explode(_rounds(shards)).alias("t")).select("t.*")
    return taken.groupBy("arc").agg(
        F.array_sort(F.collect_list(F.struct("first", "past", "shard", "slot"))).alias("pieces")
    )


def shard_rows(docs: DataFrame, shards: int = SHARDS, replicas: int = REPLICAS, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, home, shard, slot of each row of docs (doc_id, text).

    size is the text's UTF-8 bytes plus one. The key is doc_id; home is the shard the ring names for it, shard the one that has taken it, slot its place
    there, gapless from 0. Rows are ordered on the ring by point, doc_id, size and CRC, so equal rows
    are interchangeable and one doc_id with many rows overflows like any other stretch. Null text:
    size 1 and the CRC of no byte. Null doc_id: the point of the empty text. Other columns are never
    read. An empty table gives an empty result. Texts are read once; what moves is a row's numbers.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    circle = ring(docs.sparkSession, shards, replicas)
    keys = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        point(key).alias("at"),
    )
    stored = with_row(_with_arc(keys, circle), "ring-keys")
    pieces = persist_shared(plan(stored, circle, shards, slack), "ring-plan")
    order = [F.col("at"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    home = circle.select(F.posexplode("ask").alias("arc", "ask")).select("arc", F.get("ask", F.lit(0)).alias("home"))
    piece = F.get(F.filter("pieces", lambda p: F.col("rank") < p["past"]), F.lit(0))
    # At most one row for each arc and one piece for each arc and shard.
    return (
        numbered(stored, order, within=("arc",), label="ring-ranks")
        .join(F.broadcast(pieces), "arc")
        .join(F.broadcast(home), "arc")
        .withColumn("piece", piece)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "home",
            F.col("piece.shard").alias("shard"),
            (F.col("piece.slot") + F.col("rank") - F.col("piece.first")).alias("slot"),
        )
    )

"""Importance resampling towards a target distribution of hashed word features.

Features are the runs of one to `longest` consecutive words, hashed by CRC-32. The CRC of a span is the
exclusive or of what each byte contributes by its value and its distance from the span's end, and of a
constant for the span's length; contributions come from one table, and `bitwise_xor.reduceat` folds
those of all spans of an Arrow batch at once. A span longer than the table is folded block by block.
A bucket's gain is the log of its share in the target over its share in the source; a row's weight is
the sum of its features' gains, and the highest weights with Gumbel noise are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import worker_cache
from scholion.llm.ranking import numbered, with_row
from scholion.session import persist_shared

BUCKETS = 10_000
LONGEST = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024

# ---- CRC-32 of many spans ------------------------------------------------------------------

POLYNOMIAL = 0xEDB88320  # a fixed value: CRC-32, least bit first
BLOCK = 64
SPAN_BYTES = 1_000_000


class PositionTable:
    """What a byte contributes to a CRC-32 by its distance from the end, and what a length does."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1).astype(np.uint32)
        rows, start = [byte], [np.array([0xFFFFFFFF], dtype=np.uint32)]
        # One more byte behind a state: its contribution moves on by one step of the plain algorithm.
        step = lambda x: (x >> np.uint32(8)) ^ byte[x & np.uint32(255)]
        for _ in range(block - 1):
            rows.append(step(rows[-1]))
        for _ in range(block):
            start.append(step(start[-1]))
        self.flat = np.concatenate(rows)
        self.start = np.concatenate(start)

    def fold(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Exclusive or of the contributions in each span of at most `block` bytes; 0 if it is empty."""
        out = np.zeros(len(begin), dtype=np.uint32)
        some = np.flatnonzero(length)
        if len(some):
            size = length[some].astype(np.int32)
            past = np.cumsum(size, dtype=np.int64)
            first = past - size
            place = np.arange(past[-1], dtype=np.int32)
            distance = np.repeat((past - 1).astype(np.int32), size) - place
            byte = data[np.repeat(begin[some] - first, size) + place]
            out[some] = np.bitwise_xor.reduceat(self.flat[(distance << 8) | byte], first)
        return out

    def moved(self, state: np.ndarray) -> np.ndarray:
        """States with a block of zero bytes behind them."""
        out = np.zeros_like(state)
        for k in range(4):
            byte = (state >> np.uint32(8 * k)) & np.uint32(255)
            out ^= self.flat[((self.block - 1 - k) << 8) | byte]
        return out

    def crc32(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC-32 of data[begin : begin + length] for each span; spans may overlap."""
        out = np.empty(len(begin), dtype=np.uint32)
        # The last blocks are whole ones, so what is odd stands in front.
        head = np.where(length > self.block, (length - 1) % self.block + 1, length)
        cuts = np.append(0, np.cumsum(head)) // SPAN_BYTES
        edges = np.append(np.flatnonzero(np.diff(cuts, prepend=-1)), len(begin))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out[a:b] = self.start[head[a:b]] ^ self.fold(data, begin[a:b], head[a:b])
        todo = np.flatnonzero(length > head)
        at = head.copy()
        while len(todo):
            for a in range(0, len(todo), SPAN_BYTES // self.block):
                part = todo[a : a + SPAN_BYTES // self.block]
                whole = np.full(len(part), self.block)
                out[part] = self.moved(out[part]) ^ self.fold(data, begin[part] + at[part], whole)
            at[todo] += self.block
            todo = todo[length[todo] > at[todo]]
        return out ^ np.uint32(0xFFFFFFFF)


# ---- words and features --------------------------------------------------------------------


def _folded() -> np.ndarray:
    """Each byte as it counts: A-Z in lower case, word bytes as they are, all others 0."""
    out = np.zeros(256, dtype=np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        out[low : high + 1] = np.arange(low, high + 1)
    out[0x41 : 0x5A + 1] = np.arange(0x61, 0x7A + 1)
    return out


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of a column of texts, and begin, length and row of each word, in order."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, raw = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = (int(ends[0]), int(ends[-1])) if len(texts) else (0, 0)
    if high == low:
        return np.zeros(0, dtype=np.uint8), *(np.zeros(0, dtype=np.int64) for _ in range(3))
    ends = ends - low
    data = _folded()[np.frombuffer(raw, dtype=np.uint8)[low:high]]
    inside = data != 0
    change = np.empty(len(data) + 1, dtype=bool)
    change[0], change[-1] = inside[0], inside[-1]
    change[1:-1] = inside[1:] != inside[:-1]
    edges = np.flatnonzero(change)
    # Words that meet where one row's text ends are parted there.
    borders = ends[1:-1]
    borders = np.unique(borders[(borders > 0) & (borders < len(data))])
    meet = borders[inside[borders] & inside[borders - 1]]
    edges = np.sort(np.concatenate([edges, meet, meet]))
    begin, past = edges[::2], edges[1::2]
    return data, begin, past - begin, np.searchsorted(ends, begin, side="right") - 1


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of each feature, and the number of words of each row."""
    table = worker_cache("position_table", str(BLOCK), PositionTable)
    data, begin, length, row = words(texts)
    n_words = np.bincount(row, minlength=len(texts))
    if longest == 1:
        return table.crc32(data, begin, length) % buckets, row, n_words
    # Words again, one space apart, so that a run of words is one span.
    past = np.cumsum(length + 1) - 1
    first = past - length
    line = np.full(int(past[-1]) + 1 if len(past) else 0, 0x20, dtype=np.uint8)
    line[np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())] = data[data != 0]
    found, rows = [], []
    for n in range(1, longest + 1):
        last = np.arange(n - 1, len(row))
        last = last[row[last] == row[last - n + 1]]
        start = first[last - n + 1]
        found.append(table.crc32(line, start, past[last] - start) % buckets)
        rows.append(row[last])
    return np.concatenate(found), np.concatenate(rows), n_words


def _slices(batch: pa.RecordBatch, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows whose texts have at most `limit` bytes, or of one row."""
    text = batch.column("text").cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    at = 0
    while at < len(batch):
        past = max(int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1, at + 1)
        yield batch.slice(at, past - at)
        at = past


# ---- counts, gains, weights ----------------------------------------------------------------


def bucket_counts(rows: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts of rows fall into each bucket that has any.

    A task sends one row for each bucket, however many texts it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in _slices(batch):
                n += np.bincount(features(part.column("text"), longest, buckets)[0], minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["bucket", "n"])

    counted = rows.select("text").mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(
    source: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS
) -> DataFrame:
    """bucket, s, t, gain of each bucket: its features in source and target and what one of them adds."""
    sides = [
        bucket_counts(side, longest, buckets).select("bucket", F.col("n").alias(name))
        for side, name in ((source, "s"), (target, "t"))
    ]
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    # Stored, as the totals are taken from it, too: texts are counted once.
    both = persist_shared(
        every.join(sides[0], "bucket", "left").join(sides[1], "bucket", "left").na.fill(0), "buckets"
    )
    total = lambda c: both.agg(F.sum(c).cast("double")).scalar()
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (total("s") + buckets) / ((d("s") + 1) * (total("t") + buckets))
    return both.select("bucket", "s", "t", F.floor(1000 * F.ln(ratio)).cast("bigint").alias("gain"))


def weigh(docs: DataFrame, gains: list[int], longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of docs."""
    gain = np.asarray(gains, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                bucket, row, n_words = features(part.column("text"), longest, len(gain))
                # Sums of whole numbers far below 2^53: doubles hold them exactly.
                weight = np.bincount(row, weights=gain[bucket], minlength=len(part)).astype(np.int64)
                n = np.bincount(row, minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), *map(pa.array, (n_words, n, weight))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    )


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the sha256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296))).cast("bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of docs (doc_id, text).

    Of the rows with at least min_words words, `percent` in a hundred (rounded down) are drawn: those of
    the highest score, ties by the smaller doc_id; rank numbers them from 1 and is null for others.
    Null and empty texts have no words, no features and the weight 0. A null doc_id counts as empty in
    the noise and ranks before other ids of its score; repeated rows are drawn each on its own. An empty
    target or an empty table of rows is fine. Other columns are never read. The gains, one number a
    bucket, travel to the tasks; texts are read twice and never shuffled.
    """
    gains = bucket_gains(docs, target, longest, buckets).orderBy("bucket").select("gain").collect()
    weighed = weigh(docs, [r.gain for r in gains], longest)
    stored = with_row(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    fit = F.col("n_words") >= min_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    drawn = F.when(F.col("rank") < F.floor(F.col("n") * percent / 100), F.col("rank") + 1)
    ranked = numbered(stored.where(fit), order, label="resampled").withColumn("rank", drawn).drop("n")
    return ranked.unionByName(stored.where(~fit).withColumn("rank", F.lit(None).cast("bigint"))).drop("row")

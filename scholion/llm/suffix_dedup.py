"""Exact substring deduplication with merged Burrows-Wheeler transforms.

Every stretch of `length` bytes holds a smallest 24-byte string by hash, its anchor, and equal
stretches have equal anchors. A run of stretches with one anchor is a fragment of the text. Only
anchors seen in several documents matter (anchors travel as packed 40-bit values, dealt by their other
bits; two that are equal by chance only cost work). Their fragments go to the task of the anchor, equal
ones as one string with its smallest document. There the strings are dealt over shards, each shard's
Burrows-Wheeler transform is built, and the transforms are merged by interleave refinement; intervals
with a common prefix of `length` bytes are the repeated strings, and each hands its smallest document
back to the places it stands at. A string without another one under its anchor needs no merge: its own
smallest document is that of all its stretches. Of the others only the stretches whose 64-bit hash comes
again are merged, with what follows them; that two of them are equal is for the merge to find.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.llm.bwt import smallest_owner
from scholion.llm.common import even, forget, give_back
from scholion.session import persist_shared, small_side, stored_result

LENGTH = 50
ANCHOR = 24
CHUNK_BITS = 9
# Hashes of a segment that stay in a core's cache take two thirds of the time of 2 MB ones.
SEGMENT_BYTES = 250_000
RUN_STRETCHES = 256
BUCKET_BYTES = 16_000_000
GROUP_BYTES = 2_000_000
PACKED = "chunk bigint, bucket bigint, packed binary"
PLACED = "anchor bigint, mark bigint, doc bigint, copy bigint, start bigint, fragment binary"
COVERED = "doc bigint, copy bigint, begin bigint, past bigint"
LONG_TEXT = 100_000
ROW_BYTES = 40
SHARD_BYTES = 700_000
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


# ---- anchors and fragments ---------------------------------------------------------------


def anchor_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the `size` bytes from each place, as many as there are whole ones."""
    n = len(data) - size + 1
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray((len(data),), dtype="<u8", buffer=padded.tobytes(), strides=(1,))
    h = np.full(n, size, dtype=np.uint64)
    for at in range(0, size - 7, 8):
        h = (h ^ words[at : at + n]) * M1
        h ^= h >> np.uint64(32)
    for at in range(size // 8 * 8, size):
        h = (h ^ data[at : at + n].astype(np.uint64)) * M1
        h ^= h >> np.uint64(32)
    h *= M2
    return h ^ (h >> np.uint64(29))


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    step = 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def runs(raws: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Document, first stretch, number of stretches and anchor of each run, several arrays at a time.

    Documents are joined to segments of bounded size; a longer one is cut with an overlap, which only
    cuts a run in two.
    """
    size = min(ANCHOR, length)
    held, total = [], 0
    for doc, raw in enumerate(raws):
        for at in range(0, len(raw) - length + 1, SEGMENT_BYTES):
            part = raw[at : at + SEGMENT_BYTES + length - 1]
            held.append((doc, at, part))
            total += len(part)
            if total >= SEGMENT_BYTES:
                yield _segment_runs(held, length, size)
                held, total = [], 0
    if held:
        yield _segment_runs(held, length, size)


def _segment_runs(held: list, length: int, size: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(p) for _, _, p in held])
    ends = np.cumsum(sizes)
    least = sliding_least(
        anchor_hashes(np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8), size),
        length - size + 1,
    )
    change = np.concatenate([[True], least[1:] != least[:-1]])
    # The last length - 1 places of a document start no stretch of it.
    begins = ends - sizes
    change[begins] = True
    lasts = ends - length + 1
    change[lasts[lasts < len(change)]] = True
    start = np.flatnonzero(change)
    count = np.diff(np.append(start, len(least)))
    part = np.searchsorted(ends, start, side="right")
    inside = start < lasts[part]
    start, count, part = start[inside], count[inside], part[inside]
    pieces = -(-count // RUN_STRETCHES)
    again = np.repeat(np.arange(len(start)), pieces)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    taken = np.minimum(count[again] - nth * RUN_STRETCHES, RUN_STRETCHES)
    first = start[again] + nth * RUN_STRETCHES
    docs = np.array([d for d, _, _ in held])[part[again]]
    offset = np.array([a for _, a, _ in held]) - begins
    # A least hash is a small number, so its bits are mixed once more.
    anchor = least[first] * M3
    anchor ^= anchor >> np.uint64(31)
    return docs, first + offset[part[again]], taken, (anchor * M1).view(np.int64)


def _dealt(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each anchor, in the order of the anchors."""
    high = anchor.view(np.uint64) >> np.uint64(32)
    return ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _pack(anchor: np.ndarray) -> bytes:
    """The low 40 bits of each anchor."""
    return anchor.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 5)
    return out.view(np.int64)[:, 0]


def _anchors(length: int, buckets: int):
    """Packed anchors by chunk and bucket; an anchor of several documents of a chunk comes twice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for frame in frames:
            frame = frame.sort_values("doc_id", ignore_index=True)
            for chunk, part in frame.groupby("chunk", sort=False):
                raws = [t.encode() for t in part["text"]]
                found = list(runs(raws, length))
                if not found:
                    continue
                anchor = np.concatenate([f[3] for f in found])
                doc = np.concatenate([f[0] for f in found])
                order = np.argsort(anchor.view(np.uint64), kind="stable")
                anchor, doc = anchor[order], doc[order]
                fresh = np.concatenate([[True], anchor[1:] != anchor[:-1]])
                # Documents ascend within an anchor, so every change is another one.
                again = ~fresh & np.concatenate([[False], doc[1:] != doc[:-1]])
                anchor = anchor[fresh | again]
                bucket = _dealt(anchor, buckets)
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.append(cut[1:], len(anchor))
                yield pd.DataFrame(
                    {
                        "chunk": np.full(len(cut), chunk),
                        "bucket": bucket[cut],
                        "packed": [_pack(anchor[a:b]) for a, b in zip(cut, ends, strict=True)],
                    }
                )
        give_back()

    return run


def _repeated(frame: pd.DataFrame) -> pd.DataFrame:
    """The anchors of one bucket that come at least twice, for each chunk that has them."""
    sizes = np.array([len(p) // 5 for p in frame["packed"]])
    anchor = _unpack(b"".join(frame["packed"]))
    chunk = np.repeat(frame["chunk"].to_numpy(), sizes)
    order = np.argsort(anchor, kind="stable")
    anchor, chunk = anchor[order], chunk[order]
    same = anchor[1:] == anchor[:-1]
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    anchor, chunk = anchor[twice], chunk[twice]
    order = np.argsort(chunk, kind="stable")
    anchor, chunk = anchor[order], chunk[order]
    cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])[: len(chunk)])
    ends = np.append(cut[1:], len(chunk))[: len(cut)]
    return pd.DataFrame(
        {
            "chunk": chunk[cut],
            "bucket": np.full(len(cut), frame["bucket"].iat[0]),
            "packed": [_pack(anchor[a:b]) for a, b in zip(cut, ends, strict=True)],
        }
    )


def _fragments(length: int, buckets: int):
    """Fragments of one chunk's documents whose anchor is in the chunk's list."""
    import xxhash

    columns = ["anchor", "mark", "doc", "copy", "start", "fragment"]

    def run(docs: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        forget()
        out = [pd.DataFrame(columns=columns)]
        if len(docs) and len(wanted):
            known = np.sort(
                np.concatenate(
                    [(b << 40) | _unpack(p) for b, p in zip(wanted["bucket"], wanted["packed"], strict=True)]
                )
            )
            docs = docs.sort_values(["doc_id", "copy"], ignore_index=True)
            raws = [t.encode() for t in docs["text"]]
            ids, copies = docs["doc_id"].to_numpy(), docs["copy"].to_numpy()
            for doc, start, count, anchor in runs(raws, length):
                code = (_dealt(anchor, buckets) << 40) | (anchor & ((1 << 40) - 1))
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code)
                if not len(hit):
                    continue
                doc, start, past = doc[hit], start[hit], start[hit] + count[hit] + length - 1
                cuts = [raws[d][s:e] for d, s, e in zip(doc.tolist(), start.tolist(), past.tolist(), strict=True)]
                marks = [xxhash.xxh64_intdigest(cut) - 2**63 for cut in cuts]
                found = (anchor[hit], marks, ids[doc], copies[doc], start, cuts)
                out.append(pd.DataFrame(dict(zip(columns, found, strict=True))))
        frame = pd.concat(out[1:] or out, ignore_index=True)
        give_back()
        return frame

    return run


def _stretches(length: int):
    """A crowded anchor's strings cut into single stretches with the hash of each."""
    import xxhash

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for a, m, own, cut in zip(
                frame["anchor"], frame["mark"], frame["owner"], frame["fragment"], strict=True
            ):
                for i in range(len(cut) - length + 1):
                    part = cut[i : i + length]
                    out.append((a, m, i, xxhash.xxh64_intdigest(part) - 2**63, own, part))
            yield pd.DataFrame(out, columns=["anchor", "source", "shift", "mark", "owner", "fragment"])

    return run


def _shared_pieces(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, first stretch and number of stretches of each run of stretches whose hash comes again.

    Equal stretches have equal hashes, so a stretch outside these runs is like no other one.
    """
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    hashes = anchor_hashes(np.frombuffer(b"".join(strings), dtype=np.uint8), length)
    inside = np.ones(len(hashes), dtype=bool)
    # The last length - 1 places of a string start no stretch of it.
    for k in range(length - 1):
        at = ends - 1 - k
        inside[at[at < len(hashes)]] = False
    places = np.flatnonzero(inside)
    order = np.argsort(hashes[places])
    met = hashes[places[order]]
    same = met[1:] == met[:-1]
    marked = np.sort(places[order[np.append(False, same) | np.append(same, False)]])
    # A run ends with the stretches that come again, and with its string.
    at = np.flatnonzero(np.append(True, np.diff(marked) > 1)[: len(marked)] | np.isin(marked, ends - sizes))
    begin, count = marked[at], np.diff(np.append(at, len(marked)))
    item = np.searchsorted(ends, begin, side="right")
    return item, begin - (ends - sizes)[item], count


def _owners(strings: list[bytes], owner: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document of each stretch of all strings, and how many each has; equal anchors stand together.

    A string alone under its anchor needs no merge, and of the others only what may be found again does.
    """
    sizes = np.array([len(s) - length + 1 for s in strings])
    found = np.repeat(owner, sizes)
    same = anchor[1:] == anchor[:-1]
    several = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    if len(several):
        item, begin, count = _shared_pieces([strings[i] for i in several], length)
        item = several[item]
        pieces = [strings[i][b : b + n + length - 1] for i, b, n in zip(item, begin, count, strict=True)]
        got = smallest_owner(pieces, owner[item], length, SHARD_BYTES) if pieces else []
        at = (np.cumsum(sizes) - sizes)[item] + begin
        for a, n, least in zip(at, count, got, strict=True):
            found[a : a + n] = least
    return found, sizes


def _runs_of(least: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """String, first stretch, number of stretches and smallest document of each run that shares one."""
    item = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (item[1:] != item[:-1])]))
    count = np.diff(np.append(at, len(least)))
    return item[at], at - (np.cumsum(sizes) - sizes)[item[at]], count, least[at]


def _covered(length: int):
    """The places of a group of anchors that an earlier document covers: doc, copy, begin, past."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        forget()
        frame = frame.sort_values(["anchor", "mark", "doc"], ignore_index=True)
        anchor, mark = frame["anchor"].to_numpy(), frame["mark"].to_numpy()
        fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (mark[1:] != mark[:-1])])
        at = np.flatnonzero(fresh)
        strings = frame["fragment"].iloc[at].tolist()
        owner = frame["doc"].to_numpy()[at]
        item, shift, count, least = _runs_of(*_owners(strings, owner, anchor[at], length))
        # Each place of a string has the string's runs.
        string = np.cumsum(fresh) - 1
        n_runs = np.bincount(item, minlength=len(at))[string]
        place = np.repeat(np.arange(len(frame)), n_runs)
        begins = np.cumsum(n_runs) - n_runs
        run_ = np.searchsorted(item, string)[place] + np.arange(len(place)) - begins[place]
        doc = frame["doc"].to_numpy()[place]
        hit = least[run_] < doc
        give_back()
        place, run_ = place[hit], run_[hit]
        begin = frame["start"].to_numpy()[place] + shift[run_]
        return pd.DataFrame(
            {
                "doc": doc[hit],
                "copy": frame["copy"].to_numpy()[place],
                "begin": begin,
                "past": begin + count[run_] + length - 1,
            }
        )

    return run


def _least_documents(length: int):
    """The stretches of a group's strings in runs that share a smallest document."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["anchor", "bucket", "mark"], ignore_index=True)
        # Strings of one anchor in different buckets are equal nowhere.
        kind = frame.groupby(["anchor", "bucket"], sort=False).ngroup().to_numpy()
        found, sizes = _owners(frame["fragment"].tolist(), frame["owner"].to_numpy(), kind, length)
        item, shift, count, least = _runs_of(found, sizes)
        return pd.DataFrame(
            {
                "anchor": frame["anchor"].to_numpy()[item],
                "mark": frame["mark"].to_numpy()[item],
                "first": shift,
                "past": shift + count + length - 1,
                "least": least,
            }
        )

    return run


def _representatives(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with a hash, and the smallest document of each text that several rows hold."""
    hashed = docs.withColumn("copy", F.xxhash64("text")).withColumn(
        "copy2", F.xxhash64(F.lit(1), F.col("text"))
    )
    copies = persist_shared(
        hashed.where("doc_id is not null")
        .groupBy("copy", "copy2")
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "copies",
    )
    return hashed.join(small_side(copies), ["copy", "copy2"], "left"), copies


def repeated_spans(hashed: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, copy, spans: for each text (doc_id, copy, text) the places that an earlier one covers.

    spans is an array of (begin, past) byte positions, apart from each other and in no order.
    """
    size = F.octet_length("text")
    # A chunk is 512 neighbouring ids, or one long text: its size is bounded by that of a text.
    chunk = F.when(size > LONG_TEXT, -1 - F.col("doc_id")).otherwise(F.shiftright("doc_id", CHUNK_BITS))
    long_enough = hashed.where(size >= length).select("doc_id", "copy", "text", chunk.alias("chunk"))
    buckets = max(1, math.ceil((long_enough.agg(F.sum(size)).first()[0] or 0) / BUCKET_BYTES))
    wanted = (
        even(long_enough.select("doc_id", "text", "chunk"))
        .mapInPandas(_anchors(length, buckets), PACKED)
        .groupBy("bucket")
        .applyInPandas(_repeated, PACKED)
    )
    places = persist_shared(
        long_enough.groupBy("chunk")
        .cogroup(wanted.groupBy("chunk"))
        .applyInPandas(_fragments(length, buckets), PLACED),
        "fragments",
    )
    weight = F.octet_length("fragment") + ROW_BYTES
    hot = persist_shared(
        places.groupBy("anchor").agg(F.sum(weight).alias("bytes")).where(F.col("bytes") > GROUP_BYTES), "hot"
    )
    few = small_side(hot.select("anchor"))
    groups = max(1, math.ceil((places.agg(F.sum(weight)).first()[0] or 0) / GROUP_BYTES))
    calm = (
        places.join(few, "anchor", "left_anti")
        .withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
        .groupBy("group")
        .applyInPandas(_covered(length), COVERED)
    )
    if not hot.isEmpty():
        calm = calm.unionByName(_hot_places(places.join(few, "anchor", "left_semi"), length))
    covered = persist_shared(calm, "covered")
    return _united(covered).groupBy("doc", "copy").agg(
        F.collect_list(F.struct("begin", "past")).alias("spans")
    )


def _hot_places(places: DataFrame, length: int) -> DataFrame:
    """What _covered gives, for anchors with more places than a task should hold.

    Equal strings become one before anything is gathered. An anchor that still has too many has its
    strings cut into single stretches; equal ones become one, and these are dealt over buckets by hash.
    """
    strings = persist_shared(
        places.groupBy("anchor", "mark").agg(
            F.min("doc").alias("owner"), F.max("fragment").alias("fragment")
        ),
        "strings",
    )
    size = F.octet_length("fragment") + 1
    crowds = persist_shared(
        strings.groupBy("anchor").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > GROUP_BYTES),
        "crowds",
    )
    cut = persist_shared(
        strings.join(crowds.select("anchor"), "anchor", "left_semi").mapInPandas(
            _stretches(length),
            "anchor bigint, source bigint, shift bigint, mark bigint, owner bigint, fragment binary",
        ),
        "stretches",
    )
    crowded = (
        cut.groupBy("anchor", "mark")
        .agg(F.min("owner").alias("owner"), F.max("fragment").alias("fragment"))
        .join(crowds, "anchor")
        .withColumn("bucket", F.pmod("mark", F.ceil(F.col("bytes") * length / GROUP_BYTES)))
        .drop("bytes")
    )
    calm = strings.join(crowds, "anchor", "left_anti").withColumn("bucket", F.lit(0).cast("bigint"))
    bytes_of = lambda df: df.agg(F.sum(F.octet_length("fragment") + 1)).first()[0] or 0
    groups = max(1, math.ceil((bytes_of(strings) + bytes_of(cut)) / GROUP_BYTES))
    least = persist_shared(
        calm.unionByName(crowded)
        .withColumn("group", F.pmod(F.xxhash64("anchor", "bucket"), F.lit(groups)))
        .groupBy("group")
        .applyInPandas(
            _least_documents(length),
            "anchor bigint, mark bigint, first bigint, past bigint, least bigint",
        ),
        "least",
    )
    back = cut.select("anchor", "source", "shift", "mark").join(least, ["anchor", "mark"]).select(
        "anchor",
        F.col("source").alias("mark"),
        F.col("shift").alias("first"),
        (F.col("shift") + length).alias("past"),
        "least",
    )
    least = least.join(crowds.select("anchor"), "anchor", "left_anti").unionByName(back)
    return (
        places.select("anchor", "mark", "doc", "copy", "start")
        .join(least, ["anchor", "mark"])
        .where("least < doc")
        .select(
            "doc",
            "copy",
            (F.col("start") + F.col("first")).alias("begin"),
            (F.col("start") + F.col("past")).alias("past"),
        )
    )


def _united(covered: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document as one."""
    each = Window.partitionBy("doc", "copy").orderBy("begin", "past")
    before = F.max("past").over(each.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("begin") > before), 1).otherwise(0)
    run = F.sum("opens").over(each.rowsBetween(Window.unboundedPreceding, 0))
    return (
        covered.withColumn("opens", opens)
        .withColumn("run", run)
        .groupBy("doc", "copy", "run")
        .agg(F.min("begin").alias("begin"), F.max("past").alias("past"))
    )


def _kept(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    cuts, at = [], 0
    for begin, past in removed:
        cuts.append(raw[at:begin])
        at = past
    return b"".join([*cuts, raw[at:]])


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """docs (with text not null) and each row's spans; an exact later copy is covered whole."""
    hashed, _ = _representatives(docs)
    first = F.col("first").isNull() | (F.col("doc_id") == F.col("first"))
    earlier = hashed.where(first & F.col("doc_id").isNotNull())
    spans = stored_result(docs.sparkSession, "spans", lambda: repeated_spans(earlier, length))
    whole = (F.col("doc_id") > F.col("first")) & (F.octet_length("text") >= length)
    return hashed.join(
        small_side(spans.withColumnRenamed("doc", "doc_id")), ["doc_id", "copy"], "left"
    ).withColumn("whole", F.coalesce(whole, F.lit(False)))


def _removed(raw: bytes, spans, whole: bool) -> list[tuple[int, int]]:
    if whole:
        return [(0, len(raw))]
    return sorted((s["begin"], s["past"]) for s in spans) if spans is not None else []


def span_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text).

    A byte goes if a stretch of `length` bytes covers it that also starts in a document with a
    smaller doc_id. Null counts as an empty text; texts shorter than a stretch lose nothing; rows
    with a null doc_id lose nothing and are no one's source; repeated rows lose the same bytes. An
    empty table gives an empty result.
    """
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text, spans, whole in zip(
                frame["doc_id"], frame["text"], frame["spans"], frame["whole"], strict=True
            ):
                raw = text.encode()
                removed = _removed(raw, spans, whole)
                rows.append(
                    (doc, len(raw), sum(p - b for b, p in removed), len(removed),
                     hashlib.sha256(_kept(raw, removed)).hexdigest())
                )
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    found = _with_spans(slim, length).select("doc_id", "text", "spans", "whole")
    return found.mapInPandas(run, schema)


def strip_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated bytes taken out of text, and n_chars, where there is one, set anew.

    A letter of which only some bytes go is dropped as a whole. Rows and other columns stay as they
    are; a null text stays null.
    """
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    slim = docs.select("doc_id", "text", F.struct(*extra).alias("rest") if extra else F.lit(0).alias("rest"))
    nothing = slim.where("text is null")
    found = _with_spans(slim.where("text is not null"), length).select(
        "doc_id", "text", "rest", "spans", "whole"
    )
    fields = {f.name: f for f in slim.schema.fields}
    schema = T.StructType([fields["doc_id"], fields["text"], fields["rest"]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for text, spans, whole in zip(frame["text"], frame["spans"], frame["whole"], strict=True):
                raw = text.encode()
                removed = _removed(raw, spans, whole)
                texts.append(_kept(raw, removed).decode("utf-8", "ignore") if removed else text)
            yield frame.assign(text=texts)[["doc_id", "text", "rest"]]
        give_back()

    changed = found.mapInPandas(run, schema).unionByName(nothing)
    picked = [
        F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns
    ]
    out = changed.select(*picked)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out

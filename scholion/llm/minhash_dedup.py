"""Near-duplicates by one-permutation hashing with optimal densification and banded buckets.

A document's shingles are hashed once; the hash range is cut into bins and the least hash of each
bin is its entry. An empty bin borrows the entry of the first non-empty bin in its own random probe
order, so borrowed entries collide as rarely as own ones. Bands of entries give bucket keys. Within a
bucket only star-shaped edges to its smallest document are candidates; they are confirmed on the full
shingle sets. Buckets whose members are then still in several components are looked at again, in blocks
of bounded size: members of different components whose signatures allow a link are compared by their
full sets where they are, and a spanning forest of the links comes back, never the pairs. Equal sets
are one node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import even, give_back, worker_cache
from scholion.llm.components import components
from scholion.session import persist_shared, small_side, stored_result

BANDS = 25
ROWS = 5
BINS = BANDS * ROWS
SEED = 11
BLOCK_ROWS = 1000
CACHED_WORDS = 200_000
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word met by the worker."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.digest = xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self.digest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def shingles(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of `width` words.

    A-Z are lower-cased and words end at ASCII white space. A text with fewer words is one shingle;
    one without words, or null, has none.
    """
    words = text.encode().lower().split() if text else []
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    take = min(width, len(words))
    if not take:
        return h
    n = len(words) - take + 1
    value = np.full(n, take, dtype=np.uint64)
    for i in range(take):
        value = value * M1 + mix(h[i : i + n] + np.uint64(i))
    return np.unique(mix(value))


def probe_orders(bins: int = BINS) -> np.ndarray:
    """Row t: the bin that each bin tries as its t-th."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(bins) for _ in range(bins)], axis=1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS entries for each non-empty set."""
    filled = np.zeros((len(sets), BINS), dtype=bool)
    least = np.zeros((len(sets), BINS), dtype=np.uint32)
    for row, h in enumerate(sets):
        at = ((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        filled[row, at[first]] = True
        least[row, at[first]] = h[first].astype(np.uint32)
    out, open_ = least.copy(), ~filled
    for probe in probe_orders():
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            break
        can = open_[rows] & filled[rows][:, probe]
        out[rows] = np.where(can, least[rows][:, probe], out[rows])
        open_[rows] &= ~can
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """BANDS signed 64-bit bucket keys for each signature."""
    entries = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), entries.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * M1 + entries[:, :, i])
    return key.view(np.int64)


def _digest(h: np.ndarray) -> tuple[int, int]:
    import xxhash

    raw = h.tobytes()
    return (xxhash.xxh64_intdigest(raw) - 2**63, xxhash.xxh64_intdigest(raw, seed=1) - 2**63)


def signed_documents(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, bucket keys and signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache("word_hashes", "xxh64", WordHashes)
        for batch in batches:
            # Only a few texts at a time become Python strings.
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = [shingles(t, width, known) for t in part.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = [None] * len(sets)
                marks = [None] * len(sets)
                if full:
                    signature = signatures([sets[i] for i in full])
                    for i, s, k in zip(full, signature, band_keys(signature), strict=True):
                        keys[i], marks[i] = k, s.tobytes()
                digests = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(marks, pa.binary()),
                    ],
                    names=["doc_id", "n", "d1", "d2", "keys", "signature"],
                )
        give_back()

    schema = "doc_id bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>, signature binary"
    return even(docs.select("doc_id", "text")).mapInArrow(run, schema)


def slack(n: np.ndarray, percent: int) -> np.ndarray:
    """How far an estimate may fall below the threshold for a true link: four deviations."""
    t = percent / 100
    return 4 * np.sqrt(t * (1 - t) / np.minimum(n, BINS))


def sizes_allow(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose signatures agree often enough."""
    slim = nodes.select("doc_id", "n", "signature")
    both = pairs.join(
        slim.select(F.col("doc_id").alias("u"), F.col("n").alias("nu"), F.col("signature").alias("su")), "u"
    ).join(slim.select(F.col("doc_id").alias("v"), F.col("signature").alias("sv")), "v")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                a = np.frombuffer(b"".join(frame["su"]), dtype=np.uint32).reshape(-1, BINS)
                b = np.frombuffer(b"".join(frame["sv"]), dtype=np.uint32).reshape(-1, BINS)
                near = (a == b).mean(axis=1) >= percent / 100 - slack(frame["nu"].to_numpy(), percent)
                yield frame.loc[near, ["u", "v"]]

    return both.mapInPandas(run, "u bigint, v bigint")


def _full_sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The full shingle sets of the documents in ids (doc_id)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = worker_cache("word_hashes", "xxh64", WordHashes)
        for frame in frames:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at : at + 500]
                made = [shingles(t, width, known).tobytes() for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "members": made})

    ids = persist_shared(ids.distinct(), "candidates")
    texts = docs.select("doc_id", "text").join(small_side(ids), "doc_id", "left_semi")
    sets = texts.mapInPandas(run, "doc_id bigint, members binary").dropDuplicates(["doc_id"])
    return persist_shared(sets, "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The stored pairs whose full sets reach the threshold."""
    full = _full_sets(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")), docs, width)
    both = pairs.join(
        full.select(F.col("doc_id").alias("u"), F.col("members").alias("mu")), "u"
    ).join(full.select(F.col("doc_id").alias("v"), F.col("members").alias("mv")), "v")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            linked = []
            for mu, mv in zip(frame["mu"], frame["mv"], strict=True):
                a, b = (np.frombuffer(m, dtype=np.uint64) for m in (mu, mv))
                same = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * same >= percent * (len(a) + len(b) - same))
            yield frame.loc[linked, ["u", "v"]]

    return persist_shared(both.mapInPandas(run, "u bigint, v bigint"), "links")


def _open_partners(frame: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row with the rows that may link with it, of another component, in a block pair.

    A pair that shares several buckets is looked at in the first of them.
    """
    sig = np.frombuffer(b"".join(frame["signature"]), dtype=np.uint32).reshape(-1, BINS)
    n, group, part, band = (frame[c].to_numpy() for c in ("n", "component", "part", "band"))
    left, right = int(frame["left"].iat[0]), int(frame["right"].iat[0])
    rows, cols = np.flatnonzero(part == left), np.flatnonzero(part == right)
    for i in rows:
        others = cols[cols > i] if left == right else cols
        least = np.minimum(n[others], n[i])
        fits = (group[others] != group[i]) & (100 * least >= percent * np.maximum(n[others], n[i]))
        others, least = others[fits], least[fits]
        if len(others):
            equal = sig[others] == sig[i]
            first = equal.reshape(len(others), BANDS, ROWS).all(axis=2).argmax(axis=1)
            near = equal.mean(axis=1) >= percent / 100 - slack(least, percent)
            others = others[near & (first == band[i])]
            if len(others):
                yield i, others


def _open_members(percent: int):
    """The rows of a block pair that may still have a link to another component."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", ignore_index=True)
        wanted = np.zeros(len(frame), dtype=bool)
        for i, others in _open_partners(frame, percent):
            wanted[i] = wanted[others] = True
        give_back()
        return frame[wanted]

    return run


def _forest(percent: int):
    """A spanning forest of the links between a block pair's rows, by their full sets."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", ignore_index=True)
        sets = [np.frombuffer(m, dtype=np.uint64) for m in frame["members"]]
        sizes = np.array([len(s) for s in sets])
        begin = np.cumsum(sizes) - sizes
        distinct, element = np.unique(np.concatenate(sets), return_inverse=True)
        ids, n = frame["doc_id"].to_numpy(), frame["n"].to_numpy()
        root = np.unique(frame["component"].to_numpy(), return_inverse=True)[1]
        mine = np.zeros(len(distinct), dtype=np.int64)
        us, vs = [], []
        for i, others in _open_partners(frame, percent):
            others = others[root[others] != root[i]]
            if not len(others):
                continue
            own = element[begin[i] : begin[i] + sizes[i]]
            mine[own] = 1
            held = [int(mine[element[begin[j] : begin[j] + sizes[j]]].sum()) for j in others]
            mine[own] = 0
            same = np.array(held)
            for j in others[100 * same >= percent * (n[i] + n[others] - same)]:
                if root[i] != root[j]:
                    us.append(ids[i])
                    vs.append(ids[j])
                    root[root == root[j]] = root[i]
        give_back()
        return pd.DataFrame({"u": np.array(us, dtype=np.int64), "v": np.array(vs, dtype=np.int64)})

    return run


def _residual(
    members: DataFrame, nodes: DataFrame, groups: DataFrame, docs: DataFrame, width: int, percent: int
) -> DataFrame:
    """Links between components, found in the buckets that hold several of them."""
    marked = (
        members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component", F.coalesce("component_id", "doc_id"))
        .drop("component_id")
    )
    mixed = (
        marked.groupBy("key")
        .agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("m"))
        .where("a != b and m > 2")
        .select("key", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("parts"))
    )
    rows = (
        marked.join(mixed, "key")
        .join(nodes.select("doc_id", "signature"), "doc_id")
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("left", F.least("part", "other"))
        .withColumn("right", F.greatest("part", "other"))
        .drop("parts", "other")
    )
    block = ["key", "left", "right"]
    opened = persist_shared(
        rows.groupBy(*block).applyInPandas(_open_members(percent), rows.schema), "open"
    )
    sets = _full_sets(opened.select("doc_id"), docs, width)
    return persist_shared(
        opened.join(sets, "doc_id").groupBy(*block).applyInPandas(_forest(percent), "u bigint, v bigint"),
        "links",
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Documents link when 100 * |A & B| >= percent * |A | B| for their full shingle sets. component_id
    is the smallest doc_id reachable by links, itself included. Null, empty and white-space texts
    have no shingles and stay alone, as does a row with a null doc_id; repeated rows share a component; an empty table gives an empty
    result; other columns are ignored.
    """
    build = lambda: _near_duplicates(docs, width, percent)
    return stored_result(docs.sparkSession, "near-duplicates", build)


def _near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    signed = persist_shared(signed_documents(docs, width), "signed")
    # Equal sets are one node: its smallest document.
    named = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    nodes = persist_shared(
        signed.where(named)
        .groupBy("d1", "d2")
        .agg(F.min(F.struct("doc_id", "n", "keys", "signature")).alias("r"))
        .select("d1", "d2", "r.*"),
        "nodes",
    )
    exploded = nodes.select("doc_id", "n", F.posexplode("keys").alias("band", "key"))
    buckets = (
        exploded.groupBy("key")
        .agg(F.min(F.struct("doc_id", "n")).alias("hub"), F.count("*").alias("m"))
        .where("m > 1")
    )
    members = persist_shared(exploded.join(buckets, "key"), "buckets")
    star = (
        members.where(F.col("doc_id") != F.col("hub.doc_id"))
        .where(sizes_allow("n", "hub.n", percent))
        .select(F.col("hub.doc_id").alias("u"), F.col("doc_id").alias("v"))
        .distinct()
    )
    links = _confirmed(persist_shared(_plausible(star, nodes, percent), "pairs"), docs, width, percent)
    groups = persist_shared(components(links), "groups")
    slim = members.select("doc_id", "n", "band", "key")
    more = _residual(slim, nodes, groups, docs, width, percent)
    if not more.isEmpty():
        groups = persist_shared(components(links.unionByName(more)), "groups")
    groups = groups.withColumnRenamed("node", "doc_id")
    classes = nodes.select("d1", "d2", "doc_id").join(groups, "doc_id", "left")
    classes = classes.select("d1", "d2", F.coalesce("component_id", "doc_id").alias("component_id"))
    linked = signed.where(named).select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2"])
    alone = signed.where(~named).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return (
        linked.select("doc_id", "n", "component_id")
        .unionByName(alone)
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )

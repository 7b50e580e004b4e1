"""Best-fit packing of token sequences: hierarchical residual packing.

Every partition packs its own pieces best-fit (longest first, each into the fullest bin it fits).
Bins that are full but for a small residue are emitted. An underfull bin then counts as one item of
its length: items of several partitions meet in a task, are packed best-fit again, and so on up a
tree, whose tasks each hold a bounded number of items, until one task is left or a round no longer
saves bins.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import even, give_back, worker_cache
from scholion.session import persist_shared

CAPACITY = 4096
RESIDUE = 8
ITEMS_PER_TASK = 40_000
CACHED_WORDS = 900_000
CACHED_STRETCHES = 250_000
WORDS_A_CALL = 500
# The ASCII marks but for the apostrophe.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PIECES = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = f"{PIECES}, bin bigint, offset bigint, full boolean"


# ---- token pieces ------------------------------------------------------------------------


def split_word(word: str) -> tuple[str, str]:
    """A word as the vocabulary sees it and the ASCII marks behind it, which are tokens of their own.

    Only where both parts have the ids that they have together: behind a letter or digit, and never at an
    apostrophe, which may belong to the letters after it. ASCII capitals are lower-cased, as the vocabulary
    does. A word that may hold a special token's string stays as it is.
    """
    if "<|" in word:
        return word, ""
    core = word.rstrip(MARKS)
    # Of other letters than these, some end in a combining mark once they are normalised.
    if not core or not core[-1].isalnum() or core[-1] > "ſ" or core[-1] == "İ":
        core = word
    return (core.lower() if core.isascii() else core), word[len(core) :]


class WordIds(dict):
    """Ids (little-endian 32-bit) of each stretch between blanks, as the library gives them.

    The vocabulary drops white space and no token crosses it, so a text's ids are those of its
    stretches, one after the other. Stretches that differ in marks and capitals share their words' ids.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.parts: dict[str, bytes] = {}
        self.library = Tokenizer.from_file(vocabulary)

    def learn(self, words: set[str]) -> None:
        if len(self) > CACHED_STRETCHES:
            self.clear()
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()
        ids = self.parts
        ids[""] = b""
        new = list(words.difference(self))
        # Most words are letters alone: there is nothing to split.
        split = [(w.lower() if w.isascii() else w, "") if w.isalpha() else split_word(w) for w in new]
        missing = set(chain.from_iterable(split)).difference(ids)
        plain = [w for w in missing if "<|" not in w]
        for at in range(0, len(plain), WORDS_A_CALL):
            ids.update(self.encoded(plain[at : at + WORDS_A_CALL]))
        for word in missing.difference(plain):
            ids.update(self.encoded([word]))
        self.update(zip(new, [ids[core] + ids[marks] if marks else ids[core] for core, marks in split], strict=True))

    def encoded(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word and its ids, from one call: a blank parts the words, and tokens tell where they begin."""
        found = self.library.encode(" ".join(words), add_special_tokens=False)
        begins = np.fromiter((b for b, _ in found.offsets), dtype=np.int64)
        past = np.cumsum(np.fromiter(map(len, words), dtype=np.int64) + 1)
        cuts = (4 * np.searchsorted(begins, past)).tolist()
        raw = np.asarray(found.ids, dtype="<u4").tobytes()
        return zip(words, (raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True)


def words_of(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1
) -> DataFrame:
    """One row per piece of at most capacity tokens: doc_id, piece, start, length, ids_crc32.

    A document is its text's ids and then end_id; null counts as empty, so each row gives at least
    one piece. Only a longer document is cut, its last piece may be shorter.
    """
    # Ids travel as texts, as a null among whole numbers would make them all doubles.
    slim = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache("word_ids", vocabulary, lambda: WordIds(vocabulary))
        for batch in batches:
            # Only a few texts at a time become Python strings.
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                split = [words_of(t) for t in part.column("text").to_pylist()]
                known.learn(set().union(*split))
                rows = []
                for n, words in enumerate(split):
                    ids = b"".join(map(known.__getitem__, words)) + end
                    for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                        cut = ids[4 * start : 4 * (start + capacity)]
                        rows.append((n, k, start, len(cut) // 4, zlib.crc32(cut)))
                row, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)),
                        pa.array(piece, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        give_back()

    return _numbered(even(slim).mapInArrow(run, PIECES))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))


# ---- packing -----------------------------------------------------------------------------


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill; ties go to the earlier item and bin.

    Open bins are stacked by free room, and a bit set of the rooms in use finds the smallest room
    that is large enough.
    """
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        larger = rooms >> size
        if larger:
            room = (larger & -larger).bit_length() - 1 + size
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        rest = room - size
        if rest:
            by_room[rest].append(b)
            rooms |= 1 << rest
    return bins, offsets, np.asarray(fill, dtype=np.int64)


def _repack(frame: pd.DataFrame, capacity: int, residue: int, first_bin: int) -> pd.DataFrame:
    """Pack the frame's bins as items; rows keep their place inside the item."""
    order = np.sort(frame["bin"].unique())
    item = np.searchsorted(order, frame["bin"].to_numpy())
    lengths = np.zeros(len(order), dtype=np.int64)
    np.add.at(lengths, item, frame["length"].to_numpy())
    bins, offsets, fill = best_fit(lengths, capacity)
    return frame.assign(
        bin=first_bin + bins[item],
        offset=frame["offset"].to_numpy() + offsets[item],
        full=fill[bins[item]] >= capacity - residue,
    )


def _local(capacity: int, residue: int, per_task: int):
    """Pack each task's own pieces, a bounded number at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = (TaskContext.get().partitionId() + 1) << 38
        held, n = [], 0
        for frame in frames:
            for at in range(0, len(frame), per_task):
                part = frame.iloc[at : at + per_task]
                if n + len(part) > per_task:
                    base = yield from flush(held, base)
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if held:
            yield from flush(held, base)

    def flush(held: list[pd.DataFrame], base: int):
        part = pd.concat(held, ignore_index=True).sort_values(
            ["doc_id", "piece", "ids_crc32"], ignore_index=True
        )
        part = part.assign(bin=np.arange(len(part)), offset=0)
        yield _repack(part, capacity, residue, base)
        return base + len(part)

    return run


def _merge(round_no: int, capacity: int, residue: int):
    """Pack one task's underfull bins as items."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        first = (round_no << 56) + ((int(key[0]) + 1) << 32)
        frame = frame.sort_values(["bin", "offset"], ignore_index=True)
        return _repack(frame.drop(columns="task"), capacity, residue, first)

    return run


def pack(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    residue: int = RESIDUE,
    items_per_task: int = ITEMS_PER_TASK,
    max_rounds: int = 8,
) -> DataFrame:
    """Place every piece: the columns of pieces, sequence_id and offset (gapless from 0).

    pieces holds doc_id, piece, start, length (1 to capacity) and ids_crc32 and should be stored, as
    it is read once per run. Repeated rows are packed each on its own; an empty table gives an empty
    result. A bin whose residue is at most `residue` tokens is emitted in the round that filled it.
    Rounds end when all items fit one task and were packed there, or when a round saved under one
    bin in a thousand; bins that are left are emitted as they are.
    """
    named = pieces.withColumn("doc_id", F.col("doc_id").cast("string"))
    placed = persist_shared(
        named.mapInPandas(_local(capacity, residue, items_per_task), PLACED), "packed"
    )
    done = placed.where("full")
    rest = placed.where("not full")
    for round_no in range(1, max_rounds + 1):
        rows, bins = rest.agg(F.count("*"), F.countDistinct("bin")).first()
        if bins < 2:
            break
        tasks = max(1, math.ceil(rows / items_per_task))
        task = F.pmod(F.xxhash64("bin", F.lit(round_no)), F.lit(tasks)).cast("int")
        merged = persist_shared(
            rest.withColumn("task", task)
            .groupBy("task")
            .applyInPandas(_merge(round_no, capacity, residue), PLACED),
            "packed",
        )
        done = done.unionByName(merged.where("full"))
        rest = merged.where("not full")
        after = merged.agg(F.countDistinct("bin")).first()[0]
        if tasks == 1 or after > bins * 0.999:
            break
    return _numbered(done.unionByName(rest)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack a table's texts. Pieces are stored once, texts are read once.

    Nulls in columns other than text and doc_id are never looked at; a null doc_id is kept as null.
    """
    return pack(persist_shared(token_pieces(docs, vocabulary, capacity), "pieces"), capacity)

"""Benchmark decontamination by BM25 retrieval with block-max WAND.

The test items are the indexed documents, the training passages the queries. Postings are kept in
blocks of items with the largest weight of each block. Item weights are divided by the item's score
against itself, so a score is the share of the item's BM25 mass that a passage holds and one threshold
serves all. A passage's traversal sorts its terms' cursors by item, finds the pivot where the summed
list maxima can reach the threshold, checks the pivot's block maxima, and skips to the next block or
scores the item. Every item above the threshold is retrieved; it is a leak if the document also holds
enough of the five-word shingles of both its question and its answer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import even, give_back, worker_cache
from scholion.session import persist_shared

K1, B = 1.2, 0.75
BLOCK_ITEMS = 2
PASSAGES_AT_ONCE = 128
SCORE_SHARE = 0.5
OVERLAP_SHARE = 0.5
SHINGLE = 5
#: Items of one index; more items make several indexes, each of bounded size.
ITEMS_PER_INDEX = 1000
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's last sentence is its answer; a single sentence is cut in the middle."""
    parts = [w for w in map(words_of, SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for part in parts[:-1] for w in part], parts[-1]
    words = parts[0] if parts else []
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


def span(text: str) -> int:
    """The words of a passage that an item may fill."""
    return sum(map(len, question_and_answer(text)))


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    take = min(SHINGLE, len(words))
    return {tuple(words[i : i + take]) for i in range(len(words) - take + 1)} if take else set()


class Index:
    """Block-wise postings of the test items, built from (item_id, text) rows.

    whole: of all items of the benchmark, where these are a part of them: how many they are, their
    mean length, their longest one and how many hold each of these items' words.
    """

    def __init__(self, items: list[tuple[int, str]], whole: tuple[int, float, int, dict[str, int]] | None = None):
        bags = [Counter(words_of(t)) for _, t in items]
        # Items of one language stand together, so a block's maxima say something about it.
        order = sorted(range(len(items)), key=lambda i: ([w for w, _ in bags[i].most_common(2)], str(items[i][0])))
        self.ids = [items[i][0] for i in order]
        bags = [bags[i] for i in order]
        lengths = [max(sum(b.values()), 1) for b in bags]
        texts = [items[i][1] for i in order]
        if whole is None:
            seen: dict[str, int] = Counter(w for b in bags for w in b)
            whole = (len(bags), sum(lengths) / max(len(lengths), 1), max(map(span, texts), default=1), seen)
        n, mean, self.window, seen = whole
        self.terms = {w: k for k, w in enumerate(sorted(seen))}
        idf = {w: math.log(1 + (n - df + 0.5) / (df + 0.5)) for w, df in seen.items()}
        self.items: list[list[int]] = [[] for _ in self.terms]
        self.weights: list[list[float]] = [[] for _ in self.terms]
        for i, bag in enumerate(bags):
            norm = K1 * (1 - B + B * lengths[i] / mean)
            own = {w: idf[w] * tf * (K1 + 1) / (tf + norm) for w, tf in bag.items()}
            mass = sum(own.values())
            for w, x in own.items():
                self.items[self.terms[w]].append(i)
                self.weights[self.terms[w]].append(x / mass)
        self.n_blocks = -(-len(bags) // BLOCK_ITEMS)
        self.block_max = np.zeros((len(self.terms) + 1, self.n_blocks), dtype=np.float32)
        for t, (found, weights) in enumerate(zip(self.items, self.weights, strict=True)):
            for i, x in zip(found, weights, strict=True):
                b = i // BLOCK_ITEMS
                self.block_max[t, b] = max(self.block_max[t, b], x)
        self.list_max = self.block_max.max(axis=1) if self.n_blocks else np.zeros(len(self.terms) + 1)
        self.parts = [tuple(shingles(part) for part in question_and_answer(t)) for t in texts]

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score against the distinct terms is at least threshold, with scores."""
        # Sums are compared with a little room, so rounding never loses an item.
        least = threshold - 1e-6
        cursors = [[self.items[t][0], 0, t] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            reach, pivot = 0.0, None
            for k, (_, _, t) in enumerate(cursors):
                reach += float(self.list_max[t])
                if reach >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            bound = sum(float(self.block_max[t, block]) for _, _, t in cursors[: pivot + 1])
            if bound < least:
                # No item of this block before the next cursor can reach the threshold.
                target = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == item:
                # Exactly rounded, so the order of the terms doesn't matter.
                score = math.fsum(self.weights[t][at] for i, at, t in cursors[: pivot + 1] if i == item)
                if score >= least:
                    found.append((item, score))
                target, moved = item + 1, cursors[: pivot + 1]
            else:
                target, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            for cursor in moved:
                _, at, t = cursor
                cursor[1] = at = bisect_left(self.items[t], target, at)
                cursor[0] = self.items[t][at] if at < len(self.items[t]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def candidates(self, terms: np.ndarray, threshold: float) -> dict[int, tuple[int, float]]:
        """Items that some passage of one document retrieves, with the passage and its score.

        terms holds the document's words as term numbers, -1 for words of no item. A passage is two
        neighbouring windows, each as long as the longest item, so an item stands whole in some
        passage. The first bound is taken for many passages at once: the block maxima of a passage's
        distinct terms, summed up; only passages where some block can reach the threshold are
        traversed.
        """
        size, width = max(self.window, 1), len(self.terms)
        found: dict[int, tuple[int, float]] = {}
        step = size * PASSAGES_AT_ONCE
        for begin in range(0, len(terms), step):
            part = terms[begin : begin + step + size]
            at = np.flatnonzero(part >= 0)
            if not len(at):
                continue
            window = at // size
            keys = np.unique(
                np.concatenate([window * width + part[at], (window[window > 0] - 1) * width + part[at[window > 0]]])
            )
            passage, term = keys // width, keys % width
            starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
            bound = np.add.reduceat(self.block_max[term], starts, axis=0).max(axis=1)
            ends = np.append(starts[1:], len(term))
            for k in np.flatnonzero(bound >= threshold - 1e-3).tolist():
                p = begin // size + int(passage[starts[k]])
                for item, score in self.retrieve(term[starts[k] : ends[k]].tolist(), threshold):
                    if item not in found or score > found[item][1]:
                        found[item] = (p, score)
        return found


def overlap(part: set, held: set) -> float:
    """The share of a part's shingles that the document holds; an empty part is held."""
    return len(part & held) / len(part) if part else 1.0


SCHEMA = (
    "doc_id string, item_id string, passage bigint, score double, question_overlap double, answer_overlap double"
)


def _leaks(
    docs: DataFrame, items: list[tuple[str | None, str]], whole: tuple | None, score_share: float, overlap_share: float
) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, whole))
    version = f"{hash((tuple(items), whole and (*whole[:3], tuple(sorted(whole[3].items())))))}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = worker_cache("item_index", version, lambda: Index(*shared.value))
        number = index.terms
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                words = words_of(text)
                terms = np.fromiter((number.get(w, -1) for w in words), dtype=np.int64, count=len(words))
                found = index.candidates(terms, score_share)
                held = None
                for item, (passage, score) in sorted(found.items()):
                    question, answer = index.parts[item]
                    if held is None:
                        held = _held(words, index.parts, found)
                    q, a = overlap(question, held), overlap(answer, held)
                    if q >= overlap_share and a >= overlap_share:
                        rows.append((doc_id, index.ids[item], passage, score, q, a))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        give_back()

    # Ids travel as texts, as a null among whole numbers would make them all doubles.
    found = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, SCHEMA)
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("doc_id", "item_id")})


def _held(words: list[str], parts: list, found: dict) -> set:
    """The document's shingles of the lengths that the found items' shingles have."""
    lengths = {len(s) for item in found for part in parts[item] for s in part}
    return {tuple(words[i : i + n]) for n in lengths for i in range(len(words) - n + 1)}


def _measured(dealt: DataFrame) -> tuple[DataFrame, int, float, int]:
    """(part, word, df) for the words of each part's items, df over all items; and over all items their
    number, mean length and longest one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = [words_of(t) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "part": frame["part"],
                    "words": [sorted(set(w)) for w in words],
                    "length": [max(len(w), 1) for w in words],
                    "span": [span(t) for t in frame["text"]],
                }
            )

    each = persist_shared(
        dealt.select("part", "text").mapInPandas(run, "part bigint, words array<string>, length bigint, span bigint"),
        "item-words",
    )
    n, length, longest = each.agg(F.count("*"), F.sum("length"), F.max("span")).first()
    per_part = each.select("part", F.explode("words").alias("word")).groupBy("part", "word").agg(F.count("*").alias("n"))
    df = per_part.groupBy("word").agg(F.sum("n").alias("df"))
    held = persist_shared(per_part.select("part", "word").join(df, "word"), "item-frequencies")
    return held, n, length / n, longest


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    score_share: float = SCORE_SHARE,
    overlap_share: float = OVERLAP_SHARE,
    items_per_index: int = ITEMS_PER_INDEX,
) -> DataFrame:
    """doc_id, item_id, passage, score and overlaps of each item that a document holds.

    docs holds doc_id and text, benchmark item_id and text; other columns are ignored. Null and empty
    documents hold nothing; items that are null or have no word are never held; an item without an id
    is held under a null item_id, a document without one under a null doc_id; repeated rows each give
    their rows; repeated items count once for each different text. An empty side gives an empty result.
    Beyond items_per_index items the benchmark is dealt over several indexes, which give the same
    rows and scores as one.
    """
    slim = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    wanted = benchmark.where(F.col("text").rlike(r"[\p{L}\p{N}]")).select("item_id", "text").distinct()
    n = wanted.count()
    rounds = max(1, -(-n // items_per_index))
    dealt = even(slim)
    numbered = wanted.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)))
    # The scores of parts are those of one index: what BM25 weighs by is taken over all items.
    held, *over_all = _measured(numbered) if rounds > 1 else (None,)
    out = None
    for k in range(rounds):
        part = numbered.where(F.col("part") == k)
        listed = [(r["item_id"], r["text"]) for r in part.collect()]
        listed.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        items = [(None if i is None else str(i), t) for i, t in listed]
        whole = None
        if held is not None:
            whole = (*over_all, {r["word"]: r["df"] for r in held.where(F.col("part") == k).collect()})
        found = _leaks(dealt, items, whole, score_share, overlap_share)
        out = found if out is None else out.unionByName(found)
    return out

"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut into the vocabulary's pre-tokens; for each distinct one the adjacent pair of the
lowest rank is popped from a heap and merged in a doubly linked list until no pair has a rank. Its
count is the number of its bytes minus the number of merges; no identifiers are built. Counts of
pre-tokens met before are kept by the Python worker (a bounded number), so the heap runs once per
word and not once per occurrence.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.llm.common import even, worker_cache

# The white space class and the pre-token pattern of the published byte-level BPE.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
CACHED_WORDS = 600_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for shift, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + shift)
    return letters


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """The number of symbols left after all merges, lowest rank first, leftmost on ties."""
    last = len(symbols) - 1
    if last < 1:
        return len(symbols)
    right = list(range(1, last + 2))
    left = list(range(-1, last))
    heap = [
        (rank, i, symbols[i], symbols[i + 1])
        for i in range(last)
        if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None
    ]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        # An entry is stale once either side was merged into something else.
        if symbols[i] != a or j > last or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, ""
        merges += 1
        after = right[i] = right[j]
        if after <= last:
            left[after] = i
            if (rank := ranks.get((symbols[i], symbols[after]))) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[after]))
        before = left[i]
        if before >= 0 and (rank := ranks.get((symbols[before], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, before, symbols[before], symbols[i]))
    return last + 1 - merges


class WordCounts(dict):
    """Token count of each pre-token met; the heap runs for new ones only."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks = ranks
        self.letters = byte_letters()

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        letters = self.letters
        symbols = [letters[b] for b in word.encode("utf-8", "surrogatepass")]
        count = merged_length(symbols, self.ranks)
        if len(word) <= 64:
            self[word] = count
        return count


class Counter:
    """Counts the tokens of whole texts as the vocabulary's own library does."""

    def __init__(self, vocabulary: str):
        import regex

        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.words = WordCounts({(a, b): rank for rank, (a, b) in enumerate(merges)})
        self.find = regex.compile(PATTERN).findall
        specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len)[::-1]
        self.special = specials and regex.compile("|".join(map(regex.escape, specials)))

    def __call__(self, text: str) -> int:
        if not self.special or not (found := len(self.special.findall(text))):
            return sum(map(self.words.__getitem__, self.find(text)))
        # A special string is one token; the stretches between are tokenised on their own.
        return found + sum(
            sum(map(self.words.__getitem__, self.find(part))) for part in self.special.split(text)
        )


def count_tokens(
    docs: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens"
) -> DataFrame:
    """docs with a column holding each whole text's number of tokens.

    vocabulary is the path of a byte-level BPE file. Null counts as empty (0 tokens); repeated rows
    each keep their row; an empty table stays empty; other columns pass through, also one already
    named like the result, which is replaced.
    """
    kept = docs.drop(out) if out in docs.columns else docs
    fields = T.StructType([*kept.schema.fields, T.StructField(out, T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = worker_cache("token_counter", vocabulary, lambda: Counter(vocabulary))
        for frame in frames:
            yield frame.assign(**{out: [count(t) if t else 0 for t in frame[text]]})

    return kept.mapInPandas(run, fields)


def token_report(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row; texts do not leave the task."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fields = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = worker_cache("token_counter", vocabulary, lambda: Counter(vocabulary))
        for frame in frames:
            tokens = [count(t) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "n_bytes": [len(t.encode()) for t in frame["text"]],
                    "n_tokens": tokens,
                    "over_limit": [n > limit for n in tokens],
                }
            )

    return even(slim).mapInPandas(run, fields)

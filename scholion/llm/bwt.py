"""Burrows-Wheeler transforms of string collections and their merging by interleave refinement."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """The transform of one collection; rows are suffixes in order, end markers first.

    letters: the letter before each suffix plus one, 0 where the suffix is a whole string.
    back: the row of the suffix that is one letter longer (an end marker's where the letter is 0, each one's once).
    place: where each row's suffix starts in the joined strings, one end marker after each string.
    n_strings: their number, which is that of end marker rows.
    """

    letters: np.ndarray
    back: np.ndarray
    place: np.ndarray
    n_strings: int


def joined(strings: list[bytes]) -> np.ndarray:
    """All strings with each letter plus one and a 0 after each string."""
    sizes = np.array([len(s) for s in strings])
    out = np.zeros(int(sizes.sum()) + len(strings), dtype=np.int16)
    inside = np.ones(len(out), dtype=bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    out[inside] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int16) + 1
    return out


def transform(strings: list[bytes]) -> Shard:
    """Sort one shard's suffixes by doubling; equal suffixes keep the order of their strings."""
    text = joined(strings)
    n = len(text)
    ends = np.flatnonzero(text == 0)
    # The end markers differ, so all suffixes do: they come first, in the order of the strings.
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    fresh = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    depth = 1
    while True:
        # Only groups of several suffixes are sorted on, by the rank `depth` letters further.
        single = np.concatenate([fresh[1:], [True]]) & fresh
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        rows = order[slots]
        key = rank[rows] * (n + 1) + rank[np.minimum(rows + depth, n - 1)]
        inner = np.argsort(key, kind="stable")
        order[slots] = rows[inner]
        key = key[inner]
        fresh[slots[1:]] |= key[1:] != key[:-1]
        rank[order[slots]] = np.flatnonzero(fresh)[np.cumsum(fresh)[slots] - 1]
        depth *= 2
    before = np.concatenate([[0], text[:-1]])
    return Shard(before[order].astype(np.int16), rank[order - 1].astype(np.int32), order.astype(np.int32), len(ends))


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the shards' rows by their first `depth` letters.

    Returns, for each merged row, its row in the shards laid end to end, and whether it begins a new
    interval, that is, has a common prefix of under `depth` letters with the row before. A round takes
    the rows in their current order, sends each to the row that is two letters longer and is stable on
    those letters: from the order by h letters comes that by h + 2. An odd depth begins with a round of
    one letter. No suffix is compared with another. Suffixes that end within `depth` letters are intervals
    of their own.
    """
    base = np.cumsum([0, *(len(s.letters) for s in shards)])
    letters = np.concatenate([s.letters for s in shards]).astype(np.int32)
    back = np.concatenate([s.back + b for s, b in zip(shards, base, strict=False)]).astype(np.int32)
    ends = np.concatenate(
        [np.arange(s.n_strings, dtype=np.int32) + b for s, b in zip(shards, base, strict=False)]
    )
    kinds = int(letters.max(initial=0)) + 1
    pairs = letters[back] * kinds + letters
    # Before the first round no letter is compared: the end markers in front, all in one interval.
    first = np.ones(len(letters), dtype=bool)
    first[ends] = False
    rows = np.concatenate([ends, np.flatnonzero(first).astype(np.int32)])
    starts = np.zeros(len(rows), dtype=bool)
    starts[:1] = True
    group = np.zeros(len(rows), dtype=np.int32)
    for codes, longer, rounds in ((letters, back, depth % 2), (pairs, back[back], depth // 2)):
        # Codes of up to 16 bits are sorted by counting.
        narrow = codes.astype(np.uint16) if codes.max(initial=0) < 2**16 else codes
        # A suffix with an end marker among these letters is like no other one.
        over = (codes < kinds) | (codes % kinds == 0) if codes is pairs else codes == 0
        for _ in range(rounds):
            order = np.argsort(narrow[rows], kind="stable")
            rows, group = rows[order], group[order]
            met, ended = narrow[rows], over[rows]
            rows = longer[rows]
            starts[1:] = (met[1:] != met[:-1]) | (group[1:] != group[:-1]) | ended[1:] | ended[:-1]
            group = np.cumsum(starts, dtype=np.int32)
    return rows, starts


def smallest_owner(strings: list[bytes], owners: np.ndarray, depth: int, shard_bytes: int) -> list[np.ndarray]:
    """For each string and each of its stretches of `depth` letters, the least owner of an equal one.

    Strings are dealt over shards in turn, each shard is transformed, the transforms are merged, and
    every interval of rows with a common prefix of at least `depth` letters gets its least owner.
    """
    total = sum(map(len, strings)) + len(strings)
    n_shards = max(1, min(len(strings), -(-total // shard_bytes)))
    dealt = [np.arange(k, len(strings), n_shards) for k in range(n_shards)]
    shards = [transform([strings[i] for i in ids]) for ids in dealt]
    rows, starts = merge(shards, depth)
    owner = np.concatenate(
        [
            np.repeat(owners[ids], [len(strings[i]) + 1 for i in ids])[s.place]
            for ids, s in zip(dealt, shards, strict=True)
        ]
    )
    at = np.flatnonzero(starts)
    least = np.repeat(np.minimum.reduceat(owner[rows], at), np.diff(np.append(at, len(rows))))
    by_row = np.empty(len(rows), dtype=np.int64)
    by_row[rows] = least
    found: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(strings)
    base = 0
    for ids, shard in zip(dealt, shards, strict=True):
        by_place = np.empty(len(shard.place), dtype=np.int64)
        by_place[shard.place] = by_row[base : base + len(shard.place)]
        base += len(shard.place)
        start = 0
        for i in ids:
            found[i] = by_place[start : start + max(len(strings[i]) - depth + 1, 0)]
            start += len(strings[i]) + 1
    return found

"""Only what may be found again is merged, two letters a round."""

from __future__ import annotations

import random

import numpy as np
import pytest

from scholion.llm import bwt, suffix_dedup


def least_by_hand(strings, owners, length):
    least = {}
    for s, o in zip(strings, owners, strict=True):
        for i in range(len(s) - length + 1):
            part = s[i : i + length]
            least[part] = min(least.get(part, o), o)
    return [least[s[i : i + length]] for s in strings for i in range(len(s) - length + 1)]


@pytest.mark.parametrize("length", [1, 2, 3, 6, 9])
def test_owners_equal_brute_force(monkeypatch, length):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 40)
    rng = random.Random(length)
    for _ in range(120):
        letters = rng.choice([b"a", b"ab", b"abc\x00\xff", bytes(range(256))])
        strings = [bytes(rng.choices(letters, k=length + rng.randint(0, 20))) for _ in range(rng.randint(2, 9))]
        strings += [strings[0][1:] + b"q" * length, b"z" * length]
        owners = np.array([rng.randint(0, 5) for _ in strings])
        found, sizes = suffix_dedup._owners(strings, owners, np.zeros(len(strings)), length)
        assert found.tolist() == least_by_hand(strings, owners, length)
        assert sizes.tolist() == [len(s) - length + 1 for s in strings]


def test_what_comes_once_is_not_merged(monkeypatch):
    rng = random.Random(1)
    shared = bytes(rng.choices(range(256), k=60))
    strings = [bytes(rng.choices(range(256), k=200)) for _ in range(20)]
    strings[3] = strings[3][:70] + shared + strings[3][70:]
    strings[8] = strings[8][:10] + shared + strings[8][10:]
    seen = []
    merged = suffix_dedup.smallest_owner
    monkeypatch.setattr(suffix_dedup, "smallest_owner", lambda s, *rest: seen.extend(s) or merged(s, *rest))
    owners = np.arange(20)[::-1].copy()
    found, _ = suffix_dedup._owners(strings, owners, np.zeros(20), 50)
    assert found.tolist() == least_by_hand(strings, owners, 50)
    assert seen == [shared, shared]


@pytest.mark.parametrize("depth,rounds", [(50, 25), (7, 4)])
def test_a_round_takes_two_letters(monkeypatch, depth, rounds):
    strings = [b"abcabcabc" * 9, b"bcabcabca" * 9, b"", b"c"]
    shards = [bwt.transform(strings[:2]), bwt.transform(strings[2:])]
    sorts = []
    plain = np.argsort
    monkeypatch.setattr(bwt.np, "argsort", lambda *a, **k: sorts.append(1) or plain(*a, **k))
    rows, starts = bwt.merge(shards, depth)
    assert len(sorts) == rounds and sorted(rows) == list(range(len(rows)))
    # Intervals are the different stretches, and the suffixes that end before.
    whole = [s[i:] for s in strings for i in range(len(s) + 1)]
    assert int(starts.sum()) == len({s[:depth] for s in whole if len(s) >= depth}) + sum(len(s) < depth for s in whole)

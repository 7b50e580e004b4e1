"""Sharding, importance resampling and the Merkle manifest, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scholion.llm import merkle, ranking, resampling, sharding
from helpers import DOCS, awkward, documents, empty, sentence

NAMES = "doc_id size text_crc32 home shard slot".split()


# ---- ranks ---------------------------------------------------------------------------------


def test_ranks_of_crowded_groups_and_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", None, "b"]), rng.choice([None, 1, 2, 2, 2])) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "g string, k int").repartition(7)
    got = ranking.numbered(
        ranking.with_row(frame, "t"), [spark_col("k").asc_nulls_first()], within=("g",)
    ).collect()
    for g in ("a", None, "b"):
        mine = sorted((r.rank, r.k) for r in got if r.g == g)
        want = sorted((k for h, k in rows if h == g), key=lambda k: (k is not None, k or 0))
        assert mine == list(enumerate(want))
        assert {r.n for r in got if r.g == g} == {len(want)}
    assert ranking.numbered(ranking.with_row(frame.limit(0), "t"), [spark_col("k")]).collect() == []


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


# ---- sharding ------------------------------------------------------------------------------


def point(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def ring_by_hand(rows, shards, replicas, bounds):
    """Row by row: each round lets the rows without a shard ask their next one, arc by arc."""
    points = sorted((point(f"{s}:{v}"), s) for s in range(shards) for v in range(replicas))
    arcs = defaultdict(list)
    for doc, text in rows:
        raw = (text or "").encode()
        at = point("" if doc is None else str(doc))
        arc = sum(p < at for p, _ in points)
        arcs[arc].append((at, doc is not None, doc or 0, len(raw) + 1, zlib.crc32(raw), doc))
    room, out = list(bounds), []
    waiting = {a: sorted(v, key=lambda x: x[:5]) for a, v in arcs.items()}
    for r in range(shards):
        for a in sorted(waiting):
            order = list(dict.fromkeys(s for _, s in points[a:] + points[:a]))
            stay = []
            for row in waiting[a]:
                s = order[r]
                if room[s]:
                    out.append((row[5], row[3], row[4], order[0], s, bounds[s] - room[s]))
                    room[s] -= 1
                else:
                    stay.append(row)
            waiting[a] = stay
    assert not any(waiting.values())
    return sorted(out, key=repr)


def sharded(docs, **more):
    return sorted((tuple(r[n] for n in NAMES) for r in sharding.shard_rows(docs, **more).collect()), key=repr)


@pytest.mark.parametrize("shards,replicas", [(4, 8), (3, 1), (1, 2)])
def test_sharding_equals_brute_force(spark, shards, replicas):
    rows = awkward() + [(5, "hot") for _ in range(60)] + [(5, "hot too")] * 5
    n = len(rows)
    bounds = [n // shards + (s < n % shards) for s in range(shards)]
    got = sharded(documents(spark, rows), shards=shards, replicas=replicas)
    assert got == ring_by_hand(rows, shards, replicas, bounds)
    counts = Counter(g[4] for g in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, c in counts.items():
        assert sorted(g[5] for g in got if g[4] == s) == list(range(c))


def test_sharding_with_slack_moves_little(spark):
    rows = [(k, f"text {k}") for k in range(4000)]
    docs = documents(spark, rows)
    before = {g[0]: g for g in sharded(docs, shards=8, slack=0.25)}
    after = {g[0]: g for g in sharded(docs, shards=9, slack=0.25)}
    assert max(Counter(g[4] for g in before.values()).values()) <= math.ceil(4000 * 1.25 / 8)
    # With room to spare nearly every row stays at home, and only the new shard's share moves.
    assert sum(g[3] == g[4] for g in before.values()) > 3900
    moved = [k for k in before if before[k][4] != after[k][4]]
    assert len(moved) < 4000 * 0.2 and sum(after[k][4] == 8 for k in moved) > 0.9 * len(moved)


def test_sharding_of_small_empty_and_clashing_tables(spark):
    assert sharded(empty(spark)) == []
    assert len(sharded(documents(spark, [(7, None)]))) == 1
    assert sharded(documents(spark, [(None, None)]))[0][1:3] == (1, 0)
    frame = documents(spark, [(k, "x") for k in range(20)])
    for name in ("arc", "at", "rank", "row", "n", "slot", "shard", "points"):
        frame = frame.withColumn(name, spark_col("text"))
    assert sharded(frame) == sharded(documents(spark, [(k, "x") for k in range(20)]))


# ---- resampling ----------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_crc_of_spans_of_any_length():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    for block in (4, 64):
        table = resampling.PositionTable(block)
        length = np.concatenate([np.arange(300), rng.integers(0, 2000, 50)])
        begin = rng.integers(0, 3000, len(length))
        got = table.crc32(data, begin, length)
        assert got.tolist() == [zlib.crc32(data[b : b + n].tobytes()) for b, n in zip(begin, length, strict=True)]
        assert len(table.crc32(data, begin[:0], length[:0])) == 0


@pytest.mark.parametrize("longest", [1, 3])
def test_features_equal_brute_force(monkeypatch, longest):
    monkeypatch.setattr(resampling, "SPAN_BYTES", 300)
    texts = [t for _, t in awkward()] + ["ab", "cd", "Ä-ö 12z" * 40, "q" * 1000, None, "", "x\x00y\x7fz"]
    for column in (pa.array(texts), pa.array(["cut", *texts, "cut"])[1:-1], pa.array(texts, pa.large_string())):
        bucket, row, n_words = resampling.features(column, longest, 10007)
        want = []
        for i, text in enumerate(texts):
            words = WORD.findall((text or "").encode().lower())
            assert n_words[i] == len(words)
            for n in range(1, longest + 1):
                runs = (b" ".join(words[k : k + n]) for k in range(len(words) - n + 1))
                want += [(i, zlib.crc32(x) % 10007) for x in runs]
        assert sorted(zip(row.tolist(), bucket.tolist(), strict=True)) == sorted(want)
    assert [len(x) for x in resampling.features(pa.array([], pa.string()), longest, 10)] == [0, 0, 0]


def resample_by_hand(rows, target, longest, buckets, min_words, percent):
    def found(text):
        words = WORD.findall((text or "").encode().lower())
        return words, [
            zlib.crc32(b" ".join(words[k : k + n])) % buckets
            for n in range(1, longest + 1)
            for k in range(len(words) - n + 1)
        ]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(found(text)[1])
    for text in target:
        t.update(found(text)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for doc, text in rows:
        words, buckets_of = found(text)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in buckets_of
        )
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(words), len(buckets_of), weight, score, None])
    fit = sorted((o for o in out if o[1] >= min_words), key=lambda o: (-o[4], o[0] is not None, o[0] or 0))
    for rank, o in enumerate(fit[: len(fit) * percent // 100], 1):
        o[5] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 55)])
def test_resampling_equals_brute_force(spark, longest, percent):
    rows = awkward() + [(80, sentence(random.Random(4), 30))] * 6
    target = ["river stone window7 garden3 the of and", None, "", "漢字 text"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(documents(spark, rows), frame, longest=longest, percent=percent, min_words=10)
    names = "doc_id n_words n_features weight score rank".split()
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == resample_by_hand(
        rows, target, longest, 10_000, 10, percent
    )


def test_resampling_of_empty_tables(spark):
    docs = documents(spark, [(1, "one two " * 20), (2, None)])
    none = spark.createDataFrame([], "item_id long, text string")
    got = sorted((r.doc_id, r.n_features, r.rank) for r in resampling.resample(docs, none, percent=100).collect())
    assert got == [(1, 40, 1), (2, 0, None)]
    assert resampling.resample(empty(spark), none).collect() == []
    clash = docs.withColumn("rank", spark_col("text")).withColumn("n", spark_col("text")).withColumn("row", spark_col("text"))
    assert len(resampling.resample(clash, docs).collect()) == 2


# ---- the Merkle manifest -------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_by_hand(row, text):
    doc, _, lang, source, n_chars = row
    fields = [None if x is None else str(x) for x in (doc, source, lang, n_chars, text)]
    return sha("".join("-" if f is None else f"{len(f.encode())}:{f}" for f in fields))


def climb_by_hand(nodes):
    """Levels of a tree: each node's number at a level leads to its run in the level's list."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def proof_by_hand(levels, k):
    out = []
    for level in levels[:-1]:
        run = level[k // 8 * 8 : k // 8 * 8 + 8]
        out.append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        k //= 8
    return out


def audit_by_hand(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf_by_hand(row, row[1]), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb_by_hand([x[2] for x in sorted(v, key=lambda x: x[:3])]) for g, v in groups.items()}
    trunk = climb_by_hand([trees[g][-1][0] for g in order])
    out = []
    for number, g in enumerate(order):
        for k, (_, _, leaf, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = proof_by_hand(trees[g], k) + proof_by_hand(trunk, number)
            own = leaf
            if row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                own = leaf_by_hand(row, re.sub("[A-Z]", lambda m: m[0].lower(), row[1]))
            for before, after in path:
                own = sha(before + own + after)
            root = trunk[-1][0]
            digest = sha("".join(b + a for b, a in path))
            out.append((row[0], leaf, trees[g][-1][0], root, digest, own, own == root))
    return sorted(out, key=repr)


def check_audit(spark, rows):
    got = merkle.audit(spark.createDataFrame(rows, DOCS))
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    found = sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr)
    assert found == audit_by_hand(rows)
    return found


def test_manifest_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, t, rng.choice(["en", None, "de", "é", "z"]), rng.choice(["s", None, ""]), rng.choice([None, 3])) for i, t in awkward()]
    rows += [(None, None, None, None, None)] * 3 + [(200 + k, f"Text {k}", f"lang{k}", "s", 1) for k in range(12)]
    found = check_audit(spark, rows)
    assert {f[6] for f in found} == {True, False}


def test_manifest_over_several_blocks(spark):
    """A group of more leaves than two tiers' blocks, one key in a third of the rows."""
    rows = [(k if k % 3 else 7, f"Row {k % 50}", "en", "s", k % 4) for k in range(1200)]
    rows += [(k, "x", "de", None, None) for k in range(513)] + [(k, "x", "fr", None, None) for k in range(512)]
    check_audit(spark, rows)


def test_manifest_of_small_empty_and_clashing_tables(spark):
    assert merkle.audit(empty(spark)).collect() == []
    check_audit(spark, [(3, "Alone", "en", "s", 5)])
    check_audit(spark, [(3, "ALONE", "en", "s", 5), (4, "B", None, "s", 5)])
    rows = [(k, "A", "en", "s", 5) for k in range(30)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("group", "rank", "hash", "leaf", "carried", "height", "block", "path", "n", "row", "d0"):
        frame = frame.withColumn(name, spark_col("source"))
    assert sorted(r.leaf for r in merkle.audit(frame).collect()) == sorted(leaf_by_hand(r, "A") for r in rows)


def test_a_path_belongs_to_its_leaf(spark):
    rows = [(k, f"T {k}", "en", "s", 5) for k in range(100)]
    frame = spark.createDataFrame(rows, DOCS)
    leaves = frame.select(spark_col("lang").alias("group"), "doc_id", merkle.leaf_hash().alias("leaf"), "source")
    got = merkle.manifest(leaves.withColumnRenamed("source", "carried")).collect()
    for r in got:
        own = r.leaf
        for step in r.path:
            own = sha(step.before + own + step.after)
        assert own == r.root and r.carried == "s"

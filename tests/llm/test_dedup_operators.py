"""Near-duplicate, substring and embedding deduplication and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from scholion.llm import bwt, components, embedding_dedup, minhash_dedup, suffix_dedup
from helpers import awkward, documents, empty, sentence


def groups_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def shingle_set(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    take = min(width, len(words))
    return {tuple(words[i : i + take]) for i in range(len(words) - take + 1)} if take else set()


def near_by_hand(rows, width, percent):
    sets = {i: shingle_set(t, width) for i, t in rows}
    links = []
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            same = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * same >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    root = groups_of(ids, links)
    return sorted((i, len(sets[i]), root[i], root[i] == i) for i in ids)


def got_near(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect())


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (5, 6), (6, 5), (None, 3)]
    frame = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.component_id for r in components.components(frame).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components.components(frame.limit(0)).collect() == []


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rows = [r for r in awkward() if r[0] is not None and r[0] != 35]
    docs = documents(spark, rows)
    assert got_near(minhash_dedup.near_duplicates(docs, width, percent)) == near_by_hand(rows, width, percent)


def test_near_duplicates_in_one_crowded_group(spark, monkeypatch):
    """Copies of a base that is not the smallest id: stars alone would lose most links."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 40)
    rng = random.Random(12)
    base = sentence(rng, 150).split()
    rows = [(500, " ".join(base))]
    for k in range(180):
        edited = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4])):
            edited[at] = f"edit{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(edited)))
    got = got_near(minhash_dedup.near_duplicates(documents(spark, rows), 3, 85))
    assert got == near_by_hand(rows, 3, 85)


def test_near_duplicates_of_odd_tables(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (9, "A  b\tC d"), (None, "a b c d"), (3, None)]
    got = minhash_dedup.near_duplicates(documents(spark, rows), 3, 85).collect()
    assert len(got) == 5
    assert {r.component_id for r in got if r.doc_id in (7, 9)} == {7}
    assert minhash_dedup.near_duplicates(empty(spark), 3, 85).collect() == []


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (20, 400):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        errors = []
        for _ in range(30):
            b = np.sort(np.concatenate([a[: n * 9 // 10], rng.integers(0, 2**64, n // 10, dtype=np.uint64)]))
            signature = minhash_dedup.signatures([a, b])
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((signature[0] == signature[1]).mean() - truth)
        assert abs(np.mean(errors)) < 0.05


# ---- substrings --------------------------------------------------------------------------


def removed_by_hand(rows, length):
    first = {}
    for i, t in sorted((i, t or "") for i, t in rows if i is not None):
        raw = t.encode()
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        flags = np.zeros(len(raw), dtype=bool)
        if i is not None:
            for k in range(len(raw) - length + 1):
                if first[raw[k : k + length]] < i:
                    flags[k : k + length] = True
        edges = np.diff(np.concatenate([[0], flags.astype(int)]))
        kept = bytes(b for b, f in zip(raw, flags, strict=True) if not f)
        out.append((str(i), len(raw), int(flags.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got_removed(frame):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect())


def shared_passages(seed=3):
    rng = random.Random(seed)
    passages = [sentence(rng, rng.randint(8, 60)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [sentence(rng, rng.randint(0, 30)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((rng.choice([i, i + 500]), " ".join(parts)))
    return rows + [(40, "ab" * 400), (41, "b" + "ab" * 200 + "x"), (42, "ab" * 30)]


@pytest.mark.parametrize("group_bytes,segment", [(2_000_000, 2_000_000), (300, 170)])
def test_repeated_spans_equal_brute_force(spark, monkeypatch, group_bytes, segment):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 150)
    rows = [r for r in awkward() if r[0] not in (35, 70)] + shared_passages()
    rows = list({str(i): (i, t) for i, t in rows}.values())
    docs = documents(spark, rows)
    assert got_removed(suffix_dedup.span_report(docs, 50)) == removed_by_hand(rows, 50)


def test_repeated_rows_lose_the_same_bytes(spark):
    text = "abcdefghij" * 9
    rows = [(5, text), (5, text), (3, text + "tail"), (4, None)]
    got = got_removed(suffix_dedup.span_report(documents(spark, rows), 50))
    assert [(r[0], r[2]) for r in got] == [("3", 0), ("4", 0), ("5", 90), ("5", 90)]
    assert suffix_dedup.span_report(empty(spark), 50).collect() == []


def test_stripping_keeps_rows_and_columns(spark):
    rows = [(1, "é" * 40 + "tail"), (2, "x" + "é" * 40), (3, None), (4, "")]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in suffix_dedup.strip_repeats(docs, 50).collect()}
    assert suffix_dedup.strip_repeats(docs, 50).columns == docs.columns
    assert {i: r.text for i, r in got.items()} == {1: rows[0][1], 2: "x", 3: None, 4: ""}
    assert got[2].n_chars == 1 and got[2].source == "src2"


def test_merged_transforms_find_repeated_intervals():
    rng = random.Random(2)
    for _ in range(150):
        length = rng.choice([1, 2, 3, 5])
        letters = rng.choice([b"ab", b"abc\x00\xff", bytes(range(256))])
        strings = [bytes(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(rng.randint(1, 12))]
        owners = np.array([rng.randint(0, 5) for _ in strings])
        least = {}
        for s, o in zip(strings, owners, strict=True):
            for i in range(len(s) - length + 1):
                least[s[i : i + length]] = min(least.get(s[i : i + length], 99), o)
        got = bwt.smallest_owner(strings, owners, length, rng.choice([5, 20, 1000]))
        for s, g in zip(strings, got, strict=True):
            assert g.tolist() == [least[s[i : i + length]] for i in range(len(s) - length + 1)]


# ---- embeddings --------------------------------------------------------------------------


def vectors(seed=4, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(240):
        base = rng.standard_normal(dim)
        if k % 3 and rows:
            base = np.array(rows[rng.integers(max(0, k - 9), k)][1]) + rng.standard_normal(dim) * rng.choice([0, 0.05, 0.2, 0.4])
        rows.append((k, [float(x) for x in np.float32(base)], int(k % 2) if k % 40 else None))
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * dim, 1), (303, [float("nan")] + [1.0] * (dim - 1), 1),
             (304, [float("inf")] + [1.0] * (dim - 1), 1), (305, [None] + [1.0] * (dim - 1), 1), (306, [1.0, 2.0], 1),
             (307, [2.0, 4.0], 1), (308, [1e30] * dim, 0), (309, [1e-30] * dim, 0)]
    return rows


def embeddings_by_hand(rows, threshold):
    fit = {
        i: (np.array(v, dtype=float), label)
        for i, v, label in rows
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v)
    }
    links = []
    for a, (x, la) in fit.items():
        for b, (y, lb) in fit.items():
            if a < b and la == lb and len(x) == len(y):
                x1, y1 = x / np.abs(x).max(), y / np.abs(y).max()
                if x1 @ y1 / math.sqrt((x1 @ x1) * (y1 @ y1)) >= threshold:
                    links.append((a, b))
    root = groups_of([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return sorted((i, n[i], root[i], root[i] == i) for i in n)


@pytest.mark.parametrize("block_rows", [3000, 20])
def test_embedding_links_equal_brute_force(spark, block_rows):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.link_embeddings(frame, 0.93, block_rows=block_rows).collect()
    assert sorted(tuple(r) for r in got) == embeddings_by_hand(rows, 0.93)


def test_embedding_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    dim = 64
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 2000, dim)))
    y = 0.6 * x + 0.8 * y
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    bits, factor = embedding_dedup.encode(x)
    signs = embedding_dedup.decode(bits, dim)
    turned = y @ embedding_dedup.rotation(dim)
    estimate = (signs * turned).sum(axis=1) / (math.sqrt(dim) * factor)
    truth = (x * y).sum(axis=1)
    assert abs((estimate - truth).mean()) < 0.01
    near = embedding_dedup.may_reach(signs[:200], factor[:200], turned[:200].astype(np.float32), 0.6)
    assert near.diagonal()[truth[:200] >= 0.6].all()


def test_embedding_repeats_and_empty_table(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.link_embeddings(frame).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert embedding_dedup.link_embeddings(frame.limit(0)).collect() == []


# ---- pipeline ----------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = random.Random(21)
    passage = sentence(rng, 70)
    item = sentence(rng, 25).capitalize() + ". " + sentence(rng, 6) + "."
    base = sentence(rng, 120)
    rows, labels = [], []
    for i in range(160):
        text = ". ".join(sentence(rng, 14).capitalize() for _ in range(rng.randint(2, 9))) + "."
        if i % 4 == 0:
            text = " ".join(w + "###" for w in text.split())
        labels.append((i, int(i % 4 != 0), 0))
        rows.append((i, text))
    rows += [(201, base), (202, base), (203, base + " more"), (204, None), (205, "")]
    rows += [(210, sentence(rng, 40) + " " + passage), (211, sentence(rng, 40) + " " + passage)]
    rows += [(220, sentence(rng, 60) + " " + item + " " + sentence(rng, 60))]
    sf = str(tmp_path / "sf")
    documents(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clashing = docs.selectExpr("*", "'x' AS score", "1 AS spans", "2 AS copy", "3 AS n", "4 AS quality")
    assert clashing.columns == corpus_pipeline.keep_good(spark, clashing, sf).columns
    assert {r.score for r in corpus_pipeline.keep_good(spark, clashing, sf).collect()} == {"x"}
    assert clashing.columns == corpus_pipeline.strip_repeated(spark, clashing, sf).columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        kept.append({r.doc_id: r for r in docs.collect()})
    good = {i for i, _ in rows if i >= 200 or i % 4}
    assert kept[0].keys() >= good - {204, 205} and not any(i < 160 and i % 4 == 0 for i in kept[0])
    assert kept[1].keys() == kept[0].keys() - {202, 203}
    assert passage in kept[2][210].text and passage[5:] not in kept[2][211].text
    assert kept[3].keys() == kept[2].keys() - {220}
    assert {r.doc_id for r in docs.collect()} == kept[3].keys()
    assert corpus_pipeline.run(spark, sf).count() == docs.count()

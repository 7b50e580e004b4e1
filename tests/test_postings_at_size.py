"""Positional postings from Arrow data, stems of single words, and searches that read stored places once."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from scholion.functions.stemming import BEGINNINGS, DERIVED, IRREGULAR, PLAIN, RELATED, UNCHANGED, stem, stems
from scholion.functions.text import STOP_WORDS, singular, singular_word
from scholion.operators import keyword, positions
from scholion.session import scratch_path

CHUNKS = "chunk_id string, document_id string, content string"
ROWS = [
    ("a", "1", "Running dogs, the dog runs. Glasses of ÉTUDES and ΣΟΦΟΣ"), ("a", "1", "dog 7 running"),
    ("a", "2", "dog the the dog"), (None, "3", "runs"), (None, None, "runs dog"), ("b", None, None), ("c", "4", ""),
    ("d", "5", "the of ... and"), ("e", "6", "  _x_y_ queries\nflies\tbus buses "),
]


def rows(spark):
    return spark.createDataFrame(ROWS, CHUNKS)


def test_stem_of_a_word_is_that_of_the_column(spark):
    rng = random.Random(11)
    ends = [r.suffix for r in DERIVED + RELATED + PLAIN] + "s es ed ing ly edly ingly eed eedly ies ied sses us y e ll".split()
    words = {*IRREGULAR, *UNCHANGED, *(b + e for b in BEGINNINGS for e in ends), "s", "y", ""}
    for _ in range(5000):
        word = "".join(rng.choice("aeiouybcdglnrstvwxzéß7") for _ in range(rng.randint(0, 6)))
        words.add(word + "".join(rng.choice(ends) for _ in range(rng.randint(0, 3))))
    table = spark.createDataFrame([(w,) for w in words], "term string")
    assert [r for r in stems(table).collect() if stem(r.term) != r.stem] == []
    assert [r for r in table.select("term", singular(F.col("term")).alias("s")).collect() if singular_word(r.term) != r.s] == []


@pytest.mark.parametrize("conf", ["simple", "stop", "english", "stem"])
def test_places_of_repeated_and_null_chunks(spark, conf):
    folded = {"stem": stem, "english": singular_word}.get(conf, lambda w: w)
    want, length = {}, {}
    for chunk, document, text in ROWS:
        for i, word in enumerate(re.findall(r"[^\W_]+", (text or "").lower())):
            if conf == "simple" or word not in STOP_WORDS:
                want.setdefault((folded(word), chunk, document), []).append(i)
                length[chunk, document] = length.get((chunk, document), 0) + 1
    got = positions.positional_postings(rows(spark), conf)
    assert dict(got.dtypes)["gaps"] == "array<int>" and dict(got.dtypes)["tf"] == dict(got.dtypes)["dl"] == "bigint"
    found = {(r.term, r.chunk_id, r.document_id): (r.tf, r.dl, r.gaps) for r in got.collect()}
    assert found.keys() == want.keys()
    for key, places in want.items():
        at = sorted(places)
        assert found[key] == (len(at), length[key[1:]], [b - a for a, b in zip([0, *at], at)])


def test_no_word_is_a_row_of_its_own(spark):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    plan = positions.positional_postings(rows(spark))._jdf.queryExecution().explainString(mode)
    assert "Generate" not in plan and "ObjectHashAggregate" not in plan


def test_marked_postings_give_the_same_lengths(spark):
    chunks = rows(spark)
    plain = positions.chunk_lengths(positions.positional_postings(chunks), chunks)
    path = scratch_path(spark, "places")
    keyword.write_postings(positions.positional_postings(chunks, marked=True), path)
    stored = spark.read.parquet(path)
    marked = positions.chunk_lengths(stored, chunks, marked=True)
    key = lambda r: tuple(map(str, r))
    assert sorted(marked.collect(), key=key) == sorted(plain.collect(), key=key)
    # Only the folder of the empty term is read.
    assert len(marked.inputFiles()) >= 1
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    assert "PartitionFilters: [isnotnull(term_bucket" in marked._jdf.queryExecution().explainString(mode)


def test_stored_places_are_read_once(spark):
    texts = {k: f"dog run w{k}" for k in range(40)}
    chunks = spark.createDataFrame([(f"c{k}", str(k), t) for k, t in texts.items()], CHUNKS)
    docs = spark.createDataFrame(
        [(str(k), "j", "a", "completed") for k in texts],
        "document_id string, journal string, article_type string, processing_status string",
    ).withColumn("publication_date", F.lit("2024-01-01").cast("date"))
    asking = spark.createDataFrame([("q", "dog w7"), ("p", "running dogs"), ("n", "cat dog")], "query_id string, query_text string")
    path = scratch_path(spark, "places")
    keyword.write_postings(positions.positional_postings(chunks, marked=True), path)
    postings = spark.read.parquet(path)
    placed = positions.placed_matches(
        asking, chunks, docs, postings, lengths=positions.chunk_lengths(postings, chunks, marked=True)
    )
    # What a search still reads when it runs is what was stored for it.
    assert not any(path in f for f in placed.inputFiles())
    got = {(r.query_id, r.chunk_id) for r in placed.collect()}
    assert got == {("q", "c7"), *(("p", f"c{k}") for k in texts)}

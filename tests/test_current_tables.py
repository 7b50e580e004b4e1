"""Tables kept up to date by batches: against a dictionary, with repeats and half-written batches."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from scholion.sources import current as cu
from scholion.streaming import ingest

SCHEMA = "k string, v int, batch_id int"


def stored(spark, path):
    frame = cu.read_current(spark, path)
    return {} if frame is None else {r.k: (r.v, r.batch_id, r.processing_attempts, r.created_at) for r in frame.collect()}


def test_many_batches_equal_a_dictionary(spark, tmp_path):
    path, rng, want = str(tmp_path / "t"), random.Random(1), {}
    for n in range(20):
        rows = [(f"k{k}", rng.randrange(100), 99) for k in rng.sample(range(60), rng.choice([0, 1, 5, 30]))]
        assert cu.merge_batch(spark.createDataFrame([*rows, (None, 1, 1)], SCHEMA), path, "k", n, buckets=5)
        for k, v, _ in rows:
            _, _, tries, first = want.get(k, (0, 0, 0, n))
            want[k] = (v, n, tries + 1, first)
    assert stored(spark, path) == want
    # A repeated batch changes nothing; a read scans one version of each bucket.
    assert not cu.merge_batch(spark.createDataFrame([("k1", -1, 0)], SCHEMA), path, "k", 19, buckets=5)
    assert stored(spark, path) == want
    files = cu.read_current(spark, path).inputFiles()
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == len({os.path.dirname(f) for f in files}) <= 5
    assert len(os.listdir(f"{path}/pointer")) <= cu.KEPT_POINTERS


def test_a_batch_without_its_pointer_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    assert cu.read_current(spark, path) is None
    cu.merge_batch(spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("b", 2, 0)], SCHEMA), path, "k", 0, buckets=2)
    before = stored(spark, path)
    # What a batch leaves behind that failed before its pointer: data of version 1.
    half = spark.createDataFrame([("a", 7)], "k string, v int").withColumns(
        {"batch_id": F.lit(1).cast("long"), "processing_attempts": F.lit(2), "created_at": F.lit(0).cast("long"),
         "bucket": cu.bucket_of("k", 2), "version": F.lit(1)}
    )
    half.write.mode("append").partitionBy("bucket", "version").parquet(f"{path}/data")
    assert stored(spark, path) == before == {"a": (1, 0, 1, 0), "b": (2, 0, 1, 0)}
    assert cu.merge_batch(spark.createDataFrame([("a", 9, 0)], SCHEMA), path, "k", 1, buckets=2)
    assert stored(spark, path) == {"a": (9, 1, 2, 0), "b": (2, 0, 1, 0)}


def test_merged_documents_are_the_newest_versions(spark, tmp_path):
    base, rng = str(tmp_path), random.Random(4)
    for n in range(4):
        ids = rng.sample(range(12), 6)
        rows = [(f"d{k}", f"title {k} of {n}", rng.choice([None, f"10.1/{k % 5}"]), None) for k in ids]
        frame = spark.createDataFrame(rows, "document_id string, title string, doi string, pmcid string")
        frame.write.parquet(f"{base}/documents/batch_id={n}")
        assert ingest.merge_documents(spark, base, n)
    assert not ingest.merge_documents(spark, base, 3)
    names = ["document_id", "title", "doi", "batch_id", "processing_attempts", "created_at"]
    whole, merged = (
        sorted((tuple(r[c] for c in names) for r in f.select(*names).collect()), key=repr)
        for f in (ingest.current_documents(spark, base), ingest.stored_documents(spark, base))
    )
    assert whole == merged and len(whole) > 3

"""Steps that have to grow no faster than their input."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from scholion.functions.text import WS, strip, word_count, words
from scholion.functions.vectors import normalise
from scholion.operators import chunking as ch
from scholion.operators import embedding as em
from scholion.operators import vector_search as vs
from scholion.operators.asked import Asked
from scholion.plans import base, search

SPACES = [" ", "\n", "\n\n", "\t", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", " \n \n "]


def texts(n, seed=3):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "bé", "word", "\u200b", "中文", "x" * 30])
    made = ["".join(word() + rnd.choice(SPACES) for _ in range(rnd.choice([0, 1, 5, 8, 9, 30, 90]))) for _ in range(n)]
    return [*made, None, "", " \n\u2003 ", "one two three four five six seven eight nine ten eleven twelve"]


def test_texts_are_packed_alike_in_batches_and_by_columns(spark):
    rows = [(str(i), [("T", "T", "body", t, 1), ("U", "U", "body", t, 1)]) for i, t in enumerate(texts(60))]
    docs = spark.createDataFrame(
        rows, "document_id string, sections array<struct<title:string,full_title:string,type:string,content:string,depth:int>>"
    )
    for size, overlap, sep in ((8, 3, "\n\n"), (8, 0, "\n"), (1, 0, "\n"), (30, 29, "\n\n")):
        fast = ch.chunk_documents(docs, size, overlap, sep)
        slow = ch.chunk_documents(docs, size, overlap, sep, counter=lambda c: word_count(c))
        assert "ArrowEvalPython" in fast._jdf.queryExecution().toString()
        assert sorted(map(str, fast.collect())) == sorted(map(str, slow.collect()))


def test_python_and_columns_agree_on_white_space(spark):
    letters = [chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    frame = spark.createDataFrame([(c,) for c in letters], "c string")
    spaces = {r.c for r in frame.where(F.col("c").rlike(f"^[{WS}]$")).collect()}
    assert spaces == {c for c in letters if not c.split()}


def test_words_and_ends_of_a_text_are_found_in_one_pass(spark):
    rows = [(i, t) for i, t in enumerate([*texts(300), "\U0001d4b3 \u2028\U0001d4b4", "\ufeff a", "\x00\x1b \x7f"])]
    got = spark.createDataFrame(rows, "i long, t string").select("i", words("t").alias("w"), word_count("t").alias("n"), strip("t").alias("s"))
    want = {(i, *((str(t.split()), len(t.split()), t.strip()) if t is not None else ("None", None, None))) for i, t in rows}
    assert {(r.i, str(r.w), r.n, r.s) for r in got.collect()} == want
    # A long run of blanks inside a text was walked from each of its blanks.
    gap = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 400_000), F.lit("b")).alias("t"))
    began = time.monotonic()
    assert gap.select(F.length(strip("t")), word_count("t")).first()[:] == (400_002, 2)
    assert time.monotonic() - began < 15


def test_a_vector_is_made_once_to_be_normalised(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    out = v.select(normalise(F.col("v")).alias("n"))
    assert [r.n for r in out.collect()] == [[0.6, 0.8], None, None]
    assert out._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1


def test_texts_go_to_a_model_without_a_second_copy(spark):
    class Lengths:
        model_id, dimensions = "lengths", 2

        def load(self):
            def model(batch):
                if "bad" in batch:
                    raise ValueError("bad text")
                return [np.array([len(t), len(batch)]) for t in batch]

            return model

    rows = [(i, None if i == 4 else "bad" if i == 7 else "x" * i, i % 2 == 0) for i in range(12)]
    df = spark.createDataFrame(rows, "i long, text string, even boolean").coalesce(1)
    out = em.embed(df, "text", Lengths(), batch_size=3)
    assert "_embed_text" not in out._jdf.queryExecution().toString()
    got = {r.i: r for r in out.collect()}
    assert got[4].embedding is None and got[4].embedding_error == "no text"
    assert got[7].embedding is None and got[7].embedding_error == "bad text"
    assert got[5].embedding == [5.0, 3.0] and got[8].embedding == [8.0, 1.0] and got[0].embedding == [0.0, 3.0]
    assert [(r.i, r.text, r.even) for r in got.values()] == rows


def test_each_question_of_many_queries_is_searched_once(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    cand = [(f"c{i:03d}", "d", rnd.normal(size=4).tolist(), "j", "t") for i in range(90)]
    chunks = spark.createDataFrame(cand, "chunk_id string, document_id string, embedding array<float>, journal string, article_type string")
    chunks = chunks.withColumn("publication_date", F.lit("2024-01-01").cast("date"))
    asks = [rnd.normal(size=4).tolist() for _ in range(7)]
    rows = [(f"q{i}", asks[i % 7]) for i in range(200)] + [("q3", asks[3]), ("none", None), (None, asks[0])]
    queries = spark.createDataFrame(rows, "query_id string, query_embedding array<float>")
    passes = []
    for name in ("_broadcast_pass", "_streamed_pass"):
        one = getattr(vs, name)
        monkeypatch.setattr(vs, name, lambda *a, one=one, name=name: passes.append(name) or one(*a))
    found = []
    for per_query, held in ((10, 1000), (2, 1000), (2, 10)):
        monkeypatch.setattr(vs, "CANDIDATES_PER_BLOCK", held)
        hits = vs.vector_topk(Asked(queries, None), chunks, 3, per_query)
        found.append(sorted(str((r.query_id, r.chunk_id, r.vector_rank)) for r in hits.collect()))
    assert passes == ["_broadcast_pass"] + ["_streamed_pass"] + ["_broadcast_pass"] * 4
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.argsort(-(unit(np.float32(asks).astype(float)) @ unit(np.float32([c[2] for c in cand]).astype(float)).T), axis=1)
    want = [(q, cand[near[asks.index(v)][k]][0], k + 1) for q, v in rows if v and q != "q3" for k in range(3)]
    # Two queries of one id share a rank list.
    twice = [cand[near[3][k]][0] for k in (0, 0, 1)]
    want += [("q3", c, k + 1) for k, c in enumerate(twice)]
    assert found == [sorted(map(str, want))] * 3


def small_tables(spark, folder, vectors):
    """Documents, labels, vectors and questions, one Parquet file each."""
    text = [None if i == 3 else f"alpha beta line {i}\nsecond gamma{i % 4} words" for i in range(40)]
    made = {
        "documents": ([(i, t, "en", f"src{i % 5}", 10) for i, t in enumerate(text)], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, 1, i % 7 == 0) for i in range(36)], "doc_id long, quality int, toxic boolean"),
        "embeddings": (vectors, "vec_id long, embedding array<float>, label int"),
        "benchmark": ([(i, f"alpha gamma{i % 4} words") for i in range(6)], "item_id long, text string"),
    }
    for name, (rows, schema) in made.items():
        df = spark.createDataFrame(rows, schema)
        if name == "labels":
            df = df.withColumn("toxic", F.col("toxic").cast("int"))
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_texts_alone_are_the_rows_of_the_chunks(spark, tmp_path):
    once = [(i, [float(i), 1.0], 0) for i in range(30)]
    for name, vectors in (("once", once), ("twice", [*once, (4, [0.5, 0.5], 1), (4, None, 1), (9, [1.0, 1.0], 1), (None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)])):
        sf = small_tables(spark, tmp_path / name, vectors)
        alone, whole = base.chunk_texts(spark, sf), base.chunks(spark, sf).drop("embedding")
        assert alone.columns == whole.columns
        assert sorted(map(str, alone.collect())) == sorted(map(str, whole.collect()))
        assert alone.count() == (40 if name == "once" else 43)
        assert ("Join" in alone._jdf.queryExecution().optimizedPlan().toString()) == (name == "twice")
        if name == "twice":
            spark.createDataFrame([(5, 1, 0), (5, 0, 1), (5, 1, 1), (None, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{sf}/labels.parquet")
        alone, whole = base.document_texts(spark, sf), base.documents(spark, sf).drop("processing_status")
        assert alone.columns == whole.columns
        assert sorted(map(str, alone.collect())) == sorted(map(str, whole.collect()))
        assert alone.count() == (40 if name == "once" else 42)


def test_texts_of_hits_meet_no_label_and_no_vector(spark, tmp_path):
    sf = small_tables(spark, tmp_path, [(i, [float(i), 1.0], 0) for i in range(30)])
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = search.QUERIES["q10_enriched_hits"](spark, sf)
        plan = hits._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joins = [next(k for k in ("LeftOuter", "LeftSemi", "Inner") if k in x) for x in plan if "- Join" in x or ":- Join" in x or x.startswith("Join")]
        # Neither a text nor a title meets a vector or label; the hits pick their documents before any shuffle.
        assert joins == ["Inner", "Inner", "LeftSemi", "LeftSemi"]
        rows = hits.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    again = search.QUERIES["q10_enriched_hits"](spark, sf).collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, again))
    assert all(r.title == r.content.split("\n")[0] for r in rows if r.content)

"""Cases that operators once got wrong: ids beside nulls, texts without repeats, long runs, page parts."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers
from scholion.llm import decontamination, html_text, language_id, packing, suffix_dedup
from helpers import awkward, documents, empty, sentence
from test_dedup_operators import got_removed, removed_by_hand

BIG = 2**60
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# ---- ids -----------------------------------------------------------------------------------


def test_large_ids_survive_beside_a_null_one(spark):
    rows = [(BIG + 1, "the one and the other"), (BIG + 3, "the other and the one"), (None, "the and"), (None, None)]
    ids = {BIG + 1, BIG + 3, None}
    docs = documents(spark, rows).coalesce(1)
    packed = packing.pack_documents(docs, VOCABULARY).collect()
    assert len(packed) == 4 and {r.doc_id for r in packed} == ids
    learn = documents(spark, [(k, "the and ing") for k in range(5)])
    assert {r.doc_id for r in language_id.identify(docs, learn).collect()} == ids
    item = sentence(random.Random(1), 30)
    held = documents(spark, [(BIG + 1, item), (None, item), (BIG + 3, "x")]).coalesce(1)
    tests = spark.createDataFrame([(None, item), (-1, "never seen words here"), (BIG + 5, item)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(held, tests).collect()}
    assert found == {(d, i) for d in (BIG + 1, None) for i in (None, BIG + 5)}
    spans = suffix_dedup.span_report(documents(spark, [(BIG + 1, "a" * 60), (BIG + 3, "a" * 60), (None, "a" * 60)]), 50)
    assert {(r.doc_id, r.n_removed) for r in spans.collect()} == {(BIG + 1, 0), (BIG + 3, 60), (None, 0)}


# ---- tokens of marked and capital words ------------------------------------------------------


def test_words_with_marks_have_the_ids_of_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(5)
    letters = ["a", "Z", "é", "É", "ß", "Σ", "1", "'", "’", "»", "…", ",", ".", "-", "$", "s", "'s", "<|", "|>", "endoftext",
               "\t", "́", "̸", "漢", "İ"]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 8))) for _ in range(4000)]
    words += ["<|endoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>,", "don't.", "don'", "X.Y.Z.", "...", "=", "≠."]
    known = packing.WordIds(VOCABULARY)
    known.learn(set(words))
    for word in words:
        want = np.asarray(library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert known[word] == want, word


# ---- repeated spans --------------------------------------------------------------------------


def test_texts_without_a_repeat_lose_nothing(spark):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=80))) for k in range(2)]
    for some in (rows, rows[:1], [(1, "short"), (2, None)]):
        assert got_removed(suffix_dedup.span_report(documents(spark, some), 50)) == removed_by_hand(some, 50)
    docs = documents(spark, rows)
    assert sorted(suffix_dedup.strip_repeats(docs, 50).collect()) == sorted(docs.collect())


@pytest.mark.parametrize("long_text", [100_000, 300])
def test_one_hot_passage_and_sparse_ids(spark, monkeypatch, long_text):
    """A passage in every row, ids far apart, negative ones, and texts counted as long ones."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "LONG_TEXT", long_text)
    rng = random.Random(4)
    passage = sentence(rng, 14)
    rows = [(k * 100_003 - 500_000, f"{sentence(rng, rng.randint(0, 25))} {passage} {sentence(rng, rng.randint(0, 25))}") for k in range(60)]
    # The helper compares ids by size, so rows are listed by id.
    got = got_removed(suffix_dedup.span_report(documents(spark, rows), 50))
    assert got == removed_by_hand(sorted(rows), 50)
    assert sum(r[2] > 0 for r in got) == 59


# ---- languages -------------------------------------------------------------------------------


def grams_by_hand(word):
    marked = f"<{word}>"
    return sorted(marked[i : i + n] for n in language_id.GRAMS for i in range(len(marked) - n + 1))


def test_long_runs_count_with_all_their_letters():
    """Pieces of a run give the n-grams of the whole run, and a run's inside matters."""
    rng = random.Random(3)
    word = "".join(rng.choices("abcdefg", k=500))
    for limit in (4, 37, 499, 500, 10_000):
        found = []
        for own, pieces in language_id.steps([word, "short"], limit):
            buckets, real, _ = language_id.subwords(pieces)
            letters = np.array(list("".join(f"{'<' * f}{w}{'>' * e}" for w, f, e in pieces)))
            for n in range(len(language_id.GRAMS)):
                for at in np.flatnonzero(real[n]):
                    found.append("".join(letters[at : at + language_id.GRAMS[n]]))
            assert set(own) <= {0, 1}
        assert sorted(found) == sorted(grams_by_hand(word) + grams_by_hand("short"))
    other = word[:30] + "xyz" * 100 + word[-30:]
    assert not np.array_equal(language_id._counts(word)[0], language_id._counts(other)[0])


def test_more_languages_than_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    rows = [(k, w * 6, lang, "s", 0) for k, (w, lang) in enumerate([("aab ", "x"), ("ccd ", "y")] * 30 + [("eef ", "z")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = language_id.identify(docs, docs).collect()
    assert len(got) == 61 and {r.lang_pred for r in got} == {"x", "y"}
    assert {r.rejected for r in got if r.doc_id < 60} == {False}


def test_a_sample_is_the_first_rows_by_hash(spark):
    from pyspark.sql import functions as F

    from scholion.llm.sampling import stratified

    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("quality"))
    listed = rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h").collect()
    want = {q: [r.doc_id for r in listed if r.quality == q][:40] for q in (0, 1)}
    got = stratified(rows.repartition(9), "doc_id", "quality", 40).collect()
    assert {q: {r.doc_id for r in got if r.quality == q} for q in (0, 1)} == {q: set(x) for q, x in want.items()}
    assert stratified(rows.limit(0), "doc_id", "quality", 40).collect() == []


# ---- pages -----------------------------------------------------------------------------------

LONG = "Some words, with a comma, and enough of them to be a paragraph of its own. "


def test_parts_of_an_article_stay():
    page = (
        "<body><nav><a href=x>Home</a></nav><main><h1>Title</h1><p>lead</p><article>"
        f"<p>{LONG}</p><section id='discussion'><h2 id='search'>Search</h2><p>{LONG}</p></section>"
        f"<h2 id='related-work'>Related work</h2><p>{LONG}</p><div class='alert'>Take care.</div>"
        "<div class='share'><a href=a>Tweet</a></div><div class='ad'>Buy</div>"
        f"<div id='comments'><p>{LONG}</p></div></article><article><p>short</p></article></main><footer>f</footer></body>"
    )
    part = LONG.strip()
    want = ["Title", "lead", part, "Search", part, "Related work", part, "Take care.", "short"]
    assert html_text.main_text(page).split("\n\n") == want


def test_what_stands_beside_the_container_stays():
    page = (
        f"<body><h1>Title</h1>Bare words<article><p>{LONG * 4}</p></article><article><p>Second</p></article>"
        "<div class=ad>Buy</div>tail<ul><li><a href=x>Link</a></ul></body>"
    )
    assert html_text.main_text(page).split("\n\n") == ["Title", "Bare words", (LONG * 4).strip(), "Second", "tail"]


def test_generated_pages_give_what_they_were_made_of():
    """Pages are built from parts that are known to be text or not; nothing of the text may be lost."""
    rng = random.Random(11)

    def said(low, high):
        return " ".join(rng.choice("Alpha beta, gamma delta. epsilon zeta".split()) for _ in range(rng.randint(low, high)))

    for _ in range(300):
        want, body = [], []
        for _ in range(rng.randint(2, 9)):
            kind = rng.choice("p p p h2 list quote section noise".split())
            text = said(4, 60)
            if kind == "p":
                body.append(f"<p>{text}")
                want.append(text)
            elif kind == "h2":
                name = rng.choice(["search", "related-work", "discussion", "notice", "x"])
                body.append(f"<h2 id={name}>{text}</h2>")
                want.append(text)
            elif kind == "list":
                body.append(f"<ul><li>{text}<li><b>{text}</b></ul>")
                want += [text, text]
            elif kind == "quote":
                body.append(f"<blockquote><p>{text}</p></blockquote>")
                want.append(text)
            elif kind == "section":
                body.append(f"<section id=discussion><h3>Part</h3><p>{text}</p></section>")
                want += ["Part", text]
            else:
                body.append(
                    rng.choice(
                        [
                            "<script>var a;</script>", "<div class='ad banner'>Buy it, now, please</div>", "<!-- <p>no</p> -->",
                            "<form><input><p>Sign, up</p></form>", "<aside><p>Aside, note</p></aside>",
                            "<div class=related><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>",
                        ]
                    )
                )
        if not want:
            continue
        inner = "".join(body)
        shell = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"])
        page = (
            "<html><head><title>T</title></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=a>A</a></ul></nav>"
            + shell.format(inner)
            + "<aside>Side, bar</aside><div class='cookie-notice'>We use cookies, many</div><footer>(c) us</footer></body></html>"
        )
        assert html_text.main_text(page) == "\n\n".join(want), page


# ---- pipeline --------------------------------------------------------------------------------


def tables(spark, folder, docs, labels=(), items=()):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_over_empty_and_odd_tables(spark, tmp_path):
    nothing = tables(spark, tmp_path / "a", empty(spark))
    assert corpus_pipeline.run(spark, nothing).collect() == []
    rows = awkward()[:12]
    odd = tables(spark, tmp_path / "b", documents(spark, rows), [(None, 1, 0), (3, None, 0), (4, 1, 0)], [(None, None), (1, "")])
    got = {r.doc_id for r in corpus_pipeline.run(spark, odd).collect()}
    assert {0, 1, 2, 3, 4, None} <= got
    rng = random.Random(7)
    plain = [(k, "".join(rng.choices("abcdefghijklmnop ", k=200))) for k in range(6)]
    alone = tables(spark, tmp_path / "c", documents(spark, plain))
    assert {r.doc_id for r in corpus_pipeline.run(spark, alone).collect()} == set(range(6))


def test_of_rows_with_one_id_the_same_one_stays(spark, tmp_path):
    rows = [(1, "one text of its own"), (1, "another text"), (1, "one text of its own"), (2, None), (None, "x"), (None, "x")]
    folder = tables(spark, tmp_path / "d", documents(spark, rows))
    got = [
        sorted(corpus_pipeline.keep_distinct(spark, documents(spark, order), folder).collect(), key=repr)
        for order in (rows, rows[::-1])
    ]
    assert got[0] == got[1] and [r.doc_id for r in got[0]].count(1) == 1 and len(got[0]) == 4

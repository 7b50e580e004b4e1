"""Exact cases, brute-force comparisons and edge behaviour of single operators."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholion.functions import present as pr
from scholion.functions.text import capitalize, lexemes
from scholion.functions.vectors import cosine
from scholion.operators import articles as ar
from scholion.operators import chunking as ch
from scholion.operators import context as cx
from scholion.operators import embedding as em
from scholion.operators import fuzzy, history, hybrid, keyword, routing, traffic
from scholion.operators import filters as flt
from scholion.operators import vector_search as vs
from scholion.operators.asked import Asked, ask
from scholion.sources import raw as rw


# ---- chunking ----------------------------------------------------------------------------


def test_window_starts(spark):
    want = {0: [], 1: [0], 512: [0], 513: [0, 312], 824: [0, 312], 825: [0, 312, 624], 1200: [0, 312, 624, 936]}
    df = spark.createDataFrame([(n,) for n in want], "n int")
    got = df.select("n", ch.window_starts(F.col("n"), 512, 200).alias("s")).collect()
    assert {r.n: r.s for r in got} == want


@pytest.mark.parametrize("sizes", [(100, 100), (100, 200), (0, 0), (10, -1)])
def test_bad_sizes_are_rejected(sizes):
    with pytest.raises(ValueError):
        ch.check_sizes(*sizes)


def check_plan(sizes, plan, cap, overlap):
    """What makes a plan the greedy one, stated of its pieces instead of computed anew."""
    spans = [(p.lo - 1, p.lo - 1 + p.n) for p in plan]
    total = lambda a, b: sum(sizes[a:b])
    assert {i for a, b in spans for i in range(a, b)} == set(range(len(sizes)))
    assert [a for (a, b), p in zip(spans, plan, strict=True) if p.split] == [i for i, n in enumerate(sizes) if n > cap]
    assert all(b == a + 1 for (a, b), p in zip(spans, plan, strict=True) if p.split)
    for k, (a, b) in enumerate(spans):
        carried = spans[k - 1][1] - a if k else 0
        # Carried paragraphs fit the overlap and one more would not; none cross a split paragraph.
        assert carried >= 0 and total(a, a + carried) <= overlap
        if k and not plan[k].split and not plan[k - 1].split:
            before = spans[k - 1][0]
            assert a == before or total(a - 1, a + carried) > overlap
            assert total(before, spans[k - 1][1] + 1) > cap
        else:
            assert carried == 0
        # Past the first new paragraph, each one still fitted.
        if not plan[k].split:
            assert all(total(a, end) <= cap for end in range(a + carried + 2, b + 1))


def test_packing_is_greedy(spark):
    rng = random.Random(7)
    lists = [[300, 200, 100, 600, 50], [500, 150, 400], []]
    lists += [[rng.choice([1, 5, 60, 200, 512, 513, 700]) for _ in range(rng.randrange(1, 30))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, s array<int>")
    got = df.select("id", ch.packing_plan(F.col("s"), 512, 200).alias("p")).collect()
    for r in got:
        check_plan(lists[r.id], r.p, 512, 200)
    assert [(p.lo, p.n, p.split) for p in got[0].p] == [(1, 2, False), (2, 2, False), (4, 1, True), (5, 1, False)]


def test_zero_overlap_is_honoured_and_links_are_inverse(spark):
    text = "\n\n".join(" ".join(f"w{i}" for i in range(k, k + 40)) for k in range(0, 400, 40))
    section = [("S", "S", None, text, 1)]
    docs = spark.createDataFrame(
        [("d", section)], f"document_id string, sections array<{ar.FLAT_SECTION}>"
    )
    rows = {r.chunk_id: r for r in ch.chunk_documents(docs, 80, 0).collect()}
    assert sorted(r.chunk_index for r in rows.values()) == list(range(5))
    assert sum(r.token_count for r in rows.values()) == 400
    for r in rows.values():
        if r.next_chunk_id:
            assert rows[r.next_chunk_id].previous_chunk_id == r.chunk_id
    linked = ch.link_chunks(ch.chunk_documents(docs, 80, 0)).collect()
    assert all(rows[r.chunk_id].next_chunk_id == r.next_chunk_id for r in linked)


def test_equal_content_has_equal_hash(spark):
    df = spark.createDataFrame([("c1", "d1", 0, "h"), ("c2", "d1", 1, "h"), ("c3", "d2", 0, "x")],
                               "chunk_id string, document_id string, chunk_index int, content_hash string")
    assert {r.chunk_id for r in ch.dedup_chunks(df).collect()} == {"c1", "c3"}


# ---- search ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    base[20:40] = base[5]  # a third of all rows are copies
    words = ["gene", "cell", "studies", "crispr", "heart", "the"]
    pick = random.Random(5)
    chunks = [
        (f"c{i:02d}", f"d{i % 30:02d}", " ".join(pick.choices(words, k=12)), [float(x) for x in base[i]] if i % 7 else None)
        for i in range(60)
    ] + [("c99", "d01", "zero", [0.0] * 8)]
    docs = [
        (f"d{i:02d}", "completed" if i % 5 else "pending", f"j{i % 3}", f"t{i % 2}", dt.date(2024, 1, 1 + i) if i % 6 else None)
        for i in range(30)
    ]
    queries = [
        ("a", [float(x) for x in base[5]], "crispr studies", None, ["j1", "j2"]),
        ("b", [float(x) for x in base[1]], "the", dt.date(2024, 1, 9), None),
        ("c", None, "gene gene heart", None, []),
        ("z", [0.0] * 8, "absent", None, None),
    ]
    return (
        spark.createDataFrame(queries, "query_id string, query_embedding array<float>, query_text string, date_from date, journals array<string>"),
        spark.createDataFrame(chunks, "chunk_id string, document_id string, content string, embedding array<float>"),
        spark.createDataFrame(docs, "document_id string, processing_status string, journal string, article_type string, publication_date date"),
    )


def brute_vector(corpus, depth):
    queries, chunks, docs = ([r for r in x.collect()] for x in corpus)
    meta = {d.document_id: d for d in docs if d.processing_status == "completed"}
    out = {}
    for q in queries:
        if q.query_embedding is None or not any(q.query_embedding):
            continue
        v = np.array(q.query_embedding)
        rows = []
        for c in chunks:
            d = meta.get(c.document_id)
            if d is None or c.embedding is None or not any(c.embedding):
                continue
            if q.date_from and (d.publication_date is None or d.publication_date < q.date_from):
                continue
            if q.journals and d.journal not in q.journals:
                continue
            w = np.array(c.embedding)
            rows.append((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), c.chunk_id))
        out[q.query_id] = [c for _, c in sorted(rows)[:depth]]
    return out


def by_query(df, rank):
    out = {}
    for r in df.orderBy("query_id", rank).collect():
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


def test_vector_topk_broadcast_and_blocks_equal_brute_force(spark, corpus):
    queries, chunks, docs = corpus
    want = brute_vector(corpus, 7)
    cand = vs.candidates(chunks, docs)
    assert by_query(vs.vector_topk(queries, cand, 7), "vector_rank") == want
    blocks = vs.vector_topk(Asked(queries, None), cand, 7, per_query=2)
    assert by_query(blocks, "vector_rank") == want


def test_page_is_part_of_the_whole(spark, corpus):
    queries, chunks, docs = corpus
    page = vs.vector_search(queries, chunks, docs, k=3, offset=2)
    assert by_query(page, "rank") == {q: c[2:5] for q, c in brute_vector(corpus, 5).items()}


def test_ann_with_all_cells_is_exact(spark, corpus):
    queries, chunks, docs = corpus
    centres = vs.fit_cells(chunks, 4)
    approx = vs.ann_search(queries, vs.assign_cells(chunks, centres), docs, centres, k=5, nprobe=4)
    assert by_query(approx, "rank") == brute_vector(corpus, 5)


def keyword_rows(df):
    return sorted((r.query_id, r.chunk_id, round(r.keyword_score, 6)) for r in df.collect())


def test_keyword_matches_need_all_terms_on_every_path(spark, corpus, tmp_path):
    queries, chunks, docs = corpus
    rows = keyword_rows(keyword.keyword_matches(queries, chunks, docs))
    texts = {r.chunk_id: r for r in chunks.collect()}
    seen = {q for q, _, _ in rows}
    assert seen == {"a", "c"}  # only a stop word, or no known word, matches nothing
    for q, c, _ in rows:
        need = {"a": ["crispr", "studies"], "c": ["gene", "heart"]}[q]
        assert all(w in texts[c].content.split() for w in need)
    assert keyword_rows(keyword.keyword_matches(Asked(queries, None), chunks, docs)) == rows
    keyword.write_postings(keyword.build_postings(chunks), str(tmp_path / "p"), 16)
    stored = spark.read.parquet(str(tmp_path / "p"))
    found = keyword.keyword_matches(queries, chunks, docs, postings=stored, term_buckets=16)
    assert keyword_rows(found) == rows


def test_more_mentions_rank_higher(spark):
    chunks = spark.createDataFrame(
        [("c1", "d1", "crispr gene editing with crispr and crispr"), ("c2", "d2", "crispr gene editing with much other text")],
        "chunk_id string, document_id string, content string",
    )
    docs = spark.createDataFrame(
        [("d1", "completed", "j", "t", None), ("d2", "completed", "j", "t", None)],
        "document_id string, processing_status string, journal string, article_type string, publication_date date",
    )
    q = spark.createDataFrame([("q", "CRISPR gene editing")], "query_id string, query_text string")
    hits = keyword.keyword_search(q, chunks, docs).orderBy("rank").collect()
    assert [h.chunk_id for h in hits] == ["c1", "c2"] and hits[0].score > hits[1].score


def test_fusion_hand_case(spark):
    v = spark.createDataFrame([("q", c, "d", i + 1, 0.5) for i, c in enumerate("abc")],
                              "query_id string, chunk_id string, document_id string, vector_rank int, vector_similarity double")
    w = spark.createDataFrame([("q", c, "d", i + 1) for i, c in enumerate("cd")],
                              "query_id string, chunk_id string, document_id string, keyword_rank int")
    got = hybrid.fuse(v, w).orderBy(F.desc("score")).collect()
    assert [r.chunk_id for r in got] == ["c", "a", "b", "d"]
    assert got[0].score == pytest.approx(0.7 / 63 + 0.3 / 61)
    assert got[3].vector_similarity is None and got[3].vector_rank == 1000


def test_hybrid_ignores_article_types_unless_asked(spark, corpus):
    queries, chunks, docs = corpus
    only = queries.withColumn("article_types", F.array(F.lit("none")))
    assert hybrid.hybrid_search(only, chunks, docs).count() > 0
    assert hybrid.hybrid_search(only, chunks, docs, article_type_filter=True).count() == 0


def test_title_similarity_paths_agree(spark):
    titles = spark.createDataFrame([("gene editing in cells",), ("gene editing in cells",), ("Gene-edited cell",), ("weather",)], "title string")
    q = spark.createDataFrame([("1", "gene editing cells"), ("2", "whether")], "query_id string, query_text string")
    rows = lambda df: sorted((r.query_id, r.title, round(r.similarity, 9), r.documents) for r in df.collect())
    got = rows(fuzzy.title_similarity(q, titles))
    assert got == rows(fuzzy.title_similarity(Asked(q, None), titles))
    assert ("1", "gene editing in cells") == got[0][:2] or ("1", "Gene-edited cell") == got[0][:2]


def test_query_validation(spark):
    q = spark.createDataFrame(
        [("1", "", 5, "vector"), ("2", "x" * 1001, 5, "vector"), ("3", "x", 101, "vector"), ("4", "x", 5, "fuzzy"), ("5", "x" * 10001, 5, "x")],
        "query_id string, query_text string, k int, search_type string",
    )
    ok, bad = flt.validate_queries(q)
    assert [(r.query_id, r.search_type) for r in ok.collect()] == [("4", "hybrid")]
    assert bad.count() == 4


def test_large_query_table_is_not_held(spark):
    q = spark.range(50).select(F.col("id").cast("string").alias("query_id"))
    assert ask(q, max_rows=49).frame is None and len(ask(q, max_rows=50).frame) == 50


# ---- contexts ----------------------------------------------------------------------------


def test_context_and_confidence(spark):
    hits = spark.createDataFrame(
        [("q", 1, "c1", "d1", "T1", "Methods", "10.1/a", None, "one", 0.9), ("q", 2, "c2", "d2", "T2", None, None, None, "two", 0.8)],
        "query_id string, rank int, chunk_id string, document_id string, title string, section_title string, doi string, pmcid string, content string, score double",
    )
    r = cx.build_context(hits).first()
    assert r.context == "Source [1]: T1 - Methods (DOI: 10.1/a)\none\n\n---\n\nSource [2]: T2\ntwo"
    assert r.confidence == pytest.approx(0.705) and cx.confidence(hits).first().confidence == pytest.approx(0.705)
    q = spark.createDataFrame([("q", "why"), ("none", "who")], "query_id string, query_text string")
    rows = {x.query_id: x for x in cx.rag_requests(q, hits).collect()}
    assert rows["none"].answer == cx.NO_HITS and rows["none"].confidence == 0 and rows["none"].citations == []
    assert rows["q"].prompt.startswith("Research paper excerpts:\nSource [1]") and "Question: why" in rows["q"].prompt


# ---- parsing -----------------------------------------------------------------------------

ARTICLE = """<?xml version="1.0"?><!DOCTYPE article PUBLIC "-//N//DTD//EN" "https://example.org/a.dtd">
<article article-type="letter"><front><journal-meta><journal-title-group><journal-title>Test Journal</journal-title>
</journal-title-group></journal-meta><article-meta><article-id pub-id-type="pmc">PMC1</article-id>
<article-id pub-id-type="doi">10.1/x</article-id><title-group><article-title>A <i>b</i> &lt; c &amp; d</article-title></title-group>
<contrib-group><contrib contrib-type="author"><name><surname>Smith</surname><given-names>J</given-names></name>
<contrib-id contrib-id-type="orcid">0000</contrib-id><xref ref-type="aff" rid="a2">2</xref></contrib></contrib-group>
<aff id="a1">One</aff><aff id="a2"><label>2</label>Two</aff>
<pub-date pub-type="epub"><month>Jan</month><year>2024</year></pub-date><pub-date pub-type="ppub"><month>3</month><year>2023</year></pub-date>
<abstract><sec><title>Aim</title><p>x</p></sec><sec><p>y</p></sec></abstract></article-meta></front>
<body><sec><title>Experimental results</title><p>p1</p><p>p2</p><sec><title>Sub</title><p>s1</p>
<sec><title>L3</title><sec><title>L4</title><p>deep</p></sec></sec></sec></sec><sec><title>Empty</title></sec></body>
<back><ref-list><ref id="r1"><mixed-citation>plain text</mixed-citation></ref></ref-list></back></article>"""


def test_article_fields(spark):
    raw = spark.createDataFrame(
        [("ok", ARTICLE.encode()), ("json", b'{"error": 1}'), ("nofront", b"<article><body><p>x</p></body></article>"),
         ("nosec", b"<article><front><article-meta></article-meta></front><body><p>just</p><p>text</p></body></article>")],
        "object_key string, content binary",
    )
    rows = {r.object_key: r for r in ar.parse_articles(raw).collect()}
    r = rows["ok"]
    assert r.reason is None and r.title == "A  b  < c & d" and r.journal == "Test Journal"
    assert (r.pmcid, r.doi, r.pmid, r.article_type) == ("PMC1", "10.1/x", None, "letter")
    assert r.publication_date == dt.date(2023, 3, 1)
    assert r.abstract == "Aim: x y"
    assert [(a.surname, a.orcid, a.affiliations) for a in r.authors] == [("Smith", "0000", ["2 Two"])]
    assert [s.full_title for s in r.sections] == [
        "Experimental results", "Experimental results > Sub", "Experimental results > Sub > L3",
        "Experimental results > Sub > L3 > L4",
    ]
    assert r.sections[0].type == "methods" and r.sections[0].content == "p1\n\np2" and r.section_count == 1
    assert r.references[0].raw == "plain text" and r.has_full_text and r.reference_count == 1
    assert rows["json"].reason == "not well-formed XML" and rows["nofront"].reason == "article has no front element"
    assert [(s.title, s.content) for s in rows["nosec"].sections] == [("Main Text", "just text")]


def test_format_routing(spark):
    df = spark.createDataFrame(
        [("a.bin", b"%PDF-1.7"), ("b.PDF", b"junk"), ("c", b"<?xml?><pmc-articleset>"), ("d", b"<html>"), ("e", b"\xff\xfe")],
        "k string, c binary",
    )
    got = [r.f for r in df.select(routing.sniff_format(F.col("c"), F.col("k")).alias("f")).collect()]
    assert got == ["pdf", "pdf", "article_xml", None, None]


# ---- embedding ---------------------------------------------------------------------------


def test_one_failing_text_does_not_spoil_its_batch(spark):
    class Lengths:
        model_id, dimensions = "len", 1

        def load(self):
            def model(texts):
                assert len(texts) <= 3
                if "bad" in texts:
                    raise RuntimeError("no")
                return [[float(len(t))] for t in texts]

            return model

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "ccc", None, "dd"])], "id int, t string").coalesce(1)
    rows = em.embed(df, "t", Lengths(), batch_size=3).collect()
    assert [r.id for r in rows] == [0, 1, 2, 3, 4]
    assert [r.embedding for r in rows] == [[1.0], None, [3.0], None, [2.0]]
    assert rows[1].embedding_error == "no"


def test_zero_vectors_have_no_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [None, 1.0]


# ---- history and traffic -----------------------------------------------------------------


def brute_bookmarks(events):
    state = {}
    for user, doc, action, ts, _ in sorted(events, key=lambda e: (e[3], e[4])):
        if action == "clear":
            state = {k: v for k, v in state.items() if k[0] != user}
            continue
        on = (user, doc) in state
        if action == "remove" or (action == "toggle" and on):
            state.pop((user, doc), None)
        elif not on:
            state[(user, doc)] = ts
    return state


@pytest.mark.parametrize("bucket", [60, 3600, 10**7])
def test_bookmarks_do_not_depend_on_the_cut(spark, bucket):
    rng = random.Random(bucket)
    start = dt.datetime(2024, 1, 1)
    events = []
    for seq in range(400):
        action = rng.choice(["add", "remove", "toggle", "toggle", "add", "clear"] if seq % 40 == 0 else ["add", "remove", "toggle"])
        user = "hot" if rng.random() < 0.6 else f"u{rng.randrange(4)}"
        doc = None if action == "clear" else f"d{rng.randrange(3)}"
        events.append((user, doc, action, start + dt.timedelta(seconds=rng.randrange(20000)), seq))
    df = spark.createDataFrame(events, "user_id string, document_id string, action string, ts timestamp_ntz, seq int")
    got = {(r.user_id, r.document_id): r.bookmarked_at for r in history.bookmarks(df, bucket).collect()}
    assert got == brute_bookmarks(events)


def test_rate_limit_hand_case(spark):
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = [("k", t0 + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 61.5])]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, request_id int")
    got = traffic.rate_limit(df, 2, 60).orderBy("request_id").collect()
    assert [r.allowed for r in got] == [True, True, False, True]
    assert got[2].remaining == 0 and got[2].reset_seconds == 58


@pytest.mark.parametrize("limit,spread", [(3, 2000), (5, 30000), (2, 400)])
def test_rate_limit_equals_one_pass_per_key(spark, limit, spread):
    rng = random.Random(limit)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", t0 + dt.timedelta(milliseconds=rng.randrange(spread * 1000)), i) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, request_id int")
    got = {r.request_id: (r.allowed, r.remaining, r.reset_seconds) for r in traffic.rate_limit(df, limit, 60).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == key)
        admitted = []
        for t, i in mine:
            live = [u for u in admitted if u > t - dt.timedelta(seconds=60)]
            if len(live) < limit:
                admitted.append(t)
                want[i] = (True, limit - len(live) - 1, 60)
            else:
                left = live[0] + dt.timedelta(seconds=60) - t
                want[i] = (False, 0, max(left // dt.timedelta(seconds=1), 1))
    assert got == want


def test_a_reused_correlation_id_is_reported_not_multiplied(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("x", t0 + dt.timedelta(seconds=i), "request_started" if i % 2 == 0 else "request_completed", "GET", "/", 200) for i in range(100)]
    df = spark.createDataFrame(rows, "correlation_id string, ts timestamp_ntz, event string, method string, path string, status_code int")
    got = traffic.pair_requests(df).collect()
    assert len(got) == 1 and got[0].outcome == "repeated" and got[0].starts == 50


# ---- small columns -----------------------------------------------------------------------


def test_allowed_paths_need_the_separator(spark):
    df = spark.createDataFrame([("/data/uploads/a",), ("/data/uploads_x/a",), ("/data/uploads/../b",)], "object_key string")
    assert [r[0] for r in rw.allowed_paths(df, ["/data/uploads"]).collect()] == ["/data/uploads/a"]


def test_display_columns(spark):
    df = spark.createDataFrame([("Use a.b and A.B", "a.b", "uSER", ["x", "y", "z"])], "t string, q string, r string, n array<string>")
    r = df.select(
        pr.highlight(F.col("t"), F.col("q")).alias("h"), capitalize(F.col("r")).alias("c"),
        pr.author_summary(F.col("n")).alias("a"), pr.snippet(F.col("t"), 8).alias("s"),
        lexemes(F.lit("The Studies of genes, buses and glass")).alias("l"),
    ).first()
    assert r.h.count("<mark") == 2 and r.c == "User" and r.a == "x, y, and z" and r.s == "Use a..."
    assert r.l == ["study", "gene", "buse", "glass"]


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.6])
def test_titles_match_alike_on_both_paths(spark, threshold):
    """Also where a share times a size is a whole number, which floating point may miss."""
    rng = random.Random(11)
    letters = "abcdefgh"
    titles = ["".join(rng.choices(letters, k=rng.randint(3, 40))) for _ in range(60)]
    # 20 trigrams each, 11 of them in common, is 11 of 29; prefixes give shares like 11 of 20.
    for n in (10, 20, 40, 99):
        word = "".join(rng.choices(letters, k=n))
        titles += [word, *(word[: k * n // 20] for k in range(9, 20))]
    frame = spark.createDataFrame([(t,) for t in titles], "title string")
    queries = spark.createDataFrame([(str(i), t) for i, t in enumerate(titles)], "query_id string, query_text string")

    def found(asked):
        out = fuzzy.title_similarity(asked, frame, threshold).collect()
        return sorted((r.query_id, r.title, round(r.similarity, 9), r.documents) for r in out)

    assert found(ask(queries)) == found(Asked(queries, None))


def test_tags_inside_cdata_and_comments_cut_nothing(spark):
    """What looks like an article's end in CDATA or a comment does not end it; a comment in CDATA is text."""
    front = "<front><article-meta><title-group><article-title>{}</article-title></title-group></article-meta></front>"
    files = [
        ("a", f"<article>{front.format('<![CDATA[A </article> of <!-- words --> & more]]>')}<body><p>x</p></body></article>"),
        ("b", f"<!-- <article> --><article><!-- </article> <![CDATA[ -->{front.format('B')}<!-- ]]> --></article>"),
        ("c", f"<set><article>{front.format('C')}</article><!-- <article></article> --><article>{front.format('D')}</article></set>"),
        ("d", "<article><front></article>"),
    ]
    raw = spark.createDataFrame([(k, x.encode()) for k, x in files], "object_key string, content binary")
    got = {(r.object_key, r.title): r.reason for r in ar.parse_articles(raw).collect()}
    assert got == {
        ("a", "A </article> of <!-- words --> & more"): None, ("b", "B"): None, ("c", "C"): None, ("c", "D"): None,
        ("d", "Untitled"): "not well-formed XML",
    }

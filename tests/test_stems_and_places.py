"""The stemmer against published examples; positions, distance rank and phrases by hand."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from scholion.functions.stemming import stems
from scholion.functions.text import STOP_WORDS
from scholion.operators import keyword, positions
from scholion.session import scratch_path

# Words and stems of the published sample vocabulary, and cases of each rule.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl
constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel
kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight
knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
running run hoping hope hopping hop ties tie cries cri gas gas gaps gap this this kiwis kiwi by by say say cry cri
agreed agre feed feed luxuriated luxuri sky sky skies sky dying die news news inning inning innings inning
proceed proceed exceeding exceed generally general communism communism generate generat rational ration
relational relat hopefulness hope vietnamization vietnam electricity electr adjustment adjust adoption adopt
yes yes youth youth enjoy enjoy boy boy sayings say controll control roll roll rate rate probate probat
cease ceas bed bed shed shed replacement replac organization organ ogi ogi apology apolog a a is is""".split()
CASES = dict(zip(SAMPLE[::2], SAMPLE[1::2], strict=True))
# Words of which the rules alone, read by hand, give another stem than a first look suggests.
CASES.update({"communism": "communism", "generate": "generat", "generally": "general"})


def test_stems_of_published_words(spark):
    frame = spark.createDataFrame([(w,) for w in CASES] + [(None,), ("",)], "term string")
    got = {r.term: r.stem for r in stems(frame).collect()}
    wrong = {w: (got[w], s) for w, s in CASES.items() if got[w] != s}
    assert not wrong
    assert got[None] is None and got[""] == ""


def chunk_rows(spark, texts):
    rows = [(f"c{k}", str(k), t) for k, t in texts.items()]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, content string")


def doc_rows(spark, texts):
    rows = [(str(k), "j", "a", "completed") for k in texts]
    frame = spark.createDataFrame(rows, "document_id string, journal string, article_type string, processing_status string")
    return frame.withColumn("publication_date", F.lit("2024-01-01").cast("date"))


def asked(spark, queries):
    return spark.createDataFrame([(f"q{k}", q) for k, q in enumerate(queries)], "query_id string, query_text string")


TEXTS = {
    1: "Running dogs run. The dog, and the runner!", 2: "the of and", 3: None, 4: "", 5: "dog run dog",
    6: "gene editing with the editing of genes", 7: "Genes are far away " + "word " * 120 + "from edits",
}


def places_by_hand(spark, text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    kept = [(i, w) for i, w in enumerate(words) if w not in STOP_WORDS]
    table = {r.term: r.stem for r in stems(spark.createDataFrame([(w,) for _, w in kept] or [("x",)], "term string")).collect()}
    return [(i, table[w]) for i, w in kept]


def test_positional_postings(spark):
    got = positions.positional_postings(chunk_rows(spark, TEXTS)).collect()
    want = {}
    for k, text in TEXTS.items():
        kept = places_by_hand(spark, text)
        for i, stem in kept:
            want.setdefault((f"c{k}", stem), (len(kept), []))[1].append(i)
    found = {}
    for r in got:
        at, out = 0, []
        for g in r.gaps:
            at += g
            out.append(at)
        assert r.tf == len(out)
        found[(r.chunk_id, r.term)] = (r.dl, out)
    assert found == want


def test_rank_by_distance_and_phrases(spark):
    queries = ["gene edit", "dogs", "the", "running dog", "editing of genes", "genes edits"]
    c, d, q = chunk_rows(spark, TEXTS), doc_rows(spark, TEXTS), asked(spark, queries)
    postings = positions.positional_postings(c)
    placed = positions.placed_matches(q, c, d, postings)
    score = {(r.query_id, r.chunk_id): r.keyword_score for r in positions.ranked_by_distance(placed).collect()}
    phrase = {(r.query_id, r.chunk_id): (r.first, r.times) for r in positions.phrases(placed).collect()}
    held = {f"c{k}": places_by_hand(spark, t) for k, t in TEXTS.items()}
    want, spoken = {}, {}
    for n, text in enumerate(queries):
        terms = places_by_hand(spark, text)
        for chunk, kept in held.items():
            at = {t: [i for i, w in kept if w == t] for _, t in terms}
            if not terms or not all(at.values()):
                continue
            if len(at) == 1:
                s = 0.1 * sum(1 / k**2 for k in range(1, len(next(iter(at.values()))) + 1)) / positions.SQUARES
            else:
                rest = 1.0
                for a in at:
                    for b in at:
                        for x in at[a]:
                            for y in at[b]:
                                if a != b and 0 < y - x <= 100:
                                    rest *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp((y - x) / 1.5 - 2)))
                s = 1 - rest
            want[(f"q{n}", chunk)] = round(s, 9)
            starts = set.intersection(*[{p - o for p in at[t]} for o, t in terms])
            if starts:
                spoken[(f"q{n}", chunk)] = (min(starts), len(starts))
    assert score.keys() == want.keys()
    assert all(abs(score[k] - want[k]) < 1e-8 for k in want)
    assert phrase == spoken
    assert ("q0", "c6") in score and score[("q0", "c6")] > score[("q0", "c7")]
    # The inner stop word keeps its room: "editing of genes" is no "editing genes".
    assert ("q4", "c6") in phrase


@pytest.mark.parametrize("stored", [False, True])
def test_running_finds_run(spark, stored, tmp_path):
    c, d = chunk_rows(spark, TEXTS), doc_rows(spark, TEXTS)
    q = asked(spark, ["runs", "runner", "dog running", "missing", ""])
    options = {"conf": "stem"}
    if stored:
        keyword.write_index(c, str(tmp_path / "index"), conf="stem")
        options |= keyword.read_index(spark, str(tmp_path / "index"))
    got = {(r.query_id, r.chunk_id) for r in keyword.keyword_matches(q, c, d, **options).collect()}
    assert got == {("q0", "c1"), ("q0", "c5"), ("q1", "c1"), ("q2", "c1"), ("q2", "c5")}


def test_empty_chunks_have_no_postings(spark):
    none = chunk_rows(spark, {1: "x"}).limit(0)
    assert positions.positional_postings(none).collect() == []
    rng = random.Random(3)
    long = {1: " ".join(rng.choice(["gene", "editing", "run"]) for _ in range(3000))}
    rows = positions.positional_postings(chunk_rows(spark, long)).collect()
    assert sum(r.tf for r in rows) == 3000


def exchanged(df):
    """The columns by which rows are dealt to tasks, exchange by exchange."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return re.findall(r"Exchange (\w+\(?[^,)]*)", df._jdf.queryExecution().explainString(mode))


@pytest.mark.parametrize("conf", ["stem", "stop"])
def test_places_are_put_together_without_shuffling_words(spark, conf):
    by = exchanged(positions.positional_postings(chunk_rows(spark, TEXTS), conf))
    assert len(by) == 1 and by[0].startswith("hashpartitioning(_part")


def test_places_of_words_not_asked_for_are_not_shuffled(spark):
    texts = {k: f"dog run w{k}" for k in range(300)}
    chunks, docs = chunk_rows(spark, texts), doc_rows(spark, texts)
    path = scratch_path(spark, "places")
    keyword.write_postings(positions.positional_postings(chunks), path)
    found = positions.placed_matches(asked(spark, ["dog running"]), chunks, docs, spark.read.parquet(path))
    assert found.count() == 300
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    read = next(k for k, line in enumerate(plan) if "gaps" in line and "Relation" in line)
    above = [line for line in plan[:read] if "Join" in line]
    assert "LeftSemi" in above[-1]


@pytest.mark.parametrize("conf", ["stem", "english"])
def test_postings_are_counted_without_shuffling_words(spark, conf):
    postings = keyword.build_postings(chunk_rows(spark, TEXTS), conf)
    by = exchanged(postings)
    assert len(by) == 1 and by[0].startswith("hashpartitioning(_part")
    counts = {(r.chunk_id, r.term): (r.tf, r.dl) for r in postings.collect()}
    assert counts["c5", "dog"] == (2, 3) and counts["c5", "run"] == (1, 3)


def test_whole_passages_are_counted_without_shuffling_words(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(keyword, "persist_shared", lambda df, label: stored.append(exchanged(df)) or df)
    found = keyword.keyword_matches(asked(spark, ["dog run", "gene"]), chunk_rows(spark, TEXTS), doc_rows(spark, TEXTS))
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == {("q0", "c1"), ("q0", "c5"), ("q1", "c6"), ("q1", "c7")}
    assert any("_part" in by for by in stored[0]) and not any("chunk_id" in by for by in stored[0])


def test_documents_listed_twice_are_refused(spark):
    chunks, docs = chunk_rows(spark, TEXTS), doc_rows(spark, [*TEXTS, 5])
    with pytest.raises(ValueError, match="more than once"):
        keyword.keyword_matches(asked(spark, ["dog run"]), chunks, docs)

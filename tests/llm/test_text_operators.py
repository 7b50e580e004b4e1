"""Tokens, packing, quality, language, licences, leaks and page texts on small tables."""

from __future__ import annotations

import random
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholion.llm import decontamination, html_text, language_id, license_scan, packing, quality, token_counts
from helpers import awkward, documents, empty, sentence

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# ---- tokens and packing ------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(BYTE_BPE)
    rows = awkward()
    got = token_counts.token_report(documents(spark, rows), BYTE_BPE).collect()
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_token_counts_of_odd_strings():
    library, count = Tokenizer.from_file(BYTE_BPE), token_counts.Counter(BYTE_BPE)
    rng = random.Random(1)
    parts = ["<|endoftext|>", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "don't", "é", "é", "漢字",
             "😀", "١٢", "²", "_", "-", "a", " the", "​", "\x00", "$$$", "　"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_token_column_replaces_a_clashing_one(spark):
    docs = documents(spark, [(1, "a b"), (2, None)]).withColumn("n_tokens", F.lit("old"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, BYTE_BPE).collect()}
    assert got == {1: 2, 2: 0}
    assert token_counts.count_tokens(empty(spark), BYTE_BPE).collect() == []


def pieces_by_hand(rows, capacity):
    library = Tokenizer.from_file(WORD_BPE)
    out = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out.append((str(i), k // capacity, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    return sorted(out)


def check_packed(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_round_trip(spark, capacity):
    rows = awkward()
    got = packing.pack_documents(documents(spark, rows), WORD_BPE, capacity).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces_by_hand(rows, capacity)
    n = check_packed(got, capacity)
    total = sum(r.length for r in got)
    assert n <= -(-total // capacity) * 1.1 + 2


def test_packing_over_many_tasks_and_rounds(spark):
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.randint(1, 60), i) for i in range(4000)]
    pieces = spark.createDataFrame(rows, packing.PIECES).repartition(8)
    got = packing.pack(pieces, capacity=100, residue=0, items_per_task=150).collect()
    assert sorted(r.doc_id for r in got) == list(range(4000))
    n = check_packed(got, 100)
    assert n <= 1.02 * sum(r[3] for r in rows) / 100 + 1
    # Items over half a sequence cannot be joined; the rounds end all the same.
    large = spark.createDataFrame([(i, 0, 0, 51, i) for i in range(500)], packing.PIECES)
    assert check_packed(packing.pack(large, capacity=100, items_per_task=50).collect(), 100) == 500
    assert packing.pack(large.limit(0), capacity=100).collect() == []


# ---- quality -----------------------------------------------------------------------------


def quality_rows(seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        text = ". ".join(sentence(rng, 12).capitalize() for _ in range(rng.randint(1, 12))) + "."
        if not good:
            text = [" ".join(w + "###" for w in text.split()), text.upper().replace(" ", "!! "), "word " * 200][i // 4 % 3]
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_learns_held_out_labels(spark):
    docs, labels = quality_rows()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = documents(spark, docs + [(900, None), (901, "")])
    model = quality.fit(frame, table.where("doc_id % 5 != 0"))
    got = {r.doc_id: r for r in quality.score(frame, model).collect()}
    held = [(got[i].predicted, q) for i, q, _ in labels if i % 5 == 0]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and {900, 901} <= set(got)
    assert got[900].score == got[901].score


def test_quality_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.standard_normal((k, quality.WIDTH)) for k in (1, 3, 2)]
    y = np.array([1, 0, 1])
    model = quality.train(bags, y, steps=3)
    x, sizes, weight = np.vstack(bags), np.array([1, 3, 2]), np.ones(3)

    def loss():
        p = quality.forward(model, x, sizes)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    score, kept = quality.forward(model, x, sizes)
    grads = quality._gradients(model, kept, score, y, weight)
    for name in model.names():
        value = getattr(model, name)
        at = tuple(0 for _ in value.shape)
        before = value[at]
        value[at] = before + 1e-5
        up = loss()
        value[at] = before - 1e-5
        down = loss()
        value[at] = before
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-5


def test_quality_without_labels(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) is None
    clash = docs.withColumn("score", F.lit("x"))
    assert {(r.score, r.predicted) for r in quality.score(clash, None).collect()} == {(0.5, 1)}
    assert quality.score(empty(spark), None).collect() == []


# ---- language ----------------------------------------------------------------------------


def test_language_of_held_out_rows(spark):
    rng = random.Random(8)
    stems = {"en": "the and ing tion wh th", "fr": "eau aux que ment é oi", "de": "sch ung keit ein ü pf"}
    rows = []
    for i in range(300):
        lang = ["en", "en", "fr", "de"][i % 4]
        parts = stems[lang].split()
        rows.append((i, " ".join("".join(rng.choices(parts, k=2)) for _ in range(rng.randint(4, 50))), lang, "s", 0))
    odd = [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "123 !!", "en", "s", 0), (903, "eau", None, "s", 0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in language_id.identify(docs, docs.where("doc_id % 3 != 1"), 60).collect()}
    held = [(got[r[0]].lang_pred, r[2]) for r in rows if r[0] % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred in stems and all(0 <= r.score <= 1 for r in got.values())


def test_language_rejects_what_it_never_saw(spark):
    rows = [(i, "the and tion ing " * 5, "en", "s", 0) for i in range(40)]
    rows += [(100 + i, "eau que ment aux " * 5, "fr", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    strange = documents(spark, [(1, "жзийклмн опрст"), (2, "the and tion")])
    got = {r.doc_id: r.lang_pred for r in language_id.identify(strange, docs, reject=True).collect()}
    assert got == {1: "und", 2: "en"}
    assert {r.lang_pred for r in language_id.identify(strange, docs.limit(0)).collect()} == {"und"}


# ---- licences ----------------------------------------------------------------------------


def test_license_scan_equals_its_definition(spark):
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (None, "MIT License. Released under the MIT License.")]
    for i in range(2, 120):
        notice = rng.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 3)):
            notice[rng.randrange(len(notice))] = rng.choice(["the", "License", "new", "4.0"])
        rows.append((i, sentence(rng, 9) + rng.choice([". ", "\n", " "]) + " ".join(notice) + "\n" + sentence(rng, 5)))

    def dice(a, b):
        return 2 * len(a & b) / (len(a) + len(b))

    want = {}
    for i, t in rows:
        for part in (t or "").replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n"):
            grams = set(license_scan.bigrams_of(license_scan.words_of(part)))
            scored = [(dice(grams, set(license_scan.bigrams_of(license_scan.words_of(n)))), -k, lic)
                      for k, (lic, n) in enumerate(license_scan.TEMPLATES) if grams]
            best = max(scored, default=(0, 0, ""))
            if best[0] * 100 >= license_scan.PERCENT - 1e-9:
                old = want.get((i, best[2]), (0, 0))
                want[i, best[2]] = (max(old[0], best[0]), old[1] + 1)
    docs = documents(spark, rows).withColumn("words", F.lit(1)).withColumn("n", F.lit(1))
    got = {(r.doc_id, r.license_id): (r.dice, r.n_sentences) for r in license_scan.scan(docs).collect()}
    assert got.keys() == want.keys() and len(want) > 40
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)
    assert license_scan.scan(empty(spark)).collect() == []


def finds_by_hand(text):
    """Every stretch of neighbouring pieces against every template, and what counts of them."""
    for end in ".!?":
        text = text.replace(f"{end} ", f"{end}\n\x01")
    cut = [(license_scan.words_of(part), part.startswith("\x01")) for part in text.split("\n")]
    parts = [w for w, _ in cut if w]
    inside = [x for w, x in cut if w]
    given = len(license_scan.TEMPLATES)
    best = {}
    for k, (lic, notice) in enumerate((*license_scan.TEMPLATES, *license_scan.NOTICES)):
        theirs = set(license_scan.bigrams_of(license_scan.words_of(notice)))
        for i in range(len(parts)):
            for j in range(i, len(parts)):
                words = [w for part in parts[i : j + 1] for w in part]
                if j > i and len(words) > 2 * len(license_scan.words_of(notice)):
                    break
                ours = set(license_scan.bigrams_of(words))
                shared, both = len(ours & theirs), len(ours) + len(theirs)
                if k < given and any(inside[i + 1 : j + 1]):
                    break
                if shared * 200 >= both * license_scan.PERCENT:
                    kind = 1 if i == j else 0 if k >= given else 2
                    find = (kind, -2 * shared / both, k, i, j, lic)
                    best[kind, i] = min(best.get((kind, i), find), find)
    taken, out = [], {}
    for _, less, _, i, j, lic in sorted(best.values()):
        if not any(a <= j and i <= b for a, b in taken):
            taken.append((i, j))
            old = out.get(lic, (0, 0))
            out[lic] = (max(old[0], -less), old[1] + 1)
    return out


def test_wrapped_and_full_notices_are_found(spark):
    rng = random.Random(12)
    rows, named = [], {}
    for i, (lic, notice) in enumerate((*license_scan.TEMPLATES, *license_scan.NOTICES)):
        for k, width in enumerate((30, 72, 100)):
            lines = textwrap.wrap(notice, width)
            mark = ["", "# ", " * "][k]
            text = "\n".join([sentence(rng, 12), "", *(mark + x for x in lines), "", sentence(rng, 12)])
            rows.append((10 * i + k, text))
            named[10 * i + k] = lic
        rows.append((10 * i + 3, sentence(rng, 8) + ".\n" + notice))
        named[10 * i + 3] = lic
    rows.append((5000, "\n".join(textwrap.wrap(license_scan.NOTICES[2][1], 72) + ["\n"] + textwrap.wrap(license_scan.NOTICES[9][1], 60))))
    rows += [(5001, None), (5002, "\n \n"), (5003, "software license conditions\n" * 400)]
    got = defaultdict(dict)
    for r in license_scan.scan(documents(spark, rows)).collect():
        got[r.doc_id][r.license_id] = (pytest.approx(r.dice, abs=1e-12), r.n_sentences)
    assert all(lic in got[i] for i, lic in named.items())
    assert {"BSD-2-Clause", "MIT"} == set(got[5000])
    assert {i: v for i, v in got.items() if v} == {i: w for i, t in rows if (w := finds_by_hand(t or ""))}


# ---- leaks -------------------------------------------------------------------------------


def test_leaks_are_found_wherever_they_stand(spark):
    rng = random.Random(6)
    items = [(k, sentence(rng, rng.randint(8, 30)).capitalize() + ". " + sentence(rng, rng.randint(3, 12)) + ".") for k in range(60)]
    rows, want = [(0, None), (1, ""), (2, "word")], set()
    for i in range(3, 120):
        text = sentence(rng, rng.randint(0, 400)).split()
        if i % 3 == 0:
            k = rng.randrange(60)
            at = rng.randint(0, len(text))
            text[at:at] = items[k][1].split()
            want.add((i, k))
        rows.append((i, " ".join(text)))
    bench = spark.createDataFrame(items + [(900, None), (901, ""), (902, "?!")], "item_id long, text string")
    docs = documents(spark, rows)
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == want
    # Several indexes find the same.
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench, items_per_index=7).collect()} == want
    assert decontamination.find_leaks(docs, bench.limit(0)).collect() == []
    assert decontamination.find_leaks(empty(spark), bench).collect() == []


def test_several_indexes_give_the_scores_of_one(spark):
    rng = random.Random(16)
    items = [(k, sentence(rng, rng.randint(6, 30)).capitalize() + ". " + sentence(rng, rng.randint(3, 12)) + ".") for k in range(60)]
    rows = []
    for i in range(150):
        words = rng.choice(items)[1].split()
        # Parts of an item, near the share that is asked for.
        part = words[: round(len(words) * rng.uniform(0.4, 0.8))]
        rows.append((i, " ".join([*sentence(rng, rng.randint(0, 90)).split(), *part, *sentence(rng, 20).split()])))
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), documents(spark, rows)
    found = [
        sorted(map(tuple, decontamination.find_leaks(docs, bench, overlap_share=0.0, items_per_index=n).collect()))
        for n in (1000, 10, 1)
    ]
    assert found[0] == found[1] == found[2] and 20 < len(found[0])
    assert sum(r[3] < 0.7 for r in found[0]) > 5


def test_block_max_wand_retrieves_all_above_the_threshold():
    rng = random.Random(9)
    items = [(k, sentence(rng, rng.randint(1, 20))) for k in range(80)]
    index = decontamination.Index(items)
    for _ in range(200):
        words = sentence(rng, rng.randint(1, 25)).split()
        if rng.random() < 0.5:
            words += rng.choice(items)[1].split()[: rng.randint(1, 10)]
        terms = sorted({index.terms[w] for w in words if w in index.terms})
        want = {}
        for t in terms:
            for item, weight in zip(index.items[t], index.weights[t], strict=True):
                want[item] = want.get(item, 0) + weight
        for threshold in (0.2, 0.5, 0.9):
            got = dict(index.retrieve(list(terms), threshold))
            assert got.keys() == {i for i, x in want.items() if x >= threshold - 1e-6}
            assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


# ---- pages -------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><a href=/>Site</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many, many, of them, all day long, really.</p></div>
<div class="wrap"><div id="content"><h1>A &amp; B</h1><p>First, a   paragraph<br>with a&nbsp;break.
<p>Second one, with <b>bold</b> and <a href=x>a link</a>, and commas, commas.<ul><li>item one<li>item two</ul>
<script>var x = "<p>no</p>";</script><!-- <p>gone</p> --><div class="ad">Buy, buy, buy</div>
<p>Third &lt;tag&gt; paragraph.</div><div class="sidebar"><p>Related, things, here</p></div></div>
<section id="comments"><p>Reader says, yes, it is, good, and more, and more, and more.</p></section>
<footer>&copy; us</footer></body></html>"""


def test_page_text(spark):
    want = "A & B\n\nFirst, a paragraph with a break.\n\nSecond one, with bold and a link, and commas, commas." \
           "\n\nitem one\n\nitem two\n\nThird <tag> paragraph."  # fmt: skip
    rows = [(1, "u", PAGE, 7), (2, None, None, 7), (3, "u", "", 7), (None, "u", PAGE, 7), (1, "u", PAGE, 7),
            (4, "u", "<div><p>open <b>bold", 7), (5, "u", "plain text < here", 7), (6, "u", "<nav>x</nav>", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows)
    texts = defaultdict(set)
    for r in got:
        texts[r.page_id].add(r.text)
        assert r.n_chars == len(r.text)
    assert texts[1] == {want} == texts[None]
    assert texts[2] == texts[3] == texts[6] == {""}
    assert texts[4] == {"open bold"} and texts[5] == {"plain text < here"}
    assert html_text.extract(pages.limit(0)).collect() == []


def test_page_with_article_keeps_all_of_it():
    body = "".join(f"<section><p>Part {k}, with text.</p></section>" for k in range(5))
    page = f"<body><div class=menu>m</div><article>{body}<p>x</p></article><aside><p>{'no, ' * 90}</p></aside></body>"
    assert html_text.main_text(page).split("\n\n") == [f"Part {k}, with text." for k in range(5)] + ["x"]
    assert html_text.main_text("<p>a" * 3000).count("a") == 3000
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"


def test_a_form_around_the_page_is_no_boilerplate():
    said = "".join(f"<p>Part {k}, with text, and some more of it.</p>" for k in range(5))
    want = [f"Part {k}, with text, and some more of it." for k in range(5)]
    controls = "<input value=x><select><option>One, of, many</select><label>Name</label><button>Go, go</button>"
    nav = "<nav><a href=a>Home</a></nav>"
    login = "<form class=login><p>Log in, please, now.</p><input></form>"
    for body in (f"<article>{said}</article>", f"<main>{said}</main>", f"<div>{said}</div>", f"<div><h1>Head</h1>{said}</div>"):
        text = html_text.main_text(f"<body><form id=aspnetForm>{nav}{controls}{body}{controls}</form></body>").split("\n\n")
        assert text == (["Head"] if "h1" in body else []) + want
        # A form beside the text is boilerplate as before.
        text = html_text.main_text(f"<body>{nav}{login}{body}<form>{controls}<p>Ask, us.</p></form></body>").split("\n\n")
        assert text == (["Head"] if "h1" in body else []) + want

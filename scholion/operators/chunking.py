"""Sections into overlapping chunks, in-row: a document never leaves its partition."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import WS, content_hash, let, stable_id, strip, word_count, words

# Default chunk size and overlap, in tokens.
MAX_TOKENS, OVERLAP_TOKENS = 512, 200

_PIECE = "struct<lo:int,n:int,split:boolean>"
_STATE = f"struct<lo:int,cur:array<int>,tok:int,pieces:array<{_PIECE}>>"
_CHUNK = "struct<section_title:string,section_type:string,content:string,token_count:int>"
_CUT = "array<array<struct<content:string,token_count:int>>>"


def check_sizes(max_tokens: int, overlap: int) -> None:
    if max_tokens < 1 or not 0 <= overlap < max_tokens:
        raise ValueError("need max_tokens >= 1 and 0 <= overlap < max_tokens")


def split_paragraphs(text: Column, sep: str = "\n\n") -> Column:
    """Trimmed, non-blank pieces between separators."""
    literal = "\\Q" + sep + "\\E"
    return F.filter(F.transform(F.split(text, literal, -1), strip), lambda p: p != "")


def window_starts(length: Column, max_tokens: int, overlap: int) -> Column:
    """Zero-based starts of the windows over that many tokens; the last one reaches the end."""
    check_sizes(max_tokens, overlap)
    last = F.greatest(F.lit(0), length - overlap - 1)
    return F.when(length > 0, F.sequence(F.lit(0), last, F.lit(max_tokens - overlap))).otherwise(
        F.array().cast("array<int>")
    )


def window_tokens(tokens: Column, max_tokens: int, overlap: int) -> Column:
    """Overlapping windows over a token array."""
    return let(
        tokens,
        lambda t: F.transform(
            window_starts(F.size(t), max_tokens, overlap),
            lambda s: F.slice(t, s + 1, F.lit(max_tokens)),
        ),
    )


def _kept(cur: Column, overlap: int) -> Column:
    """How many trailing paragraphs together stay within the overlap."""
    state = "struct<keep:int,total:int,stop:boolean>"

    def step(acc: Column, n: Column) -> Column:
        full = acc["stop"] | (acc["total"] + n > overlap)
        return F.struct(
            F.when(full, acc["keep"]).otherwise(acc["keep"] + 1).alias("keep"),
            F.when(full, acc["total"]).otherwise(acc["total"] + n).alias("total"),
            full.alias("stop"),
        ).cast(state)

    start = F.struct(F.lit(0), F.lit(0), F.lit(False)).cast(state)
    return F.aggregate(F.reverse(cur), start, step, lambda acc: acc["keep"])


def packing_plan(sizes: Column, max_tokens: int, overlap: int) -> Column:
    """Greedy packing of paragraphs given their token counts.

    Gives pieces (first paragraph, count, split?) in order. A piece marked split is one
    paragraph longer than a chunk. The fold's state holds one open chunk plus the pieces.
    """
    empty = F.array().cast("array<int>")

    def piece(lo: Column, n: Column, split: bool) -> Column:
        return F.array(
            F.struct(lo.alias("lo"), n.alias("n"), F.lit(split).alias("split")).cast(_PIECE)
        )

    def state(lo: Column, cur: Column, tok: Column, pieces: Column) -> Column:
        return F.struct(
            lo.alias("lo"), cur.alias("cur"), tok.alias("tok"), pieces.alias("pieces")
        ).cast(_STATE)

    def closed(acc: Column) -> Column:
        return F.when(
            F.size(acc["cur"]) > 0,
            F.concat(acc["pieces"], piece(acc["lo"], F.size(acc["cur"]), False)),
        ).otherwise(acc["pieces"])

    def step(acc: Column, para: Column) -> Column:
        n, at = para["n"], para["at"]
        oversize = state(at + 1, empty, F.lit(0), F.concat(closed(acc), piece(at, F.lit(1), True)))

        def carried(keep: Column) -> Column:
            tail = F.slice(acc["cur"], F.size(acc["cur"]) - keep + 1, keep)
            return state(
                at - keep,
                F.concat(tail, F.array(n)),
                F.aggregate(tail, n, lambda a, x: a + x),
                closed(acc),
            )

        opened = state(
            F.when(F.size(acc["cur"]) == 0, at).otherwise(acc["lo"]),
            F.concat(acc["cur"], F.array(n)),
            acc["tok"] + n,
            acc["pieces"],
        )
        overflow = (F.size(acc["cur"]) > 0) & (acc["tok"] + n > max_tokens)
        return (
            F.when(n > max_tokens, oversize)
            .when(overflow, let(_kept(acc["cur"], overlap), carried))
            .otherwise(opened)
        )

    start = state(F.lit(1), empty, F.lit(0), F.array().cast(f"array<{_PIECE}>"))
    paras = F.transform(sizes, lambda n, i: F.struct(n.alias("n"), (i + 1).alias("at")))
    return F.aggregate(paras, start, step, closed)


def pack_text(
    text: Column,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP_TOKENS,
    sep: str = "\n\n",
    counter: Callable[[Column], Column] = word_count,
    tokenizer: Callable[[Column], Column] = words,
) -> Column:
    """Chunk texts of one section, as an array of strings."""
    check_sizes(max_tokens, overlap)

    def contents(paras: Column) -> Column:
        plan = packing_plan(F.transform(paras, counter), max_tokens, overlap)

        def texts(p: Column) -> Column:
            whole = F.array(F.array_join(F.slice(paras, p["lo"], p["n"]), "\n\n"))
            windows = F.transform(
                window_tokens(tokenizer(F.element_at(paras, p["lo"])), max_tokens, overlap),
                lambda w: F.array_join(w, " "),
            )
            return F.when(p["split"], windows).otherwise(whole)

        return F.flatten(F.transform(plan, texts))

    def section(clean: Column) -> Column:
        return (
            F.when(clean == "", F.array().cast("array<string>"))
            .when(counter(clean) <= max_tokens, F.array(clean))
            .otherwise(let(split_paragraphs(clean, sep), contents))
        )

    return let(strip(F.coalesce(text, F.lit(""))), section)


def pack_words(text: str | None, max_tokens: int, overlap: int, sep: str) -> list[tuple[str, int]]:
    """What pack_text gives with its default counter and tokenizer, each text with its words, for one text.

    Python's white space is that of functions.text.WS.
    """
    clean = (text or "").strip()
    n = len(clean.split())
    if n <= max_tokens:
        return [(clean, n)] if clean else []
    paras = [p for x in clean.split(sep) if (p := x.strip())]
    sizes = [len(p.split()) for p in paras]
    out: list[tuple[str, int]] = []
    lo = tok = 0

    def close(end: int) -> None:
        if end > lo:
            out.append(("\n\n".join(paras[lo:end]), tok))

    for at, size in enumerate(sizes):
        if size > max_tokens:
            close(at)
            t = paras[at].split()
            for s in range(0, max(0, size - overlap - 1) + 1, max_tokens - overlap):
                out.append((" ".join(t[s : s + max_tokens]), len(t[s : s + max_tokens])))
            lo, tok = at + 1, 0
        elif tok + size > max_tokens:
            close(at)
            first, lo, tok = lo, at, 0
            while lo > first and tok + sizes[lo - 1] <= overlap:
                lo -= 1
                tok += sizes[lo]
            tok += size
        else:
            tok += size
    close(len(paras))
    return out


def _packed_sections(contents: Column, max_tokens: int, overlap: int, sep: str) -> Column:
    """The chunks of each of a document's texts, found in Arrow batches without an object for each word kept."""

    @F.arrow_udf(_CUT)
    def cut(batch: pa.Array) -> pa.Array:
        texts, done, n_cuts, n_sections = [], [], [0], [0]
        for sections in batch:
            for text in sections or ():
                found = pack_words(text.as_py(), max_tokens, overlap, sep)
                texts += [t for t, _ in found]
                done += [n for _, n in found]
                n_cuts.append(len(done))
            n_sections.append(len(n_cuts) - 1)
        rows = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(done, pa.int32())], ["content", "token_count"])
        inner = pa.ListArray.from_arrays(pa.array(n_cuts, pa.int32()), rows)
        return pa.ListArray.from_arrays(pa.array(n_sections, pa.int32()), inner)

    return cut(contents)


def section_list(abstract: Column | None, sections: Column) -> Column:
    """Abstract first, then the sections depth-first under their full titles, blanks skipped."""
    kind = "array<struct<title:string,type:string,content:string>>"
    body = F.transform(
        sections,
        lambda s: F.struct(
            s["full_title"].alias("title"), s["type"].alias("type"), s["content"].alias("content")
        ),
    ).cast(kind)
    if abstract is not None:
        head = F.array(
            F.struct(
                F.lit("Abstract").alias("title"),
                F.lit("abstract").alias("type"),
                abstract.alias("content"),
            )
        ).cast(kind)
        body = F.concat(head, F.coalesce(body, F.array().cast(kind)))
    return F.filter(body, lambda s: F.coalesce(s["content"], F.lit("")).rlike(f"[^{WS}]"))


def flatten_sections(docs: DataFrame) -> DataFrame:
    """One row per section of each parsed document."""
    abstract = F.col("abstract") if "abstract" in docs.columns else None
    return docs.select(
        "document_id",
        F.posexplode_outer(section_list(abstract, F.col("sections"))).alias("section_ord", "s"),
    ).where(F.col("section_ord").isNotNull()).select(
        "document_id",
        "section_ord",
        F.col("s.title").alias("section_title"),
        F.col("s.type").alias("section_type"),
        F.col("s.content").alias("content"),
    )


def _finish(df: DataFrame) -> DataFrame:
    """Chunk arrays -> rows with dense index, hash, stable id and neighbour ids, no shuffle."""
    # The outer form keeps Spark from adding a size test that would chunk every text twice.
    rows = (
        df.select("document_id", "cs", F.size("cs").alias("n"))
        .select("document_id", "n", F.posexplode_outer("cs").alias("chunk_index", "c"))
        .where(F.col("chunk_index").isNotNull())
    )
    here = F.col("chunk_index")
    doc = F.col("document_id")
    return rows.select(
        stable_id(doc, here).alias("chunk_id"),
        "document_id",
        "chunk_index",
        F.col("c.section_title").alias("section_title"),
        F.col("c.section_type").alias("section_type"),
        F.col("c.content").alias("content"),
        content_hash(F.col("c.content")).alias("content_hash"),
        F.col("c.token_count").alias("token_count"),
        F.when(here > 0, stable_id(doc, here - 1)).alias("previous_chunk_id"),
        F.when(here < F.col("n") - 1, stable_id(doc, here + 1)).alias("next_chunk_id"),
    )


def chunk_documents(
    docs: DataFrame,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP_TOKENS,
    sep: str = "\n\n",
    counter: Callable[[Column], Column] = word_count,
    tokenizer: Callable[[Column], Column] = words,
) -> DataFrame:
    """Section-aware chunks of parsed documents (document_id, abstract?, sections).

    With the default counter and tokenizer texts are cut in Arrow batches, otherwise by columns.
    """
    check_sizes(max_tokens, overlap)
    abstract = F.col("abstract") if "abstract" in docs.columns else None
    if counter is word_count and tokenizer is words and sep:
        listed = docs.select("document_id", section_list(abstract, F.col("sections")).alias("_s"))
        contents = F.transform("_s", lambda s: s["content"])
        cut = listed.withColumn("_cut", _packed_sections(contents, max_tokens, overlap, sep))
        titled = F.transform(
            "_s",
            lambda s, i: F.transform(
                F.get("_cut", i),
                lambda c: F.struct(
                    s["title"].alias("section_title"), s["type"].alias("section_type"),
                    c["content"].alias("content"), c["token_count"].alias("token_count"),
                ),
            ),
        )
        return _finish(cut.select("document_id", F.flatten(titled).cast(f"array<{_CHUNK}>").alias("cs")))

    def of_section(s: Column) -> Column:
        return F.transform(
            pack_text(s["content"], max_tokens, overlap, sep, counter, tokenizer),
            lambda t: F.struct(
                s["title"].alias("section_title"),
                s["type"].alias("section_type"),
                t.alias("content"),
                counter(t).alias("token_count"),
            ),
        )

    cs = F.flatten(F.transform(section_list(abstract, F.col("sections")), of_section))
    return _finish(docs.select("document_id", cs.cast(f"array<{_CHUNK}>").alias("cs")))


def fixed_size_chunks(
    docs: DataFrame,
    text_col: str = "full_text",
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP_TOKENS,
    tokenizer: Callable[[Column], Column] = words,
) -> DataFrame:
    """Windows over the whole text, structure ignored, empty ones skipped, index dense."""
    texts = F.transform(
        window_tokens(tokenizer(F.col(text_col)), max_tokens, overlap),
        lambda w: F.struct(
            F.lit(None).cast("string").alias("section_title"),
            F.lit(None).cast("string").alias("section_type"),
            F.array_join(w, " ").alias("content"),
            F.size(w).alias("token_count"),
        ),
    )
    cs = F.filter(texts, lambda c: strip(c["content"]) != "")
    return _finish(docs.select("document_id", cs.cast(f"array<{_CHUNK}>").alias("cs")))


def number_chunks(parts: DataFrame, block: int = 4096) -> DataFrame:
    """Dense chunk_index over (section_ord, part_ord) rows that were chunked separately.

    Only part counts are put in order, in blocks of consecutive sections and then block by
    block; the parts are joined by key. A document with very many parts is sorted nowhere.
    """
    counts = (
        parts.groupBy("document_id", "section_ord")
        .agg(F.count("*").alias("n"))
        .withColumn("_block", F.floor(F.col("section_ord") / block))
    )
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    in_block = before(Window.partitionBy("document_id", "_block").orderBy("section_ord"))
    by_block = before(Window.partitionBy("document_id").orderBy("_block"))
    blocks = (
        counts.groupBy("document_id", "_block")
        .agg(F.sum("n").alias("total"))
        .withColumn("_base", F.coalesce(F.sum("total").over(by_block), F.lit(0)))
        .drop("total")
    )
    bases = (
        counts.withColumn("_inner", F.coalesce(F.sum("n").over(in_block), F.lit(0)))
        .join(blocks, ["document_id", "_block"])
        .select("document_id", "section_ord", (F.col("_base") + F.col("_inner")).alias("_base"))
    )
    return (
        parts.join(bases, ["document_id", "section_ord"])
        .withColumn("chunk_index", (F.col("_base") + F.col("part_ord")).cast("int"))
        .drop("_base")
    )


def link_chunks(chunks: DataFrame) -> DataFrame:
    """Neighbour ids by joining on (document, index +- 1).

    The join key is unique, so a document holding most of the chunks spreads over all tasks.
    """
    ids = chunks.select("document_id", "chunk_index", "chunk_id")
    before = ids.select(
        "document_id",
        (F.col("chunk_index") + 1).alias("chunk_index"),
        F.col("chunk_id").alias("previous_chunk_id"),
    )
    after = ids.select(
        "document_id",
        (F.col("chunk_index") - 1).alias("chunk_index"),
        F.col("chunk_id").alias("next_chunk_id"),
    )
    key = ["document_id", "chunk_index"]
    bare = chunks.drop("previous_chunk_id", "next_chunk_id")
    return bare.join(before, key, "left").join(after, key, "left")


def duplicate_report(chunks: DataFrame) -> DataFrame:
    """Hashes held by more than one chunk. Counts are combined before the shuffle."""
    return (
        chunks.groupBy("content_hash")
        .agg(
            F.count("*").alias("copies"),
            F.min(F.struct("document_id", "chunk_index", "chunk_id")).alias("first"),
        )
        .where("copies > 1")
        .select("content_hash", "copies", F.col("first.chunk_id").alias("kept_chunk_id"))
    )


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """First chunk of each content hash; survivors are found by a pre-combined minimum.

    A hash shared by a third of all rows costs one row per map task in the shuffle; the second
    join is on the unique chunk id.
    """
    kept = chunks.groupBy("content_hash").agg(
        F.min(F.struct("document_id", "chunk_index", "chunk_id")).alias("first")
    )
    return chunks.join(kept.select(F.col("first.chunk_id").alias("chunk_id")), "chunk_id", "left_semi")

"""Structure out of page text: title, abstract, sections, authors, references, identifiers.

Each function works on the text column of one document, so nothing is shuffled; only the
assembly of pages into a document groups rows, and it does so in two bounded steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.functions.text import let, lines, nullif_empty, squeeze, strip, words
from scholion.operators.articles import FLAT_SECTION
from scholion.schemas import AUTHOR

# Section heading lines (lower case) and the type each stands for.
HEADINGS = {
    "abstract": r"^abstract\s*$",
    "introduction": r"^(introduction|background)\s*$",
    "methods": r"^(methods?|materials?\s*(and|&)\s*methods?|experimental)\s*$",
    "results": r"^(results?|findings?)\s*$",
    "discussion": r"^discussion\s*$",
    "conclusion": r"^(conclusions?|summary)\s*$",
    "references": r"^(references?|bibliography|literature\s*cited)\s*$",
    "acknowledgments": r"^(acknowledgm?ents?)\s*$",
    "supplementary": r"^(supplementary|supporting)\s*(materials?|information)?\s*$",
}
# Patterns of the text heuristics.
ABSTRACT_START = r"^abstract\s*:?\s*$"
ABSTRACT_END = r"^(introduction|background|keywords?|methods?|1\.?\s*introduction)\s*:?\s*$"
DOI = r"(?i)(?:doi[:\s]*|https?://(?:dx\.)?doi\.org/)?(10\.\d{4,}/[^\s]+)"
PMID = r"(?i)PMID[:\s]*(\d{7,8})"
PMCID = r"(?i)PMC\s*ID?[:\s]*(PMC\d+)|(?:^|\s)(PMC\d+)"
YEAR = r"\b(19|20)\d{2}\b"
REFERENCE_ENTRY = (
    r"(?s)(?:^|\n)\s*(?:\[?\d+\]?\.?|\(\d+\))\s+(.+?)"
    r"(?=\n\s*(?:\[?\d+\]?\.?|\(\d+\))\s+|\z)"
)
NAME_LINE = (
    r"^([A-Z][a-z]+(?:\s+[A-Z]\.?\s*)?[A-Z][a-z]+)(?:\s*[¹²³⁴⁵⁶⁷⁸⁹⁰*,]+)?\s*(?:,|and|&|$)"
)
NAME_MARKERS = "[¹²³⁴⁵⁶⁷⁸⁹⁰*†‡§]"
NAME_SPLIT = r"\s*[,;&]\s*|\s+and\s+"
NOT_A_NAME_LINE = r"^(abstract|introduction|keywords?|doi|http|received|accepted|published)"
INSTITUTION_WORDS = ["university", "institute", "department", "hospital"]
AUTHOR_SEPARATORS = [";", ",", " and ", "&"]

PAGES_PER_BLOCK = 512


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Page rows (document_id, page_no, text) -> one text per document, blank pages left out.

    Pages are first joined in blocks of consecutive numbers and then block by block, so no
    group holds more than a block of pages or the block texts of one document.
    """
    block = F.floor(F.col("page_no") / PAGES_PER_BLOCK)

    def joined(order: str, text: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(order, text)))
        return F.array_join(F.transform(rows, lambda r: r[text]), "\n\n")

    clean = pages.select(
        "document_id", "page_no", block.alias("block_no"), strip("text").alias("text")
    ).where(F.col("text") != "")
    blocks = clean.groupBy("document_id", "block_no").agg(
        joined("page_no", "text").alias("text"), F.count("*").alias("n")
    )
    return blocks.groupBy("document_id").agg(
        joined("block_no", "text").alias("text"), F.sum("n").alias("page_count")
    )


def empty_documents(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents none of whose pages held text, for the quarantine."""
    return (
        pages.select("document_id")
        .distinct()
        .join(texts.select("document_id"), "document_id", "left_anti")
        .withColumn("reason", F.lit("no page holds any text"))
    )


def heading_type(line: Column) -> Column:
    """Section type of a heading line (already trimmed), NULL for any other line."""
    low = F.lower(line)
    chain = F.lit(None).cast("string")
    for kind, pattern in reversed(HEADINGS.items()):
        chain = F.when(low.rlike(pattern), F.lit(kind)).otherwise(chain)
    return F.when(F.length(line) < 100, chain)


def title_from_text(text: Column, meta_title: Column | None = None) -> Column:
    def usable(line: Column) -> Column:
        return (F.length(line) > 10) & ~(
            line.startswith("http") | line.startswith("doi") | line.startswith("DOI")
        )

    found = F.get(F.filter(F.transform(lines(text), strip), usable), F.lit(0))
    fallback = F.coalesce(found, F.lit("Untitled Document"))
    if meta_title is None:
        return fallback
    return F.when(F.length(meta_title) > 0, strip(meta_title)).otherwise(fallback)


def abstract_from_text(text: Column, max_lines: int | None = None) -> Column:
    """Lines below an abstract heading up to the next heading (or to max_lines, if given)."""
    state = "struct<mode:int,taken:array<string>>"

    def step(acc: Column, line: Column) -> Column:
        low = F.lower(line)
        taken = acc["taken"]
        more = (
            F.when(line != "", F.concat(taken, F.array(line)))
            .when((F.size(taken) > 0) & (F.element_at(taken, -1) != ""), F.concat(taken, F.array(line)))
            .otherwise(taken)
        )
        full = F.lit(False) if max_lines is None else F.size(taken) > max_lines
        grown = F.struct(F.lit(1).alias("mode"), more.alias("taken")).cast(state)
        done = F.struct(F.lit(2).alias("mode"), taken.alias("taken")).cast(state)
        return (
            F.when((acc["mode"] == 2) | full, acc)
            .when(
                low.rlike(ABSTRACT_START),
                F.struct(F.lit(1).alias("mode"), taken.alias("taken")).cast(state),
            )
            .when(acc["mode"] == 0, acc)
            .when(low.rlike(ABSTRACT_END), done)
            .otherwise(grown)
        )

    start = F.struct(
        F.lit(0).alias("mode"), F.array().cast("array<string>").alias("taken")
    ).cast(state)
    taken = F.aggregate(F.transform(lines(text), strip), start, step, lambda acc: acc["taken"])
    trimmed = let(
        taken,
        lambda t: F.when(
            (F.size(t) > 0) & (F.element_at(t, -1) == ""), F.slice(t, 1, F.size(t) - 1)
        ).otherwise(t),
    )
    return let(trimmed, lambda t: F.when(F.size(t) > 0, F.array_join(t, " ")))


def sections_from_text(text: Column) -> Column:
    """Heading lines start a section; the lines below belong to it; empty sections are dropped."""

    def cut(all_lines: Column) -> Column:
        marked = F.filter(
            F.transform(
                all_lines,
                lambda x, i: F.struct(i.alias("at"), x.alias("title"), heading_type(x).alias("type")),
            ),
            lambda h: h["type"].isNotNull(),
        )

        def build(heads: Column) -> Column:
            def one(h: Column, j: Column) -> Column:
                end = F.coalesce(F.get(heads, j + 1)["at"], F.size(all_lines))
                body = F.slice(all_lines, h["at"] + 2, end - h["at"] - 1)
                return F.struct(
                    h["title"].alias("title"),
                    h["title"].alias("full_title"),
                    h["type"].alias("type"),
                    F.array_join(F.filter(body, lambda x: x != ""), "\n").alias("content"),
                    F.lit(1).alias("depth"),
                )

            return F.filter(F.transform(heads, one), lambda s: s["content"] != "")

        return let(marked, build)

    return let(F.transform(lines(text), strip), cut).cast(f"array<{FLAT_SECTION}>")


def _person(name: Column) -> Column:
    return let(
        words(name),
        lambda w: F.when(
            F.size(w) >= 2,
            _author(F.array_join(F.slice(w, 1, F.size(w) - 1), " "), F.element_at(w, -1)),
        ).otherwise(_author(F.lit(""), name)),
    )


def _author(given: Column, surname: Column) -> Column:
    return F.struct(
        given.alias("given_names"),
        surname.alias("surname"),
        F.lit(None).cast("string").alias("email"),
        F.array().cast("array<string>").alias("affiliations"),
        F.lit(None).cast("string").alias("orcid"),
    ).cast(AUTHOR)


def authors_from_metadata(text: Column) -> Column:
    """Names split at the first separator of the list that occurs; last word is the surname."""
    parts = F.array(text)
    for sep in reversed(AUTHOR_SEPARATORS):
        parts = F.when(text.contains(sep), F.split(text, sep)).otherwise(parts)
    names = F.filter(F.transform(parts, strip), lambda n: n != "")
    return F.coalesce(F.transform(names, _person), F.array().cast(f"array<{AUTHOR}>"))


def authors_from_text(text: Column, max_lines: int | None = None) -> Column:
    """Names on the first line (of the first max_lines, if given) that looks like an author line."""

    def people(line: Column) -> Column:
        names = F.transform(
            F.split(F.regexp_replace(line, NAME_MARKERS, ""), NAME_SPLIT), strip
        )

        def is_person(n: Column) -> Column:
            institution = F.lit(False)
            for word in INSTITUTION_WORDS:
                institution = institution | F.lower(n).contains(word)
            return (F.length(n) >= 3) & (F.size(words(n)) >= 2) & ~institution

        return F.transform(F.filter(names, is_person), _person)

    def usable(line: Column) -> Column:
        return (
            (F.length(line) >= 5)
            & ~F.lower(line).rlike(NOT_A_NAME_LINE)
            & line.rlike(NAME_LINE)
        )

    read = lines(text) if max_lines is None else F.slice(lines(text), 1, max_lines)
    header = F.transform(read, strip)
    found = F.filter(F.transform(F.filter(header, usable), people), lambda p: F.size(p) > 0)
    return F.coalesce(F.get(found, F.lit(0)), F.array().cast(f"array<{AUTHOR}>"))


def references_from_text(text: Column, limit: int | None = None) -> Column:
    """Numbered entries (at most limit, if given) below the references heading, with DOI and year."""

    def entries(all_lines: Column) -> Column:
        at = F.get(
            F.filter(
                F.transform(
                    all_lines,
                    lambda x, i: F.when(F.lower(strip(x)).rlike(HEADINGS["references"]), i),
                ),
                lambda i: i.isNotNull(),
            ),
            F.lit(0),
        )
        return let(
            at,
            lambda a: F.when(
                a.isNotNull(),
                F.array_join(F.slice(all_lines, a + 2, F.size(all_lines)), "\n"),
            ),
        )

    raw = F.regexp_extract_all(let(lines(text), entries), F.lit(REFERENCE_ENTRY), F.lit(1))
    raw = raw if limit is None else F.slice(raw, 1, limit)
    return F.coalesce(
        F.transform(
            F.transform(raw, squeeze),
            lambda r, i: F.struct(
                (i + 1).cast("string").alias("id"),
                r.alias("raw"),
                nullif_empty(F.regexp_extract(r, DOI, 1)).alias("doi"),
                nullif_empty(F.regexp_extract(r, YEAR, 0)).alias("year"),
            ),
        ),
        F.array().cast("array<struct<id:string,raw:string,doi:string,year:string>>"),
    )


def doi_of(text: Column) -> Column:
    found = F.regexp_extract(text, DOI, 1)
    return nullif_empty(F.regexp_replace(found, r"[.,;)]+\z", ""))


def pmcid_of(text: Column) -> Column:
    return F.coalesce(
        nullif_empty(F.regexp_extract(text, PMCID, 1)), nullif_empty(F.regexp_extract(text, PMCID, 2))
    )


def pmid_of(text: Column) -> Column:
    return nullif_empty(F.regexp_extract(text, PMID, 1))


def keywords_of(text: Column) -> Column:
    found = F.filter(F.transform(F.split(text, "[,;]"), strip), lambda k: k != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def date_from_stamp(*stamps: Column) -> Column:
    """First of the stamps (D:YYYYMMDD..., later parts optional) that is a real date."""

    def one(stamp: Column) -> Column:
        digits = F.regexp_replace(stamp, "^D:", "")
        n = F.length(digits)
        month = F.when(n >= 6, F.substring(digits, 5, 2)).otherwise(F.lit("1"))
        day = F.when(n >= 8, F.substring(digits, 7, 2)).otherwise(F.lit("1"))
        parts = [p.try_cast("int").cast("string") for p in (month, day)]
        year = F.substring(digits, 1, 4).try_cast("int").cast("string")
        return F.concat_ws("-", F.lpad(year, 4, "0"), *parts).try_cast("date")

    return F.coalesce(*[one(s) for s in stamps])


def parse_pages(pages: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Page rows (and optional per-document metadata maps) into parsed documents."""
    docs = assemble_pages(pages)
    if meta is not None:
        docs = docs.join(meta.select("document_id", "meta"), "document_id", "left")
    else:
        docs = docs.withColumn("meta", F.create_map().cast("map<string,string>"))
    text = F.col("text")

    def m(key: str) -> Column:
        return F.try_element_at("meta", F.lit(key))

    named = authors_from_metadata(m("author"))
    from scholion.operators.articles import with_indicators

    return with_indicators(
        docs.select(
            "document_id",
            title_from_text(text, m("title")).alias("title"),
            abstract_from_text(text).alias("abstract"),
            let(
                named,
                lambda a: F.when(F.size(a) > 0, a).otherwise(authors_from_text(text)),
            ).alias("authors"),
            F.lit(None).cast("string").alias("journal"),
            date_from_stamp(m("creationDate"), m("modDate")).alias("publication_date"),
            doi_of(text).alias("doi"),
            pmcid_of(text).alias("pmcid"),
            pmid_of(text).alias("pmid"),
            F.array().cast("array<string>").alias("mesh_terms"),
            keywords_of(m("keywords")).alias("keywords"),
            F.lit(None).cast("string").alias("article_type"),
            sections_from_text(text).alias("sections"),
            references_from_text(text).alias("references"),
            text.alias("full_text"),
            "page_count",
        )
    )

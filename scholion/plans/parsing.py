"""Parsing over the given tables.

Article XML is written out of the documents by Spark and parsed back; the SQL side computes
the same fields straight from the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from scholion.functions import present as pr
from scholion.functions.text import lines, strip
from scholion.operators import articles as ar
from scholion.operators import plaintext as pt
from scholion.operators import routing as rt
from scholion.plans.base import Registry, lines_sql, strip_sql, table, words_sql
from scholion.plans.search import TITLE_SQL
from scholion.sources.manifest import MANIFEST, explode_papers
from scholion.sources.raw import read_pages

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

HEADINGS = ["Background", "Materials and Methods", "Experimental results", "Discussion", "Notes"]
HEADINGS_SQL = "[" + ",".join(f"'{h}'" for h in HEADINGS) + "]"
# A section below the others, nested five levels deep; texts stand on the second and the fifth.
NESTED = ["Supplementary", "Inner results", "L3", "L4", "L5"]
NESTED_SQL = "[" + ",".join(f"'{h}'" for h in NESTED) + "]"
NESTED_TYPES_SQL = "['supplementary', 'results', NULL, NULL, NULL]"
NESTED_TEXT_SQL = "['', CAST(doc_id AS VARCHAR), '', '', CAST(doc_id AS VARCHAR)]"
TYPES_SQL = "['introduction', 'methods', 'methods', 'discussion', NULL]"


def _esc(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def _tag(name: str, *inner, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attrs}>"), *inner, F.lit(f"</{name}>"))


def article_xml(spark, sf):
    """object_key and content: first line title, second abstract, every further line a section.

    Keys ending in 7 miss their closing tag, keys ending in 8 their front matter; files of keys
    ending in 5 hold their article twice. Each article has two author groups, two abstracts, two
    reference lists, a journal title in a CDATA section and a section nested five levels deep.
    """
    d = table(spark, sf, "documents").withColumn(
        "ls", F.filter(F.transform(lines(F.col("text")), strip), lambda x: x != "")
    )
    i = F.col("doc_id")
    num = i.cast("string")
    heading = F.array(*map(F.lit, HEADINGS))
    section = lambda x, j: _tag(
        "sec", _tag("title", F.get(heading, j % 5)), _tag("p", F.lit("<italic>"), _esc(x), F.lit("</italic>"))
    )
    body = F.array_join(F.transform(F.slice("ls", 3, F.greatest(F.size("ls"), F.lit(1))), section), "")
    nested = F.lit("")
    for level in reversed(range(len(NESTED))):
        said = _tag("p", num) if level in (1, 4) else F.lit("")
        nested = _tag("sec", _tag("title", F.lit(NESTED[level])), said, nested)
    body = F.concat(body, nested)
    abstract = F.when(
        F.size("ls") > 1,
        F.concat(
            _tag("abstract", _tag("p", _esc(F.get("ls", F.lit(1))))),
            _tag("abstract", _tag("p", F.lit("Shown")), attrs=' abstract-type="graphical"'),
        ),
    ).otherwise("")
    front = _tag(
        "front",
        _tag("journal-meta", _tag("journal-title-group", _tag("journal-title", F.lit("<![CDATA["), F.col("source"), F.lit(" <J & K>]]>")))),
        _tag(
            "article-meta",
            _tag("article-id", F.lit("PMC"), num, attrs=' pub-id-type="pmcid"'),
            _tag("article-id", F.lit("10.1234/"), num, attrs=' pub-id-type="doi"'),
            _tag("title-group", _tag("article-title", _esc(F.get("ls", F.lit(0))))),
            _tag(
                "contrib-group",
                _tag(
                    "contrib",
                    _tag("name", _tag("surname", F.lit("S"), num), _tag("given-names", F.col("lang"))),
                    F.lit('<xref ref-type="aff" rid="a1">1</xref><xref ref-type="fn" rid="f1">*</xref>'),
                    _tag("email", F.lit("s"), num, F.lit("@example.org")),
                    attrs=' contrib-type="author"',
                ),
                _tag("contrib", _tag("collab", F.lit("Group")), attrs=' contrib-type="author"'),
                _tag("contrib", _tag("name", _tag("surname", F.lit("E"))), attrs=' contrib-type="editor"'),
            ),
            _tag(
                "contrib-group",
                _tag(
                    "contrib",
                    _tag("name", _tag("surname", F.lit("T"), num), _tag("given-names", F.lit("Second"))),
                    attrs=' contrib-type="author"',
                ),
            ),
            _tag("aff", _tag("label", F.lit("1")), F.lit("Dept "), F.col("source"), attrs=' id="a1"'),
            _tag("pub-date", _tag("year", F.lit("2020")), attrs=' pub-type="collection"'),
            F.when(
                i % 3 != 0,
                _tag(
                    "pub-date", _tag("day", (i % 28 + 1).cast("string")),
                    _tag("month", F.when(i % 3 == 1, (i % 12 + 1).cast("string")).otherwise("Jan")),
                    _tag("year", F.lit("2023")), attrs=' pub-type="epub"',
                ),
            ).otherwise(""),
            abstract,
            _tag("kwd-group", _tag("kwd", F.col("lang")), _tag("kwd", F.lit("k"), (i % 7).cast("string"))),
            _tag("kwd-group", _tag("kwd", F.lit("m"), (i % 5).cast("string")), attrs=' kwd-group-type="MeSH"'),
        ),
    )
    ref = _tag(
        "ref-list",
        F.lit('<ref id="r1">'),
        _tag(
            "element-citation", _tag("article-title", F.lit("Work <b>"), num, F.lit("</b> again")),
            _tag("source", F.col("source")), _tag("year", F.lit("1999")),
            _tag("pub-id", F.lit("10.1/"), num, attrs=' pub-id-type="doi"'), attrs=' publication-type="journal"',
        ),
        F.lit('</ref><ref id="r2"><mixed-citation>Plain '), num, F.lit("</mixed-citation></ref>"),
    )
    more = _tag(
        "ref-list",
        F.lit('<ref id="r3">'),
        _tag("element-citation", _tag("article-title", F.lit("Third")), _tag("year", F.lit("2001"))),
        F.lit("</ref>"),
    )
    article = F.concat(
        F.lit('<article article-type="'), F.col("lang"), F.lit('">'),
        F.when(i % 10 == 8, F.lit("")).otherwise(front),
        _tag("body", body), _tag("back", ref, more),
        F.when(i % 10 == 7, F.lit("")).otherwise("</article>"),
    )
    xml = F.concat(
        F.lit('<?xml version="1.0"?>'),
        F.when(i % 10 == 5, _tag("pmc-articleset", article, article)).otherwise(
            F.concat(
                F.lit('<!DOCTYPE article PUBLIC "-//X//DTD//EN" "https://example.org/x.dtd">'), article
            )
        ),
    )
    return d.select(num.alias("object_key"), xml.cast("binary").alias("content"))


def parsed(spark, sf):
    return ar.parse_articles(article_xml(spark, sf), "object_key")


GOOD = f"""art AS (SELECT *, CAST(doc_id AS VARCHAR) || nth AS document_id, coalesce(ls[3:], []) AS rest,
    CASE WHEN len(ls) > 1 THEN ls[2] || ' Shown' END AS abstract
  FROM (SELECT doc_id, source, lang, unnest(CASE WHEN doc_id % 10 = 5 THEN ['', '#1'] ELSE [''] END) AS nth,
      list_filter(list_transform({lines_sql('text')}, lambda x: {strip_sql('x')}), lambda x: x <> '') AS ls
    FROM documents) WHERE doc_id % 10 NOT IN (7, 8))"""


def art(select: str) -> str:
    return f"WITH {GOOD}\n{select}"


def good(spark, sf):
    return rt.split_valid(parsed(spark, sf))[0]


@R.add(
    "p1_sniff_format",
    """SELECT key, CASE WHEN contains(head, '<?xml') AND (contains(head, 'pmc-articleset') OR contains(head, '<article'))
        THEN 'article_xml' WHEN starts_with(t, '%PDF') OR ends_with(lower(key), '.pdf') THEN 'pdf' END AS format
    FROM (SELECT key, t, lower(t) AS head FROM (
      SELECT url AS key, html AS t FROM pages
      UNION ALL SELECT 'd' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.PDF' ELSE '.txt' END,
        CASE WHEN doc_id % 4 = 1 THEN '%PDF-1.7 ' WHEN doc_id % 4 = 2 THEN '<?xml version="1.0"?><ARTICLE>' ELSE '' END || text
      FROM documents))""",
)
def p1(spark, sf):
    i = F.col("doc_id")
    made = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), i.cast("string"), F.when(i % 5 == 0, ".PDF").otherwise(".txt")).alias("object_key"),
        F.concat(
            F.when(i % 4 == 1, "%PDF-1.7 ").when(i % 4 == 2, '<?xml version="1.0"?><ARTICLE>').otherwise(""), "text"
        ).cast("binary").alias("content"),
    )
    pages = read_pages(spark, f"{sf}/pages.parquet").select("object_key", "content")
    raw = pages.unionByName(made)
    return raw.select(
        F.col("object_key").alias("key"), rt.sniff_format(F.col("content"), F.col("object_key")).alias("format")
    )


@R.add(
    "p2_quarantine",
    """SELECT CAST(doc_id AS VARCHAR) AS object_key, 1 AS attempts, CASE WHEN doc_id % 10 = 7 THEN 'not well-formed XML'
      ELSE 'article has no front element' END AS reason FROM documents WHERE doc_id % 10 IN (7, 8)""",
)
def p2(spark, sf):
    return rt.split_valid(parsed(spark, sf))[1].select("object_key", "attempts", "reason")


@R.add(
    "p2_unmatched_pages",
    """SELECT url AS object_key, 'no parser takes this object' AS reason FROM pages""",
)
def p2_pages(spark, sf):
    """Web pages match no parser and are quarantined whole."""
    raw = read_pages(spark, f"{sf}/pages.parquet")
    parsers = [rt.Parser("article_xml", rt.is_article_xml, ar.parse_articles)]
    return rt.route(raw, parsers)[1].select("object_key", "reason")


@R.add(
    "p3_required_structure",
    art("SELECT document_id FROM art"),
)
def p3(spark, sf):
    return good(spark, sf).select("document_id")


@R.add(
    "p4_text_content",
    f"""SELECT doc_id, {strip_sql("replace(text, chr(10), '   ')")} AS txt FROM documents""",
)
def p4(spark, sf):
    """Every line wrapped in inline markup; the markup is one blank afterwards."""
    marked = F.concat(F.lit("<p>"), F.replace("text", F.lit("\n"), F.lit(" </b><i> ")), F.lit("</p>"))
    return table(spark, sf, "documents").select("doc_id", ar.text_content(marked).alias("txt"))


@R.add("p5_title", art("SELECT document_id, ls[1] AS title FROM art"))
def p5(spark, sf):
    return good(spark, sf).select("document_id", "title")


@R.add("p6_abstract", art("SELECT document_id, abstract FROM art"))
def p6(spark, sf):
    return good(spark, sf).select("document_id", "abstract")


@R.add(
    "p7_authors",
    art("""SELECT document_id, 2 AS n, 'T' || doc_id AS second, lang AS given_names, 'S' || doc_id AS surname, 's' || doc_id || '@example.org' AS email,
      '1 Dept ' || source AS affiliations FROM art"""),
)
def p7(spark, sf):
    a = F.col("authors")[0]
    return good(spark, sf).select(
        "document_id", F.size("authors").alias("n"), F.col("authors")[1]["surname"].alias("second"), a["given_names"].alias("given_names"), a["surname"].alias("surname"),
        a["email"].alias("email"), F.array_join(a["affiliations"], ";").alias("affiliations"),
    )


@R.add("p8_journal", art("SELECT document_id, source || ' <J & K>' AS journal FROM art"))
def p8(spark, sf):
    return good(spark, sf).select("document_id", "journal")


@R.add(
    "p9_publication_date",
    art("""SELECT document_id, CASE WHEN doc_id % 3 = 1 THEN make_date(2023, doc_id % 12 + 1, doc_id % 28 + 1)
      ELSE DATE '2020-01-01' END::VARCHAR AS day FROM art"""),
)
def p9(spark, sf):
    return good(spark, sf).select("document_id", F.col("publication_date").cast("string").alias("day"))


@R.add(
    "p10_identifiers",
    art("SELECT document_id, '10.1234/' || doc_id AS doi, 'PMC' || doc_id AS pmcid, NULL::VARCHAR AS pmid FROM art"),
)
def p10(spark, sf):
    return good(spark, sf).select("document_id", "doi", "pmcid", "pmid")


@R.add(
    "p11_terms",
    art("SELECT document_id, 'm' || doc_id % 5 AS mesh, lang || ',k' || doc_id % 7 AS keywords FROM art"),
)
def p11(spark, sf):
    return good(spark, sf).select(
        "document_id", F.array_join("mesh_terms", ",").alias("mesh"), F.array_join("keywords", ",").alias("keywords")
    )


@R.add("p12_article_type", art("SELECT document_id, lang AS article_type FROM art"))
def p12(spark, sf):
    return good(spark, sf).select("document_id", "article_type")


SECS = f"""secs AS (SELECT document_id, unnest(rest) AS content, generate_subscripts(rest, 1) - 1 AS j,
    unnest(list_transform(rest, lambda x, i: {HEADINGS_SQL}[(i - 1) % 5 + 1])) AS title,
    unnest(list_transform(rest, lambda x, i: {TYPES_SQL}[(i - 1) % 5 + 1])) AS type FROM art
  UNION ALL SELECT document_id, unnest({NESTED_TEXT_SQL}), len(rest) + generate_subscripts({NESTED_SQL}, 1) - 1,
    unnest({NESTED_SQL}), unnest({NESTED_TYPES_SQL}) FROM art)"""


@R.add(
    "p13_sections",
    f"""WITH {GOOD}, {SECS} SELECT document_id, CAST(j AS INTEGER) AS ord, title, type, content FROM secs""",
)
def p13(spark, sf):
    return (
        good(spark, sf)
        .select("document_id", F.posexplode_outer("sections").alias("ord", "s"))
        .where(F.col("ord").isNotNull())
        .select(
            "document_id", "ord", F.col("s.title").alias("title"), F.col("s.type").alias("type"),
            F.col("s.content").alias("content"),
        )
    )


@R.add(
    "p14_section_type",
    f"""WITH {GOOD}, {SECS} SELECT type, count(*) AS sections FROM secs GROUP BY 1""",
)
def p14(spark, sf):
    return (
        good(spark, sf)
        .select(F.explode_outer("sections").alias("s"))
        .where(F.col("s").isNotNull())
        .groupBy(F.col("s.type").alias("type"))
        .agg(F.count("*").alias("sections"))
    )


@R.add(
    "p15_references",
    art("""SELECT document_id, 0 AS ref_ord, 'r1' AS id, 'journal' AS type, 'Work  ' || doc_id || '  again' AS title,
      source, '1999' AS year, '10.1/' || doc_id AS doi FROM art
    UNION ALL SELECT document_id, 1, 'r2', NULL, NULL, NULL, NULL, NULL FROM art
    UNION ALL SELECT document_id, 2, 'r3', NULL, 'Third', NULL, '2001', NULL FROM art"""),
)
def p15(spark, sf):
    return ar.reference_rows(good(spark, sf)).select(
        "document_id", "ref_ord", "id", "type", "title", "source", "year", "doi"
    )


FULL_SQL = f"""array_to_string(list_concat([ls[1]], CASE WHEN abstract IS NULL THEN [] ELSE [abstract] END,
  flatten(list_transform(rest, lambda x, i: [{HEADINGS_SQL}[(i - 1) % 5 + 1], x])),
  list_filter(flatten(list_transform({NESTED_SQL}, lambda x, i: [x, {NESTED_TEXT_SQL}[i]])), lambda x: x <> '')), chr(10) || chr(10))"""


@R.add("p16_full_text", art(f"SELECT document_id, md5({FULL_SQL}) AS digest FROM art"))
def p16(spark, sf):
    return good(spark, sf).select("document_id", F.md5("full_text").alias("digest"))


@R.add(
    "p17_indicators",
    art(f"""SELECT document_id, abstract IS NOT NULL AS has_abstract, true AS has_full_text,
      CAST(len(rest) + 1 AS INTEGER) AS section_count, CAST(len({words_sql(FULL_SQL)}) AS INTEGER) AS word_count,
      3 AS reference_count FROM art"""),
)
def p17(spark, sf):
    return good(spark, sf).select(
        "document_id", "has_abstract", "has_full_text", "section_count", "word_count", "reference_count"
    )


# ---- plain text --------------------------------------------------------------------------


@R.add(
    "p18_assemble_pages",
    f"""SELECT CAST(conv_id AS VARCHAR) AS document_id, count(*) AS page_count,
      md5(string_agg(t, chr(10) || chr(10) ORDER BY turn)) AS digest
    FROM (SELECT conv_id, turn, {strip_sql('text')} AS t FROM conversations) WHERE t <> '' GROUP BY conv_id""",
)
def p18(spark, sf):
    """Each conversation as a document, each turn as a page."""
    pages = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("page_no"), "text"
    )
    return pt.assemble_pages(pages).select("document_id", "page_count", F.md5("text").alias("digest"))


@R.add("p19_title_fallback", f"SELECT doc_id, {TITLE_SQL} AS title FROM documents")
def p19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", pt.title_from_text(F.col("text")).alias("title"))


def paper_text() -> Column:
    """Text with headings put in: abstract first, then methods, results, references."""
    t = F.col("text")
    return F.concat(
        F.lit("A heading that is long enough\nJohn Q. Smith, Jane A. Doe\nDOI: 10.1038/x."), F.col("doc_id").cast("string"),
        F.lit(".\nPMID: 1234567 PMC ID: PMC"), F.col("doc_id").cast("string"), F.lit("\nAbstract\n"), F.get(lines(t), F.lit(0)),
        F.lit("\n\nMore.\nKeywords\nnone\nMethods\n"), t, F.lit("\nResults\n"), F.col("source"),
        F.lit("\nDiscussion\nReferences\n1. Doudna J, 2014. A.\n  doi:10.1126/s.1\n[2] Second work 1987\nstill second\n(3) Third"),
    )


PAPER_SQL = """('A heading that is long enough' || chr(10) || 'John Q. Smith, Jane A. Doe' || chr(10) || 'DOI: 10.1038/x.' || doc_id || '.' || chr(10)
  || 'PMID: 1234567 PMC ID: PMC' || doc_id || chr(10) || 'Abstract' || chr(10) || l1 || chr(10) || chr(10) || 'More.')"""


@R.add(
    "p20_abstract_from_text",
    f"""SELECT doc_id, md5({strip_sql('l1')} || '  More.' || repeat(' line', 60) || ' ' || doc_id || ' end') AS digest
    FROM (SELECT doc_id, {lines_sql('text')}[1] AS l1 FROM documents)""",
)
def p20(spark, sf):
    """An abstract of 64 lines, up to the heading that ends it."""
    text = F.concat(
        F.lit("Abstract\n"), F.get(lines(F.col("text")), F.lit(0)), F.lit("\n\nMore.\n"), F.repeat(F.lit("line\n"), 60),
        F.col("doc_id").cast("string"), F.lit(" end\nKeywords\nnone\nMethods\n"), F.col("text"),
    )
    return table(spark, sf, "documents").select("doc_id", F.md5(pt.abstract_from_text(text)).alias("digest"))


@R.add(
    "p21_sections_from_text",
    f"""WITH t AS (SELECT doc_id, source, list_filter(list_transform({lines_sql('text')}, lambda x: {strip_sql('x')}), lambda x: x <> '') AS ls FROM documents)
    SELECT doc_id, 0 AS ord, 'Abstract' AS title, 'abstract' AS type, md5(ls[1] || chr(10) || 'More.' || chr(10) || 'Keywords' || chr(10) || 'none') AS digest FROM t
    UNION ALL SELECT doc_id, 1, 'Methods', 'methods', md5(array_to_string(ls, chr(10))) FROM t
    UNION ALL SELECT doc_id, 2, 'Results', 'results', md5(source) FROM t
    UNION ALL SELECT doc_id, 3, 'References', 'references', md5('1. Doudna J, 2014. A.' || chr(10) || 'doi:10.1126/s.1' || chr(10) || '[2] Second work 1987'
      || chr(10) || 'still second' || chr(10) || '(3) Third') FROM t""",
)
def p21(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.posexplode_outer(pt.sections_from_text(paper_text())).alias("ord", "s")
    )
    return d.where(F.col("ord").isNotNull()).select(
        "doc_id", "ord", F.col("s.title").alias("title"), F.col("s.type").alias("type"), F.md5("s.content").alias("digest")
    )


NAMES_SQL = f"""list_filter(list_transform(CASE WHEN contains(text, ';') THEN string_split(text, ';')
  WHEN contains(text, ',') THEN string_split(text, ',') WHEN contains(text, ' and ') THEN string_split(text, ' and ')
  WHEN contains(text, '&') THEN string_split(text, '&') ELSE [text] END, lambda x: {strip_sql('x')}), lambda x: x <> '')"""


@R.add(
    "p22_authors_from_metadata",
    f"""SELECT item_id, CAST(ord - 1 AS INTEGER) AS ord,
      CASE WHEN len(w) >= 2 THEN array_to_string(list_slice(w, 1, len(w) - 1), ' ') ELSE '' END AS given_names,
      CASE WHEN len(w) >= 2 THEN w[len(w)] ELSE n END AS surname
    FROM (SELECT item_id, ord, n, {words_sql('n')} AS w FROM (SELECT item_id, unnest(ns) AS n, generate_subscripts(ns, 1) AS ord
      FROM (SELECT item_id, {NAMES_SQL} AS ns FROM benchmark)))""",
)
def p22(spark, sf):
    """Each benchmark passage read as an author string."""
    return (
        table(spark, sf, "benchmark")
        .select("item_id", F.posexplode(pt.authors_from_metadata(F.col("text"))).alias("ord", "a"))
        .select("item_id", "ord", F.col("a.given_names").alias("given_names"), F.col("a.surname").alias("surname"))
    )


@R.add(
    "p23_authors_from_text",
    "SELECT doc_id, 'Anna B. ' || upper(lang[1]) || lang[2:] || '|Jane A. Doe' AS authors FROM documents",
)
def p23(spark, sf):
    """The author line stands behind 150 other lines."""
    text = F.concat(
        F.repeat(F.lit("a line of no names at all\n"), 150), F.lit("Anna B. "), F.initcap("lang"),
        F.lit(", Jane A. Doe\nAbstract\n"), F.col("source"),
    )
    names = pr.author_names(pt.authors_from_text(text))
    return table(spark, sf, "documents").select("doc_id", F.array_join(names, "|").alias("authors"))


@R.add(
    "p24_references_from_text",
    """SELECT doc_id, CAST(k AS VARCHAR) AS id, 'Work ' || doc_id || ' of ' || k || ' ' || (1900 + k % 100) AS raw,
      NULL::VARCHAR AS doi, CAST(1900 + k % 100 AS VARCHAR) AS year FROM documents, range(1, 121) AS g(k)
    UNION ALL SELECT doc_id, '121', 'Doudna J, 2014. ' || source || ' doi:10.1126/s.' || doc_id, '10.1126/s.' || doc_id, '2014' FROM documents
    UNION ALL SELECT doc_id, '122', 'Last work 1987 still last', NULL, '1987' FROM documents""",
)
def p24(spark, sf):
    """More references than a hundred, of three ways of numbering."""
    num = F.col("doc_id").cast("string")
    entry = lambda k: F.concat(
        k.cast("string"), F.lit(". Work "), num, F.lit(" of "), k.cast("string"), F.lit(" "), (1900 + k % 100).cast("string")
    )
    text = F.concat(
        F.lit("Discussion\nReferences\n"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(120)), entry), "\n"),
        F.lit("\n[121] Doudna J, 2014. "), F.col("source"), F.lit("\n  doi:10.1126/s."), num,
        F.lit("\n(122) Last work 1987\nstill last"),
    )
    return (
        table(spark, sf, "documents")
        .select("doc_id", F.explode(pt.references_from_text(text)).alias("r"))
        .select("doc_id", "r.id", "r.raw", "r.doi", "r.year")
    )


@R.add(
    "p25_identifiers_from_text",
    "SELECT doc_id, '10.1038/' || source || '.' || doc_id AS doi, 'PMC' || doc_id AS pmcid, CAST(1000000 + doc_id AS VARCHAR) AS pmid FROM documents",
)
def p25(spark, sf):
    """The identifiers stand behind 6000 other letters."""
    num = F.col("doc_id").cast("string")
    t = F.concat(
        F.repeat(F.lit("a line of no ids\n"), 360), F.lit("DOI: 10.1038/"), F.col("source"), F.lit("."), num,
        F.lit(".\nPMID: "), (F.col("doc_id") + 1_000_000).cast("string"), F.lit(" PMC ID: PMC"), num, F.lit("\n"), F.col("text"),
    )
    return table(spark, sf, "documents").select(
        "doc_id", pt.doi_of(t).alias("doi"), pt.pmcid_of(t).alias("pmcid"), pt.pmid_of(t).alias("pmid")
    )


@R.add(
    "p26_keywords",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,;]'), lambda x: {strip_sql('x')}),
      lambda x: x <> ''), '|') AS keywords FROM documents""",
)
def p26(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(pt.keywords_of(F.col("text")), "|").alias("keywords")
    )


@R.add(
    "p27_date_from_stamp",
    """SELECT event_id, (CASE event_id % 4 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN date_trunc('month', ts)::DATE
      WHEN 2 THEN date_trunc('year', ts)::DATE ELSE CAST(ts AS DATE) END)::VARCHAR AS day FROM events""",
)
def p27(spark, sf):
    i, ts = F.col("event_id"), F.col("ts")
    first = (
        F.when(i % 4 == 0, F.date_format(ts, "'D:'yyyyMMddHHmmss"))
        .when(i % 4 == 1, F.date_format(ts, "'D:'yyyyMM"))
        .when(i % 4 == 2, F.date_format(ts, "yyyy"))
        .otherwise(F.lit("D:20241399"))
    )
    day = pt.date_from_stamp(first, F.date_format(ts, "yyyyMMdd"))
    return table(spark, sf, "events").select("event_id", day.cast("string").alias("day"))


MAN_ABS = "text"


@R.add(
    "p28_manifest_rows",
    f"""SELECT 'PMC' || doc_id || '.xml' AS filename, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS pub_date,
      {MAN_ABS} AS abstract, lang || ' S' || doc_id AS authors FROM documents""",
)
def p28(spark, sf):
    from scholion.sources.manifest import manifest_rows

    i = F.col("doc_id")
    docs = table(spark, sf, "documents").select(
        i.cast("string").alias("document_id"), F.concat(F.lit("PMC"), i.cast("string")).alias("pmcid"),
        F.lit("t").alias("title"), F.lit(None).cast("string").alias("doi"), F.col("source").alias("journal"),
        F.array(F.struct(F.col("lang").alias("given_names"), F.concat(F.lit("S"), i.cast("string")).alias("surname"))).alias("authors"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int")).alias("publication_date"),
        F.col("text").alias("abstract"),
    )
    return manifest_rows(docs).select("filename", "pub_date", "abstract", F.array_join("authors", ";").alias("authors"))


@R.add(
    "s5_manifest_scan",
    "SELECT source, 'PMC' || doc_id AS pmcid, md5(text) AS digest FROM documents",
)
def s5(spark, sf):
    """Per source one manifest object holding its papers as JSON, parsed and exploded."""
    paper = F.struct(
        F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid"), F.col("text").alias("abstract")
    )
    d = table(spark, sf, "documents")
    one = d.select(
        F.to_json(F.struct(F.lit("2024").alias("download_date"), "source", F.array(paper).alias("papers"))).alias("j")
    )
    m = one.select(F.from_json("j", MANIFEST).alias("m")).select("m.*")
    return explode_papers(m).select("source", "pmcid", F.md5("abstract").alias("digest"))


# ---- display columns ---------------------------------------------------------------------


@R.add(
    "f7_author_names",
    """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || ' ' || conv_id WHEN 1 THEN role ELSE CAST(conv_id AS VARCHAR) END AS name
    FROM conversations""",
)
def f7(spark, sf):
    t = F.col("turn") % 3
    author = F.struct(
        F.when(t != 2, F.col("role")).otherwise("").alias("given_names"),
        F.when(t != 1, F.col("conv_id").cast("string")).alias("surname"),
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", pr.author_names(F.array(author))[0].alias("name")
    )


@R.add(
    "f8_author_summary",
    """SELECT conv_id, CASE WHEN n = 1 THEN a[1] WHEN n = 2 THEN a[1] || ' and ' || a[2]
      WHEN n = 3 THEN a[1] || ', ' || a[2] || ', and ' || a[3] ELSE a[1] || ' et al.' END AS summary
    FROM (SELECT conv_id, list(role || turn ORDER BY turn) AS a, count(*) AS n FROM conversations GROUP BY conv_id)""",
)
def f8(spark, sf):
    return (
        table(spark, sf, "conversations")
        .withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
        .groupBy("conv_id")
        # The summary names three authors at most; a fourth stands for all further ones.
        .agg(F.array_sort(F.collect_list(F.when(F.col("nth") <= 4, F.struct("turn", "role")))).alias("a"))
        .select(
            "conv_id",
            pr.author_summary(F.transform("a", lambda r: F.concat(r["role"], r["turn"].cast("string")))).alias("summary"),
        )
    )


@R.add(
    "f9_snippet",
    "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substring(text, 1, 297) || '...' END AS snippet FROM documents",
)
def f9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", pr.snippet(F.col("text")).alias("snippet"))


@R.add(
    "f10_highlight",
    """SELECT doc_id, md5(regexp_replace(text, '(' || lang || '|' || upper(lang) || '|' || upper(lang[1]) || lang[2] || '|' || lang[1] || upper(lang[2]) || ')',
      '<mark>\\1</mark>', 'g')) AS digest FROM documents""",
)
def f10(spark, sf):
    """Each text with every occurrence of its language code marked."""
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(pr.highlight(F.col("text"), F.col("lang"))).alias("digest")
    )


@R.add(
    "f11_scalar_texts",
    """SELECT event_id, 'https://doi.org/10.1/' || event_id AS doi_url,
      'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || event_id || '/' AS pmc_url,
      strftime(ts, '%b %-d, %Y') AS day, format('{:,} tokens', event_id * 7) AS tokens,
      printf('%.1f', user_id * 50.0) || '%' AS percent FROM events""",
)
def f11(spark, sf):
    i = F.col("event_id")
    num = i.cast("string")
    return table(spark, sf, "events").select(
        "event_id", pr.doi_url(F.concat(F.lit("10.1/"), num)).alias("doi_url"),
        pr.pmc_url(F.concat(F.lit("PMC"), num)).alias("pmc_url"), pr.date_text(F.col("ts")).alias("day"),
        pr.token_text(i * 7).alias("tokens"), pr.percent(F.col("user_id") * 0.5).alias("percent"),
    )


@R.add(
    "f12_time_ago",
    """SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago'
      WHEN s < 604800 THEN (s // 86400) || 'd ago' ELSE strftime(ts, '%-m/%-d/%Y') END AS age
    FROM (SELECT event_id, ts, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 1000000.0) AS BIGINT) AS s FROM events)""",
)
def f12(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", pr.time_ago(F.col("ts"), now).alias("age"))


@R.add(
    "f13_split_names",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: {strip_sql('x')}), lambda x: x <> ''), '|') AS names
    FROM documents""",
)
def f13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(pr.split_names(F.col("text")), "|").alias("names"))

"""Article XML into typed columns.

Spark's XML reader does the decoding. Two readings of the same element are taken: one keeps
inner markup as text (paragraph and title text), one is structured (attributes, nesting).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.functions.text import let, nullif_empty, stable_id, strip, word_count
from scholion.schemas import AUTHOR

# Nested sections are unrolled to this depth; a deeper article goes to the quarantine, whole.
SECTION_DEPTH = 6

# Words in a section title (lower case, first hit in this order) and their type.
SECTION_TYPES = {
    "intro": "introduction",
    "introduction": "introduction",
    "background": "introduction",
    "methods": "methods",
    "materials and methods": "methods",
    "materials|methods": "methods",
    "experimental": "methods",
    "results": "results",
    "findings": "results",
    "discussion": "discussion",
    "conclusions": "conclusion",
    "conclusion": "conclusion",
    "summary": "conclusion",
    "abstract": "abstract",
    "references": "references",
    "supplementary": "supplementary",
    "acknowledgments": "acknowledgments",
    "acknowledgements": "acknowledgments",
}
# Order in which kinds of publication date are preferred; None is any kind.
DATE_PREFERENCE = ["epub", "ppub", "collection", None]

FLAT_SECTION = (
    "struct<title:string,full_title:string,type:string,content:string,depth:int>"
)
REFERENCE = (
    "struct<id:string,type:string,title:string,source:string,year:string,volume:string,"
    "fpage:string,lpage:string,doi:string,raw:string>"
)

# A literal "<" must not look like markup once entities are decoded.
_LT = "\ue000"


def _section_ddl(depth: int) -> str:
    inner = "STRING" if depth == 0 else _section_ddl(depth - 1)
    return f"STRUCT<title:STRING,p:ARRAY<STRING>,sec:ARRAY<{inner}>>"


_CITATION = (
    "ARRAY<STRUCT<`_publication-type`:STRING,`article-title`:STRING,source:STRING,year:STRING,"
    "volume:STRING,fpage:STRING,lpage:STRING,"
    "`pub-id`:ARRAY<STRUCT<`_pub-id-type`:STRING,_VALUE:STRING>>>>"
)

SHAPE_DDL = f"""`_article-type` STRING,
 front STRUCT<
  `journal-meta`:STRUCT<`journal-title`:STRING,`journal-title-group`:STRUCT<`journal-title`:STRING>>,
  `article-meta`:STRUCT<
   `article-id`:ARRAY<STRUCT<`_pub-id-type`:STRING,_VALUE:STRING>>,
   `title-group`:STRUCT<`article-title`:STRING>,
   `contrib-group`:ARRAY<STRUCT<
     contrib:ARRAY<STRUCT<`_contrib-type`:STRING,name:STRUCT<surname:STRING,`given-names`:STRING>,
       email:ARRAY<STRING>,address:ARRAY<STRUCT<email:STRING>>,
       `contrib-id`:ARRAY<STRUCT<`_contrib-id-type`:STRING,_VALUE:STRING>>,
       xref:ARRAY<STRUCT<`_ref-type`:STRING,_rid:STRING>>>>,
     aff:ARRAY<STRUCT<_id:STRING>>>>,
   aff:ARRAY<STRUCT<_id:STRING>>,
   `pub-date`:ARRAY<STRUCT<`_pub-type`:STRING,year:STRING,month:STRING,day:STRING>>,
   abstract:ARRAY<STRUCT<sec:ARRAY<STRUCT<title:STRING,p:ARRAY<STRING>>>>>,
   `kwd-group`:ARRAY<STRUCT<`_kwd-group-type`:STRING,kwd:ARRAY<STRING>>>>>,
 body STRUCT<sec:ARRAY<{_section_ddl(SECTION_DEPTH - 1)}>>,
 back STRUCT<`ref-list`:ARRAY<STRUCT<ref:ARRAY<STRUCT<_id:STRING,
   `mixed-citation`:{_CITATION},`element-citation`:{_CITATION}>>>>>,
 _broken STRING"""

TEXT_DDL = """front STRUCT<`article-meta`:STRUCT<abstract:ARRAY<STRING>,aff:ARRAY<STRING>,
   `contrib-group`:ARRAY<STRUCT<aff:ARRAY<STRING>>>>>,
 body STRING,
 back STRUCT<`ref-list`:ARRAY<STRUCT<ref:ARRAY<STRING>>>>,
 _broken STRING"""


def article_elements(xml: Column) -> Column:
    """Every article element of a file, as text, without what surrounds it."""
    return F.regexp_extract_all(xml, F.lit(r"(?s)<article(?=[\s>]).*?</article>"), F.lit(0))


def plain_cdata(xml: Column) -> Column:
    """CDATA sections as escaped text, so that none of it can be taken for markup."""

    def opened(part: Column, i: Column) -> Column:
        inner = F.substring_index(part, "]]>", 1)
        rest = F.substr(part, F.length(inner) + F.lit(4))
        escaped = F.replace(F.replace(inner, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit(_LT))
        text = F.replace(escaped, F.lit(">"), F.lit("&gt;"))
        return F.when(i == 0, part).otherwise(F.concat(text, rest))

    parts = F.transform(F.split(xml, r"<!\[CDATA\["), opened)
    return F.when(xml.contains("<![CDATA["), F.array_join(parts, "")).otherwise(xml)


def plain_markup(xml: Column) -> Column:
    """A file without comments and with CDATA as escaped text: every tag that is left is one.

    Whichever of the two opens first ends first, so a comment inside CDATA is text.
    """
    bare = F.when(
        xml.contains("<!--"), F.regexp_replace(xml, r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->", "$1")
    ).otherwise(xml)
    return let(bare, plain_cdata)


def text_content(markup: Column) -> Column:
    """All descendant text nodes joined by one blank and trimmed."""
    plain = strip(F.regexp_replace(markup, "(<[^>]+>)+", " "))
    return F.replace(plain, F.lit(_LT), F.lit("<"))


def section_type(title: Column) -> Column:
    """Type of the first listed word contained in the title, NULL if none is."""
    low = strip(F.lower(title))
    chain = F.lit(None).cast("string")
    for word, kind in reversed(SECTION_TYPES.items()):
        chain = F.when(low.contains(word), F.lit(kind)).otherwise(chain)
    return chain


def _first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def _nonblank(c: Column) -> Column:
    return F.length(strip(c)) > 0


def title_of(meta: Column) -> Column:
    return F.coalesce(text_content(meta["title-group"]["article-title"]), F.lit("Untitled"))


def abstract_of(meta: Column, meta_text: Column) -> Column:
    """Plain text, or for a structured abstract 'Heading: body' pieces joined by a blank."""

    def piece(sec: Column) -> Column:
        heading = F.coalesce(text_content(sec["title"]), F.lit(""))
        body = F.array_join(
            F.transform(F.coalesce(sec["p"], F.array().cast("array<string>")), text_content), " "
        )
        return F.when(heading != "", F.concat(heading, F.lit(": "), body)).otherwise(body)

    def one(shape: Column, markup: Column) -> Column:
        secs = shape["sec"]
        return F.when(F.size(secs) > 0, F.array_join(F.transform(secs, piece), " ")).otherwise(
            text_content(markup)
        )

    # Several abstracts (a plain and a graphical one, say) follow each other.
    found = F.zip_with(meta["abstract"], meta_text["abstract"], one)
    return let(
        F.filter(found, lambda a: a.isNotNull()),
        lambda a: F.when(F.size(a) > 0, F.array_join(a, " ")),
    )


def authors_of(meta: Column, meta_text: Column) -> Column:
    """Contributors of kind author that carry a name, affiliation ids resolved to text."""
    no_text = F.array().cast("array<string>")
    no_id = F.array().cast("array<struct<_id:string>>")
    ids = F.concat(
        F.coalesce(meta["aff"], no_id),
        F.flatten(
            F.transform(
                F.coalesce(meta["contrib-group"], F.array().cast(_group_type())),
                lambda g: F.coalesce(g["aff"], no_id),
            )
        ),
    )
    texts = F.concat(
        F.coalesce(meta_text["aff"], no_text),
        F.flatten(
            F.transform(
                F.coalesce(
                    meta_text["contrib-group"],
                    F.array().cast("array<struct<aff:array<string>>>"),
                ),
                lambda g: F.coalesce(g["aff"], no_text),
            )
        ),
    )
    affiliations = F.filter(
        F.zip_with(
            ids, texts, lambda i, t: F.struct(i["_id"].alias("id"), text_content(t).alias("txt"))
        ),
        lambda a: a["id"].isNotNull() & (a["id"] != ""),
    )

    def author(known: Column):
        def build(c: Column) -> Column:
            rids = F.transform(
                F.filter(c["xref"], lambda x: x["_ref-type"] == "aff"), lambda x: x["_rid"]
            )
            found = F.flatten(
                F.transform(
                    rids,
                    lambda r: F.slice(
                        F.transform(
                            F.filter(F.reverse(known), lambda a: a["id"] == r), lambda a: a["txt"]
                        ),
                        1,
                        1,
                    ),
                )
            )
            orcid = _first(F.filter(c["contrib-id"], lambda i: i["_contrib-id-type"] == "orcid"))
            return F.struct(
                F.coalesce(c["name"]["given-names"], F.lit("")).alias("given_names"),
                F.coalesce(c["name"]["surname"], F.lit("")).alias("surname"),
                F.coalesce(_first(c["email"]), _first(c["address"])["email"]).alias("email"),
                F.coalesce(found, no_text).alias("affiliations"),
                orcid["_VALUE"].alias("orcid"),
            )

        return build

    everyone = F.flatten(
        F.filter(
            F.transform(meta["contrib-group"], lambda g: g["contrib"]), lambda c: c.isNotNull()
        )
    )
    people = F.filter(
        everyone, lambda c: (c["_contrib-type"] == "author") & c["name"].isNotNull()
    )
    built = let(affiliations, lambda known: F.transform(people, author(known)))
    return F.coalesce(built.cast(f"array<{AUTHOR}>"), F.array().cast(f"array<{AUTHOR}>"))


def _group_type() -> str:
    return (
        "array<struct<contrib:array<struct<`_contrib-type`:string,"
        "name:struct<surname:string,`given-names`:string>,email:array<string>,"
        "address:array<struct<email:string>>,"
        "`contrib-id`:array<struct<`_contrib-id-type`:string,_VALUE:string>>,"
        "xref:array<struct<`_ref-type`:string,_rid:string>>>>,aff:array<struct<_id:string>>>>"
    )


def journal_of(front: Column) -> Column:
    journal = front["journal-meta"]
    return text_content(
        F.coalesce(journal["journal-title-group"]["journal-title"], journal["journal-title"])
    )


def _whole_date(d: Column) -> Column:
    year = F.trim(d["year"]).try_cast("int")
    part = lambda c: F.trim(F.coalesce(c, F.lit("1"))).try_cast("int").cast("string")
    text = F.when(
        year > 0,
        F.concat(
            F.lpad(year.cast("string"), 4, "0"), F.lit("-"), part(d["month"]), F.lit("-"),
            part(d["day"]),
        ),
    )
    return text.try_cast("date")


def publication_date_of(meta: Column) -> Column:
    dates = meta["pub-date"]

    def of_kind(kind: str | None) -> Column:
        return dates if kind is None else F.filter(dates, lambda d: d["_pub-type"] == kind)

    tries = [_first(of_kind(kind)) for kind in DATE_PREFERENCE]
    return F.coalesce(*[_whole_date(d) for d in tries])


def identifier_of(meta: Column, kind: str) -> Column:
    return _first(F.filter(meta["article-id"], lambda i: i["_pub-id-type"] == kind))["_VALUE"]


def terms_of(meta: Column, mesh: bool) -> Column:
    """Terms of the MeSH groups, or of all other keyword groups; empty terms dropped."""

    def wanted(g: Column) -> Column:
        is_mesh = F.coalesce(g["_kwd-group-type"], F.lit("")) == "MeSH"
        return is_mesh if mesh else ~is_mesh

    none = F.array().cast("array<string>")
    found = F.flatten(
        F.transform(
            F.filter(meta["kwd-group"], wanted),
            lambda g: F.transform(F.coalesce(g["kwd"], none), text_content),
        )
    )
    return F.coalesce(F.filter(found, lambda t: t != ""), none)


def _flat_sections(secs: Column, level: int, parent: Column | None) -> Column:
    """Depth-first list of the sections that hold text themselves or below them."""
    empty = F.array().cast(f"array<{FLAT_SECTION}>")

    def one(sec: Column) -> Column:
        title = F.coalesce(text_content(sec["title"]), F.lit("Untitled Section"))
        full = title if parent is None else F.concat(parent, F.lit(" > "), title)
        paragraphs = F.coalesce(sec["p"], F.array().cast("array<string>"))
        if level + 1 == SECTION_DEPTH:
            below = lambda _: empty
        else:
            below = lambda f: _flat_sections(sec["sec"], level + 1, f)
        content = F.array_join(F.filter(F.transform(paragraphs, text_content), _nonblank), "\n\n")

        def assemble(head: Column) -> Column:
            entry = F.struct(
                head["title"].alias("title"),
                head["full"].alias("full_title"),
                section_type(head["title"]).alias("type"),
                head["content"].alias("content"),
                F.lit(level + 1).alias("depth"),
            )
            return let(
                below(head["full"]),
                lambda inner: F.when(
                    ~_nonblank(head["content"]) & (F.size(inner) == 0), empty
                ).otherwise(F.concat(F.array(entry).cast(f"array<{FLAT_SECTION}>"), inner)),
            )

        return let(
            F.struct(title.alias("title"), full.alias("full"), content.alias("content")), assemble
        )

    return F.coalesce(F.flatten(F.transform(secs, one)), empty)


def sections_of(body: Column, body_text: Column) -> Column:
    """The section list; a body without sections is one section of its whole text."""
    whole = F.array(
        F.struct(
            F.lit("Main Text").alias("title"),
            F.lit("Main Text").alias("full_title"),
            F.lit("body").alias("type"),
            text_content(body_text).alias("content"),
            F.lit(1).alias("depth"),
        )
    ).cast(f"array<{FLAT_SECTION}>")
    return let(
        _flat_sections(body["sec"], 0, None),
        lambda s: F.when(F.size(s) > 0, s)
        .when(_nonblank(text_content(body_text)), whole)
        .otherwise(F.array().cast(f"array<{FLAT_SECTION}>")),
    )


def references_of(back: Column, back_text: Column) -> Column:
    """One entry per ref; a citation without child elements still gives its text."""

    def build(ref: Column, markup: Column) -> Column:
        cit = F.coalesce(_first(ref["mixed-citation"]), _first(ref["element-citation"]))
        doi = _first(F.filter(cit["pub-id"], lambda i: i["_pub-id-type"] == "doi"))
        return F.struct(
            ref["_id"].alias("id"),
            cit["_publication-type"].alias("type"),
            text_content(cit["article-title"]).alias("title"),
            text_content(cit["source"]).alias("source"),
            cit["year"].alias("year"),
            cit["volume"].alias("volume"),
            cit["fpage"].alias("fpage"),
            cit["lpage"].alias("lpage"),
            doi["_VALUE"].alias("doi"),
            text_content(markup).alias("raw"),
        )

    def listed(part: Column) -> Column:
        lists = F.transform(part["ref-list"], lambda r: r["ref"])
        return F.flatten(F.filter(lists, lambda r: r.isNotNull()))

    refs = F.zip_with(listed(back), listed(back_text), build)
    return F.coalesce(
        refs.cast(f"array<{REFERENCE}>"), F.array().cast(f"array<{REFERENCE}>")
    )


def full_text_of(title: Column, abstract: Column, sections: Column) -> Column:
    """Title, abstract, then each section title and content depth-first, blank lines between."""
    body = F.flatten(
        F.transform(sections, lambda s: F.array(nullif_empty(s["title"]), nullif_empty(s["content"])))
    )
    parts = F.concat(F.array(title, nullif_empty(abstract)), body)
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")


def with_indicators(df: DataFrame) -> DataFrame:
    """has_abstract, has_full_text, top-level section_count, word_count, reference_count."""
    top = F.size(F.filter("sections", lambda s: s["depth"] == 1))
    return df.withColumns(
        {
            "has_abstract": F.coalesce(F.col("abstract") != "", F.lit(False)),
            "has_full_text": top > 0,
            "section_count": top,
            "word_count": word_count("full_text"),
            "reference_count": F.size("references"),
        }
    )


def _too_deep(body: Column) -> Column:
    """True if some section lies below the last level that is read."""

    def below(secs: Column, level: int) -> Column:
        if level == SECTION_DEPTH:
            return F.size(secs) > 0
        return F.exists(secs, lambda s: below(s["sec"], level + 1))

    return F.coalesce(below(body["sec"], 0), F.lit(False))


def parse_articles(raw: DataFrame, id_column: str | None = None) -> DataFrame:
    """Rows (object_key, content) -> one parsed row per article, reason set where it was rejected.

    A file's second and later articles get ids of their own, from the file's key and "#1", "#2", ...
    The whole parse is one projection: no shuffle, the file's row stays in its partition.
    """
    xml = F.make_valid_utf8(F.col("content").cast("string"))
    elements = let(
        plain_markup(xml),
        lambda x: let(
            article_elements(x), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(x))
        ),
    )
    guarded = F.regexp_replace("_element", "(?i)&lt;|&#0*60;|&#x0*3c;", _LT)
    options = {
        "rowTag": "article",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_broken",
    }
    name = F.col(id_column or "object_key").cast("string")
    numbered = F.when(F.col("_n") > 0, F.concat(name, F.lit("#"), F.col("_n"))).otherwise(name)
    key = numbered if id_column else stable_id(numbered)
    carried = [c for c in raw.columns if c != "content"]
    names = [*carried, *(["document_id"] if "document_id" not in carried else []), "preview"]
    both = F.struct(
        F.from_xml("_x", SHAPE_DDL, options).alias("shape"),
        F.from_xml("_x", TEXT_DDL, options).alias("text"),
    )
    # Reading through a one-row generator keeps later filters from decoding the text again.
    read = (
        raw.select(
            *carried, F.substring(xml, 1, 200).alias("preview"),
            F.posexplode(elements).alias("_n", "_element"),
        )
        .select(
            *[c for c in carried if c != "document_id"], "preview",
            key.alias("document_id"), guarded.alias("_x"),
        )
        .select(*names, F.explode_outer(F.array(both)).alias("_p"))
        .select(*names, "_p.shape", "_p.text")
    )
    front = F.col("shape.front")
    meta = F.col("shape.front")["article-meta"]
    meta_text = F.col("text.front")["article-meta"]
    reason = (
        F.when(
            F.col("shape._broken").isNotNull() | F.col("shape").isNull(), F.lit("not well-formed XML")
        )
        .when(front.isNull(), F.lit("article has no front element"))
        .when(meta.isNull(), F.lit("front has no article-meta element"))
        .when(
            _too_deep(F.col("shape.body")),
            F.lit(f"Sections are nested more than {SECTION_DEPTH} levels deep"),
        )
    )
    fields = read.select(
        *names,
        reason.alias("reason"),
        title_of(meta).alias("title"),
        abstract_of(meta, meta_text).alias("abstract"),
        authors_of(meta, meta_text).alias("authors"),
        journal_of(front).alias("journal"),
        publication_date_of(meta).alias("publication_date"),
        identifier_of(meta, "doi").alias("doi"),
        F.coalesce(identifier_of(meta, "pmcid"), identifier_of(meta, "pmc")).alias("pmcid"),
        identifier_of(meta, "pmid").alias("pmid"),
        terms_of(meta, mesh=True).alias("mesh_terms"),
        terms_of(meta, mesh=False).alias("keywords"),
        F.col("shape._article-type").alias("article_type"),
        sections_of(F.col("shape.body"), F.col("text.body")).alias("sections"),
        references_of(F.col("shape.back"), F.col("text.back")).alias("references"),
    )
    return with_indicators(
        fields.withColumn(
            "full_text", full_text_of(F.col("title"), F.col("abstract"), F.col("sections"))
        )
    )


def reference_rows(parsed: DataFrame) -> DataFrame:
    """One row per reference of each document."""
    return parsed.select(
        "document_id", F.posexplode_outer("references").alias("ref_ord", "r")
    ).where(F.col("ref_ord").isNotNull()).select("document_id", "ref_ord", "r.*")

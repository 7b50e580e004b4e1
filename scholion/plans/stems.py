"""Stems, positional postings, rank by distance and phrases over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.functions import stemming as st
from scholion.functions.text import kept_tokens
from scholion.operators import keyword, positions
from scholion.operators.vocabulary import stem_table
from scholion.plans.base import (
    CHUNKS,
    DOCS,
    FILTER_SQL,
    REQUESTS,
    STOP_SQL,
    TYPE_FILTER_SQL,
    WHOLE_REQUESTS,
    Registry,
    chunk_texts,
    documents,
    lexemes_sql,
    requests,
    rounded,
    table,
    whole_requests,
    with_sql,
)
from scholion.session import scratch_path

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

# ---- the stemmer as SQL over a table of rules ------------------------------------------------


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _rules_sql() -> str:
    rows = []
    for step, rules in ((2, st.DERIVED), (3, st.RELATED), (4, st.PLAIN)):
        for r in rules:
            rows.append(f"({step}, '{r.suffix}', '{r.ending}', '{r.region}', '{r.before or '$'}')")
    return f"rules(step, suffix, ending, region, before) AS (VALUES {', '.join(rows)})"


def _rule_step_sql(step: int) -> str:
    """The rule of a step with the longest suffix that the word ends with."""
    return f"""w{step} AS MATERIALIZED (
  SELECT term, own, r1, r2, CASE WHEN rule IS NOT NULL AND regexp_matches(left(w, length(w) - length(rule.suffix)), rule.before)
      AND length(w) - length(rule.suffix) >= CASE rule.region WHEN 'r1' THEN r1 ELSE r2 END
    THEN left(w, length(w) - length(rule.suffix)) || rule.ending ELSE w END AS w
  FROM w{step - 1} LEFT JOIN (
    SELECT term, arg_max(r, length(r.suffix)) AS rule FROM w{step - 1} JOIN rules r ON r.step = {step} AND ends_with(w, r.suffix)
    GROUP BY term) USING (term))"""


def stems_sql(words: str) -> str:
    """CTEs up to stems(term, stem) of the distinct terms of a CTE."""
    v, c = "[aeiouy]", "[^aeiouy]"
    group = f"^{c}*{v}+{c}"
    short = f"({c}{v}[^aeiouywxY]|^{v}{c})$"
    listed = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in st.IRREGULAR.items())
    begins = "|".join(st.BEGINNINGS)
    return f"""{_rules_sql()},
marked AS (
  SELECT DISTINCT term, regexp_replace(term, '(^|{v})y', '\\1Y', 'g') AS w,
    CASE WHEN length(term) <= 2 OR term IN {_list(st.UNCHANGED)} THEN term ELSE CASE term {listed} END END AS own
  FROM {words} WHERE term IS NOT NULL),
firsts AS (
  SELECT *, CASE WHEN regexp_matches(w, '^({begins})') THEN length(regexp_extract(w, '^({begins})'))
    WHEN regexp_matches(w, '{group}') THEN length(regexp_extract(w, '{group}')) ELSE length(w) END AS r1 FROM marked),
seconds AS (
  SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{group}')
    THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{group}')) ELSE length(w) END AS r2 FROM firsts),
plurals AS (
  SELECT * REPLACE (CASE WHEN ends_with(w, 'sses') THEN left(w, -2)
    WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN left(w, CASE WHEN length(w) > 4 THEN -2 ELSE -1 END)
    WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w
    WHEN regexp_matches(w, '{v}.+s$') THEN left(w, -1) ELSE w END AS w) FROM seconds),
held AS (SELECT * REPLACE (coalesce(own, CASE WHEN w IN {_list(st.UNCHANGED_AFTER_PLURAL)} THEN w END) AS own) FROM plurals),
ends AS (
  SELECT *, CASE WHEN regexp_matches(w, 'eed(ly)?$') THEN 'keep' WHEN regexp_matches(w, '(ed|ing)(ly)?$') THEN 'drop' END AS kind,
    regexp_replace(w, '(eed|ed|ing)(ly)?$', '') AS rest FROM held),
parts AS (
  SELECT *, CASE WHEN kind = 'keep' THEN CASE WHEN length(rest) >= r1 THEN rest || 'ee' ELSE w END
    WHEN kind = 'drop' AND regexp_matches(rest, '{v}') THEN
      CASE WHEN regexp_matches(rest, '(at|bl|iz)$') THEN rest || 'e'
        WHEN regexp_matches(rest, '{st.DOUBLE_END}') THEN left(rest, -1)
        WHEN length(rest) <= r1 AND regexp_matches(rest, '{short}') THEN rest || 'e' ELSE rest END
    ELSE w END AS v FROM ends),
w1 AS (SELECT term, own, r1, r2, regexp_replace(v, '(.{c})[yY]$', '\\1i') AS w FROM parts),
{_rule_step_sql(2)},
{_rule_step_sql(3)},
{_rule_step_sql(4)},
last AS (
  SELECT term, own, CASE WHEN ends_with(w, 'e') AND (length(w) > r2 OR length(w) > r1 AND NOT regexp_matches(left(w, -1), '{short}'))
      OR ends_with(w, 'll') AND length(w) > r2 THEN left(w, -1) ELSE w END AS w FROM w4),
stems AS MATERIALIZED (SELECT term, coalesce(own, replace(w, 'Y', 'y')) AS stem FROM last)"""


WORDS = f"words AS (SELECT unnest({lexemes_sql('text', 'stop')}) AS term FROM documents)"


@R.add("q4_stems", with_sql(WORDS, stems_sql("words"), select="SELECT term, stem FROM stems"))
def q4_stems(spark, sf):
    """Every distinct word of the documents and its stem."""
    words = table(spark, sf, "documents").select(F.explode(kept_tokens("text", "stem")).alias("term"))
    return stem_table(words).select("term", "stem")


# ---- positional postings ---------------------------------------------------------------------


def placed_sql(name: str, rows: str, text: str, key: str) -> str:
    """CTE name(key, pos, term): kept words with their places among all words."""
    return f"""{name} AS MATERIALIZED (
  SELECT {key}, pos, t AS term FROM (
    SELECT {key}, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS pos
    FROM (SELECT {key}, {lexemes_sql(text, 'simple')} AS l FROM {rows}))
  WHERE NOT list_contains({STOP_SQL}, t))"""


PLACED = placed_sql("placed", "chunks", "content", "chunk_id, document_id")
PLACES = """places AS MATERIALIZED (
  SELECT chunk_id, document_id, stem AS term, pos FROM placed JOIN stems USING (term))"""


@R.add(
    "q5_positional_postings",
    with_sql(
        CHUNKS, PLACED, stems_sql("placed"), PLACES,
        select="""SELECT p.term, p.chunk_id, p.document_id, count(*) AS tf, any_value(d.dl) AS dl,
  list(pos - before ORDER BY pos) AS gaps
FROM (SELECT *, coalesce(lag(pos) OVER (PARTITION BY chunk_id, term ORDER BY pos), 0) AS before FROM places) p
  JOIN (SELECT chunk_id, count(*) AS dl FROM places GROUP BY chunk_id) d USING (chunk_id)
GROUP BY p.term, p.chunk_id, p.document_id""",
    ),
)
def q5_positional(spark, sf):
    return positions.positional_postings(chunk_texts(spark, sf))


# ---- search on stems -------------------------------------------------------------------------


def stemmed_requests_sql(whole: bool) -> tuple[str, ...]:
    asked = (REQUESTS.replace("requests AS", "two_words AS", 1), WHOLE_REQUESTS) if whole else (REQUESTS,)
    both = """vocabulary AS (SELECT term FROM placed UNION SELECT term FROM asked)"""
    wanted = "wanted AS MATERIALIZED (SELECT DISTINCT query_id, pos, stem AS term FROM asked JOIN stems USING (term))"
    return (
        DOCS, CHUNKS, *asked, PLACED, placed_sql("asked", "requests", "query_text", "query_id"), both,
        stems_sql("vocabulary"), PLACES, wanted,
    )


#: Visible chunks that hold all stems of a query and pass its filters.
HOLDING = f"""holding AS MATERIALIZED (
  SELECT t.query_id, p.chunk_id, p.document_id
  FROM (SELECT DISTINCT query_id, term FROM wanted) t JOIN (SELECT DISTINCT chunk_id, document_id, term FROM places) p USING (term)
    JOIN docs d USING (document_id) JOIN requests q USING (query_id)
  WHERE d.processing_status = 'completed' AND {FILTER_SQL} AND {TYPE_FILTER_SQL}
  GROUP BY t.query_id, p.chunk_id, p.document_id
  HAVING count(*) = (SELECT count(DISTINCT term) FROM wanted x WHERE x.query_id = t.query_id))"""

STEM_BM25 = """visible AS (SELECT c.chunk_id, coalesce(n, 0) AS dl FROM chunks c JOIN docs d USING (document_id)
  LEFT JOIN (SELECT chunk_id, count(*) AS n FROM places GROUP BY chunk_id) USING (chunk_id) WHERE d.processing_status = 'completed'),
stats AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM visible),
tf AS (SELECT chunk_id, term, dl, count(*) AS tf FROM places JOIN visible USING (chunk_id) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, chunk_id) AS keyword_rank FROM (
  SELECT h.query_id, h.chunk_id, h.document_id, round(sum(ln(1 + (s.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
    * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 9) AS keyword_score
  FROM holding h JOIN (SELECT DISTINCT query_id, term FROM wanted) USING (query_id) JOIN tf USING (chunk_id, term)
    JOIN df USING (term) CROSS JOIN stats s GROUP BY h.query_id, h.chunk_id, h.document_id))"""


@R.add(
    "q7_stemmed_rank",
    with_sql(
        *stemmed_requests_sql(False), HOLDING, STEM_BM25,
        select="""SELECT query_id, chunk_id, CAST(keyword_rank AS INTEGER) AS keyword_rank, round(keyword_score, 6) AS keyword_score
FROM kw WHERE keyword_rank <= 100""",
    ),
)
def q7_stemmed(spark, sf):
    """Keyword rank on stems, straight from the texts."""
    m = keyword.keyword_matches(requests(spark, sf), chunk_texts(spark, sf), documents(spark, sf), conf="stem")
    return keyword.keyword_topk(m, 100).select("query_id", "chunk_id", "keyword_rank", rounded("keyword_score"))


@R.add(
    "q8_stemmed_index",
    with_sql(
        *stemmed_requests_sql(False), HOLDING, STEM_BM25,
        select="""SELECT v.query_id, CAST(v.keyword_rank - q.off AS INTEGER) AS rank, v.chunk_id, v.document_id,
  round(v.keyword_score, 6) AS score
FROM kw v JOIN requests q USING (query_id) WHERE v.keyword_rank > q.off AND v.keyword_rank <= q.off + q.k""",
    ),
)
def q8_stemmed(spark, sf):
    """A page of hits on stems over a stored index; the search itself reads no text."""
    c, path = chunk_texts(spark, sf), scratch_path(spark, "index")
    keyword.write_index(c, path, conf="stem")
    hits = keyword.keyword_search(
        requests(spark, sf), c, documents(spark, sf), conf="stem", **keyword.read_index(spark, path)
    )
    return hits.select("query_id", "rank", "chunk_id", "document_id", rounded("score"))


def _placed(spark, sf, asking):
    """The chunks that hold a request's stems, by postings that were stored together with the chunks' lengths."""
    path, chunks = scratch_path(spark, "places"), chunk_texts(spark, sf)
    keyword.write_postings(positions.positional_postings(chunks, marked=True), path)
    postings = spark.read.parquet(path)
    lengths = positions.chunk_lengths(postings, chunks, marked=True)
    return positions.placed_matches(asking(spark, sf), chunks, documents(spark, sf), postings, lengths=lengths)


@R.add(
    "q7_distance_rank",
    with_sql(
        *stemmed_requests_sql(False), HOLDING,
        """spots AS (SELECT h.query_id, h.chunk_id, h.document_id, term, pos
  FROM holding h JOIN (SELECT DISTINCT query_id, term FROM wanted) USING (query_id) JOIN places USING (chunk_id, term)),
terms AS (SELECT query_id, count(DISTINCT term) AS n FROM wanted GROUP BY query_id),
pairs AS (SELECT a.query_id, a.chunk_id, sum(ln(1 - 0.1::DOUBLE * sqrt(1 / (1.005::DOUBLE
    + 0.05::DOUBLE * exp((b.pos - a.pos) / 1.5::DOUBLE - 2))))) AS s
  FROM spots a JOIN spots b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND a.term <> b.term
    AND b.pos > a.pos AND b.pos <= a.pos + 100 GROUP BY a.query_id, a.chunk_id),
alone AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (k * k)) AS s FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS k FROM spots) GROUP BY query_id, chunk_id),
scored AS (SELECT h.query_id, h.chunk_id, round(CASE WHEN t.n > 1 THEN 1 - exp(coalesce(p.s, 0)) ELSE 0.1::DOUBLE * a.s / 1.64493406685::DOUBLE END, 9) AS score
  FROM holding h JOIN terms t USING (query_id) LEFT JOIN pairs p USING (query_id, chunk_id) JOIN alone a USING (query_id, chunk_id))""",
        select="""SELECT query_id, chunk_id, CAST(k AS INTEGER) AS keyword_rank, round(score, 6) AS keyword_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM scored) WHERE k <= 100""",
    ),
)
def q7_distance(spark, sf):
    """Chunks ranked by how near a request's stems stand to each other."""
    top = keyword.keyword_topk(positions.ranked_by_distance(_placed(spark, sf, requests)), 100)
    return top.select("query_id", "chunk_id", "keyword_rank", rounded("keyword_score"))


@R.add(
    "q7_phrases_whole_passages",
    with_sql(
        *stemmed_requests_sql(True), HOLDING,
        select="""SELECT query_id, chunk_id, min(start) AS first, count(*) AS times FROM (
  SELECT h.query_id, h.chunk_id, p.pos - w.pos AS start FROM holding h JOIN wanted w USING (query_id)
    JOIN places p ON p.chunk_id = h.chunk_id AND p.term = w.term
  GROUP BY h.query_id, h.chunk_id, start
  HAVING count(*) = (SELECT count(*) FROM wanted x WHERE x.query_id = h.query_id)) GROUP BY query_id, chunk_id""",
    ),
)
def q7_phrases(spark, sf):
    """Documents in which a whole benchmark passage stands as a phrase, and where."""
    return positions.phrases(_placed(spark, sf, whole_requests)).select("query_id", "chunk_id", "first", "times")

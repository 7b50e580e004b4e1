"""DuckDB's SQL for the queries of the deduplication operators."""

from __future__ import annotations

#: From links(u, v), both ways: the smallest id that each linked id reaches.
COMPONENTS = """reach(id, other) AS (
    SELECT u, v FROM links UNION SELECT reach.id, links.v FROM reach JOIN links ON links.u = reach.other),
  comps AS (SELECT id, least(id, min(other)) AS component_id FROM reach GROUP BY id)"""


def near_duplicates(width: int = 3, percent: int = 85) -> str:
    last = f"list_slice(w, i, i + {width - 1})"
    return f"""WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string({last}, ' '))) END AS s
    FROM words),
  sizes AS (SELECT doc_id, len(s) AS n FROM sets),
  members AS (SELECT doc_id, unnest(s) AS x FROM sets),
  common AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM members a JOIN members b
    ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (
    SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
    WHERE 100 * c >= {percent} * (a.n + b.n - c)),
  {COMPONENTS}
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id,
  coalesce(component_id, doc_id) = doc_id AS kept
FROM sizes LEFT JOIN comps ON comps.id = doc_id"""


def repeated_spans(length: int = 50) -> str:
    return f"""WITH raw AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
  stretches AS (
    SELECT doc_id, i AS pos, substr(h, 2 * i + 1, {2 * length}) AS s
    FROM (SELECT doc_id, h, unnest(range(0, n - {length - 1})) AS i FROM raw)),
  firsts AS (SELECT s, min(doc_id) AS first FROM stretches GROUP BY s HAVING min(doc_id) < max(doc_id)),
  hits AS (SELECT doc_id, pos FROM stretches JOIN firsts USING (s) WHERE first < doc_id),
  marked AS (
    SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {length} THEN 0 ELSE 1 END AS opens
    FROM hits),
  runs AS (
    SELECT doc_id, min(pos) AS b, max(pos) + {length} AS p FROM (
      SELECT doc_id, pos, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked) GROUP BY doc_id, run),
  cuts AS (
    SELECT doc_id, b, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY b), 0) AS since FROM runs),
  kept AS (
    SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (b - since)), '' ORDER BY b) AS head,
      max(p) AS last, sum(p - b) AS removed, count(*) AS spans FROM cuts JOIN raw USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM raw LEFT JOIN kept USING (doc_id)"""


def embedding_links(threshold: float = 0.93) -> str:
    return f"""WITH RECURSIVE fit AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM fit a JOIN fit b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
  {COMPONENTS}
SELECT vec_id, coalesce(c, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT u, count(*) AS c FROM links GROUP BY u) ON u = vec_id
  LEFT JOIN comps ON comps.id = vec_id"""

"""DuckDB's SQL for the queries of sharding, resampling and the Merkle manifest."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The table of CRC-32 by the plain rule, one bit a step, as one list.
CRC_TABLE = """crc_steps AS (
    SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
    UNION ALL
    SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
  crc AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM crc_steps WHERE k = 8)"""


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, folded byte by byte; t is the table's list."""
    pairs = f"regexp_extract_all(hex(encode({text})), '..')"
    values = f"list_transform({pairs}, lambda p: ('0x' || p)::BIGINT)"
    fold = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), {fold}), 4294967295)"


def sharding(shards: int = 16, replicas: int = 128) -> str:
    """Rounds as tables: every arc with rows left asks its next shard, which takes by running sums."""
    point = "('0x' || substr(md5({}), 1, 15))::BIGINT".format
    arcs = shards * replicas
    rounds = []
    for r in range(shards):
        before = (
            "SELECT arc, 0::BIGINT AS first, n AS past FROM counts"
            if r == 0
            else f"SELECT arc, cut AS first, past FROM round{r - 1} WHERE cut < past"
        )
        used = " UNION ALL ".join(f"SELECT shard, cut - first AS took FROM round{k}" for k in range(r))
        room = f"bound - coalesce((SELECT sum(took) FROM ({used}) u WHERE u.shard = b.shard), 0)" if r else "bound"
        rounds.append(f"""round{r} AS MATERIALIZED (
    SELECT arc, first, past, shard, bound - room + least(ahead, room) AS slot, first + least(past - first, room - least(ahead, room)) AS cut
    FROM (SELECT w.arc, first, past, a.shard, bound, room,
            sum(past - first) OVER (PARTITION BY a.shard ORDER BY w.arc) - (past - first) AS ahead
          FROM ({before}) w JOIN ask a ON a.arc = w.arc % {arcs} AND a.nth = {r}
          JOIN (SELECT shard, bound, {room} AS room FROM bounds b) o ON o.shard = a.shard))""")
    pieces = " UNION ALL ".join(f"SELECT arc, first, cut, shard, slot FROM round{r} WHERE cut > first" for r in range(shards))
    listed = ",\n  ".join(rounds)
    return f"""WITH RECURSIVE {CRC_TABLE},
  points AS (
    SELECT shard, row_number() OVER (ORDER BY point, shard) - 1 AS arc, point
    FROM (SELECT i % {shards} AS shard, {point(f"(i % {shards}) || ':' || (i // {shards})")} AS point FROM range({arcs}) r(i))),
  ask AS MATERIALIZED (
    SELECT arc, shard, row_number() OVER (PARTITION BY arc ORDER BY far) - 1 AS nth
    FROM (SELECT a.arc, b.shard, min((b.arc - a.arc + {arcs}) % {arcs}) AS far FROM points a CROSS JOIN points b GROUP BY ALL)),
  keyed AS (
    SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc32("coalesce(text, '')")} AS text_crc32,
      {point("coalesce(doc_id::VARCHAR, '')")} AS point FROM documents, crc),
  arced AS (
    SELECT k.*, coalesce(p.arc, {arcs}) AS arc FROM keyed k ASOF LEFT JOIN points p ON k.point <= p.point),
  ranked AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY arc ORDER BY point, doc_id NULLS FIRST, size, text_crc32) - 1 AS place FROM arced),
  counts AS (SELECT arc, count(*) AS n FROM ranked GROUP BY arc),
  bounds AS (
    SELECT s AS shard, n // {shards} + CASE WHEN s < n % {shards} THEN 1 ELSE 0 END AS bound
    FROM range({shards}) t(s), (SELECT count(*) AS n FROM ranked)),
  {listed},
  pieces AS ({pieces})
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, p.shard::INTEGER AS shard, (slot + place - first)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard
FROM ranked r JOIN pieces p ON p.arc = r.arc AND place >= first AND place < cut"""


def resampling(buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024) -> str:
    found = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH RECURSIVE {CRC_TABLE},
  split AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {found} AS w FROM documents),
  source AS MATERIALIZED (SELECT row, unnest(w) AS word FROM split),
  target AS MATERIALIZED (SELECT unnest({found}) AS word FROM benchmark),
  hashed AS MATERIALIZED (
    SELECT word, {crc32("word")} % {buckets} AS bucket FROM (SELECT word FROM source UNION SELECT word FROM target), crc),
  s AS (SELECT bucket, count(*) AS n FROM source JOIN hashed USING (word) GROUP BY bucket),
  t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (word) GROUP BY bucket),
  gains AS (
    SELECT h.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + {buckets})
      / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + {buckets})))) AS gain
    FROM (SELECT DISTINCT bucket FROM hashed) h LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
  weights AS (SELECT row, sum(gain) AS weight FROM source JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row),
  scored AS (
    SELECT row, doc_id, len(w) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)
        / 4294967296::DOUBLE))))::BIGINT AS score
    FROM split LEFT JOIN weights USING (row)),
  ranked AS (
    SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS r, count(*) OVER () AS n
    FROM scored WHERE n_features >= {min_words})
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
  CASE WHEN r <= n * {percent} // 100 THEN r END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (row)"""


def merkle(fan_out: int = 8, levels: int = 12) -> str:
    """Every level as a table: a node's run is one hash, and each leaf's siblings are added to its proof."""

    def leaf(text: str) -> str:
        fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    def climb(name: str, start: str, depth: int) -> str:
        """Tables name0..: each leaf's node number, its hash, its proof and its folded hash, by level."""
        parts = [f"{name}0 AS MATERIALIZED ({start})"]
        for k in range(depth):
            parts.append(f"""{name}n{k} AS MATERIALIZED (
    SELECT g, pos // {fan_out} AS up, list(h ORDER BY pos) AS run FROM (SELECT DISTINCT g, pos, h FROM {name}{k}) GROUP BY g, up),
  {name}{k + 1} AS MATERIALIZED (
    SELECT p.g, p.id, p.pos // {fan_out} AS pos, n, CASE WHEN n > {fan_out}::HUGEINT ** {k} THEN sha256(array_to_string(run, '')) ELSE h END AS h,
      CASE WHEN n > {fan_out}::HUGEINT ** {k} THEN proof || array_to_string(list_slice(run, 1, p.pos % {fan_out}), '')
        || array_to_string(list_slice(run, p.pos % {fan_out} + 2, {fan_out}), '') ELSE proof END AS proof,
      CASE WHEN n > {fan_out}::HUGEINT ** {k} THEN sha256(array_to_string(list_slice(run, 1, p.pos % {fan_out}), '') || fold
        || array_to_string(list_slice(run, p.pos % {fan_out} + 2, {fan_out}), '')) ELSE fold END AS fold
    FROM {name}{k} p JOIN {name}n{k} q ON q.g IS NOT DISTINCT FROM p.g AND q.up = p.pos // {fan_out})""")
        return ",\n  ".join(parts)

    trees = climb(
        "leaf",
        """SELECT lang AS g, row AS id, pos, n, h, '' AS proof, fold FROM ranked""",
        levels,
    )
    trunk = climb(
        "trunk",
        f"""SELECT 0 AS g, id, dense_rank() OVER (ORDER BY g NULLS FIRST) - 1 AS pos,
    (SELECT count(*) FROM (SELECT DISTINCT g FROM leaf{levels})) AS n, h, proof, fold FROM leaf{levels}""",
        3,
    )
    return f"""WITH RECURSIVE {CRC_TABLE},
  leaves AS (
    SELECT row_number() OVER () AS row, lang, doc_id, {leaf("text")} AS h, {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS low,
      text IS NOT NULL AND coalesce({crc32("doc_id::VARCHAR")} % 3 = 0, false) AS chosen
    FROM documents, crc),
  ranked AS MATERIALIZED (
    SELECT row, lang, doc_id, h, CASE WHEN chosen THEN low ELSE h END AS fold,
      row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
    FROM leaves),
  {trees},
  {trunk}
SELECT doc_id, r.h AS leaf, l.h AS subroot, t.h AS root, sha256(t.proof) AS proof_sha256, t.fold AS folded_root, t.fold = t.h AS verified
FROM ranked r JOIN leaf{levels} l ON l.id = r.row JOIN trunk3 t ON t.id = r.row"""

"""DuckDB SQL that gives the same rows as the registered queries, where SQL can."""

from __future__ import annotations

_SPACES = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"

ORACLES = {}

ORACLES["op9_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_SPACES}), {_LOWER}) AS key FROM lines),
often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.line, k.i, coalesce(k.doc_id < o.last, false) AS dropped
  FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"
#: CRC-32 of UTF-8 text: a table made from the polynomial, then a fold over the bytes.
_CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n)))"""
_BYTES = "list_transform(range(0, octet_length(encode(w))), lambda i: CAST(('0x' || substring(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) + 1 AS BIGINT)])), 4294967295)"

ORACLES["op1_quality_rules"] = f"""
WITH {_CRC_TABLE},
docs AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM docs),
hashed AS (SELECT w, {_CRC} AS h FROM (SELECT DISTINCT w FROM word), crc_table),
placed AS (SELECT doc_id, i, h, lag(h) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM word JOIN hashed USING (w)),
grams AS (SELECT doc_id, h % 16384 AS b FROM placed UNION ALL SELECT doc_id, (before * 31 + h) % 16384 FROM placed WHERE before IS NOT NULL),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counts AS (SELECT b, count(*) AS raw, count(t.doc_id) AS target FROM grams g LEFT JOIN trusted t ON t.doc_id = g.doc_id GROUP BY b),
totals AS (SELECT sum(raw) AS n, sum(target) AS m FROM counts),
weights AS (SELECT b, CASE WHEN m = 0 THEN 0 ELSE ln((target + 0.5) / (m + 0.5 * 16384)) - ln((raw + 0.5) / (n + 0.5 * 16384)) END AS w FROM counts, totals),
scores AS (SELECT doc_id, round(avg(w), 6) AS score FROM grams JOIN weights USING (b) GROUP BY doc_id),
windows AS (SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS five, lead(w, 4) OVER o AS last FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM windows WHERE last IS NOT NULL) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, range(5) r(d) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE trim(line, {_SPACES}) <> '' GROUP BY doc_id),
base AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id))
SELECT *, base_failed IS FALSE AND score >= -0.12 AS kept FROM (
  SELECT b.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(score, 0) AS score FROM base b LEFT JOIN scores USING (doc_id))
"""

_KINDS = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"\']?\x20*[:=]\x20*[\"\']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("user", r"((?i:username|user|login|client_id))[\"\']?\x20*[:=]\x20*[\"\']?([A-Za-z0-9._@-]+)", 2, 3),
    ("endpoint", r"https?://[A-Za-z0-9._~:/?#@!$&\'()*+,;=%-]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0, 7),
    ("opaque", r"(?i:pass|pwd|key|auth)[\"\']?\x20*[:=]\x20*[\"\']?[A-Za-z0-9+/_.=-]+|[A-Za-z]{0,12}[0-9][A-Za-z0-9+/_-]{15,}", 0, 12),
]


def _found(number: int) -> str:
    """Matches of a kind with code point positions: each is extracted with the gap before it, and lengths are summed."""
    _, pattern, value, least = _KINDS[number]
    quoted = pattern.replace("\\'", "\\x27").replace('\\"', "\\x22")
    tied = f"'(?s)(.*?)({quoted})'"
    group = 2 + value if value else 2
    return f"""SELECT doc_id, {number} AS kind, e - o AS s, e FROM (SELECT doc_id, o, v, sum(a) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, unnest(range(len(g0))) AS i, unnest(list_transform(g0, lambda x: length(x))) AS a, unnest(list_transform(g2, lambda x: length(x))) AS o, unnest(list_transform(gv, lambda x: length(x))) AS v FROM (
        SELECT doc_id, regexp_extract_all(text, {tied}, 0) AS g0, regexp_extract_all(text, {tied}, 2) AS g2, regexp_extract_all(text, {tied}, {group}) AS gv FROM documents WHERE text IS NOT NULL))) WHERE v >= {least}"""


_LISTED = "coalesce(string_agg(concat(names[kind + 1], ':', s, ':', e), ',' ORDER BY s, kind)"

ORACLES["op2_secret_scan"] = f"""
WITH parts AS ({' UNION ALL '.join(_found(k) for k in range(len(_KINDS)))}),
swept AS (SELECT *,
  max(e) FILTER (kind < 3) OVER l AS base_before, max(e) FILTER (kind IN (1, 3)) OVER l AS id_before, max(e) FILTER (kind IN (0, 2, 5)) OVER l AS secret_before,
  min(s) FILTER (kind < 3) OVER r AS base_after, min(s) FILTER (kind IN (1, 3)) OVER r AS id_after, min(s) FILTER (kind IN (0, 2, 5)) OVER r AS secret_after
  FROM parts WINDOW l AS (PARTITION BY doc_id ORDER BY s, kind, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY doc_id ORDER BY s, kind, e ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
near AS (SELECT *, coalesce(s - id_before <= 200, false) OR coalesce(id_after - e <= 200, false) AS id_near, coalesce(s - secret_before <= 200, false) OR coalesce(secret_after - e <= 200, false) AS secret_near,
  coalesce(base_before <= s, true) AND coalesce(base_after >= e, true) AS apart FROM swept),
kept AS (SELECT doc_id, kind, s, e, ['assign', 'access', 'hex', 'user', 'endpoint', 'opaque'] AS names FROM near
  WHERE kind < 3 OR (apart AND ((kind = 5 AND id_near) OR (kind = 3 AND secret_near) OR (kind = 4 AND id_near AND secret_near))))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256({_LISTED} FILTER (kind < 3), '')) AS base_sha256, {_LISTED} FILTER (kind IS NOT NULL), '') AS spans
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _shingles(table: str, key: str) -> str:
    """Distinct five-word shingles of a table's texts, or the whole sequence of fewer words."""
    words = _WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), {_LOWER})")
    return f"""SELECT DISTINCT {key}, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE concat(array_to_string(ws, ' '), ' (', len(ws), ')') END AS g FROM (
      SELECT {key}, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM (SELECT {key}, {words} AS ws FROM {table}) WHERE len(ws) > 0)"""


ORACLES["op3_near_dedup"] = f"""
WITH RECURSIVE sh AS MATERIALIZED ({_shingles('documents', 'doc_id')}),
sized AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS least FROM ends UNION SELECT b, least FROM reach JOIN ends ON node = a),
comp AS (SELECT node, min(least) AS c FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sized s ON s.doc_id = d.doc_id LEFT JOIN comp ON node = d.doc_id
"""

ORACLES["op6_decontaminate"] = f"""
WITH sh AS ({_shingles('documents', 'doc_id')}), items AS ({_shingles('benchmark', 'item_id')}),
sized AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM sh JOIN items USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment FROM shared JOIN sized USING (item_id) WHERE 100 * n_shared >= 75 * n_item
"""

_NIBBLES = "list_transform(range(40), lambda i: CAST(('0x' || substring(sha, CAST(i + 1 AS BIGINT), 1)) AS BIGINT))"
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((((n[(5 * i) // 4 + 1] * 16 + n[(5 * i) // 4 + 2]) >> (3 - (5 * i) % 4)) & 31) + 1 AS BIGINT), 1)), '')"
_HOST = r"regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"

ORACLES["op8_warc"] = rf"""
WITH pages_ AS (SELECT page_id, url, sha1(coalesce(html, '')) AS sha, octet_length(encode(coalesce(html, ''))) AS payload_bytes, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
keyed AS (SELECT *, {_NIBBLES} AS n, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y%m%d%H%M%S') AS timestamp,
  lower(concat(array_to_string(list_reverse(string_split({_HOST}, '.')), ','), ')', coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/'), regexp_extract(url, '(\?[^#]*)', 1))) AS url_key FROM pages_)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  url_key, timestamp, row_number() OVER (PARTITION BY url_key ORDER BY timestamp, page_id) AS capture_number
FROM keyed
"""

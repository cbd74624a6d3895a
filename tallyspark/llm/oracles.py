"""DuckDB SQL with the same rows as the registered queries, where SQL can express them.

The others are learned, or need tokenizers or hash functions that SQL lacks;
their tests compare them with plain Python versions.
"""

from __future__ import annotations

from tallyspark.llm import nn_descent, quality_rules

_ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, h, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits,
         min(page_id) OVER (PARTITION BY h) AS first_id,
         row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS n
  FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INT)
           + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INT)
           + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INT), 1)), '') AS payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN first_id END AS refers_to
FROM d"""

_QUALITY = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS txt FROM documents),
w AS (
  SELECT *, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t),
windows AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 3) AS steps(k) GROUP BY r),
lines AS (
  SELECT r, host, txt, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS line
  FROM (SELECT r, host, txt, unnest(ls) AS line FROM w)),
texts AS (SELECT host, count(DISTINCT txt) AS texts FROM t GROUP BY host),
shared AS (
  SELECT host, line FROM lines JOIN texts USING (host) GROUP BY host, line, texts
  HAVING count(DISTINCT txt) >= {quality_rules.MIN_DOCUMENTS} AND count(DISTINCT txt) > CAST({quality_rules.MIN_SHARE} AS DOUBLE) * texts),
gone AS (
  SELECT r, sum(len(string_split(line, ' '))) AS n FROM lines SEMI JOIN shared USING (host, line) GROUP BY r),
s AS (
  SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(txt, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         len(ws) - coalesce(gone.n, 0) AS n_left
  FROM w LEFT JOIN covered ON covered.r = w.r LEFT JOIN gone ON gone.r = w.r),
f AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS}
         OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_left >= {quality_rules.MIN_KEPT_PERCENT} * n_words AS kept
FROM f"""

_NEIGHBOURS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {nn_descent.THRESHOLD}),
reach AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
low AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, low.component_id,
       v.vec_id = low.component_id AS kept
FROM v JOIN low ON low.vec_id = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

ORACLE_SQL: dict[str, str] = {
    "op3_arc_to_warc": _ARCHIVES,
    "op4_quality_rules": _QUALITY,
    "op8_nn_descent": _NEIGHBOURS,
}

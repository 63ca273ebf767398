"""SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

#: Bits 5 i .. 5 i + 4 of a SHA-1 are within its i // 4-th group of five hexadecimal digits.
_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)"

_REACH = "reach AS (SELECT node, node AS root FROM nodes UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.node)"

JACCARD = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM texts
), postings AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS n_u, b.n AS n_v, count(*) AS common
  FROM postings a JOIN postings b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  WHERE 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL
), found AS MATERIALIZED (
  SELECT u, v FROM pairs WHERE 100 * common >= 75 * (n_u + n_v - common)
), links AS MATERIALIZED (SELECT u, v FROM found UNION ALL SELECT v, u FROM found), nodes AS (SELECT doc_id AS node FROM sets), {_REACH}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = s.doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x != 0]) > 0
    THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings
), links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b ON a.vec_id != b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE false END
), nodes AS (SELECT vec_id AS node FROM vectors), {_REACH}
SELECT v.vec_id, coalesce(l.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM vectors v JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = v.vec_id
LEFT JOIN (SELECT u, count(*) AS n_links FROM links GROUP BY u) l ON l.u = v.vec_id
"""

WARC = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), marked AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM payloads
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, array_to_string([{_DIGIT} FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last != page_id THEN last END AS refers_to
FROM marked
"""

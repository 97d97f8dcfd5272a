"""SQL twins of the document operators that SQL can express on small tables."""

from __future__ import annotations

#: op9: windows of 35 words as strings; words that a repeated one covers go.
PHRASE_DEDUP = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT rid, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT DISTINCT rid, i + o AS p FROM dup, (SELECT unnest(range(35)) AS o)
), words AS (
  SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
  SELECT x.rid, count(cov.p) AS gone, string_agg(word, ' ' ORDER BY x.p) FILTER (cov.p IS NULL) AS t
  FROM words x LEFT JOIN cov ON x.rid = cov.rid AND x.p = cov.p GROUP BY x.rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.rid = kept.rid
"""

#: op10: common shingles counted pair by pair, links closed transitively.
JACCARD_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = w.doc_id
"""

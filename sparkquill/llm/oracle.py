"""DuckDB SQL by brute force for the near-duplicate and repeat queries; meant for small tables."""

NEAR_VECTORS = r"""
WITH RECURSIVE valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM valid x JOIN valid y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))) >= 0.95),
reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, min(other) AS component_id, e.vec_id = min(other) AS kept
FROM embeddings e JOIN reached USING (vec_id) GROUP BY e.vec_id
"""

NEAR_TEXTS = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[k:k + 4] END, ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM documents d JOIN reached USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""

REPEATS = r"""
WITH raw AS (
  SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
strings AS (
  SELECT r, k, md5(b[k:k + 199]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS k FROM raw WHERE octet_length(b) >= 200)),
marked AS (
  SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY h) AS n FROM strings) WHERE n > 1),
begun AS (
  SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + 200 THEN 0 ELSE 1 END AS new FROM marked),
runs AS (
  SELECT r, min(k) AS s, max(k) + 200 AS e FROM (SELECT r, k, sum(new) OVER (PARTITION BY r ORDER BY k) AS run FROM begun) GROUP BY r, run),
spans AS (
  SELECT r, count(*) AS n_spans, sum(e - s) AS n_removed, list(s ORDER BY s) AS starts, list(e ORDER BY s) AS ends FROM runs GROUP BY r),
kept AS (
  SELECT raw.r, doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
         list_transform(range(1, coalesce(n_spans, 0) + 2), lambda i: hex(b[CASE WHEN i = 1 THEN 1 ELSE ends[i - 1] END:CASE WHEN i > coalesce(n_spans, 0) THEN octet_length(b) ELSE starts[i] - 1 END])) AS parts
  FROM raw LEFT JOIN spans ON raw.r = spans.r)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(array_to_string(parts, ''))) AS kept_sha256 FROM kept
"""

"""DuckDB SQL for the operators whose results SQL can say; the others are tested against brute force."""

from __future__ import annotations

#: Every window of 400 bytes, as hexadecimal digits; those that occur twice, and the bytes that they cover. Then every window of 48 words.
SUFFIX_DEDUP = r"""
WITH b AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
  n AS (SELECT *, length(h) // 2 AS n_bytes FROM b),
  w AS (SELECT r, unnest(range(0, n_bytes - 399)) AS i, hash(substr(h, 2 * unnest(range(0, n_bytes - 399)) + 1, 800)) AS k FROM n WHERE n_bytes >= 400),
  d AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
  g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM d),
  s AS (SELECT r, min(i) AS a, max(i) + 400 AS e FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM g) GROUP BY r, s),
  c AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS f FROM s),
  k AS (SELECT c.r, sum(e - a)::BIGINT AS removed, count(*) AS spans, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS kept, max(e) AS e FROM c JOIN n USING (r) GROUP BY c.r),
  pt AS (SELECT r, h, regexp_extract_all(decode(unhex(h)), '[^\x20\x09-\x0D]+') AS ws FROM n),
  pe AS (SELECT r, len(ws) AS m, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM pt),
  pw AS (SELECT r, m, i, hash(list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING)) AS k FROM pe),
  pk AS (SELECT r, i, k FROM pw WHERE i <= m - 48),
  pd AS (SELECT r, i FROM pk WHERE k IN (SELECT k FROM pk GROUP BY k HAVING count(*) > 1)),
  pg AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 48 THEN 0 ELSE 1 END AS new FROM pd),
  ps AS (SELECT r, max(i) + 48 - min(i) AS words FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM pg) GROUP BY r, s),
  pp AS (SELECT r, count(*) AS passages, sum(words)::BIGINT AS words FROM ps GROUP BY r)
SELECT doc_id, n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256,
  coalesce(passages, 0) AS n_passages, coalesce(pp.words, 0) AS n_passage_words
FROM n LEFT JOIN k USING (r) LEFT JOIN pp USING (r)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
  t(node, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT node, w FROM t JOIN l ON reached = u),
  c AS (SELECT node, min(reached) AS component_id FROM t GROUP BY node),
  n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON node = vec_id LEFT JOIN n ON u = vec_id
"""

BACKOFF = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
  t AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
  p AS (SELECT r, i, w, lag(w) OVER q AS h, lag(w, 2) OVER q AS g FROM t WINDOW q AS (PARTITION BY r ORDER BY i)),
  u AS (SELECT w, count(*) AS n FROM p GROUP BY w), ud AS (SELECT r, w, count(*) AS n FROM p GROUP BY r, w),
  b AS (SELECT h, w, count(*) AS n FROM p WHERE h IS NOT NULL GROUP BY h, w), bd AS (SELECT r, h, w, count(*) AS n FROM p WHERE h IS NOT NULL GROUP BY r, h, w),
  c AS (SELECT g, h, w, count(*) AS n FROM p WHERE g IS NOT NULL GROUP BY g, h, w), cd AS (SELECT r, g, h, w, count(*) AS n FROM p WHERE g IS NOT NULL GROUP BY r, g, h, w),
  x AS (SELECT p.r, u.n - ud.n AS cu, b.n - bd.n AS cb, uh.n - udh.n AS ch, c.n - cd.n AS ct, bh.n - bdh.n AS cgh, p.h, p.g, (SELECT count(*) FROM p) - len(d.ws) AS tokens
    FROM p JOIN d USING (r) JOIN u USING (w) JOIN ud ON ud.r = p.r AND ud.w = p.w LEFT JOIN b ON b.h = p.h AND b.w = p.w LEFT JOIN bd ON bd.r = p.r AND bd.h = p.h AND bd.w = p.w
    LEFT JOIN u uh ON uh.w = p.h LEFT JOIN ud udh ON udh.r = p.r AND udh.w = p.h
    LEFT JOIN c ON c.g = p.g AND c.h = p.h AND c.w = p.w LEFT JOIN cd ON cd.r = p.r AND cd.g = p.g AND cd.h = p.h AND cd.w = p.w
    LEFT JOIN b bh ON bh.h = p.g AND bh.w = p.h LEFT JOIN bd bdh ON bdh.r = p.r AND bdh.h = p.g AND bdh.w = p.h),
  s1 AS (SELECT *, CASE WHEN cu > 0 THEN cu / greatest(tokens, 1)::DOUBLE ELSE 1 / (tokens + 1.0::DOUBLE) END AS s1 FROM x),
  s2 AS (SELECT *, CASE WHEN h IS NULL THEN s1 WHEN cb > 0 THEN cb / ch::DOUBLE ELSE 0.4::DOUBLE * s1 END AS s2 FROM s1),
  v AS (SELECT r, CASE WHEN g IS NULL THEN s2 WHEN ct > 0 THEN ct / cgh::DOUBLE ELSE 0.4::DOUBLE * s2 END AS s, CASE WHEN g IS NOT NULL THEN ct = 0 WHEN h IS NOT NULL THEN cb = 0 ELSE false END AS back FROM s2),
  a AS (SELECT r, sum(ln(s)) AS log_score, avg(ln(s)) AS score, count(*) FILTER (WHERE back) AS n_backoffs FROM v GROUP BY r)
SELECT doc_id, len(ws) AS n_words, round(coalesce(log_score, 0), 6) AS log_score, round(score, 8) AS score, coalesce(n_backoffs, 0) AS n_backoffs FROM d LEFT JOIN a USING (r)
"""

ORACLES = {"op6_suffix_dedup": SUFFIX_DEDUP, "op7_embeddings": EMBEDDINGS, "op8_backoff": BACKOFF}

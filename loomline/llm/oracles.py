"""DuckDB SQL for the queries that SQL can express, beside that of ``topk``."""

from __future__ import annotations

# Earliest deadline first as a recursion over the slots of one period.
MIX_SOURCES = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
p AS (SELECT source, n, CAST(greatest(1, floor((SELECT greatest(1000, 16 * count(*)) FROM n) * pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM n))) AS BIGINT) AS p FROM n),
s AS (SELECT list(source ORDER BY source) AS names, list(p ORDER BY source) AS p, CAST(sum(p) AS BIGINT) AS q, count(*) AS m FROM p),
line(t, had, pick, j) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(p, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM s
  UNION ALL
  SELECT t + 1, list_transform(range(1, m + 1), lambda i: had[i] + CAST(i = c AS BIGINT)), c, had[c]
  FROM (
    SELECT t, had, m, list_sort(list_transform(
      list_filter(range(1, m + 1), lambda i: had[i] < p[i] AND (had[i] * q) // p[i] <= t + 1),
      lambda i: {'d': ((had[i] + 1) * q + p[i] - 1) // p[i], 'i': i}))[1].i AS c
    FROM line, s WHERE t + 1 < q)
),
slots AS (SELECT names[pick] AS source, j, t AS slot FROM line, s WHERE t >= 0),
horizon AS (
  SELECT min((((n + 7) // 8) // p.p) * (SELECT q FROM s) + slot) AS horizon
  FROM p JOIN slots USING (source) WHERE j = ((n + 7) // 8) % p.p
),
d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents
),
b AS (
  SELECT doc_id, source, p.p AS p, (SELECT q FROM s) AS q, r // 8 AS k, r % 8 AS r, ((r // 8) // p.p) * (SELECT q FROM s) + slot AS slot
  FROM d JOIN p USING (source) JOIN slots USING (source) WHERE j = (r // 8) % p.p
)
SELECT doc_id, source, CAST(p AS DOUBLE) / q AS weight, k AS block, (k * q) // p AS release, ((k + 1) * q + p - 1) // p AS deadline,
       slot, slot * 8 + r AS position, slot < horizon AS mixed
FROM b, horizon
"""

# All pairs that share a shingle, then everything that links reach.
MINHASH_NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON r.other = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

EMBEDDING_NEAR_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM reach r JOIN e ON r.other = e.a)
SELECT r.vec_id, (SELECT count(*) FROM e WHERE e.a = r.vec_id) AS n_links, min(other) AS component_id, r.vec_id = min(other) AS kept
FROM reach r GROUP BY r.vec_id
"""

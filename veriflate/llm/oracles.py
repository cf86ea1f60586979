"""DuckDB SQL for the queries whose results SQL can express."""

OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[t:t + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(t) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)
), both_ways AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT x.b, r.c FROM r JOIN both_ways x ON x.a = r.doc_id
), m AS (
  SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, t, array_to_string(w[t:t + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS u(t)
), m AS (
  SELECT s, min(doc_id) AS low FROM x GROUP BY s
), g AS (
  SELECT DISTINCT x.doc_id, x.t + o AS p FROM x JOIN m USING (s), range(0, 13) AS r(o) WHERE m.low < x.doc_id
), k AS (
  SELECT doc_id, i AS p, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)
), t AS (
  SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.p) FILTER (g.p IS NULL) AS kept, count(*) AS n, count(g.p) AS r
  FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.p = k.p GROUP BY k.doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""

OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), e AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.95
), r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.vec_id
), m AS (
  SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id
), n AS (
  SELECT a, count(*) AS n FROM e GROUP BY a
)
SELECT m.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.c AS component_id, m.c = m.vec_id AS kept FROM m LEFT JOIN n ON n.a = m.vec_id
"""

"""DuckDB SQL for the rows of those corpus queries that SQL can express."""

from __future__ import annotations

_COMPONENTS = """
ends AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(node, place) AS (
  SELECT DISTINCT u, u FROM ends
  UNION
  SELECT r.node, b.v FROM reach r JOIN ends b ON b.u = r.place),
found AS (SELECT node, min(place) AS component FROM reach GROUP BY node)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM worded),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
{_COMPONENTS}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(f.component, s.doc_id) AS component_id,
  coalesce(f.component, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN found f ON f.node = s.doc_id"""

VECTORS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
    AND NOT list_bool_and(list_transform(embedding, lambda x: x = 0))),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
{_COMPONENTS},
counted AS (SELECT u, count(*) AS n FROM ends GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, coalesce(f.component, e.vec_id) AS component_id,
  coalesce(f.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counted c ON c.u = e.vec_id LEFT JOIN found f ON f.node = e.vec_id"""

SEARCH = """
WITH asked AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
termed AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
corpus AS (SELECT count(*) AS n_docs, sum(len(w)) AS length FROM termed WHERE len(w) > 0),
flat AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM termed),
counts AS (SELECT row, doc_id, n, t, count(*) AS tf FROM flat GROUP BY ALL),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, corpus GROUP BY t, n_docs),
wanted AS (
  SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM asked),
scores AS (
  SELECT item, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf)
    // (1000 * tf + 12 * (75 + (25 * n * n_docs) // length)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (t) JOIN counts USING (t), corpus GROUP BY item, item_id, row, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20"""

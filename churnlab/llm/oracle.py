"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
TOKEN = r"'[^\x20\x09-\x0D]+'"

VECTORS = """
v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0
)"""

SQL = {
    "op1_rabitq": f"""
WITH {VECTORS},
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_fair_queueing": f"""
WITH s AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), {TOKEN}))::BIGINT AS size,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey
  FROM documents
),
t AS (SELECT sum(size)::DOUBLE AS total FROM s),
w AS (
  SELECT skey, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s GROUP BY skey
),
c AS (
  SELECT *, 2 * source_size / weight::DOUBLE AS ratio,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight::DOUBLE, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS stopped,
    sum(weight) OVER (ORDER BY 2 * source_size / weight::DOUBLE, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest
  FROM w
),
f AS (
  SELECT stopped, rest FROM c, t
  WHERE NOT (2 * source_size < weight::DOUBLE * (1.5::DOUBLE * total - stopped) / rest) ORDER BY ratio, skey LIMIT 1
),
g AS (
  SELECT skey, source_size,
    least(2 * source_size::DOUBLE, weight::DOUBLE * (1.5::DOUBLE * total - f.stopped) / f.rest) AS target
  FROM w, t, f
),
p AS (
  SELECT doc_id, size, g.skey, source_size, target,
    unnest(generate_series(1, greatest(1, least(2, ceil(target / greatest(source_size, 1))))::INT)) AS pass
  FROM s JOIN g ON s.skey = g.skey
),
q AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY skey ORDER BY pass, md5('mix/' || pass || '/' || coalesce(doc_id::VARCHAR, '')), doc_id
    ROWS UNBOUNDED PRECEDING)::DOUBLE / CASE WHEN target > 0 THEN target END, 0) AS finish
  FROM p
),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, skey, doc_id, pass ROWS UNBOUNDED PRECEDING) AS served FROM q)
SELECT doc_id, size, source_size, target,
  sum(CASE WHEN served <= (SELECT floor(1.5::DOUBLE * total) FROM t) THEN size ELSE 0 END)::BIGINT AS taken
FROM r GROUP BY doc_id, size, source_size, target, skey""",
    "op4_cover_tree": f"""
WITH RECURSIVE {VECTORS},
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT m.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, m.vec_id = component_id AS kept
FROM embeddings m JOIN c ON c.a = m.vec_id LEFT JOIN n ON n.a = m.vec_id""",
    "op5_cuckoo_lines": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {BLANKS}), {LOWER}) AS key FROM l),
r AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1
),
m AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> first_doc AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op7_fast_sketch": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), {TOKEN}) AS words FROM documents
),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
    FROM w WHERE len(words) > 0
  )
),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
),
l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n_shingles + y.n_shingles - shared)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n_shingles, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op13_burst_trie": f"""
WITH bits AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos, id, words FROM (
    SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
      len(regexp_extract_all(coalesce(text, ''), {TOKEN}))::BIGINT AS words
    FROM conversations WHERE conv_id IS NOT NULL)
),
c AS (
  SELECT conv_id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), bits
),
r AS (
  SELECT c.conv_id, 0 AS part, pos, id, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, pos, id, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
),
s AS (
  SELECT c.conv_id, coalesce(list(id ORDER BY part, pos) FILTER (id IS NOT NULL), []) AS ids,
    coalesce(list(words ORDER BY part, pos) FILTER (id IS NOT NULL), []) AS words
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
),
p AS (
  SELECT conv_id, d AS depth, array_to_string(ids[1:d], ',') AS path, array_to_string(ids[1:d - 1], ',') AS up,
    CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words, d = len(ids) AS ends
  FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM s)
),
n AS (
  SELECT depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY depth, path
),
k AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY depth, up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
b AS (
  SELECT a.depth, a.path, sum(CASE WHEN d.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((d.n_convs - 1) * d.words) AS saved_tokens
  FROM f a JOIN f d ON d.depth >= a.depth AND (a.depth = 0 OR left(d.path, a.depth::BIGINT * 33 - 1) = a.path) GROUP BY ALL
)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves::BIGINT AS n_leaves,
  b.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN b USING (depth, path) LEFT JOIN n u ON u.depth = f.depth - 1 AND u.path = f.up""",
}

"""SQL for DuckDB that says in other words what the queries return; by all pairs, all windows and recursion, so for small tables."""

WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.a, c.reached FROM c JOIN e ON e.b = c.id),
least AS (SELECT id, min(reached) AS component_id FROM c GROUP BY id), n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON id = vec_id LEFT JOIN n ON a = vec_id
"""

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS gram
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.a, r.reached FROM r JOIN e ON e.b = r.id),
least AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id), l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) ELSE doc_id END AS class_id,
       CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, doc_id = component_id AS kept
FROM w JOIN least ON id = doc_id LEFT JOIN l ON a = doc_id
"""

OP4 = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
part AS (SELECT doc_id, n, 1000 * c AS base, substr(x, 2000 * c + 1, 2398) AS y FROM (SELECT doc_id, n, x, unnest(range(0, (n + 999) // 1000)) AS c FROM h WHERE n >= 200)),
win AS (SELECT doc_id, base + j AS i, md5(substr(y, 2 * j + 1, 400)) AS w FROM (SELECT doc_id, base, y, unnest(range(0, least(1000, n - 199 - base))) AS j FROM part)),
twice AS (SELECT w FROM win GROUP BY w HAVING count(*) > 1),
hit AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM win JOIN twice USING (w)),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b
  FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit) GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM runs
  UNION ALL SELECT h.doc_id, coalesce(max(b), 0), any_value(n) FROM h LEFT JOIN runs ON h.doc_id = runs.doc_id GROUP BY h.doc_id
), kept AS (SELECT doc_id, coalesce(string_agg(substr(x, 2 * s + 1, 2 * (e - s)), '' ORDER BY s), '') AS k FROM gaps JOIN h USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT h.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM h JOIN kept ON h.doc_id = kept.doc_id LEFT JOIN gone ON h.doc_id = gone.doc_id
"""

OP5 = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
raw AS (SELECT doc_id, unnest(generate_series(1, len(t))) AS no, unnest(t) AS raw FROM t),
each AS (SELECT doc_id, no, raw, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s, row_number() OVER (ORDER BY doc_id, no) AS pos FROM raw),
line AS (SELECT s, length(s) AS n, min(pos) AS pos FROM each WHERE s <> '' GROUP BY s),
pair AS (
  SELECT x.s AS a, x.pos AS ap, x.n AS an, y.s AS b, y.pos AS bp, y.n AS bn FROM line x JOIN line y ON y.n = x.n AND left(x.s, x.n // 2) = left(y.s, y.n // 2) AND x.pos < y.pos
  UNION SELECT x.s, x.pos, x.n, y.s, y.pos, y.n FROM line x JOIN line y ON y.n = x.n AND right(x.s, x.n // 2) = right(y.s, y.n // 2) AND x.pos < y.pos
  UNION SELECT x.s, x.pos, x.n, y.s, y.pos, y.n FROM line x JOIN line y ON y.n = x.n + 1 AND left(x.s, x.n // 2) = left(y.s, x.n // 2)
  UNION SELECT x.s, x.pos, x.n, y.s, y.pos, y.n FROM line x JOIN line y ON y.n = x.n + 1 AND right(x.s, x.n // 2) = right(y.s, x.n // 2)
), near AS (
  SELECT DISTINCT CASE WHEN ap < bp THEN b ELSE a END AS s FROM pair
  WHERE CASE WHEN ap < bp THEN bn ELSE an END >= 8 AND levenshtein(a, b) <= 1
), judged AS (
  SELECT doc_id, no, raw, s, s <> '' AND (s IN (SELECT s FROM near) OR pos > (min(pos) OVER (PARTITION BY s))) AS gone FROM each
)
SELECT doc_id, count(*) FILTER (WHERE s <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

"""DuckDB SQL of the operators that SQL can express."""

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, t[i] AS line, trim(t[i], E' \t\n\x0b\f\r') AS bare
  FROM (SELECT doc_id, string_split(text, E'\n') AS t FROM documents WHERE text IS NOT NULL), unnest(range(1, len(t) + 1)) AS u(i)
), filled AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM lines WHERE bare <> ''
), windows AS (
  SELECT a.doc_id, a.k, a.bare AS x, b.bare AS y, c.bare AS z
  FROM filled a JOIN filled b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN filled c ON c.doc_id = a.doc_id AND c.k = a.k + 2
), ranked AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, k) AS n FROM windows
), covered AS (
  SELECT DISTINCT doc_id, k + o AS k FROM ranked, (VALUES (0), (1), (2)) AS v(o) WHERE n > 1
), spans AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = covered.doc_id AND c.k = covered.k - 1)) AS n_spans FROM covered GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, count(*) AS n_left, string_agg(l.line, E'\n' ORDER BY l.pos) AS t
  FROM lines l LEFT JOIN filled f ON f.doc_id = l.doc_id AND f.pos = l.pos LEFT JOIN covered c ON c.doc_id = f.doc_id AND c.k = f.k
  WHERE c.k IS NULL GROUP BY l.doc_id
), counted AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_spans, 0) AS n_spans,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.t, '')) END AS kept_sha256
FROM documents d LEFT JOIN counted n USING (doc_id) LEFT JOIN spans s USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

MIX = r"""
WITH d AS (SELECT doc_id, source, CAST(__WORDS__ AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * CAST(source_size AS DOUBLE) AS cap FROM r),
f AS (SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT max(level) FILTER (WHERE level * weight <= cap) AS level FROM f),
t AS (SELECT source, rank, CAST(source_size AS BIGINT) AS source_size, CASE WHEN l.level IS NULL THEN cap ELSE least(cap, weight * l.level) END AS target FROM f, l),
c AS (SELECT d.doc_id, d.size, t.rank, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(size, words - c)) AS one, greatest(0, least(size, words - source_size - c)) AS two,
        CASE rank % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS a, CASE rank % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS b FROM c),
p AS (SELECT *, CAST(c AS DOUBLE) / greatest(target, 1) * ((a + b) / 2) AS u FROM k)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
       CASE WHEN one + two > 0 THEN round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * u / (a + sqrt(greatest(a * a + (b - a) / 2 * 4 * u, 0.0::DOUBLE))))), 6) END AS first_position
FROM p
""".replace("__WORDS__", WORDS)

URLS = r"""
WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM a),
r(rule, host, path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (SELECT b.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
      FROM b JOIN r ON (b.host = r.host OR ends_with(b.host, '.' || r.host)) AND starts_with(b.path, r.path) GROUP BY b.page_id)
SELECT b.page_id, b.host, b.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM b LEFT JOIN m USING (page_id)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
r AS (SELECT sh.doc_id, sh.s FROM sh SEMI JOIN shared USING (s)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM r a JOIN r b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * n_both >= 75 * (a.n + b.n - n_both)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.y AS v, c.c FROM c JOIN e ON e.x = c.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN (SELECT v AS doc_id, min(c) AS component_id FROM c GROUP BY v) m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

SUFFIX_DEDUP = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
s AS (SELECT doc_id, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS k FROM b, unnest(range(0, greatest(n - 99, 0))) AS u(i)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM s),
l AS (SELECT doc_id, i FROM f WHERE r > 1),
m AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM m),
r AS (SELECT doc_id, g, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY ALL),
c AS (SELECT doc_id, lo, hi, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS after FROM r),
k AS (SELECT c.doc_id, min(lo) AS first, sum(hi - lo) AS removed, count(*) AS spans,
             string_agg(substr(b.h, CAST(2 * hi + 1 AS BIGINT), CAST(2 * (coalesce(after, b.n) - hi) AS BIGINT)), '' ORDER BY lo) AS rest FROM c JOIN b USING (doc_id) GROUP BY c.doc_id)
SELECT b.doc_id, b.n AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed, coalesce(k.spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN b.h ELSE substr(b.h, 1, CAST(2 * k.first AS BIGINT)) || k.rest END)) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id)
"""

VECTORS = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT l.y AS v, c.c FROM c JOIN l ON l.x = c.v),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT m.v AS vec_id, coalesce(n.n, 0) AS n_links, m.component_id, m.v = m.component_id AS kept
FROM (SELECT v, min(c) AS component_id FROM c GROUP BY v) m LEFT JOIN n ON n.x = m.v
"""

SQL: dict[str, str] = {"op1_minhash_dedup": NEAR_DUPLICATES, "op2_line_dedup": LINE_DEDUP, "op5_vector_dedup": VECTORS, "op8_mix_sources": MIX, "op9_suffix_dedup": SUFFIX_DEDUP, "op10_url_filter": URLS}

"""DuckDB SQL with the same results as the queries that SQL can express on small tables; doc_ids are taken as unique."""

WORDS = r"[^\x20\x09-\x0D]+"

OP2_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS h FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, x) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.x = e.a)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(x) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1
"""

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents
), s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d)
), g AS (
  SELECT doc_id, list(DISTINCT j) AS gone
  FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

# Bytes as pairs of hexadecimal digits, cut into blocks of 256 that overlap, as a place far into a text costs time.
OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents
), b AS (SELECT doc_id, k, substring(t, 512 * k + 1, 910) AS u FROM (SELECT doc_id, t, unnest(range(0, len(t) // 512 + 1)) AS k FROM d)
), s AS (
  SELECT doc_id, 256 * k + i AS i, md5(substring(u, 2 * i + 1, 400)) AS h
  FROM (SELECT doc_id, k, u, unnest(range(0, least(256, greatest(len(u) // 2 - 199, 0)))) AS i FROM b)
), x AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)
), m AS (SELECT *, max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x
), r AS (SELECT *, sum(CASE WHEN before >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m
), g AS (SELECT doc_id, run, min(i) AS lo, max(i + 200) AS hi FROM r GROUP BY 1, 2
), k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM g
), c AS (SELECT doc_id, sum(hi - lo) AS n, count(*) AS spans, string_agg(substring(t, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS kept, max(hi) AS last FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (len(t) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept || substring(t, 2 * last + 1), t))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

"""SQL for queries whose modules hold none; each document id stands once in the table."""

LINE_DEDUP = r"""
WITH al AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
l AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS upto FROM
      (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM al) WHERE n > 0),
f AS (SELECT doc_id, pos AS a, max(pos) OVER w AS b, list(line) OVER w AS c, sum(n) OVER w AS t FROM l
      WINDOW w AS (PARTITION BY doc_id ORDER BY upto - n RANGE BETWEEN CURRENT ROW AND 50 FOLLOWING)),
g AS (SELECT doc_id, min(pos) OVER w AS a, pos AS b, list(line) OVER w AS c, sum(n) OVER w AS t FROM l
      WINDOW w AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 50 PRECEDING AND CURRENT ROW)),
u AS (SELECT doc_id, a, b, sha256(array_to_string(c, chr(10))) AS c FROM f WHERE t >= 51
      UNION SELECT doc_id, a, b, sha256(array_to_string(c, chr(10))) FROM g WHERE t >= 51),
m AS (SELECT c, min((doc_id, a)) AS first FROM u GROUP BY c),
x AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM u JOIN m USING (c) WHERE (doc_id, a) > first),
i AS (SELECT doc_id, min(pos) AS a, max(pos) + 1 AS b FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM x) GROUP BY doc_id, k),
r AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS removed_lines, sum(b - a)::BIGINT AS n FROM i GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept FROM al WHERE (doc_id, pos) NOT IN (SELECT (doc_id, pos) FROM x) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_removed_lines, coalesce(removed_lines, '') AS removed_lines,
       CASE WHEN n IS NULL THEN text ELSE coalesce(kept, '') END AS text
FROM documents LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.x = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept
FROM documents JOIN r ON r.x = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""

"""SQL for DuckDB for the queries that it can answer on whole tables of moderate size."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, (2 * i + 1)::INT, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM d)),
firsts AS (SELECT w, min(doc_id) AS first FROM win GROUP BY w),
hit AS (SELECT doc_id, i FROM win JOIN firsts USING (w) WHERE first < doc_id),
marks AS (SELECT doc_id, i, 1 AS v FROM hit UNION ALL SELECT doc_id, i + 50, -1 FROM hit),
steps AS (SELECT doc_id, i, sum(v) AS v FROM marks GROUP BY ALL),
depth AS (SELECT doc_id, i, sum(v) OVER (PARTITION BY doc_id ORDER BY i) AS n, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM steps),
gone AS (SELECT doc_id, i, j, n, lag(n, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM depth),
runs AS (SELECT doc_id, sum(CASE WHEN n > 0 THEN j - i ELSE 0 END)::BIGINT AS n_removed, sum(CASE WHEN n > 0 AND before = 0 THEN 1 ELSE 0 END)::BIGINT AS n_spans FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, (2 * i + 1)::INT, (2 * (j - i))::INT), '' ORDER BY i) AS k
  FROM (SELECT doc_id, i, j FROM gone WHERE n = 0 AND j IS NOT NULL
        UNION ALL SELECT doc_id, 0, min(i) FROM gone GROUP BY doc_id
        UNION ALL SELECT g.doc_id, max(g.i), any_value(len(h) // 2) FROM gone g JOIN d USING (doc_id) GROUP BY g.doc_id) JOIN d USING (doc_id)
  GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, {5 * k + 1}, 5))::INT >> {shift}) & 31) + 1)::INT, 1)" for k in range(8) for shift in (15, 10, 5, 0)
)
OP3 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""

_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWERED)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b),
comp AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d)),
firsts AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN firsts USING (k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

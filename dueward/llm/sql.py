"""SQL twins of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


# The same derived list as the query's; a key's interval ends with its next entry.
URL_FILTERS = r"""
WITH p AS (
  SELECT page_id, url, (page_id * 37 % 365)::INT AS day,
    regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?(/[^/?#]*)?', 1)), '^www\.', '') AS host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?(/[^/?#]*)?', 2) AS seg
  FROM pages
), k AS (
  SELECT page_id, url, day, 0 AS rank, 'domain' AS kind, array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 2, 1), len(string_split(host, '.'))), '.') AS key FROM p
  UNION ALL SELECT page_id, url, day, 1, 'host', host FROM p
  UNION ALL SELECT page_id, url, day, 2, 'path', host || seg FROM p
), d AS (
  SELECT kind, key, ('0x' || substr(md5(kind || ':' || key), 1, 4))::INT AS v FROM (SELECT DISTINCT kind, key FROM k WHERE key <> '')
), e AS (
  SELECT kind, key, v % 300 AS day, CASE WHEN v % 3 = 0 THEN 'block' ELSE 'allow' END AS action FROM d
  UNION ALL SELECT kind, key, v % 300 + 20 + v % 50, 'remove' FROM d
  UNION ALL SELECT kind, key, v % 300 + 90 + v % 70, CASE WHEN v % 5 = 0 THEN 'block' ELSE 'allow' END FROM d
), f AS (
  SELECT kind, key, day, max(action) AS action FROM e GROUP BY ALL
), i AS (
  SELECT kind, key, action, day AS first_day, lead(day) OVER (PARTITION BY kind, key ORDER BY day) AS next_day FROM f
), a AS (
  SELECT k.page_id, k.rank, k.kind, k.key, i.action,
    row_number() OVER (PARTITION BY k.page_id ORDER BY k.rank DESC) AS n, count(*) OVER (PARTITION BY k.page_id) AS n_active
  FROM k JOIN i ON k.kind = i.kind AND k.key = i.key
  WHERE i.action <> 'remove' AND i.first_day <= k.day AND (i.next_day IS NULL OR k.day < i.next_day)
)
SELECT p.page_id, p.url, p.day, coalesce(a.n_active, 0) AS n_active, coalesce(a.action = 'block', false) AS blocked,
  a.kind AS rule_kind, a.key AS rule_key
FROM p LEFT JOIN a ON p.page_id = a.page_id AND a.n = 1
"""

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents
), t AS (
  SELECT doc_id, source, n, line, trim(regexp_replace(line, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS tidy FROM l
), g AS (
  SELECT tidy FROM t WHERE tidy <> '' GROUP BY tidy HAVING count(DISTINCT coalesce('s' || source, 'null')) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(g.tidy) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (g.tidy IS NULL), '')) AS kept_sha256
FROM t LEFT JOIN g ON t.tidy = g.tidy GROUP BY doc_id
"""

RANKED_SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), i AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), z AS (
  SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d
), p AS (
  SELECT r, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL
), f AS (
  SELECT term, floor(1000 * ln((2::DOUBLE * any_value(n_docs) + 2) / (2::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, z GROUP BY term
), s AS (
  SELECT q, item_id, r, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM (SELECT q, item_id, unnest(t) AS term FROM i) JOIN f USING (term) JOIN p USING (term), z GROUP BY ALL
), k AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
"""

EXACT_TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), c AS (
  SELECT r, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM v
), s AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.r, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM c q JOIN c ON q.j = c.j AND q.r <> c.r WHERE q.vec_id % 50 = 0 GROUP BY ALL
), k AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 5
"""


def build() -> dict[str, str]:
    return {"op2_exact_dedup": EXACT_DEDUP, "op4_url_filters": URL_FILTERS, "op7_line_dedup": LINE_DEDUP,
            "op12_ranked_search": RANKED_SEARCH, "op13_exact_top_k": EXACT_TOP_K}

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def _spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
SELECT doc_id, '{kind}' AS kind, {order} AS ord, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(
  list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS n, length(v[i]) AS nv, {least} AS least
FROM (SELECT doc_id, g, m, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS g,
  regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v FROM documents
  WHERE text IS NOT NULL) WHERE len(m) > 0)"""


_RULES = [
    ("assign", """((?i:password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]

SECRET_LEDGER = f"""
WITH s AS (SELECT doc_id, kind, ord, start, kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT AS span
  FROM ({' UNION ALL '.join(_spans(k, i, p, g, least) for i, (k, p, g, least) in enumerate(_RULES))}) WHERE nv >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, coalesce(string_agg(span, ',' ORDER BY start, ord) FILTER (ord < 3), '') AS base,
  string_agg(span, ',' ORDER BY start, ord) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a USING (doc_id)
"""

URL_FILTERS = """
WITH p AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|\\.)(ads-track|adserver|doubleclick|clicktracker)\\.') OR regexp_matches(host, '(^|\\.)phish[.-]')
    OR regexp_matches(path, '/(popunder|casino-bonus)(/|\\.|$)') OR contains(path, '/banner-ads/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

def _jaccard(words: int, percent: int, columns: str) -> str:
    """Components of the documents whose sets of ``words``-word shingles are at least ``percent`` % alike."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {words} THEN
  [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {words - 2}), lambda i: array_to_string(ws[i:i + {words - 1}], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id{columns}
FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""


MINHASH = _jaccard(5, 75, ", d.doc_id = m.component_id AS kept")
NGRAM_JOIN = _jaccard(4, 85, "")

# ------------------------------------------------------------------ vectors, a row for each component
def _floor_mean(total: str, n: str) -> str:
    """floor(total / n) of integers; the remainder is made non-negative first."""
    return f"({total} - (({total} % {n}) + {n}) % {n}) // {n}"


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64"


def _zone_round(k: int) -> str:
    """Assignment to the centroids of round k, and the centroids of the next round."""
    return f"""
a{k} AS (SELECT row, c, d FROM (SELECT v.row, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{k} c USING (i) GROUP BY v.row, c.c)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1),
s{k} AS (SELECT a.c, v.i, sum(v.x) AS s, count(*) AS n FROM a{k} a JOIN v USING (row) GROUP BY a.c, v.i),
c{k + 1} AS (SELECT c.c, c.i, CASE WHEN s.n IS NULL THEN c.x ELSE {_floor_mean("s.s", "s.n")} END AS x FROM c{k} c LEFT JOIN s{k} s USING (c, i))"""


ZONE_CLUSTERS = f"""
WITH e AS (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings WHERE {_USABLE}),
v AS (SELECT row, vec_id, i, floor(64 * embedding[i]::DOUBLE)::HUGEINT AS x FROM e, range(1, 65) r(i)),
h AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id), embedding) - 1 AS c FROM e QUALIFY c < 16),
c0 AS (SELECT h.c, v.i, v.x FROM h JOIN v USING (row)),
{','.join(_zone_round(k) for k in range(4))},
g AS (SELECT c, sum(d) AS cluster_inertia FROM a3 GROUP BY c),
f AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT e.vec_id, a3.c::INTEGER AS cluster, a3.d::BIGINT AS distance, g.cluster_inertia::BIGINT AS cluster_inertia,
  (SELECT sum(d) FROM a3)::BIGINT AS inertia, f.centroid_sha256 FROM a3 JOIN e USING (row) JOIN g USING (c) JOIN f USING (c)
"""


def _code_round(k: int) -> str:
    return f"""
a{k} AS (SELECT row, p, c, d FROM (SELECT v.row, v.p, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{k} c USING (p, j)
  GROUP BY v.row, v.p, c.c) QUALIFY row_number() OVER (PARTITION BY row, p ORDER BY d, c) = 1),
s{k} AS (SELECT a.p, a.c, v.j, sum(v.x) AS s, count(*) AS n FROM a{k} a JOIN v USING (row, p) GROUP BY a.p, a.c, v.j),
c{k + 1} AS (SELECT c.p, c.c, c.j, CASE WHEN s.n IS NULL THEN c.x ELSE {_floor_mean("s.s", "s.n")} END AS x
  FROM c{k} c LEFT JOIN s{k} s USING (p, c, j))"""


ORCHARD_CODES = f"""
WITH e AS (SELECT row_number() OVER () AS row, vec_id, label, embedding FROM embeddings WHERE {_USABLE}),
v AS (SELECT row, (i - 1) // 4 AS p, (i - 1) % 4 AS j, floor(256 * embedding[i]::DOUBLE)::HUGEINT AS x FROM e, range(1, 65) r(i)),
h AS (SELECT row, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS c FROM e QUALIFY c < 64),
c0 AS (SELECT v.p, h.c, v.j, v.x FROM h JOIN v USING (row)),
{','.join(_code_round(k) for k in range(3))},
r AS (SELECT row, string_agg(printf('%02x', c), '' ORDER BY p) AS code, sum(d) AS error FROM a2 GROUP BY row),
l AS (SELECT label, sum(error) AS label_error FROM r JOIN e USING (row) GROUP BY label)
SELECT e.vec_id, r.code, r.error::BIGINT AS error, l.label_error::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, c, j)) FROM c2) AS codebooks_sha256
FROM r JOIN e USING (row) JOIN l ON l.label IS NOT DISTINCT FROM e.label
"""

ORACLE = {"op2_minhash": MINHASH, "op3_url_filters": URL_FILTERS, "op8_secret_ledger": SECRET_LEDGER, "op9_exact_dedup": EXACT_DEDUP,
          "op11_ngram_join": NGRAM_JOIN, "op12_zone_clusters": ZONE_CLUSTERS, "op13_orchard_codes": ORCHARD_CODES}

"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations

from tessera.llm.mixing import BITS, PART, SEED


def poisson_mixture() -> str:
    """Counts by summing the distribution's terms instead of stepping through it."""
    h = lambda *parts: (f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, {BITS // 4}) "  # noqa: E731
                        "AS BIGINT)")
    return f"""
WITH d AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), sha256(coalesce(text, ''))) AS k FROM documents),
size AS (SELECT source, CAST(sum(length(coalesce(text, '')) + 1) AS DOUBLE) AS size FROM documents GROUP BY source),
rate AS (SELECT source, (SELECT sum(size) / count(*) FROM size) / size AS rate FROM size),
part AS (SELECT source, rate, greatest(CAST(ceil(rate / {PART}) AS INTEGER), 1) AS parts FROM rate),
term AS (SELECT source, parts, n, exp(n * ln(rate / parts) - rate / parts - lgamma(n + 1.0)) AS p
  FROM (SELECT *, unnest(generate_series(0, CAST(rate / parts + 10 * sqrt(rate / parts) + 24 AS INTEGER))) AS n
        FROM part)),
cdf AS (SELECT source, parts, n, sum(p) OVER (PARTITION BY source ORDER BY n) AS cdf FROM term),
draw AS (SELECT d.k, d.source, u.j, ({h(str(SEED), 'u.j', 'd.k')} + 0.5) / {2 ** BITS}.0 AS u
  FROM (SELECT DISTINCT k, source FROM d) d JOIN part ON part.source IS NOT DISTINCT FROM d.source,
       LATERAL (SELECT unnest(generate_series(1, part.parts)) AS j) u),
n AS (SELECT draw.k, draw.source, count(*) AS n FROM draw
  JOIN cdf ON cdf.source IS NOT DISTINCT FROM draw.source AND cdf.cdf <= draw.u GROUP BY draw.k, draw.source)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       {h(str(SEED), "'order'", 'copy', 'k')} AS order_key
FROM (SELECT d.*, unnest(generate_series(1, n.n)) AS copy
      FROM d JOIN n ON n.k = d.k AND n.source IS NOT DISTINCT FROM d.source)"""


#: kind, pattern, group whose length counts, least length
_SECRETS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]


def secret_ledger() -> str:
    found = "\nUNION ALL ".join(
        f"""SELECT rid, {i} AS k, '{kind}' AS kind, start, start + length(hit) AS stop FROM (
  SELECT rid, hits[i] AS hit, vals[i] AS val,
         CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) AS BIGINT)
         + CAST(coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT rid, parts, hits, vals, unnest(generate_series(1, len(hits))) AS i FROM (
    SELECT rid, string_split_regex(t, '{rx}') AS parts, regexp_extract_all(t, '{rx}') AS hits,
           regexp_extract_all(t, '{rx}', {group}) AS vals FROM d)))
WHERE length(val) >= {least}""" for i, (kind, rx, group, least) in enumerate(_SECRETS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS MATERIALIZED ({found}),
s AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
             count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (rid)"""


def spherical_caps() -> str:
    """All pairs of a label and a walk over their links."""
    return """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"""


def prefix_trie() -> str:
    """Every prefix as text, grouped; subtrees by the smallest members' own prefixes."""
    poly = 0xEDB88320
    step = f"list_reduce(list_prepend(xor(crc, CAST(byte AS BIGINT)), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, {poly} * (x & 1)))"
    crc = (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), "
           f"lambda s: CAST(ord(s) AS BIGINT))), lambda crc, byte: {step}), 4294967295)")
    return f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
    coalesce(text, '')) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {crc} % 6 AS h, c - c % 100 AS b FROM (SELECT DISTINCT c FROM t)),
head AS (SELECT ids.c, t.p, role, text FROM ids JOIN t ON t.c = ids.b AND t.p < ids.h),
shift AS (SELECT ids.c, ids.h, count(head.p) AS k FROM ids LEFT JOIN head ON head.c = ids.c GROUP BY ids.c, ids.h),
seq AS (SELECT * FROM head UNION ALL
  SELECT t.c, t.p - shift.h + shift.k AS p, role, text FROM t JOIN shift ON shift.c = t.c WHERE t.p >= shift.h),
path AS (SELECT c, p + 1 AS d, length(text) AS chars, string_agg(sha256(length(role) || ':' || role || text), '')
    OVER (PARTITION BY c ORDER BY p) AS k FROM seq
  UNION ALL SELECT c, 0, 0, '' FROM ids),
size AS (SELECT c, max(d) AS n FROM path GROUP BY c),
node AS (SELECT k, d, min(path.c) AS conv_id, count(*) AS n, max(chars) AS chars,
    sha256(coalesce(string_agg(CAST(path.c AS VARCHAR), ',' ORDER BY path.c) FILTER (WHERE d = size.n), '')) AS ends
  FROM path JOIN size ON size.c = path.c GROUP BY k, d),
kids AS (SELECT left(k, length(k) - 64) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
weight AS (SELECT node.k, d, conv_id, (n - 1) * chars AS saved, kids.k IS NULL AS leaf
  FROM (SELECT * FROM node) node LEFT JOIN (SELECT k FROM kids) kids ON kids.k = node.k),
sub AS (SELECT path.k, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved
  FROM weight JOIN path ON path.c = weight.conv_id AND path.d <= weight.d GROUP BY path.k)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children,
  sub.n_leaves, sub.saved AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN sub ON sub.k = node.k LEFT JOIN kids ON kids.k = node.k
  LEFT JOIN node up ON node.d > 0 AND up.k = left(node.k, length(node.k) - 64)"""


SQL = {
    "op3_poisson_mixture": poisson_mixture(),
    "op9_secret_ledger": secret_ledger(),
    "op10_spherical_caps": spherical_caps(),
    "op11_prefix_trie": prefix_trie(),
}

"""DuckDB twins of the tree queries: each level a few grouped selects."""

from __future__ import annotations

from tessera.plans.catalog_trees import CANDIDATES, CUTS, DEPTH, RATE, SEED, TREES

DIMS = "(SELECT unnest(range((SELECT max(len(e)) FROM v))) AS f)"


def _draw(what: str) -> str:
    return (f"CAST('0x' || substr(md5(concat_ws('|', {SEED}, '{what}', tree, node, f)), 1, 13) AS BIGINT)"
            f" / CAST({2 ** 52} AS DOUBLE)")


def _levels() -> str:
    out = [f"""v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
r0 AS (SELECT v.*, tree, 1 AS node FROM v, (SELECT unnest(range({TREES})) AS tree)
  WHERE label IS NOT NULL AND e IS NOT NULL)"""]
    for i in range(DEPTH):
        out.append(f"""a{i} AS (SELECT tree, node FROM r{i} WHERE node >= {2 ** i} GROUP BY tree, node
  HAVING count(*) >= 2 AND count(DISTINCT label) > 1),
c{i} AS (SELECT tree, node, f FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY {_draw('feature')}, f) AS k
  FROM a{i}, {DIMS}) WHERE k <= {CANDIDATES}),
t{i} AS (SELECT tree, node, f, lo + {_draw('cut')} * (hi - lo) AS cut FROM (
  SELECT tree, node, f, min(e[f + 1]) AS lo, max(e[f + 1]) AS hi FROM r{i} JOIN c{i} USING (tree, node) GROUP BY ALL)),
s{i} AS (SELECT tree, node, f, cut, high, CAST(sum(n * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS score FROM (
  SELECT tree, node, f, cut, label, e[f + 1] > cut AS high, count(*) AS n FROM r{i} JOIN t{i} USING (tree, node)
  GROUP BY ALL) GROUP BY tree, node, f, cut, high),
g{i} AS (SELECT tree, node, f, cut FROM (
  SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY score DESC, f) AS k FROM (
    SELECT tree, node, f, cut, sum(score) AS score FROM s{i} GROUP BY ALL HAVING count(*) = 2)) WHERE k = 1),
r{i + 1} AS (SELECT vec_id, label, e, tree,
  CASE WHEN f IS NULL THEN node ELSE 2 * node + CAST(e[f + 1] > cut AS INTEGER) END AS node
  FROM r{i} LEFT JOIN g{i} USING (tree, node))""")
    return ",\n".join(out)


def extra_trees_nodes() -> str:
    seen = " UNION ".join(f"SELECT tree, node, count(*) AS n FROM r{i} GROUP BY tree, node" for i in range(DEPTH + 1))
    split = " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(DEPTH))
    return f"""WITH {_levels()}
SELECT tree, CAST(node AS BIGINT) AS node, f AS feature, round(cut, 9) AS threshold, n AS n_rows
FROM ({seen}) LEFT JOIN ({split}) USING (tree, node)"""


def extra_trees_classify() -> str:
    routed = "p0 AS (SELECT vec_id, e, tree, 1 AS node FROM v, (SELECT unnest(range(%d)) AS tree) WHERE e IS NOT NULL)" % TREES
    for i in range(DEPTH):
        routed += f""",
p{i + 1} AS (SELECT vec_id, e, tree, CASE WHEN f IS NULL THEN node ELSE 2 * node + CAST(e[f + 1] > cut AS INTEGER) END AS node
  FROM p{i} LEFT JOIN g{i} USING (tree, node))"""
    return f"""WITH {_levels()},
{routed},
leaf AS (SELECT tree, node, label, count(*) / sum(count(*)) OVER (PARTITION BY tree, node) AS share
  FROM r{DEPTH} GROUP BY tree, node, label),
p AS (SELECT vec_id, label, round(sum(share) / {TREES}, 9) AS p FROM p{DEPTH} JOIN leaf USING (tree, node) GROUP BY vec_id, label)
SELECT vec_id, CAST(label AS BIGINT) AS prediction, p AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS k FROM p) WHERE k = 1"""


def softmax_boost_stumps() -> str:
    return f"""
WITH v AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
k AS (SELECT label AS k, count(*) / (SELECT count(*) FROM v) AS prior, (SELECT count(DISTINCT label) FROM v) AS m FROM v GROUP BY label),
x AS (SELECT label, f, e[f + 1] AS x FROM v, {DIMS}),
cut AS (SELECT f, j, lo + (hi - lo) * (j / {CUTS + 1}.0::DOUBLE) AS cut FROM (SELECT f, min(x) AS lo, max(x) AS hi FROM x GROUP BY f),
  (SELECT unnest(range(1, {CUTS + 1})) AS j)),
side AS (SELECT k, m, f, j, cut, x > cut AS high, count(*) AS n, sum(r) AS r, sum(abs(r) * (1 - abs(r))) AS h
  FROM (SELECT k, m, x.f, x, CAST(label = k AS INTEGER) - prior AS r FROM x, k) JOIN cut USING (f) GROUP BY ALL),
sides AS (SELECT k, m, f, j, cut, sum(r * r / n) AS gain, sum(r) FILTER (NOT high) / sum(h) FILTER (NOT high) AS low,
    sum(r) FILTER (high) / sum(h) FILTER (high) AS top
  FROM side GROUP BY k, m, f, j, cut HAVING count(*) = 2)
SELECT CAST(k AS BIGINT) AS label, f AS feature, round(cut, 6) AS threshold, round({RATE} * (m - 1) / m * low, 6) AS low_value,
  round({RATE} * (m - 1) / m * top, 6) AS high_value
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gain DESC, f, j) AS place FROM sides) WHERE place = 1"""


SQL = {
    "extra_trees_nodes": extra_trees_nodes(),
    "extra_trees_classify": extra_trees_classify(),
    "softmax_boost_stumps": softmax_boost_stumps(),
}

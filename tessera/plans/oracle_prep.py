"""DuckDB twins of the preparation queries."""

from __future__ import annotations

SQL: dict[str, str] = {}

SCALE = """b AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
                 CAST(3.0 AS DOUBLE) AS const_col FROM lineitem)"""
COLS = ["l_quantity", "l_extendedprice", "l_discount", "const_col"]


def _stats(fns):
    return ", ".join(f"{fn}({c}) AS {fn}_{c}" for fn in fns for c in COLS)


SQL["standard_scale"] = f"""
WITH {SCALE}, s AS (SELECT {_stats(['avg', 'stddev_pop'])} FROM b)
SELECT l_orderkey, l_linenumber, """ + ", ".join(
    f"round(({c} - avg_{c}) / CASE WHEN stddev_pop_{c} > 0 THEN stddev_pop_{c} ELSE 1.0 END, 6) AS {c}"
    for c in COLS) + " FROM b, s"

SQL["minmax_scale"] = f"""
WITH {SCALE}, s AS (SELECT {_stats(['min', 'max'])} FROM b)
SELECT l_orderkey, l_linenumber, """ + ", ".join(
    f"round(({c} - min_{c}) / CASE WHEN max_{c} <> min_{c} THEN max_{c} - min_{c} ELSE 1.0 END"
    f" * 20.0 + -10.0, 9) AS {c}" for c in COLS) + " FROM b, s"

SQL["max_eps_scale"] = f"""
WITH {SCALE}, s AS (SELECT {_stats(['min', 'max'])} FROM b)
SELECT l_orderkey, l_linenumber, """ + ", ".join(
    f"round(({c} - min_{c}) / (max_{c} + 0.001), 9) AS {c}" for c in COLS) + " FROM b, s"

EMB_LONG = """el AS (SELECT vec_id, label, CAST(v AS DOUBLE) AS v, CAST(pos AS INTEGER) AS feature
  FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos
        FROM embeddings))"""

SQL["pixel_scale"] = f"""
WITH {EMB_LONG}
SELECT vec_id, feature AS pos, round(v / 255.0, 12) AS value FROM el"""

SQL["label_encode"] = """
SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS label_idx
FROM part"""

SQL["label_binarize"] = "SELECT vec_id, " + ", ".join(
    f"CAST(label = {k} AS INTEGER) AS is_{k}" for k in range(10)) + " FROM embeddings"

SQL["boxcox_transform"] = """
SELECT l_orderkey, l_linenumber,
       round((pow(l_quantity + 1.0, 0.5) - 1.0) / 0.5, 9) AS bc_qty,
       round(ln(l_extendedprice + 1.0), 9) AS bc_price
FROM lineitem"""


def _bc(c, lam):
    if lam == 0:
        return f"ln({c} + 1.0)"
    return f"(pow({c} + 1.0, {lam}) - 1.0) / {lam}"


def _boxcox_loglik():
    parts = []
    for c in ["l_quantity", "l_extendedprice", "l_tax"]:
        for lam in [-1.0, -0.5, 0.0, 0.5, 1.0, 2.0]:
            parts.append(
                f"SELECT '{c}' AS attribute, CAST({lam} AS DOUBLE) AS lambda, "
                f"round(({lam} - 1.0) * sum(ln({c} + 1.0)) - count(*) / 2.0 * ln(var_pop({_bc(c, lam)})), 3)"
                f" AS llf FROM lineitem")
    return "\nUNION ALL\n".join(parts)


SQL["boxcox_loglik"] = _boxcox_loglik()

# the optimum by halving, on the slope as a difference quotient's limit: z and its derivative
SQL["boxcox_fit"] = """
WITH RECURSIVE x AS (SELECT c, ln(v + 1.0) - avg(ln(v + 1.0)) OVER (PARTITION BY c) AS u FROM (
  SELECT 'l_quantity' AS c, CAST(l_quantity AS DOUBLE) AS v FROM lineitem UNION ALL
  SELECT 'l_extendedprice', CAST(l_extendedprice AS DOUBLE) FROM lineitem UNION ALL
  SELECT 'l_tax', CAST(l_tax AS DOUBLE) FROM lineitem)),
s AS (SELECT c, CAST(-8.1 AS DOUBLE) AS lo, CAST(8.3 AS DOUBLE) AS hi, 0 AS i FROM (SELECT DISTINCT c FROM x)
  UNION ALL
  SELECT c, CASE WHEN cov < 0 THEN mid ELSE lo END, CASE WHEN cov < 0 THEN hi ELSE mid END, i + 1 FROM (
    SELECT s.c, lo, hi, i, (lo + hi) / 2 AS mid, (SELECT covar_pop((exp(m * u) - 1) / m, (exp(m * u) * (m * u - 1) + 1) / (m * m))
      FROM (SELECT u, (s.lo + s.hi) / 2 AS m FROM x WHERE x.c = s.c)) AS cov FROM s WHERE i < 40))
SELECT c AS attribute, round((lo + hi) / 2, 6) AS lambda FROM s WHERE i = 40"""

SQL["tfidf_counts"] = """
WITH c AS (SELECT o_custkey, o_orderpriority AS term, count(*) AS tf FROM orders GROUP BY 1, 2),
n AS (SELECT count(DISTINCT o_custkey) AS n FROM c),
idf AS (SELECT term, ln((1.0 + n) / (count(*) + 1.0)) + 1.0 AS idf FROM c, n GROUP BY term, n),
w AS (SELECT o_custkey, term, tf * idf AS w FROM c JOIN idf USING (term))
SELECT o_custkey, term,
       round(CASE WHEN sqrt(sum(w * w) OVER (PARTITION BY o_custkey)) > 0
             THEN w / sqrt(sum(w * w) OVER (PARTITION BY o_custkey)) ELSE 0.0 END, 9) AS weight
FROM w"""

SQL["tfidf_text"] = r"""
WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term
              FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term),
vocab AS (SELECT term FROM (SELECT term, sum(tf) AS tot FROM c GROUP BY term)
          ORDER BY tot DESC, term LIMIT 10000),
cv AS (SELECT c.* FROM c JOIN vocab USING (term)),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1.0 + n) / (count(*) + 1.0)) + 1.0 AS idf FROM cv, n GROUP BY term, n),
w AS (SELECT doc_id, term, tf * idf AS w FROM cv JOIN idf USING (term))
SELECT doc_id, term,
       round(CASE WHEN sqrt(sum(w * w) OVER (PARTITION BY doc_id)) > 0
             THEN w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) ELSE 0.0 END, 9) AS weight
FROM w"""

ANOVA = f"""{EMB_LONG},
g AS (SELECT feature, label, count(*) AS n, sum(v) AS s, sum(v * v) AS ss FROM el GROUP BY 1, 2),
p AS (SELECT feature, sum(n) AS NN, count(*) AS k, sum(s) AS S, sum(ss) AS SS,
             sum(s * s / n) AS B FROM g GROUP BY feature),
f AS (SELECT feature, round(((B - S * S / NN) / (k - 1)) / ((SS - B) / (NN - k)), 6) AS f_score
      FROM p)"""

SQL["anova_f_scores"] = f"WITH {ANOVA}\nSELECT feature, f_score FROM f"

SQL["select_k_best"] = f"""WITH {ANOVA}
SELECT feature, f_score, rank FROM (
  SELECT feature, f_score,
         CAST(row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature) AS INTEGER) AS rank
  FROM f) WHERE rank <= 5"""

SQL["bernoulli_nb_counts"] = f"""
WITH {EMB_LONG}, t AS (SELECT count(*) AS N FROM embeddings)
SELECT label, feature, round(ln((n_pos + 1.0) / (n_class + 2.0)), 9) AS log_prob,
       round(ln(n_class / CAST(N AS DOUBLE)), 9) AS log_prior
FROM (SELECT label, feature, count(*) AS n_class, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS n_pos
      FROM el GROUP BY 1, 2), t"""

SQL["gaussian_nb_stats"] = f"""
WITH {EMB_LONG}, t AS (SELECT count(*) AS N FROM embeddings)
SELECT label, feature, round(avg(v), 9) AS mean, round(var_pop(v), 9) AS var,
       round(count(*) / CAST(any_value(N) AS DOUBLE), 9) AS prior
FROM el, t GROUP BY label, feature"""

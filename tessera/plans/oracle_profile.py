"""DuckDB twins of the profiling queries (generated from the fixture lists)."""

from __future__ import annotations

from tessera.plans.fixtures import (CORR_COLUMNS, PROFILE_COLUMNS, corr_select_sql,
                                    profile_select_sql)

FLOATING = {"double", "float"}
NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"

P = f"WITH p AS (SELECT {profile_select_sql()} FROM lineitem)\n"


def _missing(name, t):
    return f"({name} IS NULL OR isnan({name}))" if t in FLOATING else f"({name} IS NULL)"


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def null_profile():
    return P + _union([
        f"SELECT '{n}' AS attribute, CAST(sum(CASE WHEN {_missing(n, t)} THEN 1 ELSE 0 END) "
        f"AS DOUBLE) / count(*) AS null_frac FROM p" for n, t, _ in PROFILE_COLUMNS])


def _inf_count(n, t):
    if t in FLOATING:
        return f"CAST(sum(CASE WHEN abs({n}) = CAST('Infinity' AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT)"
    if t in ("int", "bigint"):
        return "CAST(0 AS BIGINT)"
    return "CAST(NULL AS BIGINT)"


def inf_profile():
    return P + _union([
        f"SELECT '{n}' AS attribute, CAST({_inf_count(n, t)} AS DOUBLE) / count(*) AS inf_frac FROM p"
        for n, t, _ in PROFILE_COLUMNS if t != "string"])


def null_inf_profile():
    return P + _union([
        f"SELECT '{n}' AS attribute, CAST(sum(CASE WHEN {_missing(n, t)} THEN 1 ELSE 0 END) "
        f"AS DOUBLE) / count(*) AS null_frac, CAST({_inf_count(n, t)} AS DOUBLE) / count(*) AS inf_frac "
        f"FROM p" for n, t, _ in PROFILE_COLUMNS])


def null_columns():
    return P + "SELECT attribute FROM (" + _union([
        f"SELECT '{n}' AS attribute, CAST(sum(CASE WHEN {_missing(n, t)} THEN 1 ELSE 0 END) "
        f"AS DOUBLE) / count(*) AS f FROM p" for n, t, _ in PROFILE_COLUMNS]) + ") WHERE f >= 0.8"


def _nn(n, t):
    return f"CASE WHEN isnan({n}) THEN NULL ELSE {n} END" if t in FLOATING else n


def uninformative_columns():
    return P + "SELECT attribute FROM (" + _union([
        f"SELECT '{n}' AS attribute, count(DISTINCT {_nn(n, t)}) AS k FROM p"
        for n, t, _ in PROFILE_COLUMNS]) + ") WHERE k = 1"


def binary_columns():
    parts = []
    for n, t, _ in PROFILE_COLUMNS:
        v = _nn(n, t)
        if t == "string":
            cond = f"{v} IS NOT NULL"
        else:
            cond = f"{v} IS NOT NULL AND {v} NOT IN (0, 1)"
        parts.append(f"SELECT '{n}' AS attribute, count(*) FILTER (WHERE {cond}) AS bad FROM p")
    return P + "SELECT attribute FROM (" + _union(parts) + ") WHERE bad = 0"


def _blank(n, t):
    if t in FLOATING:
        return f"({n} IS NULL OR isnan({n}))"
    if t == "string":
        return f"({n} IS NULL OR {n} = '')"
    return f"({n} IS NULL)"


def _num(n, t):
    if t == "string":
        return (f"CASE WHEN regexp_full_match({n}, '{NUMERIC_TEXT}') "
                f"THEN TRY_CAST(trim({n}) AS DOUBLE) END")
    return f"CAST({n} AS DOUBLE)"


def _finite(x):
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def column_summary():
    parts = []
    for n, t, _ in PROFILE_COLUMNS:
        b, num = _blank(n, t), _num(n, t)
        parts.append(
            f"SELECT '{n}' AS attribute,"
            f" count(*) AS n_rows,"
            f" count(*) FILTER (WHERE {b}) AS n_null,"
            f" count(*) FILTER (WHERE NOT {b} AND ({num}) IS NULL) AS bad,"
            f" min(CASE WHEN NOT {b} THEN {num} END) AS lo,"
            f" max(CASE WHEN NOT {b} THEN {num} END) AS hi,"
            f" count(DISTINCT CASE WHEN NOT {b} THEN {n} END) AS nd FROM p")
    return P + ("SELECT attribute, CASE WHEN bad = 0 THEN " + _finite("lo") + " END AS min,"
                " CASE WHEN bad = 0 THEN " + _finite("hi") + " END AS max,"
                " n_null, CAST(nd + CASE WHEN n_null > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_uniq,"
                " CAST(n_null AS DOUBLE) / n_rows AS perc_null, n_rows FROM (" + _union(parts) + ")")


def column_summary_capped(cap: int = 1000):
    parts = []
    for n, t, _ in PROFILE_COLUMNS:
        s = f"trim(CAST({n} AS VARCHAR))"
        b = f"({s} IS NULL OR {s} = '')"
        num = (f"CASE WHEN regexp_full_match({s}, '{NUMERIC_TEXT}') "
               f"THEN TRY_CAST({s} AS DOUBLE) END")
        parts.append(
            f"SELECT '{n}' AS attribute, count(*) AS n_rows,"
            f" count(*) FILTER (WHERE {b}) AS n_null,"
            f" count(*) FILTER (WHERE NOT {b} AND ({num}) IS NULL) AS bad,"
            f" min(CASE WHEN NOT {b} THEN {num} END) AS lo,"
            f" max(CASE WHEN NOT {b} THEN {num} END) AS hi,"
            f" count(DISTINCT CASE WHEN NOT {b} THEN {num} END) AS nd_num,"
            f" count(DISTINCT CASE WHEN NOT {b} THEN {s} END) AS nd_txt FROM p")
    total = ("(CASE WHEN bad = 0 THEN nd_num ELSE nd_txt END"
             " + CASE WHEN n_null > 0 THEN 1 ELSE 0 END)")
    return P + ("SELECT attribute, CASE WHEN bad = 0 THEN " + _finite("lo") + " END AS min,"
                " CASE WHEN bad = 0 THEN " + _finite("hi") + " END AS max, n_null,"
                f" CASE WHEN {total} > {cap} THEN '> {cap}' ELSE CAST({total} AS VARCHAR) END AS n_uniq,"
                " CAST(n_null AS DOUBLE) / n_rows AS perc_null, n_rows FROM (" + _union(parts) + ")")


def label_counts():
    return "SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY l_returnflag"


def value_counts():
    return "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY o_orderpriority"


def value_counts_long():
    cols = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]
    return ("SELECT attribute, value, count(*) AS n FROM (" + _union([
        f"SELECT '{c}' AS attribute, CAST({c} AS VARCHAR) AS value FROM lineitem" for c in cols])
        + ") WHERE value IS NOT NULL GROUP BY attribute, value")


def class_distribution():
    return ("SELECT label, n, n / sum(n) OVER () AS frac FROM ("
            "SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1)")


def distinct_labels():
    return "SELECT DISTINCT p_brand AS label FROM part"


def table_equal():
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    values = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
              "l_linestatus", "l_shipdate"]
    numeric = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}

    def r(side, c):
        return f"round_even({side}.{c}, 2)" if c in numeric else f"{side}.{c}"
    diff = " OR ".join(f"NOT ({r('a', c)} IS NOT DISTINCT FROM {r('b', c)})" for c in values)
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return f"""
WITH a AS (SELECT * FROM lineitem),
b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
        CASE WHEN l_discount = 0.05 AND l_returnflag = 'A' THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
        l_extendedprice + 0.004 AS l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
      FROM lineitem)
SELECT n_left, n_right, n_diff, (n_left = n_right AND n_diff = 0) AS equal FROM (
  SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right,
         count(*) FILTER (WHERE a.l_orderkey IS NULL OR b.l_orderkey IS NULL OR {diff}) AS n_diff
  FROM a FULL OUTER JOIN b ON {on})"""


C = f"WITH c AS (SELECT {corr_select_sql()} FROM lineitem)\n"


def _corr_pairs_sql():
    names = [n for n, _ in CORR_COLUMNS]
    parts = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            va = f"var_pop({a}) FILTER (WHERE {both})"
            vb = f"var_pop({b}) FILTER (WHERE {both})"
            if i == j:
                expr = f"CASE WHEN {va} > 0 THEN 1.0 END"
            else:
                expr = (f"CASE WHEN {va} > 0 AND {vb} > 0 THEN covar_pop({a}, {b}) / "
                        f"sqrt({va} * {vb}) END")
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, CAST({expr} AS DOUBLE) AS corr FROM c")
    return _union(parts)


def correlation_matrix():
    return C + "SELECT a, b, round(corr, 9) AS corr FROM (" + _corr_pairs_sql() + ")"


def correlation_spearman():
    """Ranks are taken anew over the common rows of every pair."""
    names = [n for n, _ in CORR_COLUMNS]
    parts = []
    for i, a in enumerate(names):
        for b in names[i:]:
            both = f"SELECT {a} AS x, {b} AS y FROM c WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
            rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
            expr = ("CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN "
                    "covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END")
            for l, r in {(a, b), (b, a)}:
                parts.append(f"SELECT '{l}' AS a, '{r}' AS b, CAST({expr} AS DOUBLE) AS corr FROM (SELECT "
                             f"{rank.format('x')} AS x, {rank.format('y')} AS y FROM ({both}))")
    return C + "SELECT a, b, round(corr, 9) AS corr FROM (" + _union(parts) + ")"


def correlation_kendall():
    cols = {"nation": "CAST(s_nationkey AS DOUBLE)", "balance": "s_acctbal",
            "sparse": "CASE WHEN s_nationkey % 3 <> 0 THEN CAST(floor(s_acctbal / 1000) AS DOUBLE) END"}
    parts = []
    for a in cols:
        for b in cols:
            parts.append(
                f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN sum(abs(sign(p.{a} - q.{a}))) > 0 "
                f"AND sum(abs(sign(p.{b} - q.{b}))) > 0 THEN sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) "
                f"/ sqrt(sum(abs(sign(p.{a} - q.{a}))) * sum(abs(sign(p.{b} - q.{b})))) END AS corr "
                f"FROM s p JOIN s q ON p.{a} IS NOT NULL AND p.{b} IS NOT NULL "
                f"AND q.{a} IS NOT NULL AND q.{b} IS NOT NULL")
    select = ", ".join(f"{e} AS {n}" for n, e in cols.items())
    return (f"WITH s AS (SELECT {select} FROM supplier)\nSELECT a, b, round(CAST(corr AS DOUBLE), 9) AS corr FROM ("
            + _union(parts) + ")")


def value_index():
    parts = [f"SELECT {i} AS col, '{c}' AS attribute, {c} AS value, count(*) AS n FROM lineitem "
             f"WHERE {c} IS NOT NULL GROUP BY {c}" for i, c in enumerate(["l_linestatus", "l_returnflag"])]
    return ("SELECT row_number() OVER (ORDER BY col, n DESC, value) AS place, attribute, value, n FROM ("
            + _union(parts) + ")")


def row_ids():
    return ("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_id "
            "FROM orders")


def table_equal_unkeyed():
    li = "SELECT * FROM lineitem"
    moved = ("SELECT * REPLACE (l_extendedprice + 0.004 AS l_extendedprice, CASE WHEN "
             "l_discount = 0.05 AND l_returnflag = 'A' THEN l_quantity + 1 ELSE l_quantity END AS l_quantity) "
             "FROM lineitem")
    r2 = "round_even"
    nums = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    norm = ", ".join(f"{r2}(CAST({c} AS DOUBLE), 2) AS {c}" for c in nums)
    return (f"WITH l AS (SELECT * REPLACE ({norm}) FROM ({li})), r AS (SELECT * REPLACE ({norm}) FROM ({moved})),\n"
            "a AS (SELECT count(*) AS k FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r)),\n"
            "b AS (SELECT count(*) AS k FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l))\n"
            "SELECT (SELECT count(*) FROM l) AS n_left, (SELECT count(*) FROM r) AS n_right, a.k AS n_only_left, "
            "b.k AS n_only_right, a.k = 0 AND b.k = 0 AS equal FROM a, b")


def _clusters_cte(thresh=0.95):
    names = [n for n, _ in CORR_COLUMNS]
    vals = ", ".join(f"('{n}', {i})" for i, n in enumerate(names))
    return f"""WITH RECURSIVE c AS (SELECT {corr_select_sql()} FROM lineitem),
pairs AS ({_corr_pairs_sql()}),
cols(name, pos) AS (VALUES {vals}),
edges AS (SELECT a, b FROM pairs WHERE a <> b AND corr >= {thresh}),
reach(src, dst) AS (
  SELECT name, name FROM cols
  UNION
  SELECT r.src, e.b FROM reach r JOIN edges e ON r.dst = e.a),
comp AS (SELECT r.src AS attribute, min(k.pos) AS root FROM reach r JOIN cols k ON k.name = r.dst
         GROUP BY r.src),
clusters AS (SELECT CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS cluster, attribute
             FROM comp)
"""


def feature_clusters():
    return _clusters_cte() + "SELECT cluster, attribute FROM clusters"


def important_features():
    names = [n for n, _ in CORR_COLUMNS]
    imp = _union([
        f"SELECT '{n}' AS attribute, round(coalesce(stddev_pop({n}) / (abs(avg({n})) + 1), 0.0), 9)"
        f" AS importance FROM c" for n in names])
    return _clusters_cte() + f""",
imp AS ({imp}),
ranked AS (SELECT attribute, importance,
           row_number() OVER (ORDER BY importance DESC, attribute) AS rank FROM imp),
j AS (SELECT r.attribute, r.rank, k.cluster,
      row_number() OVER (PARTITION BY k.cluster ORDER BY r.rank) AS kk
      FROM ranked r JOIN clusters k USING (attribute))
SELECT attribute, CAST(rank AS INTEGER) AS rank, cluster FROM j WHERE kk = 1"""


SQL = {name: fn() for name, fn in [
    ("null_profile", null_profile), ("inf_profile", inf_profile),
    ("null_inf_profile", null_inf_profile), ("null_columns", null_columns),
    ("uninformative_columns", uninformative_columns), ("binary_columns", binary_columns),
    ("column_summary", column_summary), ("column_summary_capped", column_summary_capped),
    ("label_counts", label_counts), ("value_counts", value_counts),
    ("value_counts_long", value_counts_long), ("class_distribution", class_distribution),
    ("distinct_labels", distinct_labels), ("table_equal", table_equal),
    ("correlation_matrix", correlation_matrix), ("correlation_spearman", correlation_spearman),
    ("correlation_kendall", correlation_kendall), ("value_index", value_index), ("row_ids", row_ids),
    ("table_equal_unkeyed", table_equal_unkeyed),
    ("feature_clusters", feature_clusters),
    ("important_features", important_features),
]}

"""DuckDB twins of the feature, metric, split and ensemble queries."""

from __future__ import annotations

from itertools import combinations

SQL: dict[str, str] = {}

SQL["opposite_bearing"] = """
SELECT l_orderkey, l_linenumber, b AS bearing,
       CASE WHEN b + 180 > 360 THEN b - 180 ELSE b + 180 END AS opposite
FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 361 AS DOUBLE) AS b FROM lineitem)"""

SQL["negative_flag"] = "SELECT c_custkey, c_acctbal, c_acctbal < 0 AS is_negative FROM customer"

SQL["linear_feature"] = """
SELECT l_orderkey, l_linenumber, round(l_extendedprice - 1.0 * l_quantity, 6) AS diff,
       round(l_extendedprice - 0.2 * l_quantity, 6) AS diff_w FROM lineitem"""

SQL["euclid_feature"] = """
SELECT l_orderkey, l_linenumber,
       round(sqrt(l_quantity * l_quantity + (l_discount * 100) * (l_discount * 100)), 9) AS dist
FROM lineitem"""


def _pairwise():
    cols = ["qty", "tax_pct", "disc_pct"]
    exprs = []
    for a, b in combinations(cols, 2):
        exprs += [f"round({a} + {b}, 6) AS {a}_{b}_sum",
                  f"round(abs({a} + {b}), 6) AS {a}_{b}_abs_sum",
                  f"round(abs({a} - {b}), 6) AS {a}_{b}_abs_diff"]
    return (f"SELECT l_orderkey, l_linenumber, {', '.join(exprs)} FROM ("
            "SELECT l_orderkey, l_linenumber, l_quantity AS qty, l_tax * 100 AS tax_pct, "
            "l_discount * 100 AS disc_pct FROM lineitem)")


SQL["pairwise_features"] = _pairwise()

SQL["label_suffix"] = """
SELECT p_partkey, p_brand, TRY_CAST(right(p_brand, 1) AS INTEGER) AS suffix FROM part"""

SQL["datetime_features"] = """
SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour,
       CAST(year(ts) - 2011 AS INTEGER) AS year_off, CAST(day(ts) AS INTEGER) AS day
FROM events"""

SQL["blocked_day_folds"] = """
WITH d AS (SELECT day(ts) AS day, count(*) AS n, sum(value) AS s FROM events GROUP BY 1),
f AS (SELECT CAST(range AS INTEGER) AS fold FROM range(10, 19)),
t AS (SELECT f.fold, sum(d.n) AS n_test, sum(d.s) AS s_test
      FROM f JOIN d ON d.day = f.fold OR d.day = f.fold + 1 GROUP BY f.fold),
tot AS (SELECT sum(n) AS n_all, sum(s) AS s_all FROM d)
SELECT fold, CAST(n_test AS BIGINT) AS n_test, CAST(n_all - n_test AS BIGINT) AS n_train,
       round(s_test / n_test, 6) AS mean_test,
       round((s_all - s_test) / (n_all - n_test), 6) AS mean_train
FROM t, tot"""

SQL["minmax_stretch"] = """
SELECT l_orderkey, l_linenumber,
       round((l_extendedprice - lo) / (hi - lo), 9) AS stretch
FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)"""

SQL["log_target_roundtrip"] = """
SELECT event_id, round(ln(1 + value), 9) AS log_y, round(exp(ln(1 + value)) - 1, 9) AS back
FROM events"""

EMB_LONG = """el AS (SELECT vec_id, label, CAST(v AS DOUBLE) AS v, CAST(pos AS INTEGER) AS pos
  FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos
        FROM embeddings))"""

SQL["threshold_values"] = f"""
WITH {EMB_LONG}
SELECT vec_id, pos, round(CASE WHEN x < 0.15 THEN 0.0 WHEN x >= 0.8 THEN 1.0 ELSE x END, 9) AS value
FROM (SELECT vec_id, pos, (v + 0.6) / 1.2 AS x FROM el)"""

SQL["activation_table"] = """
SELECT l_orderkey, l_linenumber, round(x, 9) AS x,
  round(1.0 / (1.0 + exp(-1.0 * x)), 9) AS sigmoid,
  round(tanh(x), 9) AS tanh,
  round(sin(x), 9) AS sine,
  round(greatest(x, 0.0), 9) AS relu,
  round(greatest(0.0, least(1.0, 1.0 - abs(x))), 9) AS tribas,
  round(CAST(x > 0 AS DOUBLE), 9) AS hardlim,
  round(exp(-1.0 * x * x), 9) AS gaussian,
  round(sqrt(1.0 + (1.0 * x) * (1.0 * x)), 9) AS multiquadric,
  round(pow(abs(x) + 1e-8, 2.0) * ln(abs(x) + 1e-8), 9) AS polyharmonic
FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 25.5) / 10.0 AS x FROM lineitem)"""

SQL["softmax_rows"] = f"""
WITH {EMB_LONG},
e AS (SELECT vec_id, pos, exp(v - max(v) OVER (PARTITION BY vec_id)) AS ex FROM el)
SELECT vec_id, pos, round(ex / sum(ex) OVER (PARTITION BY vec_id), 9) AS p FROM e"""

SQL["argmax_class"] = """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax
FROM embeddings"""

SCORED = """s AS (SELECT y, p, CAST(p >= 0.5 AS INTEGER) AS yhat FROM (
  SELECT l.quality AS y,
         1.0 / (1.0 + exp(-1.0 * ((ln(CAST(d.n_chars AS DOUBLE)) - 7.0) / 2.0))) AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id))"""

SQL["log_loss_binary"] = f"""
WITH {SCORED}
SELECT round(-avg(y * ln(pc) + (1.0 - y) * ln(1.0 - pc)), 9) AS log_loss, count(*) AS n
FROM (SELECT CAST(y AS DOUBLE) AS y, least(greatest(p, 1e-15), 1 - 1e-15) AS pc FROM s)"""

SQL["confusion_matrix"] = f"""
WITH {SCORED}
SELECT y AS actual, yhat AS predicted, count(*) AS n FROM s GROUP BY y, yhat"""

SQL["accuracy"] = f"""
WITH {SCORED}
SELECT round(avg(CASE WHEN y = yhat THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 9)
       AS accuracy, count(*) AS n FROM s"""

SQL["classification_report"] = """
WITH e AS (SELECT vec_id, label, CAST(list_position(lg, list_max(lg)) - 1 AS INTEGER) AS pred
           FROM (SELECT vec_id, label, embedding AS lg FROM embeddings)),
truth AS (SELECT label, count(*) AS support, sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS tp
          FROM e GROUP BY label),
pr AS (SELECT pred AS label, count(*) AS n_pred FROM e GROUP BY pred),
j AS (SELECT coalesce(t.label, p.label) AS label, CAST(coalesce(t.tp, 0) AS DOUBLE) AS tp,
             coalesce(t.support, 0) AS support, coalesce(p.n_pred, 0) AS n_pred
      FROM truth t FULL OUTER JOIN pr p ON t.label = p.label),
k AS (SELECT label, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS prec,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec, support FROM j)
SELECT label, round(prec, 9) AS precision, round(rec, 9) AS recall,
       round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END, 9) AS f1,
       CAST(support AS BIGINT) AS support
FROM k"""

SQL["log_loss_multi"] = """
WITH el AS (SELECT vec_id, label, CAST(v AS DOUBLE) AS v, CAST(pos AS INTEGER) AS pos
  FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos
        FROM embeddings)),
e AS (SELECT vec_id, label, pos, exp(v - max(v) OVER (PARTITION BY vec_id)) AS ex FROM el),
p AS (SELECT vec_id, label, pos, ex / sum(ex) OVER (PARTITION BY vec_id) AS p FROM e)
SELECT round(-avg(ln(least(greatest(p, 1e-15), 1 - 1e-15))), 9) AS log_loss, count(*) AS n
FROM p WHERE pos = label"""

SQL["rmsle"] = """
SELECT round(sqrt(avg(d * d)), 9) AS rmsle, count(*) AS n FROM (
  SELECT ln(pred + 1) - ln(round_even(y0 + y1 + 1, 0)) AS d FROM (
    SELECT l_extendedprice / 1000.0 AS pred, l_quantity AS y0, l_tax * 100 AS y1 FROM lineitem))"""

SQL["stratified_folds"] = """
SELECT vec_id, label,
       CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 AS INTEGER) AS fold
FROM embeddings"""

SQL["stratified_holdout"] = """
SELECT vec_id, label, rn <= floor(n * 0.15) AS is_train FROM (
  SELECT vec_id, label,
         row_number() OVER (PARTITION BY label ORDER BY (vec_id * 2654435761 + 17) % 4294967291,
                            vec_id) AS rn,
         count(*) OVER (PARTITION BY label) AS n
  FROM embeddings)"""

SQL["holdout_split"] = """
SELECT doc_id, ((doc_id * 2654435761 + 7) % 4294967291) % 1000 < 300 AS is_test FROM labels"""

OOF = """f AS (SELECT vec_id, label, embedding,
        CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 AS INTEGER) AS fold
      FROM embeddings),
el AS (SELECT vec_id, label, fold, CAST(v AS DOUBLE) AS v, CAST(pos AS INTEGER) AS pos
  FROM (SELECT vec_id, label, fold, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos
        FROM f)),
s AS (SELECT fold, label, pos, sum(v) AS s, count(*) AS n FROM el GROUP BY fold, label, pos),
t AS (SELECT label, pos, sum(s) AS ts, sum(n) AS tn FROM s GROUP BY label, pos),
fs AS (SELECT DISTINCT fold FROM f),
m AS (SELECT fs.fold, t.label, t.pos, (t.ts - coalesce(s.s, 0)) / (t.tn - coalesce(s.n, 0)) AS mu
      FROM fs CROSS JOIN t
      LEFT JOIN s ON s.fold = fs.fold AND s.label = t.label AND s.pos = t.pos
      WHERE t.tn - coalesce(s.n, 0) > 0),
d AS (SELECT el.vec_id, el.label AS y, el.fold, m.label AS c,
        sum((el.v - m.mu) * (el.v - m.mu)) AS d_all,
        sum(CASE WHEN el.pos < 32 THEN (el.v - m.mu) * (el.v - m.mu) ELSE 0 END) AS d_first_half,
        sum(CASE WHEN el.pos >= 32 THEN (el.v - m.mu) * (el.v - m.mu) ELSE 0 END) AS d_second_half
      FROM el JOIN m ON m.fold = el.fold AND m.pos = el.pos
      GROUP BY el.vec_id, el.label, el.fold, m.label),
preds AS (SELECT vec_id, y, fold,
        first(c ORDER BY d_all, c) AS p_all,
        first(c ORDER BY d_first_half, c) AS p_first_half,
        first(c ORDER BY d_second_half, c) AS p_second_half
      FROM d GROUP BY vec_id, y, fold)"""

SQL["oof_matrix"] = f"""
WITH {OOF}
SELECT vec_id, y AS label, fold, p_all AS pred_all, p_first_half AS pred_first_half,
       p_second_half AS pred_second_half FROM preds"""

SQL["soft_vote"] = f"""
WITH {OOF},
pm AS (SELECT vec_id, c,
         exp(min(d_all) OVER w - d_all) AS ea,
         exp(min(d_first_half) OVER w - d_first_half) AS eh,
         exp(min(d_second_half) OVER w - d_second_half) AS es
       FROM d WINDOW w AS (PARTITION BY vec_id)),
pp AS (SELECT vec_id, c, (ea / sum(ea) OVER w + eh / sum(eh) OVER w + es / sum(es) OVER w) / 3 AS p
       FROM pm WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, first(c ORDER BY p DESC, c) AS pred, round(max(p), 6) AS p_max
FROM pp GROUP BY vec_id"""

SQL["majority_vote"] = f"""
WITH {OOF},
v AS (SELECT vec_id, p_all AS v FROM preds UNION ALL SELECT vec_id, p_first_half FROM preds
      UNION ALL SELECT vec_id, p_second_half FROM preds),
vc AS (SELECT vec_id, v, count(*) AS n FROM v GROUP BY vec_id, v)
SELECT vec_id, first(v ORDER BY n DESC, v) AS vote FROM vc GROUP BY vec_id"""

SCORES = f"""{OOF},
sc AS (
  SELECT 'all' AS title, fold, avg(CAST(p_all = y AS DOUBLE)) AS score FROM preds GROUP BY fold
  UNION ALL
  SELECT 'first_half', fold, avg(CAST(p_first_half = y AS DOUBLE)) FROM preds GROUP BY fold
  UNION ALL
  SELECT 'second_half', fold, avg(CAST(p_second_half = y AS DOUBLE)) FROM preds GROUP BY fold),
summary AS (SELECT title, round(avg(score), 9) AS mean, round(max(score), 9) AS max,
       round(min(score), 9) AS min, round(stddev_pop(score), 9) AS std FROM sc GROUP BY title)"""

SQL["score_summary"] = f"WITH {SCORES}\nSELECT * FROM summary"

SQL["top_models"] = f"""WITH {SCORES}
SELECT title, mean, rank FROM (
  SELECT title, mean, CAST(row_number() OVER (ORDER BY mean DESC, title) AS INTEGER) AS rank
  FROM summary) WHERE rank <= 2"""

_VECTORS = """WITH e AS (SELECT vec_id, CAST(v AS DOUBLE) AS v, CAST(pos AS INTEGER) AS pos
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings))"""

SQL["pca_covariance"] = f"""{_VECTORS}
SELECT a.pos AS i, b.pos AS j, round(covar_pop(a.v, b.v), 9) AS cov
FROM e a JOIN e b USING (vec_id) GROUP BY a.pos, b.pos"""

SQL["elm_gram_sums"] = f"""{_VECTORS},
h AS (SELECT vec_id, unit, tanh(sum(v * sin(7 * pos + 3 * unit + 1))) AS h
      FROM e, (SELECT CAST(unnest(range(6)) AS INTEGER) AS unit) GROUP BY vec_id, unit)
SELECT a.unit AS i, b.unit AS j, round(sum(a.h * b.h), 6) AS hh
FROM h a JOIN h b USING (vec_id) GROUP BY a.unit, b.unit"""

SQL["loo_ridge_errors"] = f"""{_VECTORS},
h AS (SELECT vec_id, tanh(sum(v * sin(7 * pos + 1))) AS h FROM e GROUP BY vec_id),
c AS (SELECT vec_id, h - avg(h) OVER () AS h, count(*) OVER () AS n FROM h),
y AS (SELECT vec_id, pos, v - avg(v) OVER (PARTITION BY pos) AS y FROM e),
g AS (SELECT pos, sum(h * h) AS w, sum(h * y) AS hy FROM c JOIN y USING (vec_id) GROUP BY pos),
a AS (SELECT unnest([0.01, 1.0, 100.0, 10000.0]::DOUBLE[]) AS alpha)
SELECT alpha, round(avg(power((y - h * hy / (w + alpha)) / (1 - 1.0::DOUBLE / n - h * h / (w + alpha)), 2)), 9) AS error
FROM c JOIN y USING (vec_id) JOIN g USING (pos), a GROUP BY alpha"""

SQL["sample_rows"] = """
SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (
  ORDER BY CAST('0x' || substr(md5('7|' || event_id), 1, 15) AS BIGINT), event_id) AS k FROM events) WHERE k <= 1000"""

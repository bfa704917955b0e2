"""DuckDB twins of the image, neighbour and hidden-layer queries."""

from __future__ import annotations

import numpy as np

SQL: dict[str, str] = {}

EL = """el AS (SELECT vec_id, label, CAST(v AS DOUBLE) AS v, CAST(pos AS INTEGER) AS pos
  FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos
        FROM embeddings))"""

FOLDS = """f AS (SELECT vec_id, label, embedding,
        CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 AS INTEGER) AS fold
      FROM embeddings)"""


def _shifted(src, offsets):
    vals = ", ".join(f"('{n}', {dr}, {dc})" for n, dr, dc in offsets)
    return f"""SELECT e.vec_id, e.label, s.shift, CAST(p.pos AS INTEGER) AS pos,
       CASE WHEN p.pos // 8 + s.dr BETWEEN 0 AND 7 AND p.pos % 8 + s.dc BETWEEN 0 AND 7
            THEN CAST(e.embedding[CAST((p.pos // 8 + s.dr) * 8 + p.pos % 8 + s.dc + 1 AS BIGINT)]
                      AS DOUBLE)
            ELSE 0.0 END AS value
FROM {src} e CROSS JOIN (VALUES {vals}) s(shift, dr, dc) CROSS JOIN range(64) p(pos)"""


NUDGE = [("original", 0, 0), ("up", 1, 0), ("left", 0, 1), ("right", 0, -1), ("down", -1, 0)]
TRANSLATE = [("up", 1, 0), ("down", -1, 0), ("left", 0, 1), ("right", 0, -1)]

SQL["nudge_images"] = ("SELECT vec_id, label, shift, pos, round(value, 6) AS value FROM ("
                       + _shifted("embeddings", NUDGE) + ")")

SQL["translate_images"] = ("SELECT vec_id, label, shift, pos, round(value, 6) AS value FROM ("
                           + _shifted("embeddings", TRANSLATE) + ")")

SQL["downsample_images"] = """
SELECT vec_id, CAST(j AS INTEGER) AS pos, round((
    CAST(embedding[CAST((4 * (j // 2)) * 8 + 4 * (j % 2) + 1 AS BIGINT)] AS DOUBLE)
  + CAST(embedding[CAST((4 * (j // 2)) * 8 + 4 * (j % 2) + 2 AS BIGINT)] AS DOUBLE)
  + CAST(embedding[CAST((4 * (j // 2) + 1) * 8 + 4 * (j % 2) + 1 AS BIGINT)] AS DOUBLE)
  + CAST(embedding[CAST((4 * (j // 2) + 1) * 8 + 4 * (j % 2) + 2 AS BIGINT)] AS DOUBLE)) / 4.0, 9)
  AS value
FROM embeddings CROSS JOIN range(4) t(j)"""

SQL["crop_images"] = f"""
WITH {EL}
SELECT vec_id, CAST((pos // 8 - 2) * 4 + (pos % 8 - 2) AS INTEGER) AS pos, round(v, 6) AS value
FROM el WHERE pos // 8 BETWEEN 2 AND 5 AND pos % 8 BETWEEN 2 AND 5"""

SQL["union_augmented"] = f"""
WITH {FOLDS},
train AS (SELECT vec_id, label, embedding FROM f WHERE fold <> 0),
unl AS (SELECT vec_id, embedding FROM f WHERE fold = 0),
aug AS ({_shifted("train", TRANSLATE)}),
tr AS (SELECT 'train' AS source, count(*) AS n_rows, count(label) AS n_labelled,
              (SELECT sum(CAST(x AS DOUBLE)) FROM (SELECT unnest(embedding) AS x FROM train))
              AS pixel_sum FROM train),
ag AS (SELECT 'augmented' AS source, count(DISTINCT (vec_id, shift)) AS n_rows,
              count(DISTINCT (vec_id, shift)) AS n_labelled, sum(value) AS pixel_sum FROM aug),
un AS (SELECT 'unlabelled' AS source, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_labelled,
              (SELECT sum(CAST(x AS DOUBLE)) FROM (SELECT unnest(embedding) AS x FROM unl))
              AS pixel_sum FROM unl)
SELECT source, n_rows, n_labelled, round(pixel_sum, 6) AS pixel_sum FROM (
  SELECT * FROM tr UNION ALL SELECT * FROM ag UNION ALL SELECT * FROM un)"""

SQL["knn_classify"] = f"""
WITH {FOLDS},
fl AS (SELECT vec_id, label, fold, CAST(v AS DOUBLE) AS v, CAST(pos AS INTEGER) AS pos
  FROM (SELECT vec_id, label, fold, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos
        FROM f)),
d AS (SELECT q.vec_id AS qid, r.vec_id AS rid, r.label AS rlabel,
             sqrt(sum((q.v - r.v) * (q.v - r.v))) AS dist
      FROM fl q JOIN fl r ON q.pos = r.pos AND q.fold = 0 AND r.fold <> 0
      GROUP BY q.vec_id, r.vec_id, r.label),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rk
                      FROM d) WHERE rk <= 3),
w AS (SELECT qid, rlabel,
             CASE WHEN min(dist) OVER (PARTITION BY qid) = 0 THEN CAST(dist = 0 AS DOUBLE)
                  ELSE 1.0 / dist END AS w FROM nn),
v AS (SELECT qid, rlabel, sum(w) AS s FROM w GROUP BY qid, rlabel)
SELECT qid AS vec_id, first(rlabel ORDER BY s DESC, rlabel) AS pred FROM v GROUP BY qid"""

SQL["rbf_activations"] = f"""
WITH {EL},
cen AS (SELECT label, pos, avg(v) AS m FROM el GROUP BY label, pos),
idx AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS centre
        FROM (SELECT DISTINCT label FROM cen)),
cd AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d
       FROM cen a JOIN cen b ON a.pos = b.pos GROUP BY a.label, b.label),
r AS (SELECT max(d) / sqrt(2.0 * count(DISTINCT i)) AS r FROM cd),
dist AS (SELECT e.vec_id, c.label, sqrt(sum((e.v - c.m) * (e.v - c.m))) AS d
         FROM el e JOIN cen c ON e.pos = c.pos GROUP BY e.vec_id, c.label)
SELECT vec_id, idx.centre, round(exp(-1.0 * ((d / r) * (d / r))), 9) AS act
FROM dist JOIN idx USING (label), r"""

SQL["random_layer_fixed"] = f"""
WITH {EL},
w AS (SELECT i, j, sin(7 * i + j) AS w FROM range(64) a(i), range(8) b(j))
SELECT vec_id, CAST(j AS INTEGER) AS unit, round(tanh(sum(v * w) + cos(j)), 9) AS h
FROM el JOIN w ON el.pos = w.i GROUP BY vec_id, j"""

SQL["sparse_filter_activation"] = f"""
WITH {EL},
mu AS (SELECT vec_id, avg(v) AS m FROM el GROUP BY vec_id),
w AS (SELECT f, i, cos(3 * i + 5 * f) / 8.0 AS w FROM range(8) a(f), range(64) b(i)),
fs AS (SELECT el.vec_id, w.f, sqrt(pow(sum((el.v - mu.m) * w.w), 2) + 1e-8) AS fs
       FROM el JOIN mu USING (vec_id) JOIN w ON w.i = el.pos GROUP BY el.vec_id, w.f),
cn AS (SELECT f, sqrt(sum(fs * fs)) AS n FROM fs GROUP BY f),
nf AS (SELECT fs.vec_id, fs.f, fs.fs / cn.n AS nf FROM fs JOIN cn USING (f))
SELECT vec_id, CAST(f AS INTEGER) AS feature,
       round(nf / sqrt(sum(nf * nf) OVER (PARTITION BY vec_id)), 9) AS value FROM nf"""

SQL["flip_shift_images"] = f"""
WITH {EL},
st AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM el),
b AS (SELECT vec_id, (vec_id * 2654435761 + 3) % 4294967291 AS bits FROM embeddings),
g AS (SELECT e.vec_id, e.pos, e.pos // 8 AS r,
             CASE WHEN b.bits % 2 = 1 THEN 7 - e.pos % 8 ELSE e.pos % 8 END AS c,
             (b.bits // 2) % 3 - 1 AS dc, (b.bits // 16) % 3 - 1 AS dr
      FROM el e JOIN b USING (vec_id)),
src AS (SELECT g.vec_id, g.pos, g.r + g.dr AS rr, g.c + g.dc AS cc FROM g)
SELECT src.vec_id, src.pos,
       round(CASE WHEN rr BETWEEN 0 AND 7 AND cc BETWEEN 0 AND 7
                  THEN (e2.v - st.m) / st.s ELSE 0.0 END, 6) AS value
FROM src CROSS JOIN st
LEFT JOIN el e2 ON e2.vec_id = src.vec_id AND e2.pos = src.rr * 8 + src.cc
                 AND src.rr BETWEEN 0 AND 7 AND src.cc BETWEEN 0 AND 7"""

_PIXEL = "CASE WHEN {x} BETWEEN 0 AND 7 AND {y} BETWEEN 0 AND 7 THEN im[{y} * 8 + {x} + 1] ELSE 0.0 END"
_CORNERS = " + ".join(
    "(" + _PIXEL.format(x=f"(x0 + {dx})", y=f"(y0 + {dy})") + f") * {'fx' if dx else '(1 - fx)'} * {'fy' if dy else '(1 - fy)'}"
    for dy in (0, 1) for dx in (0, 1))

SQL["rotate_images"] = f"""
WITH e AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x + 0.6) / 1.2) AS im,
       radians(((vec_id * 2654435761 + 42) % 4294967291) % 35 - 17.0) AS t FROM embeddings),
p AS (SELECT vec_id, label, im, t, unnest(range(64)) AS pos FROM e),
s AS (SELECT *, cos(t) * (pos % 8 - 3.5) + sin(t) * (pos // 8 - 3.5) + 3.5 AS sx,
      -sin(t) * (pos % 8 - 3.5) + cos(t) * (pos // 8 - 3.5) + 3.5 AS sy FROM p),
c AS (SELECT *, CAST(floor(sx) AS BIGINT) AS x0, CAST(floor(sy) AS BIGINT) AS y0, sx - floor(sx) AS fx,
      sy - floor(sy) AS fy FROM s),
v AS (SELECT vec_id, label, pos, {_CORNERS} AS v FROM c)
SELECT vec_id, label, CAST(0 AS INTEGER) AS copy, CAST(pos AS INTEGER) AS pos, round(im[pos + 1], 6) AS value FROM p
UNION ALL
SELECT vec_id, label, CAST(1 AS INTEGER), CAST(pos AS INTEGER),
       round(CASE WHEN v < 0.15 THEN 0.0 WHEN v >= 0.8 THEN 1.0 ELSE v END, 6) FROM v"""

# coefficients = inverse of the spline's sample matrix along rows and columns
_SAMPLE = np.diag(np.full(8, 4.0)) + np.eye(8, k=1) + np.eye(8, k=-1)
_SAMPLE[0, 1] = _SAMPLE[7, 6] = 2.0
_SOLVE = ", ".join(f"({i}, {j}, CAST({v!r} AS DOUBLE))" for i, row in enumerate(np.linalg.inv(_SAMPLE / 6).tolist())
                   for j, v in enumerate(row))
_BSPLINE = "CASE WHEN {d} < 1 THEN 2.0 / 3 - {d} * {d} + {d} * {d} * {d} / 2 ELSE (2 - {d}) * (2 - {d}) * (2 - {d}) / 6 END"
_MIRROR = "CASE WHEN {x} < 0 THEN -{x} WHEN {x} > 7 THEN 14 - {x} ELSE {x} END"

SQL["rotate_images_spline"] = f"""
WITH e AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x + 0.6) / 1.2) AS im,
       radians(((vec_id * 2654435761 + 42) % 4294967291) % 35 - 17.0) AS t FROM embeddings),
b(i, j, b) AS (VALUES {_SOLVE}),
p AS (SELECT vec_id, label, t, pos, im[pos + 1] AS v FROM (SELECT *, unnest(range(64)) AS pos FROM e)),
across AS (SELECT vec_id, pos // 8 AS r, i AS x, sum(v * b) AS v FROM p JOIN b ON j = pos % 8 GROUP BY ALL),
coef AS (SELECT vec_id, i AS y, x, sum(v * b) AS v FROM across JOIN b ON j = r GROUP BY ALL),
s AS (SELECT *, cos(t) * (pos % 8 - 3.5) + sin(t) * (pos // 8 - 3.5) + 3.5 AS sx,
      -sin(t) * (pos % 8 - 3.5) + cos(t) * (pos // 8 - 3.5) + 3.5 AS sy FROM p),
tap AS (SELECT vec_id, label, pos, sx, sy, CAST(floor(sx) AS BIGINT) + dx AS x, CAST(floor(sy) AS BIGINT) + dy AS y
        FROM s, range(-1, 3) a(dx), range(-1, 3) c(dy) WHERE sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7),
near AS (SELECT vec_id, label, pos, {_BSPLINE.format(d="abs(sx - x)")} AS wx, {_BSPLINE.format(d="abs(sy - y)")} AS wy,
        {_MIRROR.format(x="x")} AS x, {_MIRROR.format(x="y")} AS y FROM tap),
v AS (SELECT n.vec_id, pos, sum(wx * wy * coef.v) AS v FROM near n JOIN coef
      ON coef.vec_id = n.vec_id AND coef.x = n.x AND coef.y = n.y GROUP BY ALL)
SELECT vec_id, label, CAST(0 AS INTEGER) AS copy, CAST(pos AS INTEGER) AS pos, round(v, 6) AS value FROM p
UNION ALL
SELECT p.vec_id, label, CAST(1 AS INTEGER), CAST(p.pos AS INTEGER),
       round(CASE WHEN coalesce(v.v, 0) < 0.15 THEN 0.0 WHEN v.v >= 0.8 THEN 1.0 ELSE v.v END, 6)
FROM p LEFT JOIN v ON v.vec_id = p.vec_id AND v.pos = p.pos"""

SQL["flatten_images"] = """
SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value
FROM embeddings"""

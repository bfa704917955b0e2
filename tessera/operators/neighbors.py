"""Exact k-nearest neighbours (J3, W4, C9) and distance-weighted votes.

References are dealt to the cells of a bounded set of pivots.  A query first
meets part of its nearest cell, which bounds the distance of its k-th
neighbour; then it is sent only to the cells that the bound cannot rule out
(by the triangle inequality, from the distance to the pivot and the cell's
radius).  Cells are cut into parts of bounded size, and the queries of a part
into blocks, so a hot cell is spread over tasks; the pairs are never
materialised, and only the k best candidates per query and part leave a task.

In many dimensions cells rule out little.  A block's squared distances then
come from one matrix product, which is right up to rounding: less a slack for
that, it is a lower bound, and only pairs whose bound does not pass the
query's k-th distance so far are measured in full.  Distances that are returned
always come from the vectors as given.  Where the cells leave more than
``CELLS_LEFT`` of all pairs, they are not used: all references are cut into
larger parts, so that each vector is copied to fewer tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _stack(col):
    import numpy as np
    return np.stack(col.map(lambda a: np.asarray(a, dtype=float)).to_numpy())


def _distances(Q, R):
    import numpy as np
    out = np.empty((len(Q), len(R)))
    for s in range(0, len(Q), 64):
        diff = Q[s:s + 64, None, :] - R[None, :, :]
        out[s:s + 64] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    out[np.isnan(out)] = np.inf                      # as far away as can be, but not lost
    return out


class Bounds:
    """Lower bounds of distances from the leading coordinates on an orthogonal
    basis (without one: from all coordinates) and the norm of the rest.
    Rotation and products keep lengths up to rounding, which ``SLACK`` covers."""

    SLACK = 1e-9

    def __init__(self, basis=None, lead: int | None = None):
        self.basis, self.lead = basis, lead

    def turned(self, X):
        """Points whose distances are the bounds, and their squared norms."""
        import numpy as np
        if self.basis is not None:
            Z = X @ self.basis
            X = np.hstack([Z[:, :self.lead], np.linalg.norm(Z[:, self.lead:], axis=1)[:, None]])
        return X, (X * X).sum(1)

    def lower(self, q, r):
        """A lower bound of every pair's squared distance."""
        (a, size_a), (b, size_b) = q, r
        size = size_a.max(initial=0.0) + size_b.max(initial=0.0)      # scale of the rounding
        low = (-2 * a) @ b.T
        low += size_b[None, :]
        low += (size_a - self.SLACK * size)[:, None]
        return low


def basis_of(rows: DataFrame, vec: str) -> Bounds | None:
    """None if the rows have fewer than ``LEAST_DIMS`` dimensions or differ in length."""
    least, d = rows.select(F.min(F.size(vec)), F.max(F.size(vec))).first()
    return None if d is None or least != d or d < LEAST_DIMS else Bounds()


#: Fewer dimensions are measured in full at once.
LEAST_DIMS = 16
#: Rows of queries and of references whose pairs are bounded at once.
Q_ROWS, R_ROWS = 256, 2048
#: Squared norms from here on are measured in full: their products may overflow.
MOST_NORM = 1e300


def _best(i, j, d, k: int):
    """The k first pairs of every i by (d, j)."""
    import numpy as np
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], d[first]


def near_pairs(Q, R, k: int, bounds: Bounds | None = None, most=None):
    """(places in Q, places in R, distances) of the pairs of every row of Q with
    its k nearest rows of R, equal distances by place, and how many pairs were
    measured in full.  ``most``: distances beyond which a row's pairs may be
    left out.  Rows with values that are not finite are measured against all."""
    import numpy as np
    k, measured, out = min(k, len(R)), 0, []
    most = np.full(len(Q), np.inf) if most is None else most
    with np.errstate(over="ignore", invalid="ignore"):
        plain_q, plain_r = (Q * Q).sum(1) < MOST_NORM, (R * R).sum(1) < MOST_NORM
    known = bounds is not None and plain_r.sum() > 2 * k
    full = np.arange(len(Q)) if not known else np.flatnonzero(~plain_q)
    for s in range(0, len(full), Q_ROWS):
        d = _distances(Q[full[s:s + Q_ROWS]], R)
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        out.append((np.repeat(full[s:s + Q_ROWS], k), near.ravel(), np.take_along_axis(d, near, 1).ravel()))
        measured += d.size
    if known:
        # a reference that is not finite is infinitely far from all: only the first k can count
        far = ~np.isfinite(R).all(1)
        odd = np.sort(np.concatenate([np.flatnonzero(~plain_r & ~far), np.flatnonzero(far)[:k]]))
        place = np.flatnonzero(plain_r)
        plain = R if len(place) == len(R) else R[place]
        right, step = bounds.turned(plain), max(R_ROWS, k)
        rows = np.flatnonzero(plain_q)
        for s in range(0, len(rows), Q_ROWS):
            mine = rows[s:s + Q_ROWS]
            q = Q[mine]
            left, limit = bounds.turned(q), most[mine].astype(float) ** 2
            limit[np.isnan(limit)] = np.inf
            best = None
            for t in range(0, len(plain), step):
                low = bounds.lower(left, tuple(x[t:t + step] for x in right))
                if t == 0 and not np.isfinite(limit).all():
                    first = np.argpartition(low, k - 1, axis=1)[:, :k]
                    diff = q[:, None, :] - plain[first]
                    limit = np.minimum(limit, np.einsum("ijk,ijk->ij", diff, diff).max(axis=1))     # k pairs are this near
                    measured += first.size
                i, j = np.divmod(np.flatnonzero(low <= limit[:, None]), low.shape[1])
                if not len(i):
                    continue
                measured += len(i)
                d = np.empty(len(i))
                for u in range(0, len(i), 1 << 16):
                    part = q[i[u:u + (1 << 16)]] - plain[t + j[u:u + (1 << 16)]]
                    d[u:u + (1 << 16)] = np.sqrt(np.einsum("ij,ij->i", part, part))
                found = (i, place[t + j], d)
                best = _best(*(found if best is None else map(np.concatenate, zip(best, found))), k)
                n = np.bincount(best[0], minlength=len(mine))
                last = np.cumsum(n)[n == k] - 1
                limit[n == k] = np.minimum(limit[n == k], best[2][last] ** 2)
            best = best or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            if len(odd):
                d = _distances(q, R[odd])
                i, j = np.divmod(np.arange(d.size), len(odd))
                best = _best(*map(np.concatenate, zip(best, (i, odd[j], d.ravel()))), k)
                measured += d.size
            out.append((mine[best[0]], best[1], best[2]))
    i, j, d = map(np.concatenate, zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return i, j, d, measured


def k_nearest(Q, R, k: int, bounds: Bounds | None = None):
    """Per row of Q the places and distances of its k nearest rows of R, equal
    distances by place, and how many pairs were measured in full."""
    import numpy as np
    k = min(k, len(R))
    i, j, d, measured = near_pairs(Q, R, k, bounds)
    order = np.argsort(i, kind="stable")
    return j[order].reshape(len(Q), k), d[order].reshape(len(Q), k), measured


#: Share of all pairs left by the cells beyond which all references are met.
CELLS_LEFT = 0.25
#: Most values (rows times dimensions) of a block where all references are met.
BLOCK_VALUES = 1 << 21


def _wide_rows(n_query: int, n_ref: int, dims: int, least: int, cores: int) -> int:
    """Rows of a block: several blocks of pairs for every core, within ``BLOCK_VALUES``."""
    return max(least, min(BLOCK_VALUES // dims, math.isqrt(n_query * n_ref // (8 * cores))))


def _by_number(numbers: dict, default: int = 1):
    """A Column that looks a cell number up in a short table."""
    if not numbers:
        return F.lit(default)
    table = F.array(*[F.lit(int(numbers.get(i, default))) for i in range(max(numbers) + 1)])
    return F.coalesce(F.get(table, F.col("_cell")), F.lit(default))


def knn(query: DataFrame, ref: DataFrame, qkey: str, rkey: str, vec: str, k: int = 3,
        block_rows: int = 4096, exclude_self: bool = False, carry=(), pivots: int = 1024, bound: bool = True,
        measured=None) -> DataFrame:
    """Top-k euclidean neighbours: (qkey, rkey as ``ref_id``, dist, rank,
    *carry) with ties broken by the reference key.  ``pivots`` bounds the
    number of cells (and the vectors that every task holds).  A null vector is
    no reference and, as a query, has no neighbours and no row.  ``bound``
    rules pairs out by bounds first; ``measured``, an accumulator, is given the
    number of pairs that were measured in full."""
    import numpy as np
    import pandas as pd

    from tessera.session import cut_lineage

    kk = k + (1 if exclude_self else 0)
    qtype, rtype = dict(query.dtypes)[qkey], dict(ref.dtypes)[rkey]
    vtype = "array<double>"
    q = query.select(F.col(qkey).alias("_qid"), F.col(vec).cast(vtype).alias("_v")).where("_v is not null")
    r = ref.select(F.col(rkey).alias("_rid"), F.col(vec).cast(vtype).alias("_v"),
                   *[F.col(c).alias(f"_c_{c}") for c in carry]).where("_v is not null")
    n_cells = min(pivots, max(1, math.ceil(r.count() / block_rows)))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    bounds = basis_of(r.where(finite), "_v") if bound else None
    chosen = [] if n_cells == 1 else r.where(finite).orderBy(F.xxhash64("_rid"), "_rid").limit(n_cells).collect()
    centres = np.array([row["_v"] for row in chosen]) if len(chosen) > 1 else None

    def dealt(batches):
        for pdf in batches:
            pdf = pdf.copy()
            if centres is None or not len(pdf):
                pdf["_cell"], pdf["_d"] = 0, math.inf
            else:
                d = _distances(_stack(pdf["_v"]), centres)
                pdf["_cell"] = d.argmin(1)
                pdf["_d"] = d.min(1)
            yield pdf.astype({"_cell": "int32", "_d": "float64"})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema.fields)
    rows = r.mapInPandas(dealt, f"{schema}, _cell int, _d double")
    rows = cut_lineage(rows) if centres is not None else rows
    cells = {c["_cell"]: c for c in rows.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("_d").alias("radius")).collect()}      # at most ``pivots`` rows
    parts = {c: math.ceil(x["n"] / block_rows) for c, x in cells.items()}
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_rid"), _by_number(parts)).cast("int"))
    carry_fields = [(c, dict(ref.dtypes)[c]) for c in carry]
    out_schema = ", ".join([f"_qid {qtype}", f"_rid {rtype}", "dist double"]
                           + [f"`{c}` {t}" for c, t in carry_fields])

    def nearest(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if qp.empty or rp.empty:
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in ["_qid", "_rid", "dist", *carry]})
        qid, rid = qp["_qid"].to_numpy(), rp["_rid"].to_numpy()
        order = np.argsort(rid, kind="stable")          # ties -> smaller reference key
        rid, R = rid[order], _stack(rp["_v"])[order]
        carried = {c: rp[f"_c_{c}"].to_numpy()[order] for c in carry}
        i, j, d, n = near_pairs(_stack(qp["_v"]), R, kk, bounds, qp["_bound"].to_numpy(dtype=float))
        if measured is not None:
            measured.add(n)
        out = pd.DataFrame({"_qid": qid[i], "_rid": rid[j], "dist": d, **{c: carried[c][j] for c in carry}})
        return out[out["_qid"] != out["_rid"]] if exclude_self else out

    def search(visits: DataFrame, where: DataFrame, most_rows: int = block_rows) -> DataFrame:
        """Candidates of the visits (_qid, _v, _bound, _cell, _part), blocks of
        queries meeting parts of cells."""
        busy = {c["_cell"]: math.ceil(c["n"] / most_rows) for c in visits.groupBy("_cell", "_part").agg(
            F.count(F.lit(1)).alias("n")).groupBy("_cell").agg(F.max("n").alias("n")).collect()}
        blocks = _by_number(busy)
        left = visits.withColumn("_block", F.pmod(F.xxhash64("_qid"), blocks).cast("int"))
        right = where.withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        key = ["_cell", "_part", "_block"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(nearest, out_schema)

    if centres is None:
        all_parts = parts.get(0, 1)
        visits = q.withColumn("_bound", F.lit(None).cast("double")).withColumn("_cell", F.lit(0)).withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.lit(all_parts - 1))))
        found = search(visits, rows)
    else:
        enough = np.array([i for i, c in cells.items() if c["n"] >= kk] or [max(cells, key=lambda c: cells[c]["n"])])

        def first(batches):
            for pdf in batches:
                pdf = pdf.copy()
                d = _distances(_stack(pdf["_v"]), centres[enough]) if len(pdf) else np.zeros((0, 1))
                pdf["_cell"] = enough[d.argmin(1)] if len(pdf) else []
                pdf["_bound"], pdf["_part"] = math.nan, 0
                yield pdf.astype({"_bound": "float64", "_cell": "int32", "_part": "int32"})

        tried = search(q.mapInPandas(first, f"_qid {qtype}, _v {vtype}, _bound double, _cell int, _part int"),
                       rows.where("_part = 0"))
        bound = tried.groupBy("_qid").agg(F.sort_array(F.collect_list("dist")).alias("near")).select(
            F.col("_qid").alias("_bid"), F.get("near", F.lit(k - 1)).alias("_bound"))
        number = np.array(sorted(cells))
        radius = np.array([cells[c]["radius"] for c in number])
        size = np.array([cells[c]["n"] for c in number])

        def again(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                d = _distances(_stack(pdf["_v"]), centres[number])
                most = pdf["_bound"].fillna(math.inf).to_numpy(dtype=float)[:, None]
                reach = d * (1 - 1e-9) - radius[None, :]
                left = ~(reach > most)                       # unknown distances rule nothing out
                out = pdf[["_qid", "_v", "_bound"]].copy()
                out["_cells"] = [number[x].tolist() for x in left]
                out["_pairs"] = left @ size
                yield out

        bounded = q.join(bound, F.col("_qid").eqNullSafe(F.col("_bid")), "left").select("_qid", "_v", "_bound")
        bounded = cut_lineage(bounded.mapInPandas(
            again, f"_qid {qtype}, _v {vtype}, _bound double, _cells array<int>, _pairs long"))
        n_query, pairs = bounded.agg(F.count(F.lit(1)), F.sum("_pairs")).first()
        n_ref = int(size.sum())
        if bounds is not None and pairs and pairs > CELLS_LEFT * n_query * n_ref:
            wide = _wide_rows(n_query, n_ref, len(centres[0]), block_rows, query.sparkSession.sparkContext.defaultParallelism)
            n_parts = math.ceil(n_ref / wide)
            visits = bounded.select("_qid", "_v", "_bound", F.lit(0).alias("_cell"),
                                    F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("_part"))
            found = search(visits, rows.withColumn("_cell", F.lit(0)).withColumn(
                "_part", F.pmod(F.xxhash64("_rid"), F.lit(n_parts)).cast("int")), wide)
        else:
            visits = bounded.select("_qid", "_v", "_bound", F.explode("_cells").alias("_cell"))
            visits = visits.withColumn("_part", F.explode(F.sequence(F.lit(0), _by_number(parts) - 1)))
            found = search(visits, rows)
    w = Window.partitionBy("_qid").orderBy("dist", "_rid")   # k candidates from each part that was met
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumnRenamed("_qid", qkey).withColumnRenamed("_rid", "ref_id"))


def weighted_vote(neigh: DataFrame, qkey: str, label: str, weights: str = "distance") -> DataFrame:
    """Uniform or inverse-distance vote; when a neighbour is at distance
    0 only the exact matches vote.  Ties -> smallest label."""
    if weights == "uniform":
        w = F.lit(1.0)
    else:
        has_zero = F.min("dist").over(Window.partitionBy(qkey)) == 0
        w = F.when(has_zero, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    scored = neigh.withColumn("_w", w).groupBy(qkey, label).agg(F.sum("_w").alias("_s"))
    best = Window.partitionBy(qkey).orderBy(F.desc("_s"), F.asc(label))
    return (scored.withColumn("_k", F.row_number().over(best)).where(F.col("_k") == 1)
            .select(qkey, F.col(label).alias("pred")))

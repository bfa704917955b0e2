"""Extreme learning machines and linear projections solved from Gram sums
(M10, M16, M17, M19, C10).

Every fit is one pass over the data per layer: each task maps its rows
through the (bounded, closure-shipped) hidden layer with numpy and emits
partial sums -- n, sum(H), sum(Y), H'H, H'Y, sum(Y*Y) -- per fold, one row
per matrix row.  A grouped ``Summarizer.sum`` adds them up on the JVM; only
the summed h x h and h x t blocks reach the driver, where numpy solves the
small systems.  Their size depends on the layer width, which is checked.

Ridge strength is chosen by the exact leave-one-out error of every candidate
(one decomposition of the Gram matrix and one more pass), or by k-fold error
from fold sums (fit on total - fold, score the fold in closed form).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import np_activation

#: Widest layer whose h x h sums (per fold) may reach the driver; ``max_width``
#: arguments raise it where the driver has the memory.
MAX_GRAM_WIDTH = 4096


def check_width(width: int, max_width: int = MAX_GRAM_WIDTH) -> None:
    """Raise before any job runs if a layer's sums would not fit the driver."""
    if width > max_width:
        raise ValueError(f"a layer of {width} units needs sums of {width} x {width} numbers on the driver; "
                         f"the limit is max_width={max_width}")


def _labels(df: DataFrame, label: str) -> list:
    """The distinct labels in the order of their own type; null is no class."""
    return sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())


def _one_hot(classes: list):
    index = {c: i for i, c in enumerate(classes)}

    def target(X, t):
        out = np.zeros((len(t), len(classes)))
        for row, value in enumerate(t):
            if value in index:
                out[row, index[value]] = 1.0
        return out
    return target


def _with_class(df: DataFrame, vec: str, scores_fn, classes: list, kind, out: str) -> DataFrame:
    """``df`` with the class of the highest score, in the label's own type."""
    from pyspark.sql.types import StructField, StructType
    schema = StructType([*df.schema.fields, StructField(out, kind)])

    def run(batches):
        for pdf in batches:
            pdf = pdf.copy()
            known = pdf[vec].notna().to_numpy()
            best = iter(np.argmax(scores_fn(_np(list(pdf[vec][known]))), axis=1) if known.any() else [])
            got = [classes[next(best)] if k else None for k in known]     # null for a null vector
            pdf[out] = pd.Series(got, index=pdf.index, dtype=object)
            yield pdf
    return df.mapInPandas(run, schema)


def _np(vals) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vals]) if len(vals) else np.zeros((0, 0))


def gram_sums(df: DataFrame, vec: str, hidden_fn, target_fn=None, fold: str | None = None,
              target_col: str | None = None, max_width: int = MAX_GRAM_WIDTH) -> dict:
    """Sufficient statistics per fold (fold None -> key 0).  A wider layer
    than ``max_width`` fails in its task, before anything is collected.

    ``hidden_fn(X) -> H`` and ``target_fn(X, t) -> Y`` run inside tasks on
    numpy blocks (``t`` is the ``target_col`` values, if any).  Returns
    {fold: dict(n, sh, sy, hh, hy, yy)}.
    """
    cols = [F.col(vec).alias("_x")]
    cols.append((F.col(fold) if fold else F.lit(0)).cast("int").alias("_f"))
    if target_col:
        cols.append(F.col(target_col).alias("_t"))
    src = df.select(*cols).where(F.col("_x").isNotNull())

    def emit(batches):
        acc: dict = {}
        for pdf in batches:
            for f, part in pdf.groupby("_f"):
                X = _np(list(part["_x"]))
                H = hidden_fn(X)
                Y = target_fn(X, part["_t"].to_numpy() if target_col else None) \
                    if target_fn else X
                check_width(H.shape[1], max_width)
                a = acc.setdefault(int(f), {"n": 0, "sh": 0, "sy": 0, "hh": 0, "hy": 0, "yy": 0})
                a["n"] += len(X)
                a["sh"] = a["sh"] + H.sum(0)
                a["sy"] = a["sy"] + Y.sum(0)
                a["hh"] = a["hh"] + H.T @ H
                a["hy"] = a["hy"] + H.T @ Y
                a["yy"] = a["yy"] + (Y * Y).sum()
        rows = []
        for f, a in acc.items():
            if a["n"] == 0:
                continue
            rows.append((f, "n", 0, [float(a["n"])]))
            rows.append((f, "yy", 0, [float(a["yy"])]))
            rows.append((f, "sh", 0, list(map(float, a["sh"]))))
            rows.append((f, "sy", 0, list(map(float, a["sy"]))))
            for i in range(a["hh"].shape[0]):
                rows.append((f, "hh", i, list(map(float, a["hh"][i]))))
                rows.append((f, "hy", i, list(map(float, a["hy"][i]))))
        if rows:
            yield pd.DataFrame(rows, columns=["fold", "part", "i", "v"])

    # every task sends one h x h block, so there are no more tasks than cores
    src = src.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))
    partial = src.mapInPandas(emit, "fold int, part string, i int, v array<double>")
    summed = (partial.withColumn("v", array_to_vector("v"))
              .groupBy("fold", "part", "i").agg(Summarizer.sum(F.col("v")).alias("v"))
              .withColumn("v", vector_to_array("v")).collect())
    out: dict = {}
    for r in summed:
        out.setdefault(r["fold"], {}).setdefault(r["part"], {})[r["i"]] = np.asarray(r["v"])
    res = {}
    for f, parts in out.items():
        hh = np.stack([parts["hh"][i] for i in sorted(parts["hh"])])
        hy = np.stack([parts["hy"][i] for i in sorted(parts["hy"])])
        res[f] = dict(n=float(parts["n"][0][0]), yy=float(parts["yy"][0][0]), sh=parts["sh"][0],
                      sy=parts["sy"][0], hh=hh, hy=hy)
    return res


def _total(stats: dict, exclude=None) -> dict:
    keys = ["n", "yy", "sh", "sy", "hh", "hy"]
    return {k: sum(s[k] for f, s in stats.items() if f != exclude) for k in keys}


def ridge_solve(s: dict, alpha: float, intercept: bool = True):
    """B (h x t) and intercept (t) minimising ||Y - HB - c||^2 + alpha ||B||^2."""
    n = s["n"]
    if intercept:
        mh, my = s["sh"] / n, s["sy"] / n
        hh = s["hh"] - n * np.outer(mh, mh)
        hy = s["hy"] - n * np.outer(mh, my)
    else:
        mh, my = np.zeros(len(s["sh"])), np.zeros(len(s["sy"]))
        hh, hy = s["hh"], s["hy"]
    B = np.linalg.solve(hh + alpha * np.eye(hh.shape[0]), hy)
    return B, my - mh @ B


def leave_one_out(df: DataFrame, vec: str, hidden_fn, alphas, stats: dict, target_fn=None,
                  target_col: str | None = None) -> dict[float, float]:
    """Mean squared leave-one-out error of the ridge of Y on H (with an
    intercept) for every alpha, from ``_total`` Gram sums and one more pass.

    With H'H = V diag(w) V' (centred), a row's leverage is
    1/n + sum (h v_j)^2 / (w_j + alpha), and its error when left out is its
    residual over one minus its leverage.  One decomposition serves all alphas,
    and a task emits one sum for each.  A leverage of 1 (a row that alone fixes
    a coefficient) has no such error, and the alpha gets infinity."""
    n, mh, my = stats["n"], stats["sh"] / stats["n"], stats["sy"] / stats["n"]
    w, V = np.linalg.eigh(stats["hh"] - n * np.outer(mh, mh))
    w, along = np.clip(w, 0.0, None), V.T @ (stats["hy"] - n * np.outer(mh, my))
    shrink = 1.0 / np.maximum(w[None, :] + np.asarray(alphas, dtype=float)[:, None], 1e-300)   # alphas x h

    def errors(batches):
        total = np.zeros(len(shrink))
        for pdf in batches:
            if not len(pdf):
                continue
            X = _np(list(pdf["_x"]))
            Y = target_fn(X, pdf["_t"].to_numpy() if target_col else None) if target_fn else X
            Z = (hidden_fn(X) - mh) @ V
            rest = 1.0 - 1.0 / n - (Z * Z) @ shrink.T
            for i in range(len(shrink)):
                residual = Y - my - (Z * shrink[i]) @ along
                with np.errstate(divide="ignore", invalid="ignore"):
                    lost = (residual ** 2).sum(1) / rest[:, i] ** 2
                total[i] += np.where(rest[:, i] > 1e-12, lost, np.inf).sum()
        yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "e": total})

    cols = [F.col(vec).alias("_x"), *([F.col(target_col).alias("_t")] if target_col else [])]
    src = df.select(*cols).where(F.col("_x").isNotNull())
    got = {r["i"]: r["e"] for r in src.mapInPandas(errors, "i int, e double").groupBy("i").agg(F.sum("e").alias("e")).collect()}
    return {float(a): got[i] / (n * len(my)) for i, a in enumerate(alphas)}


def fold_sse(train: dict, test: dict, B: np.ndarray, c: np.ndarray) -> float:
    """sum over the test fold of ||y - (hB + c)||^2 from sums only."""
    # ||y||^2 - 2 y.(hB + c) + ||hB + c||^2, summed
    cross = np.sum(test["hy"] * B) + test["sy"] @ c
    quad = np.sum(B * (test["hh"] @ B)) + 2 * (test["sh"] @ B) @ c + test["n"] * c @ c
    return float(test["yy"] - 2 * cross + quad)


def choose_alpha(stats: dict, alphas) -> float:
    """k-fold choice of the ridge strength from per-fold sums."""
    if len(stats) < 2:
        return float(alphas[len(alphas) // 2])
    best, best_err = None, None
    for a in alphas:
        err = 0.0
        for f in stats:
            tr = _total(stats, exclude=f)
            B, c = ridge_solve(tr, a)
            err += fold_sse(tr, stats[f], B, c)
        if best_err is None or err < best_err:
            best, best_err = a, err
    return float(best)


def matmul_layer(df: DataFrame, vec: str, M: np.ndarray, b=None, act="identity",
                 out: str = "z") -> DataFrame:
    """f(X M + b) as an array column, vectorised in Arrow batches.  M is a
    fitted parameter (bounded width) shipped with the task closure."""
    M = np.asarray(M, dtype=float)
    bias = np.zeros(M.shape[1]) if b is None else np.asarray(b, dtype=float)
    fn = np_activation(act)
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out, ArrayType(DoubleType()))])

    def run(batches):
        for pdf in batches:
            known = pdf[vec].notna().to_numpy()
            Z = iter(fn(_np(list(pdf[vec][known])) @ M + bias) if known.any() else [])
            pdf = pdf.copy()
            # null for a null vector
            pdf[out] = pd.Series([next(Z) if k else None for k in known], index=pdf.index, dtype=object)
            yield pdf
    return df.mapInPandas(run, schema)


# ------------------------------------------------------------ ELM AE
class ElmAutoEncoder:
    """Random (QR-orthogonal) projection -> activation H; ridge of X on H
    over ``alphas``, chosen by the leave-one-out error, or by the error over
    ``folds`` parts of the keys if their number is given; transform = f(X C) with C the ridge
    coefficients (no intercept in transform, as in the source)."""

    def __init__(self, k: int = 60, activation: str = "tanh", alphas=None,
                 orthogonal: bool = True, seed: int = 0, folds: int | None = None, max_width: int = MAX_GRAM_WIDTH):
        self.k, self.activation, self.orthogonal, self.seed, self.folds, self.max_width = \
            k, activation, orthogonal, seed, folds, max_width
        self.alphas = list(alphas) if alphas is not None else list(np.logspace(-5, 5, 11))

    def fit(self, df: DataFrame, vec: str, key: str):
        check_width(self.k, self.max_width)
        d = df.select(F.max(F.size(vec))).first()[0]
        rs = np.random.default_rng(self.seed)
        P = rs.normal(size=(d, self.k))
        if self.orthogonal:
            if self.k > d:
                raise ValueError(f"an orthogonal projection of {d} features has {d} components at most, not {self.k}")
            P, _ = np.linalg.qr(P)
        act = np_activation(self.activation)
        fold = F.lit(0) if self.folds is None else F.pmod(F.xxhash64(F.col(key)), F.lit(self.folds))
        folded = df.withColumn("_fold", fold)
        stats = gram_sums(folded, vec, lambda X: act(X @ P), None, fold="_fold", max_width=self.max_width)
        if self.folds is None:
            self.errors_ = leave_one_out(df, vec, lambda X: act(X @ P), self.alphas, _total(stats))
            self.alpha_ = min(self.errors_, key=lambda a: (self.errors_[a], a))
        else:
            self.alpha_ = choose_alpha(stats, self.alphas)
        B, _ = ridge_solve(_total(stats), self.alpha_)       # (k x d)
        self.components_ = B.T                                 # d x k: X C
        self.projection_ = P
        return self

    def transform(self, df: DataFrame, vec: str, out: str = "ae") -> DataFrame:
        return matmul_layer(df, vec, self.components_, act=self.activation, out=out)


# ------------------------------------------------------- ELM classifier
class ElmClassifier:
    """Random hidden layer (dense, sparse or low-rank weights) + least
    squares read-out to one-hot targets; prediction = arg-max class."""

    def __init__(self, n_hidden: int = 1000, activation: str = "tanh", rank: int | None = None,
                 density="auto", seed: int = 0, alpha: float = 1e-8, max_width: int = MAX_GRAM_WIDTH):
        self.n_hidden, self.activation, self.rank, self.density, self.seed, self.alpha, self.max_width = \
            n_hidden, activation, rank, density, seed, alpha, max_width

    def _weights(self, d: int):
        rs = np.random.default_rng(self.seed)
        if self.rank is not None:
            W = rs.normal(size=(d, self.rank)) @ rs.normal(size=(self.rank, self.n_hidden))
        elif self.density == 1:
            W = rs.normal(size=(d, self.n_hidden))
        else:
            dens = 1 / np.sqrt(d) if self.density == "auto" else float(self.density)
            mask = rs.random((d, self.n_hidden)) < dens
            W = np.where(mask, rs.choice([-1.0, 1.0], size=(d, self.n_hidden)) / np.sqrt(dens),
                         0.0) / np.sqrt(self.n_hidden)
        return W, rs.normal(size=self.n_hidden)

    def fit(self, df: DataFrame, vec: str, label: str):
        check_width(self.n_hidden, self.max_width)
        self.classes_, self.label_type_ = _labels(df, label), df.schema[label].dataType
        df = df.where(F.col(label).isNotNull())
        d = df.select(F.max(F.size(vec))).first()[0]
        W, b = self._weights(d)
        act = np_activation(self.activation)
        self.W_, self.b_ = W, b
        target = _one_hot(self.classes_)
        stats = _total(gram_sums(df, vec, lambda X: act(X @ W + b), target, target_col=label,
                                 max_width=self.max_width))
        # minimum-norm least squares through the pseudo-inverse of H'H
        self.beta_ = np.linalg.pinv(stats["hh"] + self.alpha * np.eye(len(b))) @ stats["hy"]
        return self

    def predict(self, df: DataFrame, vec: str, out: str = "pred") -> DataFrame:
        act = np_activation(self.activation)
        W, b, beta = self.W_, self.b_, self.beta_
        return _with_class(df, vec, lambda X: act(X @ W + b) @ beta, self.classes_, self.label_type_, out)


# ------------------------------------------------ stacked ELM-AE
def _orth(A: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the column space (MATLAB orth)."""
    U, s, _ = np.linalg.svd(A, full_matrices=False)
    tol = max(A.shape) * np.finfo(float).eps * (s[0] if len(s) else 0)
    return U[:, s > tol]


class DeepElmAutoEncoder:
    """Layer-wise ELM auto-encoders, then a ridge (or pinv) output layer.

    Layer i: orthogonal weights in [-1, 1], orthonormal bias, sigmoid with
    slope ``slopes[i]``; beta by Procrustes when widths are equal, by
    pseudo-inverse when C = 0, by ridge otherwise; the next input is
    X beta' (equal widths) or sigmoid(slope * X beta').  One Gram pass per
    layer plus one for the output layer.  The output layer is fitted to the
    classes of ``label`` or to the numbers of the array column ``target``
    (by default the input itself), which ``reconstruct_values`` returns."""

    def __init__(self, widths, C, slopes, seed: int = 1, max_width: int = MAX_GRAM_WIDTH):
        self.widths, self.C, self.slopes, self.seed = list(widths), list(C), list(slopes), seed
        self.max_width = max_width

    def _forward(self, X: np.ndarray, upto: int) -> np.ndarray:
        Z = X
        for i in range(upto):
            T = Z @ self.W_[i].T
            Z = T if self.same_[i] else 1.0 / (1.0 + np.exp(-self.slopes[i] * T))
        return Z

    def fit(self, df: DataFrame, vec: str, label: str | None = None, target: str | None = None):
        check_width(max(self.widths, default=0), self.max_width)
        rs = np.random.default_rng(self.seed)
        if label is not None:
            self.classes_, self.label_type_ = _labels(df, label), df.schema[label].dataType
            df = df.where(F.col(label).isNotNull())
        d = df.select(F.max(F.size(vec))).first()[0]
        dims = [d] + self.widths
        self.W_, self.same_ = [], []
        for i in range(len(self.widths)):
            h_in, h_out = dims[i], dims[i + 1]
            A = rs.random((h_out, h_in)) * 2 - 1
            A = _orth(A) if h_out > h_in else _orth(A.T).T
            bias = rs.random((h_out, 1)) * 2 - 1
            bias = (bias / np.linalg.norm(bias)).ravel()
            slope, upto = self.slopes[i], i

            def hidden(X, A=A, bias=bias, slope=slope, upto=upto):
                Z = self._forward(X, upto)
                return 1.0 / (1.0 + np.exp(-slope * (Z @ A.T + bias)))
            s = _total(gram_sums(df, vec, hidden, lambda X, t, upto=upto: self._forward(X, upto),
                                 max_width=self.max_width))
            same = h_out == h_in
            if same:
                # orthogonal Procrustes: the nearest rotation of H onto Z
                u, _, vt = np.linalg.svd(s["hy"])
                beta = u @ vt
            elif self.C[i] == 0:
                beta = np.linalg.pinv(s["hh"]) @ s["hy"]
            else:
                beta = np.linalg.solve(np.eye(h_out) / self.C[i] + s["hh"], s["hy"])
            self.W_.append(beta)
            self.same_.append(same)
        L = len(self.widths)
        if label is not None:
            wanted, column = _one_hot(self.classes_), label
        else:
            wanted, column = (lambda X, t: X if t is None else _np(list(t))), target
        s = _total(gram_sums(df, vec, lambda X: self._forward(X, L), wanted, target_col=column,
                             max_width=self.max_width))
        c = self.C[L] if len(self.C) > L else 0
        if c == 0:
            self.out_ = np.linalg.pinv(s["hh"]) @ s["hy"]
        else:
            self.out_ = np.linalg.solve(np.eye(s["hh"].shape[0]) / c + s["hh"], s["hy"])
        return self

    def reconstruct(self, df: DataFrame, vec: str, out: str = "pred") -> DataFrame:
        """The class that the output layer scores highest."""
        L, outW = len(self.widths), self.out_
        return _with_class(df, vec, lambda X: self._forward(X, L) @ outW, self.classes_, self.label_type_, out)

    def reconstruct_values(self, df: DataFrame, vec: str, out: str = "values") -> DataFrame:
        """The numbers that the output layer gives, as an array."""
        L, outW = len(self.widths), self.out_
        d = self.W_[0].shape[1] if self.W_ else outW.shape[0]
        return matmul_layer(df, vec, np.eye(d), act=lambda X: self._forward(X, L) @ outW, out=out)


# --------------------------------------------------------- PCA / rotation
def covariance(df: DataFrame, vec: str, max_width: int = MAX_GRAM_WIDTH):
    """(mean, population covariance) from one Gram pass.  Null vectors don't
    count; without any vector there is none, and ValueError is raised."""
    stats = gram_sums(df, vec, lambda X: X, lambda X, t: X, max_width=max_width)
    if not stats:
        raise ValueError(f"no vector in {vec!r} to take a covariance of")
    s = _total(stats)
    n = s["n"]
    mu = s["sh"] / n
    return mu, s["hh"] / n - np.outer(mu, mu)


def pca_components(df: DataFrame, vec: str, k: int | None = None, max_width: int = MAX_GRAM_WIDTH):
    """Centred PCA (all components by default, no whitening):
    returns (mean, components as columns, explained variance)."""
    mu, cov = covariance(df, vec, max_width)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    # deterministic sign: largest-magnitude loading positive
    signs = np.sign(vecs[np.argmax(np.abs(vecs), axis=0), range(vecs.shape[1])])
    vecs = vecs * np.where(signs == 0, 1, signs)
    if k is not None:
        vecs, vals = vecs[:, :k], vals[:k]
    return mu, vecs, vals


def pca_transform(df: DataFrame, vec: str, mu, comps, out: str = "pcs") -> DataFrame:
    return matmul_layer(df, vec, comps, b=-(np.asarray(mu) @ comps), out=out)


def rotation_matrix(mu, cov, n_subsets: int | None = None, seed: int = 0):
    """Z-score the features, draw random subsets of them (which may
    overlap), and write the components of each subset's PCA, one per row, from
    the shared covariance into an NF x NF matrix; a later subset overwrites
    what it shares with an earlier one.  Without ``n_subsets`` their number is
    drawn between 2 and 2 + NF / 3; sizes are drawn between 1 and NF."""
    rs = np.random.default_rng(seed)
    nf = len(mu)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    sd = np.where(sd > 0, sd, 1.0)
    corr = cov / np.outer(sd, sd)
    R = np.zeros((nf, nf))
    if n_subsets is None:
        n_subsets = int(round(2 + nf / 3 * rs.random()))
    for _ in range(max(1, n_subsets)):
        size = int(1 + round((nf - 1) * rs.random()))
        idx = np.sort(rs.permutation(nf)[:size])
        vals, vecs = np.linalg.eigh(corr[np.ix_(idx, idx)])
        R[np.ix_(idx, idx)] = vecs[:, np.argsort(vals)[::-1]].T
    # z-scoring folded in: ((x - mu) / sd) R = x (R / sd) - (mu / sd) R
    M = R / sd[:, None]
    return M, -(mu / sd) @ R

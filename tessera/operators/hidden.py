"""Random hidden layers and fixed-weight feature maps.

Weights and centres are model parameters whose size is fixed by the layer
width (n_hidden x n_features), never by the data; they travel with the task
and every batch of rows is one matrix product.  Layer statistics that depend
on all rows (RBF input range, the sparse-filter feature norms) come from one
aggregate each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import activation, literal_array
from tessera.session import scratch_path


def dense_layer(df: DataFrame, vec: str, W: np.ndarray, b: np.ndarray, act="tanh",
                out: str = "hidden", **act_args) -> DataFrame:
    """f(x . W_j + b_j) for every unit j, as an array column.
    ``W`` has shape (n_features, n_hidden); any width is one matrix product
    per Arrow batch.  A ``Column -> Column`` activation is applied to the
    products afterwards."""
    from tessera.operators.elm import matmul_layer
    W = np.asarray(W, dtype=float)
    if callable(act):
        linear = matmul_layer(df, vec, W, b, out=out)
        return linear.withColumn(out, F.transform(F.col(out), lambda x: act(x, **act_args)))
    if act_args:
        linear = matmul_layer(df, vec, W, b, out=out)
        return linear.withColumn(out, F.transform(F.col(out), lambda x: activation(act, x, **act_args)))
    return matmul_layer(df, vec, W, b, act=act, out=out)


def random_layer_weights(n_features: int, n_hidden: int, seed: int = 0):
    """Normal weights and biases, as the simple random layer draws them."""
    rs = np.random.default_rng(seed)
    return rs.normal(size=(n_features, n_hidden)), rs.normal(size=n_hidden)


def class_centres(df: DataFrame, label: str, vec: str) -> dict:
    """Per-class mean vectors (classes x dims numbers) for use as centres."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    vectors = df.where(F.col(label).isNotNull()).select(
        label, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    rows = vectors.groupBy(label).agg(Summarizer.mean(F.col("_v")).alias("m")).collect()
    return {r[label]: np.asarray(r["m"]) for r in sorted(rows, key=lambda r: r[label])}


def rbf_radius(centres: np.ndarray) -> float:
    """Default radius: max pairwise centre distance / sqrt(2 * n_centres).
    Centres that are all equal, or one alone, have no distance to take it
    from: ValueError asks for a radius."""
    c = np.asarray(centres, dtype=float)
    d = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(-1))
    if not d.max() > 0:
        raise ValueError("the centres do not differ, so pass a radius")
    return float(d.max() / math.sqrt(2.0 * len(c)))


def uniform_centres(df: DataFrame, vec: str, n_hidden: int, seed: int = 0) -> np.ndarray:
    """Centres drawn uniformly in the global [min, max] of the input (one
    aggregate for the range)."""
    r = df.select(F.explode(vec).alias("v")).agg(F.min("v"), F.max("v")).first()
    width = df.select(F.max(F.size(vec))).first()[0]
    rs = np.random.default_rng(seed)
    return rs.uniform(float(r[0]), float(r[1]), size=(n_hidden, width))


def rbf_layer(df: DataFrame, vec: str, centres, radius=None, kind="gaussian", gamma: float = 1.0,
              out: str = "rbf") -> DataFrame:
    """f(||x - c_j|| / r_j) for every centre, as an array column.
    ``radius`` is one number, or one per centre; ``kind`` is a name or a
    ``Column -> Column`` callable of the scaled distance.  Centres are a
    parameter of the layer, so this is a projection, not a join; distances
    are computed per Arrow batch."""
    from tessera.functions.scalar import gaussian, multiquadric, polyharmonic
    from tessera.operators.elm import matmul_layer
    C = np.asarray(centres, dtype=float)
    r = np.broadcast_to(np.asarray(radius if radius is not None else rbf_radius(C), dtype=float), (len(C),))
    kinds = {"gaussian": lambda x: gaussian(x, gamma), "multiquadric": lambda x: multiquadric(x, gamma),
             "polyharmonic": lambda x: polyharmonic(x, int(gamma))}
    if not callable(kind) and kind not in kinds:
        raise ValueError(f"unknown RBF kind {kind!r}; choose from {sorted(kinds)} or pass a callable")

    def scaled(X):
        D = np.empty((len(X), len(C)))
        for j in range(len(C)):
            D[:, j] = np.sqrt(((X - C[j]) ** 2).sum(1)) / r[j]
        return D

    fn = kind if callable(kind) else kinds[kind]
    dist = matmul_layer(df, vec, np.eye(C.shape[1]), act=scaled, out=out)
    return dist.withColumn(out, F.transform(F.col(out), fn))


def sparse_filter_activation(df: DataFrame, vec: str, W: np.ndarray, out: str = "sf") -> DataFrame:
    """Remove each row's mean, linear map by W (n_out x n_in), soft
    absolute value, divide each feature by its L2 norm over all rows of the
    input, then each row by its L2 norm.  The feature norms are one
    aggregate (n_out numbers); as in the source, the result depends on the
    rows passed in.  A null vector gives null."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    from tessera.operators.elm import matmul_layer
    W = np.asarray(W, dtype=float)

    def soft(X):
        return np.sqrt(((X - X.mean(1, keepdims=True)) @ W.T) ** 2 + 1e-8)

    staged = matmul_layer(df, vec, np.eye(W.shape[1]), act=soft, out="_fs")
    # grouped, as an ungrouped summary of no rows is an error
    row = staged.where(F.col("_fs").isNotNull()).groupBy(F.lit("all").alias("_g")).agg(
        Summarizer.normL2(array_to_vector("_fs")).alias("n")).first()
    nv = np.asarray(row["n"]) if row is not None else np.ones(W.shape[0])
    nf = F.zip_with(F.col("_fs"), literal_array(nv), lambda a, b: a / b)
    staged = staged.withColumn("_nf", nf)
    row_norm = F.sqrt(F.aggregate(F.col("_nf"), F.lit(0.0), lambda acc, x: acc + x * x))
    return (staged.withColumn(out, F.zip_with("_nf", F.array_repeat(row_norm, F.size("_nf")),
                                              lambda a, b: a / b))
            .drop("_fs", "_nf"))


def sparse_filter_objective(rows: DataFrame, vec: str, W: np.ndarray) -> tuple[float, np.ndarray]:
    """(sum of all activations, its gradient by W) of ``sparse_filter_activation``.

    Two passes: the feature norms over all rows; then, with these known, each
    row's activations and what flows back through both normalisations.  A
    feature's own norm depends on all rows, so its share of the gradient is the
    sum of the rows' flows times a second sum, which comes out of the same
    pass.  Only sums of the shape of W leave the tasks."""
    W = np.asarray(W, dtype=float)
    m, d = W.shape
    src = rows.select(F.col(f"`{vec}`").cast("array<double>").alias("_x")).where("_x is not null")

    def soft(batch):
        X = np.stack([np.asarray(v, dtype=float) for v in batch["_x"]])
        X = X - X.mean(1, keepdims=True)
        A = X @ W.T
        return X, A, np.sqrt(A * A + 1e-8)

    def added(part, width):
        """Rows (j, v) of every task, summed by j on the JVM."""
        def run(batches):
            total = np.zeros((m, width))
            for batch in batches:
                if len(batch):
                    total += part(batch)
            yield pd.DataFrame({"j": np.arange(m, dtype=np.int32), "v": list(total)})

        cells = src.mapInPandas(run, "j int, v array<double>").select("j", F.posexplode("v").alias("pos", "v"))
        out = np.zeros((m, width))
        for r in cells.groupBy("j", "pos").agg(F.sum("v").alias("v")).collect():       # the shape of W
            out[r["j"], r["pos"]] = r["v"]
        return out

    norms = np.sqrt(added(lambda b: (soft(b)[2] ** 2).sum(0)[:, None], 1)[:, 0])
    if not norms.all():
        raise ValueError(f"no vector in {vec!r} to learn from")

    def back(batch):
        X, A, soft_abs = soft(batch)
        G = soft_abs / norms
        size = np.sqrt((G * G).sum(1, keepdims=True))
        H = G / size
        flow = (1.0 - H * H.sum(1, keepdims=True)) / size
        slope = A / soft_abs
        return np.hstack([H.sum(0)[:, None], (flow * G).sum(0)[:, None], (flow * slope).T @ X, (G * slope).T @ X])

    sums = added(back, 2 + 2 * d)
    gradient = (sums[:, 2:2 + d] - sums[:, 1:2] * sums[:, 2 + d:]) / norms[:, None]
    return float(sums[:, 0].sum()), gradient


def fit_sparse_filter(df: DataFrame, vec: str, n_out: int, iterations: int = 50, memory: int = 10, seed: int = 0,
                      tolerance: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """M18's weights (n_out x n_in) and the objective after every step, by a
    limited-memory quasi-Newton method: the last ``memory`` steps stand for the
    curvature, and a step is halved until the objective falls as far as the
    slope promises (a share of 1e-4).  The vectors are written once; null ones
    are left out."""
    path = scratch_path(df.sparkSession, "sparse-filter")
    df.select(F.col(f"`{vec}`").cast("array<double>").alias(vec)).where(F.col(f"`{vec}`").isNotNull()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    width = rows.select(F.max(F.size(f"`{vec}`"))).first()[0]
    if width is None:
        raise ValueError(f"no vector in {vec!r} to learn from")
    W = np.random.default_rng(seed).normal(size=(n_out, width))
    value, grad = sparse_filter_objective(rows, vec, W)
    values, past = [value], []
    for _ in range(iterations):
        if np.abs(grad).max() <= tolerance * max(1.0, abs(value)):
            break
        step = -grad
        coefficients = []
        for s, y in reversed(past):
            a = (s * step).sum() / (s * y).sum()
            coefficients.append(a)
            step = step - a * y
        if past:
            s, y = past[-1]
            step = step * ((s * y).sum() / (y * y).sum())
        else:
            step = step / max(np.abs(grad).sum(), 1e-300)
        for (s, y), a in zip(past, reversed(coefficients)):
            step = step + s * (a - (y * step).sum() / (s * y).sum())
        slope, size = (grad * step).sum(), 1.0
        if slope >= 0:                       # the curvature so far misleads: go downhill
            step, slope, past = -grad, -(grad * grad).sum(), []
        while size > 1e-12:
            new_value, new_grad = sparse_filter_objective(rows, vec, W + size * step)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break                            # no descent is left at this precision
        s, y = size * step, new_grad - grad
        if (s * y).sum() > 1e-12 * (y * y).sum():
            past = [*past, (s, y)][-memory:]
        W, value, grad = W + s, new_value, new_grad
        values.append(value)
    return W, values


def exemplar_centres(df: DataFrame, key: str, vec: str, n_hidden: int, seed: int = 0):
    """M15 ``use_exemplars``: n_hidden rows of the data, by hash order, as
    centres (n_hidden is the layer width, so the collected block is bounded)."""
    if df.limit(n_hidden).count() < n_hidden:
        raise ValueError(f"fewer than {n_hidden} rows to take exemplar centres from")
    rows = (df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
            .select(vec).limit(n_hidden).collect())
    return np.array([np.asarray(r[0], dtype=float) for r in rows])

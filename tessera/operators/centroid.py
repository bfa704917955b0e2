"""Nearest-class-mean model: a closed-form classifier fitted by aggregates.

It serves the out-of-fold machinery (J2/V2), soft and majority votes
(A18/A19) and fold scores (A17) with a model whose fit is one grouped sum.

Fitting per fold uses the "all minus fold" identity: class sums are
computed once per (fold, class) and the training mean of fold f is
``(total_c - sum_{f,c}) / (n_c - n_{f,c})``.  The means table has
folds x classes rows, each a d-vector -- its size is a function of the
model, not of the data, and is checked before it is broadcast.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_CELLS = 50_000_000  # folds * classes * dims doubles (~400 MB)


def fold_class_means(df: DataFrame, label: str, vec: str, fold: str,
                     fold_ids=None) -> DataFrame:
    """(fold, means: array<struct<label, mean array<double>>>) where the means
    of fold f are fitted on every row outside fold f.  Rows with a null label
    or vector are not fitted on."""
    # vectors are summed as vectors; only the (fold, class) sums are exploded
    known = df.where(F.col(label).isNotNull() & F.col(vec).isNotNull())
    vectors = known.select(F.col(fold).alias("_f"), F.col(label).alias("_y"),
                        array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    per = vectors.groupBy("_f", "_y").agg(Summarizer.sum(F.col("_v")).alias("_s"),
                                          F.count(F.lit(1)).alias("_n"))
    sums = per.select("_f", "_y", "_n", F.posexplode(vector_to_array("_s")).alias("_pos", "_s"))
    tot = sums.groupBy("_y", "_pos").agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    # fold ids are a model parameter (k values); every (fold, class, pos)
    # cell is produced by exploding them, including classes absent from a fold
    if fold_ids is None:
        fold_ids = [r[0] for r in df.select(fold).distinct().collect()]
    grid = tot.withColumn("_f", F.explode(F.array(*[F.lit(f) for f in fold_ids])))
    cells = (grid.join(sums, ["_f", "_y", "_pos"], "left")
             .select("_f", "_y", "_pos",
                     ((F.col("_ts") - F.coalesce(F.col("_s"), F.lit(0.0)))
                      / (F.col("_tn") - F.coalesce(F.col("_n"), F.lit(0)))).alias("_m"),
                     (F.col("_tn") - F.coalesce(F.col("_n"), F.lit(0))).alias("_cnt")))
    per_class = (cells.where(F.col("_cnt") > 0)
                 .groupBy("_f", "_y")
                 .agg(F.sort_array(F.collect_list(F.struct("_pos", "_m"))).alias("_ms")))
    return (per_class.groupBy(F.col("_f").alias(fold))
            .agg(F.collect_list(F.struct(F.col("_y").alias("label"),
                                         F.transform("_ms", lambda s: s["_m"]).alias("mean")))
                 .alias("means")))


def class_distances(vec_col, means_col):
    """array<struct<dist, label>> of squared euclidean distances."""
    def dist(m):
        d = F.aggregate(F.zip_with(vec_col, m["mean"],
                                   lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)),
                        F.lit(0.0), lambda acc, x: acc + x)
        return F.struct(d.alias("dist"), m["label"].alias("label"))
    return F.transform(means_col, dist)


def nearest_mean_oof(df: DataFrame, key: str, label: str, vec: str, fold: str,
                     models: dict | None = None, with_dists: bool = False,
                     keep=()) -> DataFrame:
    """Out-of-fold predictions of every row by the nearest training-class
    mean (ties -> smallest label), one column ``pred_<model>`` per model.  A
    null vector is predicted as null; a null label is predicted like any other
    row, as its label is no class.

    ``models`` maps a name to a dimension range ``(lo, hi)`` or None (all
    dims).  The mean of a slice is the slice of the mean, so one means table
    serves every model and the data is joined to it once.
    """
    models = models or {"all": None}
    # one small job for the model's shape: fold ids, classes, vector width
    st = df.agg(F.collect_set(fold).alias("f"), F.countDistinct(label).alias("c"),
                F.max(F.size(F.col(vec))).alias("w")).first()
    fold_ids = sorted(st["f"])
    means = fold_class_means(df, label, vec, fold, fold_ids)
    n_cells = len(fold_ids) * (st["c"] or 0) * (st["w"] or 0)   # upper bound of the table
    side = F.broadcast(means) if n_cells <= MAX_BROADCAST_CELLS else means
    res = df.join(side, fold, "left")      # a fold may have nothing to learn from
    out_cols = [key, label, fold, *keep]
    for name, dims in models.items():
        if dims is None:
            v, m = F.col(vec), F.col("means")
        else:
            lo, hi = dims
            v = F.slice(F.col(vec), lo + 1, hi - lo)
            m = F.transform("means", lambda s: F.struct(
                s["label"].alias("label"), F.slice(s["mean"], lo + 1, hi - lo).alias("mean")))
        res = res.withColumn(f"dists_{name}", class_distances(v, m)) \
                 .withColumn(f"pred_{name}", F.when(F.col(vec).isNotNull(), F.array_min(f"dists_{name}")["label"]))
        out_cols.append(f"pred_{name}")
        if with_dists:
            out_cols.append(f"dists_{name}")
    return res.select(*out_cols)


def softmax_neg_dist(dists_col):
    """Class probabilities from distances: softmax(-dist), as
    array<struct<label, p>>.  Linear in the number of classes."""
    from tessera.functions.scalar import broadcast_scalar
    mn = F.array_min(F.transform(dists_col, lambda s: s["dist"]))
    ex = F.zip_with(dists_col, broadcast_scalar(mn, dists_col), lambda s, m: F.struct(
        s["label"].alias("label"), F.exp(m - s["dist"]).alias("e")))
    tot = F.aggregate(ex, F.lit(0.0), lambda acc, s: acc + s["e"])
    return F.zip_with(ex, broadcast_scalar(tot, ex), lambda s, t: F.struct(
        s["label"].alias("label"), (s["e"] / t).alias("p")))

"""Registered feature, metric, split and ensemble queries."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import centroid, elm, features, metrics, validate
from tessera.session import cut_lineage, table

R9 = 9


def _r(c, d=R9):
    return F.round(c, d)


# ------------------------------------------------------------ projections
def opposite_bearing(spark: SparkSession, sf: str) -> DataFrame:
    b = (F.col("l_partkey") % 361).cast("double")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", b.alias("bearing"), S.opposite_bearing(b).alias("opposite"))


def negative_flag(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", S.negative_flag("c_acctbal").alias("is_negative"))


def linear_feature(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        _r(features.linear_combination("l_extendedprice", "l_quantity"), 6).alias("diff"),
        _r(features.linear_combination("l_extendedprice", "l_quantity", 0.2), 6).alias("diff_w"))


def euclid_feature(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        _r(S.euclid(F.col("l_quantity"), F.col("l_discount") * 100)).alias("dist"))


PAIR_COLS = ["qty", "tax_pct", "disc_pct"]


def pairwise_features(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"),
        (F.col("l_tax") * 100).alias("tax_pct"), (F.col("l_discount") * 100).alias("disc_pct"))
    out = features.pairwise_features(base, PAIR_COLS, kinds=("sum", "abs_sum", "abs_diff"))
    return out.select("l_orderkey", "l_linenumber",
                      *[_r(F.col(c), 6).alias(c) for c in out.columns
                        if c.endswith(("_sum", "_abs_diff"))])


def label_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_brand",
                                           S.label_suffix("p_brand").alias("suffix"))


def datetime_features(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "ts")
    return features.datetime_features(ev, "ts").drop("ts")


def blocked_day_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Per fold d (test days d, d+1): sizes and mean target of both sides.
    Days are pre-aggregated first, so the fold logic touches 31 rows."""
    ev = table(spark, sf, "events")
    per_day = ev.groupBy(F.dayofmonth("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    folds = validate.blocked_day_folds(10, 18)
    fold_of_day = F.explode(F.array(*[
        F.when(F.col("day").isin(a, b), F.lit(d)) for d, (a, b) in folds]))
    tagged = per_day.select("*", fold_of_day.alias("fold")).where(F.col("fold").isNotNull())
    test = tagged.groupBy("fold").agg(F.sum("n").alias("n_test"), F.sum("s").alias("s_test"))
    tot = per_day.agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all")).first()
    n_all, s_all = F.lit(tot["n_all"]), F.lit(tot["s_all"])
    return (test.withColumn("n_all", n_all).withColumn("s_all", s_all)
            .select(F.col("fold").cast("int").alias("fold"), F.col("n_test"),
                    (F.col("n_all") - F.col("n_test")).alias("n_train"),
                    _r(F.col("s_test") / F.col("n_test"), 6).alias("mean_test"),
                    _r((F.col("s_all") - F.col("s_test")) / (F.col("n_all") - F.col("n_test")), 6)
                    .alias("mean_train")))


def minmax_stretch(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = features.minmax_stretch(li, "l_extendedprice", "stretch")
    return out.select("l_orderkey", "l_linenumber", _r(F.col("stretch")).alias("stretch"))


def log_target_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    ly = S.log_target("value")
    return ev.select("event_id", _r(ly).alias("log_y"), _r(S.inverse_log_target(ly)).alias("back"))


def _emb_long(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("pos", "v")) \
        .withColumn("v", F.col("v").cast("double"))


def threshold_values(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: (x.cast("double") + 0.6) / 1.2)
    out = emb.select("vec_id", F.posexplode(F.transform(scaled, lambda x: S.threshold_value(x)))
                     .alias("pos", "value"))
    return out.select("vec_id", "pos", _r(F.col("value")).alias("value"))


ACTIVATION_NAMES = ["sigmoid", "tanh", "sine", "relu", "tribas", "hardlim", "gaussian",
                    "multiquadric"]


def activation_table(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    x = (F.col("l_quantity") - 25.5) / 10.0
    cols = [_r(S.activation(n, x)).alias(n) for n in ACTIVATION_NAMES]
    cols.append(_r(S.polyharmonic(F.abs(x), 2)).alias("polyharmonic"))
    return li.select("l_orderkey", "l_linenumber", _r(x).alias("x"), *cols)


def softmax_rows(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    return emb.select("vec_id", F.posexplode(S.softmax_array("embedding")).alias("pos", "p")) \
              .select("vec_id", "pos", _r(F.col("p")).alias("p"))


def argmax_class(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", S.argmax_array("embedding").alias("argmax"))


# ---------------------------------------------------------------- metrics
def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """labels x documents with a rule-based score p = sigmoid((ln n_chars - 7)/2)."""
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id")
    p = S.sigmoid((F.ln(F.col("n_chars").cast("double")) - 7.0) / 2.0)
    return j.select("doc_id", F.col("quality").alias("y"), p.alias("p"),
                    (p >= 0.5).cast("int").alias("yhat"))


def log_loss_binary(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.log_loss_binary(scored_documents(spark, sf), "p", "y")
    return m.select(_r(F.col("log_loss")).alias("log_loss"), "n")


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(scored_documents(spark, sf), "y", "yhat")


def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.accuracy(scored_documents(spark, sf), "y", "yhat")
    return m.select(_r(F.col("accuracy")).alias("accuracy"), "n")


def _emb_logits(spark, sf):
    """Every value of a vector as the logit of a class."""
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("logits"))


def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    e = _emb_logits(spark, sf).withColumn("pred", S.argmax_array("logits"))
    rep = metrics.classification_report(e, "label", "pred")
    return rep.select("label", _r(F.col("precision")).alias("precision"),
                      _r(F.col("recall")).alias("recall"), _r(F.col("f1")).alias("f1"), "support")


def log_loss_multi(spark: SparkSession, sf: str) -> DataFrame:
    e = _emb_logits(spark, sf)
    e = e.withColumn("p_true", F.element_at(S.softmax_array("logits"), F.col("label") + 1))
    m = metrics.log_loss_multi(e, "p_true")
    return m.select(_r(F.col("log_loss")).alias("log_loss"), "n")


def rmsle(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 1000.0).alias("pred"), F.col("l_quantity").alias("y0"),
        (F.col("l_tax") * 100).alias("y1"))
    m = metrics.rmsle(li, "pred", "y0", "y1")
    return m.select(_r(F.col("rmsle")).alias("rmsle"), "n")


# ------------------------------------------------------------------ splits
K_FOLDS = 5


def portable_order(key: str, seed: int) -> F.Column:
    """A seeded pseudo-random order that SQL engines can reproduce exactly."""
    return F.pmod(F.col(key) * F.lit(2654435761) + F.lit(seed), F.lit(4294967291))


def emb_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with exact stratified folds, written once to the shared
    checkpoint folder: every consumer (class sums, joins, model fits) reads
    the table instead of re-expanding the fold numbering."""
    emb = table(spark, sf, "embeddings")
    return cut_lineage(validate.stratified_folds(emb, "vec_id", "label", K_FOLDS))


def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return emb_folds(spark, sf).select("vec_id", "label", "fold")


def stratified_holdout(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings").select("vec_id", "label")
    out = validate.stratified_holdout(emb, "vec_id", "label", 0.15,
                                      order=portable_order("vec_id", 17))
    return out.select("vec_id", "label", "is_train")


def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels").select("doc_id")
    out = validate.holdout_split(lab, "doc_id", 0.3,
                                 bucket=F.pmod(portable_order("doc_id", 7), F.lit(1000)))
    return out.select("doc_id", "is_test")


# ------------------------------------------------------------- Gram sums
def pca_covariance(spark: SparkSession, sf: str) -> DataFrame:
    """The covariance that PCA and the rotations are solved from."""
    _, cov = elm.covariance(table(spark, sf, "embeddings").select("embedding"), "embedding")
    rows = [(i, j, float(v)) for i, row in enumerate(cov) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "i int, j int, cov double").select("i", "j", _r(F.col("cov"), 9).alias("cov"))


GRAM_UNITS = 6


def elm_gram_sums(spark: SparkSession, sf: str) -> DataFrame:
    """H'H of a hidden layer whose weights a formula gives."""
    W = np.array([[math.sin(7 * i + 3 * j + 1) for j in range(GRAM_UNITS)] for i in range(64)])
    stats = elm.gram_sums(table(spark, sf, "embeddings").select("embedding"), "embedding", lambda X: np.tanh(X @ W))
    rows = [(i, j, float(v)) for i, row in enumerate(stats[0]["hh"]) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "i int, j int, hh double").select("i", "j", _r(F.col("hh"), 6).alias("hh"))


def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """1,000 events by an order that SQL can hash too."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    order = F.conv(F.substring(F.md5(F.concat(F.lit("7|"), F.col("event_id").cast("string"))), 1, 15), 16, 10).cast("long")
    return features.sample_rows(ev, "event_id", 1000, order=order)


LOO_ALPHAS = [0.01, 1.0, 100.0, 10000.0]


def loo_ridge_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Leave-one-out error of every alpha, for a unit whose weights a formula gives."""
    w = np.array([[math.sin(7 * i + 1)] for i in range(64)])
    emb, hide = table(spark, sf, "embeddings").select("embedding"), lambda X: np.tanh(X @ w)
    stats = elm._total(elm.gram_sums(emb, "embedding", hide))
    errors = elm.leave_one_out(emb, "embedding", hide, LOO_ALPHAS, stats)
    return spark.createDataFrame(list(errors.items()), "alpha double, error double").withColumn("error", _r(F.col("error"), 9))


# -------------------------------------------------------------- ensembles
MODELS = {"all": None, "first_half": (0, 32), "second_half": (32, 64)}


def _oof(spark, sf, with_dists=False):
    return centroid.nearest_mean_oof(emb_folds(spark, sf), "vec_id", "label", "embedding", "fold",
                                     MODELS, with_dists=with_dists)


def oof_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _oof(spark, sf).select("vec_id", "label", "fold", "pred_all", "pred_first_half", "pred_second_half")


def soft_vote(spark: SparkSession, sf: str) -> DataFrame:
    o = _oof(spark, sf, with_dists=True)
    # the arrays list classes in the same order (same means table)
    p = [centroid.softmax_neg_dist(F.col(f"dists_{m}")) for m in MODELS]
    avg = F.transform(p[0], lambda x, i: F.struct(
        (sum((q[i]["p"] for q in p[1:]), x["p"]) / len(p)).alias("p"), (-x["label"]).alias("neg_label")))
    best = F.array_max(avg)
    return o.select("vec_id", (-best["neg_label"]).alias("pred"), _r(best["p"], 6).alias("p_max"))


def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    o = _oof(spark, sf)
    votes = F.array(*[F.col(f"pred_{m}") for m in MODELS])
    counted = F.transform(F.array_distinct(votes), lambda v: F.struct(
        F.size(F.filter(votes, lambda x: x == v)).alias("n"), (-v).alias("neg")))
    best = F.array_max(counted)
    return o.select("vec_id", (-best["neg"]).alias("vote"))


def _fold_scores(spark, sf):
    o = _oof(spark, sf)
    long = o.select("fold", F.inline(F.array(*[
        F.struct(F.lit(m).alias("title"), (F.col(f"pred_{m}") == F.col("label")).cast("double")
                 .alias("hit")) for m in MODELS])))
    return long.groupBy("title", "fold").agg(F.avg("hit").alias("score"))


def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.score_summary(_fold_scores(spark, sf), "title", "score")
    return s.select("title", *[_r(F.col(c)).alias(c) for c in ("mean", "max", "min", "std")])


def top_models(spark: SparkSession, sf: str) -> DataFrame:
    s = score_summary(spark, sf)
    return metrics.top_models(s, n=2).select("title", "mean", "rank")


QUERIES = {
    "opposite_bearing": opposite_bearing,
    "negative_flag": negative_flag,
    "linear_feature": linear_feature,
    "euclid_feature": euclid_feature,
    "pairwise_features": pairwise_features,
    "label_suffix": label_suffix,
    "datetime_features": datetime_features,
    "blocked_day_folds": blocked_day_folds,
    "minmax_stretch": minmax_stretch,
    "log_target_roundtrip": log_target_roundtrip,
    "threshold_values": threshold_values,
    "activation_table": activation_table,
    "softmax_rows": softmax_rows,
    "argmax_class": argmax_class,
    "log_loss_binary": log_loss_binary,
    "confusion_matrix": confusion_matrix,
    "accuracy": accuracy,
    "classification_report": classification_report,
    "log_loss_multi": log_loss_multi,
    "rmsle": rmsle,
    "stratified_folds": stratified_folds,
    "stratified_holdout": stratified_holdout,
    "holdout_split": holdout_split,
    "pca_covariance": pca_covariance,
    "elm_gram_sums": elm_gram_sums,
    "loo_ridge_errors": loo_ridge_errors,
    "sample_rows": sample_rows,
    "oof_matrix": oof_matrix,
    "soft_vote": soft_vote,
    "majority_vote": majority_vote,
    "score_summary": score_summary,
    "top_models": top_models,
}

"""Registered model queries (row-count check only: fitted models have no
SQL twin).  Train on folds 1-4 of the embeddings, predict fold 0, unless
the operator itself is a cross-validation."""

from __future__ import annotations

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier,
                                       LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import elm, metrics, models
from tessera.plans.catalog_features import emb_folds
from tessera.session import cut_lineage, table


def _split(spark, sf):
    # folds + vectors written once to the checkpoint folder: every model
    # iteration below re-reads this table instead of recomputing it
    f = cut_lineage(models.with_vector(emb_folds(spark, sf), "embedding"))
    return f.where(F.col("fold") != 0), f.where(F.col("fold") == 0), f


def _predict(est, spark, sf) -> DataFrame:
    train, test, _ = _split(spark, sf)
    return est.fit(train).transform(test).select(
        "vec_id", "label", F.col("prediction").cast("int").alias("prediction"))


def rf_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _predict(RandomForestClassifier(numTrees=30, impurity="gini", seed=0), spark, sf)


def gbt_ovr(spark: SparkSession, sf: str) -> DataFrame:
    return _predict(models.multiclass_gbt(maxIter=5, maxDepth=3, seed=0), spark, sf)


def logreg(spark: SparkSession, sf: str) -> DataFrame:
    train, test, _ = _split(spark, sf)
    fitted = models.logistic(C=1.0, n=train.count(), maxIter=100).fit(train)
    return fitted.transform(test).select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"))


def linear_svm_ovr(spark: SparkSession, sf: str) -> DataFrame:
    return _predict(models.linear_svm(maxIter=10, regParam=0.01), spark, sf)


def mlp_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _predict(models.mlp([64, 32, 10], maxIter=60), spark, sf)


def stack_blend(spark: SparkSession, sf: str) -> DataFrame:
    _, _, f = _split(spark, sf)
    f = f.withColumn("y", (F.col("label") < 5).cast("double"))
    base = {
        "rf_gini": RandomForestClassifier(numTrees=20, impurity="gini", labelCol="y", seed=0),
        "et_entropy": models.extra_trees(numTrees=20, impurity="entropy", labelCol="y", seed=0),
        "gbt": GBTClassifier(maxIter=5, maxDepth=4, subsamplingRate=0.5, labelCol="y", seed=0),
    }
    # fold 0 is the test set; the others are the blend's folds
    out = models.stack_blend(f.where("fold != 0"), "vec_id", "y", base, test=f.where("fold = 0"))
    return out.select("vec_id", F.round("p_stretch", 9).alias("p_stretch"))


def _events_features(spark, sf):
    ev = table(spark, sf, "events")
    ev = models.dealt(ev.select("event_id", "value", F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour"),
                                F.dayofmonth("ts").alias("day"), "event_type"))
    ev = StringIndexer(inputCol="event_type", outputCol="etype", stringOrderType="alphabetAsc") \
        .fit(ev).transform(ev)
    ev = ev.withColumn("y0", F.col("value")).withColumn("y1", F.col("value") * 0.5)
    return VectorAssembler(inputCols=["weekday", "hour", "day", "etype"],
                           outputCol="features").transform(ev)


def two_part_regression(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events_features(spark, sf)
    test_mask = F.col("day").isin(10, 11)
    reg = models.MeanRegressor([
        models.TwoPartRegressor(RandomForestRegressor(numTrees=20, seed=0),
                                RandomForestRegressor(numTrees=20, seed=0), "y0", "y1"),
        models.TwoPartRegressor(GBTRegressor(maxIter=10, seed=0), GBTRegressor(maxIter=10, seed=0),
                                "y0", "y1")])
    return reg.fit(ev.where(~test_mask)).predict(ev.where(test_mask), "event_id")


def blocked_day_cv(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events_features(spark, sf)
    return models.blocked_day_cv(
        ev, "day", lambda: models.TwoPartRegressor(LinearRegression(), LinearRegression(),
                                                   "y0", "y1"),
        "event_id", "y0", "y1")


def elm_classify(spark: SparkSession, sf: str) -> DataFrame:
    f = cut_lineage(emb_folds(spark, sf))
    clf = elm.ElmClassifier(n_hidden=200, density=1, seed=0).fit(
        f.where(F.col("fold") != 0), "embedding", "label")
    return clf.predict(f.where(F.col("fold") == 0).select("vec_id", "label", "embedding"),
                       "embedding").select("vec_id", "label", "pred")


def elm_ae_features(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    ae = elm.ElmAutoEncoder(k=16, seed=0).fit(emb, "embedding", "vec_id")
    out = ae.transform(emb, "embedding", "ae")
    return out.select("vec_id", F.posexplode("ae").alias("unit", "value"))


def deep_elm_ae(spark: SparkSession, sf: str) -> DataFrame:
    f = cut_lineage(emb_folds(spark, sf))
    m = elm.DeepElmAutoEncoder(widths=[32, 32], C=[1e3, 0, 1e3], slopes=[1.0, 1.0]).fit(
        f.where(F.col("fold") != 0), "embedding", "label")
    return m.reconstruct(f.where(F.col("fold") == 0).select("vec_id", "label", "embedding"),
                         "embedding").select("vec_id", "label", "pred")


def rotation_forest(spark: SparkSession, sf: str) -> DataFrame:
    f = emb_folds(spark, sf)
    rf = models.RotationForest({
        "tree": DecisionTreeClassifier(maxDepth=6, seed=0),
        "nb": models.gaussian_nb(),
        "logit": LogisticRegression(maxIter=50),
        "elm": models.ElmMember(n_hidden=100, density=1),
        "knn": models.NeighbourMember(k=3, key="vec_id"),
    }, n=5, seed=0).fit(f.where(F.col("fold") != 0), "embedding", "label", "vec_id")
    return rf.predict(f.where(F.col("fold") == 0), "embedding", "vec_id")


def pca_features(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    mu, comps, _ = elm.pca_components(emb, "embedding", k=8)
    out = elm.pca_transform(emb, "embedding", mu, comps, out="pcs")
    return out.select("vec_id", F.posexplode("pcs").alias("component", "value"))


def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    _, _, f = _split(spark, sf)
    lr = LogisticRegression(maxIter=50)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.01, 0.1]) \
        .addGrid(lr.elasticNetParam, [0.0, 0.5]).build()
    return models.grid_search(f, lr, grid)


def random_search(spark: SparkSession, sf: str) -> DataFrame:
    _, _, f = _split(spark, sf)
    lr = LogisticRegression()
    space = {"regParam": ("exp", 1e-4, 1.0), "elasticNetParam": ("uniform", 0.0, 1.0),
             "maxIter": ("int", 10, 50)}
    return models.random_search(f, lr, space, n=8, seed=0)


def feature_group_cv(spark: SparkSession, sf: str) -> DataFrame:
    f = emb_folds(spark, sf)
    scores = models.feature_group_cv(f, [(0, 32), (32, 64), (0, 64)], "label",
                                     models.gaussian_nb(), "embedding",
                                     titles=["first_half", "second_half", "all"])
    return metrics.score_summary(scores, "title", "score")


def rank_features(spark: SparkSession, sf: str) -> DataFrame:
    _, _, f = _split(spark, sf)
    return models.rank_features(f, [f"f{i}" for i in range(64)], "label")


def soft_vote_models(spark: SparkSession, sf: str) -> DataFrame:
    train, test, _ = _split(spark, sf)
    sv = models.SoftVote([RandomForestClassifier(numTrees=20, seed=0), models.gaussian_nb(),
                          LogisticRegression(maxIter=50)]).fit(train)
    return sv.transform(test, "vec_id").select("vec_id", F.col("prediction").cast("int")
                                               .alias("prediction"))


def rbf_svm(spark: SparkSession, sf: str) -> DataFrame:
    """C8 re-aim: RBF features (centres = 20 exemplar rows) + linear SVM.
    Not the kernel SVM's optimum; the nearest table-scale form."""
    from tessera.operators import hidden
    train, test, f = _split(spark, sf)
    C = hidden.exemplar_centres(train, "vec_id", "embedding", 20, seed=0)
    feats = models.with_vector(hidden.rbf_layer(f, "embedding", C, out="rbf"), "rbf")
    est = models.linear_svm(maxIter=10, regParam=0.01)
    m = est.fit(feats.where("fold != 0"))
    return m.transform(feats.where("fold = 0")).select(
        "vec_id", "label", F.col("prediction").cast("int").alias("prediction"))


def shuffle_split(spark: SparkSession, sf: str) -> DataFrame:
    _, _, f = _split(spark, sf)
    return models.shuffle_split_scores(f, "vec_id", "label", models.gaussian_nb(), n=3,
                                       train_frac=0.15)


def naive_bayes_classify(spark: SparkSession, sf: str) -> DataFrame:
    """C4/C5 fitted: Bernoulli NB on inputs binarised at 0, multinomial NB
    on inputs min-max scaled to [0, 1] over all rows (it needs
    non-negative counts),
    Gaussian NB on the raw values; one prediction column per kind."""
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import MinMaxScaler
    train, test, f = _split(spark, sf)
    bern = NaiveBayes(modelType="bernoulli", featuresCol="bin", predictionCol="p_bern",
                      probabilityCol="pr_b", rawPredictionCol="raw_b")
    tr_b = models.bernoulli_nb(train)
    out = bern.fit(tr_b).transform(models.bernoulli_nb(test))
    # the scaler is fitted on every row (features only, no labels), as the
    # source fits its scaler on the unlabelled table: no value leaves [0, 1]
    scaler = MinMaxScaler(inputCol="features", outputCol="scaled").fit(f)
    multi = NaiveBayes(modelType="multinomial", featuresCol="scaled", predictionCol="p_multi",
                       probabilityCol="pr_m", rawPredictionCol="raw_m")
    out = multi.fit(scaler.transform(train)).transform(scaler.transform(out))
    gauss = models.gaussian_nb(predictionCol="p_gauss", probabilityCol="pr_g",
                               rawPredictionCol="raw_g")
    out = gauss.fit(train).transform(out)
    return out.select("vec_id", "label", *[F.col(c).cast("int").alias(c)
                                           for c in ("p_bern", "p_multi", "p_gauss")])


def repeated_holdout(spark: SparkSession, sf: str) -> DataFrame:
    _, _, f = _split(spark, sf)
    return models.repeated_holdout_scores(f, "vec_id", "label", models.gaussian_nb(), n=4,
                                          test_frac=0.3)


QUERIES = {
    "naive_bayes_classify": naive_bayes_classify,
    "repeated_holdout": repeated_holdout,
    "rbf_svm": rbf_svm,
    "shuffle_split": shuffle_split,
    "rf_classify": rf_classify,
    "gbt_ovr": gbt_ovr,
    "logreg": logreg,
    "linear_svm_ovr": linear_svm_ovr,
    "mlp_classify": mlp_classify,
    "stack_blend": stack_blend,
    "two_part_regression": two_part_regression,
    "blocked_day_cv": blocked_day_cv,
    "elm_classify": elm_classify,
    "elm_ae_features": elm_ae_features,
    "deep_elm_ae": deep_elm_ae,
    "rotation_forest": rotation_forest,
    "pca_features": pca_features,
    "grid_search": grid_search,
    "random_search": random_search,
    "feature_group_cv": feature_group_cv,
    "rank_features": rank_features,
    "soft_vote_models": soft_vote_models,
}

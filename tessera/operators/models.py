"""Model fitting, cross-validation and ensembles on Spark ML.

Folds are a column (``fold``), so every fit sees a filtered DataFrame and
``CrossValidator(foldCol=...)`` can be used for searches.  Per-fold scores
are small tables; ensembles combine probability columns by key, never by
row position.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def with_vector(df: DataFrame, array_col: str, out: str = "features", dims=None) -> DataFrame:
    """array<float> -> ml Vector (optionally a dimension slice)."""
    arr = F.col(array_col)
    if dims is not None:
        arr = F.slice(arr, dims[0] + 1, dims[1] - dims[0])
    return df.withColumn(out, array_to_vector(F.transform(arr, lambda x: x.cast("double"))))


#: Rows of a task where a fit reads the same rows again and again.
TASK_ROWS = 1 << 17


def dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written once for fits that read it many times, in as many
    partitions as its rows need: files of few bytes a row give too few tasks.
    Enough partitions stay as they are."""
    need = math.ceil(df.count() / (rows or TASK_ROWS))
    return cut_lineage(df.repartition(need) if need > df.rdd.getNumPartitions() else df)


def extra_trees(**kw) -> RandomForestClassifier:
    """Nearest Spark form of extra-trees: no bootstrap, all rows per tree.
    Split thresholds are not random, so results differ from extra-trees."""
    return RandomForestClassifier(bootstrap=False, **kw)


def multiclass_gbt(parallelism: int = 4, **kw) -> OneVsRest:
    """GBTClassifier is binary only; one-vs-rest for multi-class."""
    return OneVsRest(classifier=GBTClassifier(**kw), parallelism=parallelism)


def linear_svm(parallelism: int = 4, **kw) -> OneVsRest:
    """Linear SVM (L2 only in Spark; the source's L1 hinge has no twin).
    The one-vs-rest fits run ``parallelism`` at a time."""
    return OneVsRest(classifier=LinearSVC(**kw), parallelism=parallelism)


def bernoulli_nb(df: DataFrame, features: str = "features", out: str = "bin") -> DataFrame:
    """Bernoulli NB needs 0/1 inputs: binarise at 0 first."""
    from pyspark.ml.feature import Binarizer
    return Binarizer(threshold=0.0, inputCol=features, outputCol=out).transform(df)


def logistic(C: float = 1.0, n: int | None = None, **kw) -> LogisticRegression:
    """Logistic regression with the reference's C mapped to regParam 1/(C n)."""
    reg = 1.0 / (C * n) if n else 0.0
    return LogisticRegression(family="multinomial", regParam=reg, **kw)


# ---------------------------------------------------------------- scoring
def accuracy_of(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    return pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double"))).first()[0]


def _together(spark, fn, items, parallelism: int = 4) -> list:
    """``fn`` of every item in order, several Spark jobs at a time."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    items = list(items)
    with ThreadPool(max(1, min(parallelism, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), items)


def cv_scores(df: DataFrame, estimator: Estimator, label: str = "label", fold: str = "fold",
              metric: str = "accuracy") -> DataFrame:
    """V1/V2: score of a fresh fit per fold (train on the other folds).
    Returns (fold, score); the fold list is read once (k values)."""
    spark = df.sparkSession
    df = cut_lineage(df)      # k fits reuse the input; never recompute its lineage
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)

    def score(f):
        model = estimator.copy().fit(df.where(F.col(fold) != f))
        return int(f), float(ev.evaluate(model.transform(df.where(F.col(fold) == f))))

    return spark.createDataFrame(_together(spark, score, folds), "fold int, score double")


def oof_predict(df: DataFrame, key: str, estimator: Estimator, fold: str = "fold",
                prob_col: str = "probability") -> DataFrame:
    """V2: every row predicted exactly once by the model not trained on its
    fold; output (key, fold, prediction, probability array)."""
    df = cut_lineage(df)
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())

    def predict(f):
        model = estimator.copy().fit(df.where(F.col(fold) != f))
        p = model.transform(df.where(F.col(fold) == f))
        cols = [key, fold, "prediction"]
        if prob_col in p.columns:
            p = p.withColumn(prob_col, vector_to_array(prob_col))
            cols.append(prob_col)
        return p.select(*cols)

    parts = _together(df.sparkSession, predict, folds)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_table(scores: dict[str, DataFrame]) -> DataFrame:
    """(title, fold, score) from per-title fold score tables."""
    out = None
    for title, s in scores.items():
        t = s.withColumn("title", F.lit(title))
        out = t if out is None else out.unionByName(t)
    return out


def feature_group_cv(df: DataFrame, groups, label: str, estimator: Estimator, array_col: str,
                     titles=None, fold: str = "fold") -> DataFrame:
    """V7: one CV per feature group (groups are dim ranges or index lists);
    titles must match the groups in number."""
    if titles is not None and len(titles) != len(groups):
        raise ValueError(f"{len(groups)} feature groups need as many titles, got {len(titles)}")
    titles = titles or [str(i) for i in range(len(groups))]
    scores = {}
    for t, g in zip(titles, groups):
        if isinstance(g, tuple):
            v = with_vector(df, array_col, dims=g)
        else:
            v = df.withColumn("features", array_to_vector(F.array(*[
                F.element_at(array_col, i + 1).cast("double") for i in g])))
        scores[t] = cv_scores(v, estimator, label, fold)
    return score_table(scores)


def shuffle_split_scores(df: DataFrame, key: str, label: str, estimator: Estimator,
                         n: int = 3, train_frac: float = 0.15) -> DataFrame:
    """V3: n stratified shuffle splits (train_frac of every class trains,
    the rest tests), stratified on the label actually passed in (the
    source stratified on a global)."""
    from tessera.operators.validate import hash_order, stratified_holdout
    df = cut_lineage(df)
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")

    def score(i):
        split = stratified_holdout(df, key, label, train_frac, order=hash_order(key, 4 * i))
        model = estimator.copy().fit(split.where("is_train"))
        return i, float(ev.evaluate(model.transform(split.where("NOT is_train"))))

    return df.sparkSession.createDataFrame(_together(df.sparkSession, score, range(n)),
                                           "repeat int, score double")


def repeated_holdout_scores(df: DataFrame, key: str, label: str, estimator: Estimator,
                            n: int = 4, test_frac: float = 0.3) -> DataFrame:
    """V5: n random hold-outs (seeds 0, 4, 8, ...), accuracy of a fresh fit
    on each; (repeat, score) rows, average with ``score_summary``."""
    from tessera.operators.validate import holdout_split
    df = cut_lineage(df)
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")

    def score(i):
        split = holdout_split(df, key, test_frac, seed=4 * i)
        model = estimator.copy().fit(split.where("NOT is_test"))
        return i, float(ev.evaluate(model.transform(split.where("is_test"))))

    rows = _together(df.sparkSession, score, range(n))
    return df.sparkSession.createDataFrame(rows, "repeat int, score double")


def cv_per_dataset(df: DataFrame, dataset: str, key: str, label: str, estimator: Estimator,
                   k: int = 11) -> DataFrame:
    """S5 + V1: the benchmark loop over numbered datasets (one file each,
    read together with ``io.read_numbered``): stratified k folds inside each
    dataset, a fresh fit per fold.  Returns (dataset, fold, score).  The
    dataset list is the number of input files, so it is small."""
    from tessera.operators.validate import stratified_folds
    df = cut_lineage(df)
    out = None
    for d in sorted(r[0] for r in df.select(dataset).distinct().collect()):
        part = stratified_folds(df.where(F.col(dataset) == d), key, label, k)
        sc = cv_scores(part, estimator, label).withColumn(dataset, F.lit(d))
        out = sc if out is None else out.unionByName(sc)
    return out


def compare_models(df: DataFrame, estimators: dict, label: str = "label",
                   fold: str = "fold") -> DataFrame:
    """V8: fold scores for every named estimator."""
    return score_table({n: cv_scores(df, e, label, fold) for n, e in estimators.items()})


def grid_search(df: DataFrame, estimator, grid, label: str = "label", fold: str = "fold",
                parallelism: int = 2) -> DataFrame:
    """V9: ParamGridBuilder grid scored by CrossValidator on the fold column;
    returns (params, metric) rows."""
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    df = cut_lineage(df)
    k = df.select(fold).distinct().count()          # fold ids must be 0..k-1
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=ev,
                        foldCol=fold, numFolds=k, parallelism=parallelism)
    model = cv.fit(df)
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda kv: kv[0].name)),
             float(m)) for pm, m in zip(grid, model.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, "params string, metric double")


def sample_param_maps(estimator, space: dict, n: int = 8, seed: int = 0):
    """N draws from {param: ("int", lo, hi) | ("uniform", lo, hi) |
    ("exp", lo, hi) | list of choices}."""
    rs = random.Random(seed)
    maps = []
    for _ in range(n):
        pm = {}
        for name, spec in space.items():
            p = estimator.getParam(name)
            if isinstance(spec, list):
                pm[p] = rs.choice(spec)
            elif spec[0] == "int":
                pm[p] = rs.randint(spec[1], spec[2])
            elif spec[0] == "uniform":
                pm[p] = rs.uniform(spec[1], spec[2])
            elif spec[0] == "exp":
                pm[p] = math.exp(rs.uniform(math.log(spec[1]), math.log(spec[2])))
        maps.append(pm)
    return maps


def random_search(df: DataFrame, estimator, space: dict, n: int = 8, seed: int = 0,
                  label: str = "label", fold: str = "fold") -> DataFrame:
    return grid_search(df, estimator, sample_param_maps(estimator, space, n, seed), label, fold)


def rank_features(df: DataFrame, feature_names, label: str = "label",
                  estimator=None) -> DataFrame:
    """Importances from a forest, descending (rank, attribute, importance)."""
    est = estimator or RandomForestClassifier(numTrees=50, labelCol=label, seed=0)
    model = est.fit(df)
    imp = model.featureImportances.toArray()
    order = np.argsort(-imp, kind="stable")
    rows = [(i + 1, feature_names[j], float(imp[j])) for i, j in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, "rank int, attribute string, importance double")


# -------------------------------------------------------------- ensembles
def _renamed(model, tag: str):
    """Give a fitted model's output columns unique names so several models
    can be applied to one DataFrame in a chain (no join back on the key)."""
    for setter, name in (("setPredictionCol", "pred"), ("setProbabilityCol", "prob"),
                         ("setRawPredictionCol", "raw")):
        if hasattr(model, setter):
            getattr(model, setter)(f"_{name}_{tag}")
    return model


def _drop_outputs(df: DataFrame, tag: str) -> DataFrame:
    return df.drop(*[f"_{n}_{tag}" for n in ("pred", "prob", "raw")])


class SoftVote:
    """Average the class-probability vectors of several fitted
    models; prediction = arg-max of the mean (ties -> lowest class).  The
    models are applied one after another to the same rows: row-wise
    transforms, no join on the key."""

    def __init__(self, estimators):
        self.estimators = list(estimators)

    def fit(self, df: DataFrame):
        self.models_ = [e.copy().fit(df) for e in self.estimators]
        return self

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        cur = df
        for i, m in enumerate(self.models_):
            cur = _renamed(m, f"sv{i}").transform(cur).withColumn(
                f"_p{i}", vector_to_array(f"_prob_sv{i}"))
            cur = _drop_outputs(cur, f"sv{i}")
        n = len(self.models_)
        mean = F.col("_p0")
        for i in range(1, n):
            mean = F.zip_with(mean, F.col(f"_p{i}"), lambda a, b: a + b)
        mean = F.transform(mean, lambda x: x / n)
        return cur.select(key, mean.alias("probability")).withColumn(
            "prediction", F.array_position("probability", F.array_max("probability")) - 1)


class TwoPartRegressor:
    """One regressor on log1p(y0), one on log1p(y1); prediction is
    round_half_even(expm1(p0) + expm1(p1)) floored at 0."""

    def __init__(self, r0, r1, y0: str, y1: str, features: str = "features"):
        self.r0, self.r1, self.y0, self.y1, self.features = r0, r1, y0, y1, features

    def fit(self, df: DataFrame):
        self.m0_ = self.r0.copy().setLabelCol("_l0").setFeaturesCol(self.features).fit(
            df.withColumn("_l0", F.log1p(self.y0)))
        self.m1_ = self.r1.copy().setLabelCol("_l1").setFeaturesCol(self.features).fit(
            df.withColumn("_l1", F.log1p(self.y1)))
        return self

    def with_raw(self, df: DataFrame, out: str = "raw") -> DataFrame:
        """Adds expm1(p0) + expm1(p1) as ``out`` (chained transforms)."""
        cur = self.m1_.setPredictionCol("_tp1").transform(
            self.m0_.setPredictionCol("_tp0").transform(df))
        return cur.withColumn(out, F.expm1("_tp0") + F.expm1("_tp1")).drop("_tp0", "_tp1")

    def raw(self, df: DataFrame, key: str) -> DataFrame:
        return self.with_raw(df).select(key, "raw")

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        return self.with_raw(df).select(key, F.greatest(F.bround("raw", 0), F.lit(0.0))
                                        .alias("prediction"))


class MeanRegressor:
    """C14: average of several two-part regressors' rounded predictions,
    rounded half-even and floored at 0 (chained, no joins)."""

    def __init__(self, regs):
        self.regs = list(regs)

    def fit(self, df: DataFrame):
        for r in self.regs:
            r.fit(df)
        return self

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        cur = df
        for i, r in enumerate(self.regs):
            cur = r.with_raw(cur, f"_r{i}").withColumn(
                f"_p{i}", F.greatest(F.bround(f"_r{i}", 0), F.lit(0.0)))
        total = sum((F.col(f"_p{i}") for i in range(1, len(self.regs))), F.col("_p0"))
        return cur.select(key, F.greatest(F.bround(total / len(self.regs), 0), F.lit(0.0))
                          .alias("prediction"))


def blocked_day_cv(df: DataFrame, day: str, reg_factory, key: str, y0: str, y1: str,
                   start: int = 10, stop: int = 18) -> DataFrame:
    """V6 + V17: fold d tests on days (d, d+1); score is the RMS log error
    against round(y0 + y1 + 1).  Returns (fold, rmsle)."""
    from tessera.operators.metrics import rmsle
    df = cut_lineage(df)

    def score(d):
        test_mask = F.col(day).isin(d, d + 1)
        model = reg_factory().fit(df.where(~test_mask))
        pred = model.with_raw(df.where(test_mask)).withColumn(
            "prediction", F.greatest(F.bround("raw", 0), F.lit(0.0)))
        return d, float(rmsle(pred, "prediction", y0, y1).first()["rmsle"])

    rows = _together(df.sparkSession, score, range(start, stop + 1))
    return df.sparkSession.createDataFrame(rows, "fold int, rmsle double")


def stack_blend(df: DataFrame, key: str, label: str, base: dict, fold: str = "fold",
                test: DataFrame | None = None) -> DataFrame:
    """K-fold out-of-fold positive-class probabilities of every base
    model become the blend's features; test-set columns are the mean over
    the fold models; a logistic blend is fitted on the OOF columns and its
    test probabilities are linearly stretched to [0, 1].

    A fold's model scores only that fold and, in a chain of row-wise
    transforms, the test rows; what is written per base model is the key and
    one score, and those narrow tables are joined on the key."""
    from tessera.operators.features import minmax_stretch
    df = cut_lineage(df)
    test = df if test is None else cut_lineage(test)
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    names = list(base)
    train_cur = test_cur = None
    for name, est in base.items():
        oof = tmean = None
        scored = test
        for f in folds:
            tag = f"{name}_{f}"
            m = _renamed(est.copy().fit(df.where(F.col(fold) != f)), tag)
            p1 = vector_to_array(f"_prob_{tag}")[1]
            part = m.transform(df.where(F.col(fold) == f)).select(key, label, p1.alias(name))
            oof = part if oof is None else oof.unionByName(part)
            scored = _drop_outputs(m.transform(scored).withColumn(f"_t_{tag}", p1), tag)
            tmean = F.col(f"_t_{tag}") if tmean is None else tmean + F.col(f"_t_{tag}")
        oof = cut_lineage(oof)
        mean = cut_lineage(scored.select(key, (tmean / len(folds)).alias(name)))
        train_cur = oof if train_cur is None else train_cur.join(oof.drop(label), key)
        test_cur = mean if test_cur is None else test_cur.join(mean, key)
    # the blend's inputs (key + one column per base model) are written once:
    # its iterations must not re-run every chained base-model transform
    oof_table = cut_lineage(train_cur.select(key, label, *names))
    test_table = cut_lineage(test_cur.select(key, *names))
    train = with_vector(oof_table.withColumn("_arr", F.array(*names)), "_arr", "bf")
    blend = LogisticRegression(featuresCol="bf", labelCol=label).fit(train)
    tv = with_vector(test_table.withColumn("_arr", F.array(*names)), "_arr", "bf")
    p = blend.transform(tv).select(key, vector_to_array("probability")[1].alias("p"))
    return minmax_stretch(p, "p", "p_stretch")


# --------------------------------------------------------- rotation forest
#: How often the candidate of each rank may be drawn.
RANK_WEIGHTS = [13, 8, 5, 3, 2, 1, 1]


def fibonacci_weights(n: int) -> list[float]:
    """Draw weights of n ranked candidates, the best first: the leading
    ``RANK_WEIGHTS``, and 1 for every further rank."""
    w = [RANK_WEIGHTS[i] if i < len(RANK_WEIGHTS) else 1 for i in range(n)]
    return [x / sum(w) for x in w]


class ElmMember:
    """An ELM classifier in the form that ensembles take: ``copy``, ``fit`` on
    a vector column, and a model whose ``transform`` adds ``prediction``."""

    def __init__(self, features: str = "features", label: str = "label", **settings):
        self.features, self.label, self.settings = features, label, settings

    def copy(self):
        return ElmMember(self.features, self.label, **self.settings)

    def fit(self, df: DataFrame):
        from tessera.operators.elm import ElmClassifier
        arrays = df.withColumn("_elm", vector_to_array(self.features))
        self.model_ = ElmClassifier(**self.settings).fit(arrays.select("_elm", self.label), "_elm", self.label)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        arrays = df.withColumn("_elm", vector_to_array(self.features)).drop(self.features)
        return self.model_.predict(arrays, "_elm", "prediction").drop("_elm")


class NeighbourMember:
    """Nearest-neighbour votes in the form that ensembles take."""

    def __init__(self, k: int = 3, weights: str = "distance", key: str = "key", features: str = "features",
                 label: str = "label"):
        self.settings = dict(k=k, weights=weights, key=key, features=features, label=label)
        self.k, self.weights, self.key, self.features, self.label = k, weights, key, features, label

    def copy(self):
        return NeighbourMember(**self.settings)

    def fit(self, df: DataFrame):
        self.rows_ = cut_lineage(df.select(self.key, self.label, vector_to_array(self.features).alias("_v")))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        from tessera.operators.neighbors import knn, weighted_vote
        df = cut_lineage(df)          # the search reads its queries several times
        q = df.select(self.key, vector_to_array(self.features).alias("_v"))
        near = knn(q, self.rows_, self.key, self.key, "_v", k=self.k, carry=[self.label])
        vote = weighted_vote(near, self.key, self.label, self.weights)
        return df.join(vote.withColumnRenamed("pred", "prediction"), self.key, "left")


class RotationForest:
    """C17: members are fresh base models on rotated features.  30% of the
    rows (by hash) only rank the candidates: each is fitted on four fifths of
    them and scored on the last fifth.  Each member's kind is drawn with
    weights by rank, gets its own rotation (random feature subsets, PCA per
    subset from one shared covariance) and is fitted on the other 70%;
    prediction = mode vote (ties -> lowest label).  Without ``n_subsets``
    their number is drawn for each member."""

    def __init__(self, candidates: dict, n: int = 23, n_subsets: int | None = None, seed: int = 0):
        self.candidates, self.n, self.n_subsets, self.seed = candidates, n, n_subsets, seed

    def fit(self, df: DataFrame, array_col: str, label: str = "label", key: str = "key"):
        from tessera.operators.elm import covariance, matmul_layer, rotation_matrix
        rs = random.Random(self.seed)
        df = cut_lineage(df)
        part = F.pmod(F.xxhash64(F.col(key), F.lit(self.seed)), F.lit(100))
        vec = with_vector(df, array_col)
        scores = {}
        for name, est in self.candidates.items():
            m = est.copy().fit(vec.where(part < 24))
            scores[name] = accuracy_of(m.transform(vec.where((part >= 24) & (part < 30))), label)
        ranked = sorted(scores, key=lambda k: (-scores[k], k))
        weights = fibonacci_weights(len(ranked))
        mu, cov = covariance(df, array_col)
        rest = df.where(part >= 30)
        self.members_ = []
        for i in range(self.n):
            kind = rs.choices(ranked, weights=weights)[0]
            M, b = rotation_matrix(mu, cov, self.n_subsets, seed=self.seed * 1000 + i)
            rot = matmul_layer(rest, array_col, M, b, out="_rot")
            model = self.candidates[kind].copy().fit(with_vector(rot, "_rot"))
            self.members_.append((kind, M, b, model))
        return self

    def predict(self, df: DataFrame, array_col: str, key: str) -> DataFrame:
        """Every member adds its vote to the row; the vote is counted in the
        row, so nothing is shuffled or scanned again."""
        from tessera.operators.elm import matmul_layer
        cur, names = df.select(key, array_col), []
        for i, (_, M, b, model) in enumerate(self.members_):
            rot = with_vector(matmul_layer(cur, array_col, M, b, out="_rot"), "_rot")
            names.append(f"_vote{i}")
            cur = model.transform(rot).withColumn(names[-1], F.col("prediction").cast("int")).select(
                key, array_col, *names)
        votes = F.array_sort(F.filter(F.array(*names), lambda v: v.isNotNull()))
        tally = F.transform(F.array_distinct(votes), lambda v: F.struct(
            F.size(F.filter(votes, lambda x: x == v)).alias("n"), (-v).alias("low")))
        return cur.select(key, (-F.array_max(tally)["low"]).alias("prediction"))


def mlp(layers, seed: int = 0, **kw) -> MultilayerPerceptronClassifier:
    """C11: sigmoid hidden layers, softmax output; no dropout in Spark."""
    return MultilayerPerceptronClassifier(layers=list(layers), seed=seed, **kw)


def gaussian_nb(**kw) -> NaiveBayes:
    return NaiveBayes(modelType="gaussian", **kw)


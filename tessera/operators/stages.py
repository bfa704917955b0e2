"""Fitted feature steps and the ELM classifier as Spark ML stages (M7, M11,
M14, M16, C10): settings and fitted numbers are Params, so the stages go into
pipelines, cross-validation and ``io.cached_model``, and save and load like
Spark's own."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import np_activation
from tessera.operators import elm, prep


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert)


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    def _given(self, **kw):
        self._set(**{k: v for k, v in kw.items() if v is not None})
        return self


def _array(df: DataFrame, col: str):
    return F.col(col).cast("array<double>") if dict(df.dtypes)[col].startswith("array") else vector_to_array(col)


def _mapped(fn):
    """A Column function over an array column from a numpy block function."""
    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        return pd.Series(list(fn(np.stack([np.asarray(v, dtype=float) for v in values]))))
    return run


# ------------------------------------------------------------ label index (M7)
class LabelIndexModel(Model, HasInputCol, HasOutputCol, _Stage):
    classes = _param("classes", "labels in order, as JSON", TypeConverters.toString)

    def __init__(self, inputCol=None, outputCol=None, classes=None):
        super().__init__()
        self._given(inputCol=inputCol, outputCol=outputCol, classes=classes)

    def labels(self) -> list:
        return json.loads(self.getOrDefault(self.classes))

    def _transform(self, df):
        known = df.sparkSession.createDataFrame(
            [(str(v), i) for i, v in enumerate(self.labels())], "label string, index int")
        classes = known.withColumn("label", F.col("label").cast(df.schema[self.getInputCol()].dataType))
        return prep.label_apply(df, classes, self.getInputCol(), self.getOutputCol())


class LabelIndex(Estimator, HasInputCol, HasOutputCol, _Stage):
    """Labels to 0..k-1 in the order of their own type; null and unseen
    labels stay null."""

    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._given(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, df):
        found = prep.label_classes(df, self.getInputCol()).orderBy("index").collect()  # one row per class
        return LabelIndexModel(self.getInputCol(), self.getOutputCol(), json.dumps([r["label"] for r in found]))


# ------------------------------------------------- k best by ANOVA F
class KBestModel(Model, HasInputCol, HasOutputCol, _Stage):
    indices = _param("indices", "selected feature numbers", TypeConverters.toListInt)

    def __init__(self, inputCol=None, outputCol=None, indices=None):
        super().__init__()
        self._given(inputCol=inputCol, outputCol=outputCol, indices=indices)

    def _transform(self, df):
        x = _array(df, self.getInputCol())
        picked = F.array(*[F.get(x, F.lit(i)) for i in self.getOrDefault(self.indices)])
        return df.withColumn(self.getOutputCol(), array_to_vector(picked))


class KBest(Estimator, HasInputCol, HasOutputCol, HasLabelCol, _Stage):
    """Fitted on training rows, applied to any: the k features with the
    highest ANOVA F, in feature order."""

    k = _param("k", "number of features kept", TypeConverters.toInt)

    def __init__(self, inputCol=None, outputCol=None, labelCol=None, k=10):
        super().__init__()
        self._given(inputCol=inputCol, outputCol=outputCol, labelCol=labelCol, k=k)

    def _fit(self, df):
        long = df.select(F.col(self.getLabelCol()).alias("label"),
                         F.posexplode(_array(df, self.getInputCol())).alias("feature", "value"))
        scores = prep.anova_f(long, "feature", "label", "value")
        best = prep.select_k_best(scores, "feature", self.getOrDefault(self.k)).select("feature").collect()
        return KBestModel(self.getInputCol(), self.getOutputCol(), sorted(r["feature"] for r in best))


# ------------------------------------------------------ ELM auto-encoder
class ElmFeaturesModel(Model, HasInputCol, HasOutputCol, _Stage):
    weights = _param("weights", "components, row by row", TypeConverters.toListFloat)
    width = _param("width", "number of components", TypeConverters.toInt)
    activation = _param("activation", "name of the activation", TypeConverters.toString)

    def __init__(self, inputCol=None, outputCol=None, weights=None, width=None, activation=None):
        super().__init__()
        self._given(inputCol=inputCol, outputCol=outputCol, weights=weights, width=width, activation=activation)

    def _transform(self, df):
        W = np.array(self.getOrDefault(self.weights)).reshape(-1, self.getOrDefault(self.width))
        act = np_activation(self.getOrDefault(self.activation))
        out = _mapped(lambda X: act(X @ W))(_array(df, self.getInputCol()))
        return df.withColumn(self.getOutputCol(), array_to_vector(out))


class ElmFeatures(Estimator, HasInputCol, HasOutputCol, _Stage):
    """``elm.ElmAutoEncoder`` as a stage; ``keyCol`` deals rows to its folds."""

    k = _param("k", "number of components", TypeConverters.toInt)
    activation = _param("activation", "name of the activation", TypeConverters.toString)
    seed = _param("seed", "seed of the projection", TypeConverters.toInt)
    keyCol = _param("keyCol", "unique key", TypeConverters.toString)

    def __init__(self, inputCol=None, outputCol=None, keyCol=None, k=60, activation="tanh", seed=0):
        super().__init__()
        self._given(inputCol=inputCol, outputCol=outputCol, keyCol=keyCol, k=k, activation=activation, seed=seed)

    def _fit(self, df):
        get = self.getOrDefault
        src = df.select(get(self.keyCol), _array(df, self.getInputCol()).alias("_x"))
        ae = elm.ElmAutoEncoder(k=get(self.k), activation=get(self.activation), seed=get(self.seed)).fit(
            src, "_x", get(self.keyCol))
        return ElmFeaturesModel(self.getInputCol(), self.getOutputCol(),
                                [float(v) for v in ae.components_.ravel()], get(self.k), get(self.activation))


# ---------------------------------------------------------- ELM classifier
class ElmClassificationModel(Model, HasFeaturesCol, HasPredictionCol, _Stage):
    hidden = _param("hidden", "hidden weights, row by row", TypeConverters.toListFloat)
    bias = _param("bias", "hidden biases", TypeConverters.toListFloat)
    readout = _param("readout", "read-out weights, row by row", TypeConverters.toListFloat)
    classes = _param("classes", "class of each read-out column", TypeConverters.toListFloat)
    activation = _param("activation", "name of the activation", TypeConverters.toString)

    def __init__(self, featuresCol=None, predictionCol=None, hidden=None, bias=None, readout=None, classes=None,
                 activation=None):
        super().__init__()
        self._given(featuresCol=featuresCol, predictionCol=predictionCol, hidden=hidden, bias=bias,
                    readout=readout, classes=classes, activation=activation)

    def _transform(self, df):
        get = self.getOrDefault
        b, cls = np.array(get(self.bias)), np.array(get(self.classes))
        W = np.array(get(self.hidden)).reshape(-1, len(b))
        beta = np.array(get(self.readout)).reshape(len(b), len(cls))
        act = np_activation(get(self.activation))
        best = _mapped(lambda X: cls[np.argmax(act(X @ W + b) @ beta, axis=1)][:, None])
        return df.withColumn(self.getPredictionCol(), best(_array(df, self.getFeaturesCol()))[0])


class ElmClassification(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, _Stage):
    """``elm.ElmClassifier`` as a stage, for numeric labels (index text first)."""

    nHidden = _param("nHidden", "number of hidden units", TypeConverters.toInt)
    activation = _param("activation", "name of the activation", TypeConverters.toString)
    density = _param("density", "share of nonzero hidden weights", TypeConverters.toFloat)
    alpha = _param("alpha", "ridge strength", TypeConverters.toFloat)
    seed = _param("seed", "seed of the hidden weights", TypeConverters.toInt)

    def __init__(self, featuresCol=None, labelCol=None, predictionCol=None, nHidden=200, activation="tanh",
                 density=1.0, alpha=1e-8, seed=0):
        super().__init__()
        self._given(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, nHidden=nHidden,
                    activation=activation, density=density, alpha=alpha, seed=seed)

    def _fit(self, df):
        get = self.getOrDefault
        src = df.select(_array(df, self.getFeaturesCol()).alias("_x"), self.getLabelCol())
        m = elm.ElmClassifier(get(self.nHidden), get(self.activation), density=get(self.density),
                              seed=get(self.seed), alpha=get(self.alpha)).fit(src, "_x", self.getLabelCol())
        flat = lambda a: [float(v) for v in np.asarray(a).ravel()]
        return ElmClassificationModel(self.getFeaturesCol(), self.getPredictionCol(), flat(m.W_), flat(m.b_),
                                      flat(m.beta_), [float(c) for c in m.classes_], get(self.activation))

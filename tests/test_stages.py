"""Stages in pipelines: fit, cross-validate, save, load, predict."""

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder

from tessera.operators import models, stages
from tessera.sources import io


def frame(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        x = rng.normal(size=8)
        x[:3] += 3 * np.eye(3)[i % 3]
        rows.append((i, ["ash", "elm", "oak"][i % 3], x.tolist()))
    return models.with_vector(spark.createDataFrame(rows, "key long, tree string, x array<double>"), "x", "raw")


def steps():
    return [stages.LabelIndex("tree", "label"),
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
            stages.ElmFeatures("scaled", "ae", keyCol="key", k=4),
            stages.KBest("scaled", "best", labelCol="label", k=3),
            VectorAssembler(inputCols=["ae", "best"], outputCol="features")]


def test_pipeline_with_union_forest_and_cross_validation(spark, tmp_path):
    df = frame(spark)
    forest = RandomForestClassifier(numTrees=8, seed=1)
    flow = Pipeline(stages=[*steps(), forest])
    ev = MulticlassClassificationEvaluator(metricName="accuracy")
    grid = ParamGridBuilder().addGrid(forest.maxDepth, [2, 4]).build()
    found = CrossValidator(estimator=flow, estimatorParamMaps=grid, evaluator=ev, numFolds=2, seed=1).fit(df)
    assert max(found.avgMetrics) > 0.85
    best = found.bestModel
    assert best.stages[3].getOrDefault(best.stages[3].indices) == [0, 1, 2]
    best.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    pick = lambda m: {r["key"]: r["prediction"] for r in m.transform(df).select("key", "prediction").collect()}
    assert pick(again) == pick(best)
    assert isinstance(found, CrossValidatorModel)


def test_elm_classifier_stage_saves_and_loads(spark, tmp_path):
    df = frame(spark)
    flow = Pipeline(stages=[*steps()[:2], stages.ElmClassification("scaled", "label", "prediction", nHidden=40)])
    model = io.cached_model(spark, str(tmp_path / "elm"), lambda: flow.fit(df), PipelineModel.load)
    again = io.cached_model(spark, str(tmp_path / "elm"), lambda: 1 / 0, PipelineModel.load)
    ev = MulticlassClassificationEvaluator(metricName="accuracy")
    assert ev.evaluate(model.transform(df)) == ev.evaluate(again.transform(df)) > 0.85


def test_label_stage_keeps_nulls_and_unseen_labels_null(spark):
    df = frame(spark)
    model = stages.LabelIndex("tree", "label").fit(df.where("tree <> 'oak'"))
    assert model.labels() == ["ash", "elm"]
    got = {r["tree"]: r["label"] for r in model.transform(df).select("tree", "label").distinct().collect()}
    assert got == {"ash": 0, "elm": 1, "oak": None}

"""Registered queries of the level-wise trees, over all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import trees
from tessera.session import table

#: Shared with the SQL twins.
TREES, DEPTH, CANDIDATES, SEED = 3, 3, 8, 7
CUTS, RATE = 3, 0.1


def _emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def _forest(spark: SparkSession, sf: str) -> trees.Forest:
    return trees.extra_trees(_emb(spark, sf), "embedding", "label", TREES, DEPTH, CANDIDATES, seed=SEED)


def extra_trees_nodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(t, n, f, cut, int(sum(s))) for _, t, n, f, cut, s in _forest(spark, sf).nodes()]
    return spark.createDataFrame(rows, "tree long, node long, feature long, threshold double, n_rows long").withColumn(
        "threshold", F.round("threshold", 9))


def extra_trees_classify(spark: SparkSession, sf: str) -> DataFrame:
    got = trees.predict(_emb(spark, sf).select("vec_id", "embedding"), _forest(spark, sf), "embedding")
    return got.select("vec_id", F.col("prediction").cast("long").alias("prediction"),
                      F.round(F.array_max("probability"), 9).alias("confidence"))


def extra_trees_oof(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold classes of all rows: five models grown in the same passes."""
    df = _emb(spark, sf).select("vec_id", "label", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(5)).alias("fold"))
    forest = trees.extra_trees(df, "embedding", "label", 10, 5, seed=SEED, fold="fold")
    return trees.predict(df, forest, "embedding", "fold").select("vec_id", "label", "fold", "prediction")


def softmax_boost_stumps(spark: SparkSession, sf: str) -> DataFrame:
    model = trees.boost(_emb(spark, sf), "embedding", "label", rounds=1, depth=1, rate=RATE, cuts=CUTS)
    forest, values = model.rounds[0]
    rows = [(int(c), int(forest.feature[k, 1]), float(forest.threshold[k, 1]), float(values[k, 2]), float(values[k, 3]))
            for k, c in enumerate(model.classes)]
    df = spark.createDataFrame(rows, "label long, feature long, threshold double, low_value double, high_value double")
    return df.withColumns({c: F.round(c, 6) for c in ("threshold", "low_value", "high_value")})


def softmax_boosting(spark: SparkSession, sf: str) -> DataFrame:
    model = trees.boost(_emb(spark, sf), "embedding", "label", rounds=3, depth=2)
    return trees.boosted_predict(_emb(spark, sf), model, "embedding").select("vec_id", "label", "prediction")


QUERIES = {f.__name__: f for f in (
    extra_trees_nodes, extra_trees_classify, extra_trees_oof, softmax_boost_stumps, softmax_boosting)}

"""Registered image, neighbour and hidden-layer queries (embeddings as 8x8)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import hidden, images, neighbors
from tessera.plans.catalog_features import emb_folds
from tessera.session import table

WIDTH = 8


def _long(df, key_cols, arr, d=6):
    return df.select(*key_cols, F.posexplode(arr).alias("pos", "value")).select(
        *key_cols, "pos", F.round(F.col("value").cast("double"), d).alias("value"))


def nudge_images(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    out = images.nudge_images(emb, "embedding", WIDTH)
    return _long(out, ["vec_id", "label", "shift"], "embedding")


def translate_images(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    out = images.translate_images(emb, "embedding", WIDTH)
    return _long(out, ["vec_id", "label", "shift"], "embedding")


def downsample_images(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return _long(images.downsample_images(emb, "embedding", WIDTH, block=4, keep=2),
                 ["vec_id"], "embedding", 9)


def crop_images(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return _long(images.crop_images(emb, "embedding", WIDTH, border=2), ["vec_id"], "embedding")


def union_augmented(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows (folds 1-4) + their 4 translated copies + the
    unlabelled rows (fold 0, label removed), summarised per source."""
    f = emb_folds(spark, sf)
    train = f.where(F.col("fold") != 0).select("vec_id", "label", "embedding")
    unlabelled = f.where(F.col("fold") == 0).select(
        "vec_id", F.lit(None).cast("int").alias("label"), "embedding")
    aug = images.translate_images(train, "embedding", WIDTH).drop("shift")
    both = (train.withColumn("source", F.lit("train"))
            .unionByName(aug.withColumn("source", F.lit("augmented")))
            .unionByName(unlabelled.withColumn("source", F.lit("unlabelled"))))
    px = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("label").alias("n_labelled"),
        F.round(F.sum(px), 6).alias("pixel_sum"))


def flatten_images(spark: SparkSession, sf: str) -> DataFrame:
    """One row per pixel."""
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return images.flatten_long(emb, "vec_id", "embedding").withColumn("value", F.col("value").cast("double"))


def _rotated(spark: SparkSession, sf: str, order: int) -> DataFrame:
    emb = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    scaled = emb.withColumn("embedding", F.transform("embedding", lambda x: (x + 0.6) / 1.2))
    # angles of -17 to 17 degrees that SQL can draw too
    turn = F.pmod(F.pmod(F.col("vec_id") * 2654435761 + 42, F.lit(4294967291)), F.lit(35)) - 17
    out = images.rotate_images(scaled, "vec_id", "embedding", WIDTH, angles=[turn], order=order)
    return out.select("vec_id", "label", "copy", F.posexplode("embedding").alias("pos", "v")).select(
        "vec_id", "label", "copy", "pos", F.round("v", 6).alias("value"))


def rotate_images(spark: SparkSession, sf: str) -> DataFrame:
    return _rotated(spark, sf, order=1)


def rotate_images_spline(spark: SparkSession, sf: str) -> DataFrame:
    return _rotated(spark, sf, order=3)


def knn_classify(spark: SparkSession, sf: str) -> DataFrame:
    """k=3 distance-weighted vote; queries = fold 0, references = the rest."""
    f = emb_folds(spark, sf)
    q = f.where(F.col("fold") == 0)
    r = f.where(F.col("fold") != 0)
    nn = neighbors.knn(q, r, "vec_id", "vec_id", "embedding", k=3, carry=("label",))
    return neighbors.weighted_vote(nn, "vec_id", "label")


def rbf_activations(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    centres = hidden.class_centres(emb, "label", "embedding")
    C = np.stack([centres[k] for k in sorted(centres)])
    out = hidden.rbf_layer(emb.select("vec_id", "embedding"), "embedding", C, kind="gaussian")
    return out.select("vec_id", F.posexplode("rbf").alias("centre", "act")).select(
        "vec_id", "centre", F.round("act", 9).alias("act"))


def fixed_weights(n_in: int, n_hidden: int):
    """Closed-form weights W[i][j] = sin(7i + j), b[j] = cos(j)."""
    W = np.array([[math.sin(7 * i + j) for j in range(n_hidden)] for i in range(n_in)])
    b = np.array([math.cos(j) for j in range(n_hidden)])
    return W, b


def random_layer_fixed(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    W, b = fixed_weights(64, 8)
    out = hidden.dense_layer(emb, "embedding", W, b, act="tanh")
    return out.select("vec_id", F.posexplode("hidden").alias("unit", "h")).select(
        "vec_id", "unit", F.round("h", 9).alias("h"))


def sparse_weights(n_out: int, n_in: int):
    """W[f][i] = cos(3i + 5f) / 8."""
    return np.array([[math.cos(3 * i + 5 * f) / 8.0 for i in range(n_in)] for f in range(n_out)])


def sparse_filter_activation(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = hidden.sparse_filter_activation(emb, "embedding", sparse_weights(8, 64))
    return out.select("vec_id", F.posexplode("sf").alias("feature", "value")).select(
        "vec_id", "feature", F.round("value", 9).alias("value"))


def flip_shift_images(spark: SparkSession, sf: str) -> DataFrame:
    """Dataset mean/std normalisation, then a per-image horizontal flip
    and one-pixel shift chosen by a portable hash of the key."""
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    norm = images.normalise_images(emb, "embedding")
    bits = F.pmod(F.col("vec_id") * F.lit(2654435761) + F.lit(3), F.lit(4294967291))
    out = images.flip_shift_images(norm, "embedding", WIDTH, bits)
    return _long(out, ["vec_id"], "embedding")


QUERIES = {
    "flip_shift_images": flip_shift_images,
    "nudge_images": nudge_images,
    "translate_images": translate_images,
    "downsample_images": downsample_images,
    "crop_images": crop_images,
    "union_augmented": union_augmented,
    "flatten_images": flatten_images,
    "rotate_images": rotate_images,
    "rotate_images_spline": rotate_images_spline,
    "knn_classify": knn_classify,
    "rbf_activations": rbf_activations,
    "random_layer_fixed": random_layer_fixed,
    "sparse_filter_activation": sparse_filter_activation,
}

"""Classification and regression metrics (V12-V17, A17, A20) as aggregates.

Every metric is a single aggregate (or a grouped count over classes), so the
data is scanned once and only per-class partial counts cross the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import clip, nan_to_null


def _number(c: str) -> Column:
    """The column as a double, NaN read as null."""
    return nan_to_null(F.col(f"`{c}`").cast("double"), "double")


def log_loss_binary(df: DataFrame, p: str, y: str, eps: float = 1e-15) -> DataFrame:
    """Mean binary cross-entropy with p clipped to [eps, 1-eps].  Rows
    whose p or y is null or NaN are not scored and don't count in ``n``; with
    no scored row the loss is null."""
    pc, yy = clip(_number(p), eps, 1.0 - eps), _number(y)
    term = yy * F.ln(pc) + (1.0 - yy) * F.ln(1.0 - pc)
    return df.agg((-F.avg(term)).alias("log_loss"), F.count(term).alias("n"))


def log_loss_multi(df: DataFrame, p_true: str, eps: float = 1e-15) -> DataFrame:
    """Mean of -ln p(true class), clipped; a null or NaN p is not scored
    and doesn't count in ``n``."""
    pc = clip(_number(p_true), eps, 1.0 - eps)
    return df.agg((-F.avg(F.ln(pc))).alias("log_loss"), F.count(pc).alias("n"))


def accuracy(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Share of exact matches."""
    hit = F.when(F.col(y) == F.col(yhat), 1.0).otherwise(0.0)
    return df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Long confusion matrix (actual, predicted, n)."""
    return df.groupBy(F.col(y).alias("actual"), F.col(yhat).alias("predicted")) \
             .agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Per class precision, recall, F1, support; zero when undefined
    (a class never predicted or never true)."""
    hit = F.col("actual").eqNullSafe(F.col("predicted"))
    cells = confusion_matrix(df, y, yhat).select(F.inline(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("true"), F.lit(0).cast("long").alias("pred"),
                 F.when(hit, F.col("n")).otherwise(F.lit(0).cast("long")).alias("tp")),
        F.struct(F.col("predicted").cast(df.schema[y].dataType).alias("label"), F.lit(0).cast("long").alias("true"),
                 F.col("n").alias("pred"), F.lit(0).cast("long").alias("tp")))))
    per = cells.groupBy("label").agg(F.sum("true").alias("support"), F.sum("pred").alias("n_pred"),
                                     F.sum("tp").cast("double").alias("tp")).where("label is not null")
    precision = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return (per.select("label", precision.alias("precision"), recall.alias("recall"), "support")
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall")
                                     / (F.col("precision") + F.col("recall"))).otherwise(0.0)))


def rmsle(df: DataFrame, pred: str, y0: str, y1: str) -> DataFrame:
    """sqrt(mean((ln(p+1) - ln(round_half_even(y0+y1+1)))^2)) over the
    rows where all three are numbers, which ``n`` counts."""
    d = F.ln(_number(pred) + 1) - F.ln(F.bround(_number(y0) + _number(y1) + 1, 0))
    return df.agg(F.sqrt(F.avg(d * d)).alias("rmsle"), F.count(d).alias("n"))


def score_summary(scores: DataFrame, group: str, score: str) -> DataFrame:
    """Mean, max, min and population std of scores per group."""
    return scores.groupBy(F.col(group).alias("title")).agg(
        F.avg(score).alias("mean"), F.max(score).alias("max"), F.min(score).alias("min"),
        F.stddev_pop(score).alias("std"))


def top_models(summary: DataFrame, n: int = 3, by: str = "mean") -> DataFrame:
    """T4: the n best rows of a (small) score table; the limit is the report."""
    w = Window.orderBy(F.desc(by), F.asc("title"))
    return summary.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

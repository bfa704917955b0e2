"""Registered profiling queries (A1-A15) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.operators.ordering import row_numbers
from tessera.plans.fixtures import CORR_COLUMNS, corr_input, profile_input
from tessera.session import table


def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.null_profile(profile_input(spark, sf))


def inf_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.inf_profile(profile_input(spark, sf))


def null_inf_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.null_inf_profile(profile_input(spark, sf))


def null_columns(spark: SparkSession, sf: str) -> DataFrame:
    return P.null_columns(profile_input(spark, sf), frac=0.8)


def uninformative_columns(spark: SparkSession, sf: str) -> DataFrame:
    return P.uninformative_columns(profile_input(spark, sf))


def binary_columns(spark: SparkSession, sf: str) -> DataFrame:
    return P.binary_columns(profile_input(spark, sf))


def column_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.column_summary(profile_input(spark, sf))


def column_summary_capped(spark: SparkSession, sf: str) -> DataFrame:
    return P.column_summary_capped(profile_input(spark, sf), cap=1000)


def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.label_counts(table(spark, sf, "lineitem"), "l_returnflag")


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.value_counts(table(spark, sf, "orders"), "o_orderpriority")


def value_counts_long(spark: SparkSession, sf: str) -> DataFrame:
    return P.value_counts_long(table(spark, sf, "lineitem"),
                               ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"])


def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return P.class_distribution(table(spark, sf, "orders"), "o_orderstatus")


def distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    return P.distinct_labels(table(spark, sf, "part"), "p_brand")


TABLE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def perturbed_lineitem(li: DataFrame) -> DataFrame:
    """Price moves below the rounding step; quantity changes on some rows."""
    return (li.withColumn("l_extendedprice", F.col("l_extendedprice") + 0.004)
            .withColumn("l_quantity", F.when((F.col("l_discount") == 0.05)
                                             & (F.col("l_returnflag") == "A"),
                                             F.col("l_quantity") + 1)
                        .otherwise(F.col("l_quantity"))))


def table_equal(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return P.table_equal(li, perturbed_lineitem(li), TABLE_KEYS, decimals=2)


def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = P.correlation_matrix(corr_input(spark, sf), [n for n, _ in CORR_COLUMNS])
    return m.select("a", "b", F.round("corr", 9).alias("corr"))


def correlation_spearman(spark: SparkSession, sf: str) -> DataFrame:
    """A14 with method='spearman' (average ranks, ties shared) on all columns
    of the correlation fixture, with nulls, an opposite and a constant."""
    m = P.correlation_matrix(corr_input(spark, sf), [n for n, _ in CORR_COLUMNS], method="spearman")
    return m.select("a", "b", F.round("corr", 9).alias("corr"))


def correlation_kendall(spark: SparkSession, sf: str) -> DataFrame:
    """A14 with method='kendall' on suppliers and a column with nulls."""
    s = table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"),
        F.when(F.col("s_nationkey") % 3 != 0, F.floor(F.col("s_acctbal") / 1000)).cast("double").alias("sparse"))
    m = P.correlation_matrix(s, ["nation", "balance", "sparse"], method="kendall")
    return m.select("a", "b", F.round("corr", 9).alias("corr"))


def value_index(spark: SparkSession, sf: str) -> DataFrame:
    """T9 with the place of every row in the index."""
    idx = P.value_index(table(spark, sf, "lineitem"), ["l_linestatus", "l_returnflag"])
    return row_numbers(idx.withColumn("col", (F.col("attribute") != "l_linestatus").cast("int")),
                       ["col", F.desc("n"), "value"], "place").select("place", "attribute", "value", "n")


def row_ids(spark: SparkSession, sf: str) -> DataFrame:
    """1..n in order of price, then key."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return row_numbers(o, ["o_totalprice", "o_orderkey"], "row_id")


def table_equal_unkeyed(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return P.table_equal_unkeyed(li, perturbed_lineitem(li), decimals=2)


def feature_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return P.feature_clusters(corr_input(spark, sf), [n for n, _ in CORR_COLUMNS], thresh=0.95)


def column_importance(df: DataFrame, cols) -> DataFrame:
    """Data-derived importance used by the ranking query: coefficient of
    variation-like spread, stddev / (|mean| + 1), rounded to 9 places."""
    aggs = []
    for c in cols:
        aggs.append(F.round(F.coalesce(F.stddev_pop(c) / (F.abs(F.avg(c)) + 1), F.lit(0.0)), 9)
                    .alias(c))
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("attribute"), F.col(c).alias("importance")) for c in cols])))


def important_features(spark: SparkSession, sf: str) -> DataFrame:
    cols = [n for n, _ in CORR_COLUMNS]
    df = corr_input(spark, sf)
    clusters = P.feature_clusters(df, cols, thresh=0.95)
    return P.important_features(clusters, column_importance(df, cols))


QUERIES = {
    "null_profile": null_profile,
    "inf_profile": inf_profile,
    "null_inf_profile": null_inf_profile,
    "null_columns": null_columns,
    "uninformative_columns": uninformative_columns,
    "binary_columns": binary_columns,
    "column_summary": column_summary,
    "column_summary_capped": column_summary_capped,
    "label_counts": label_counts,
    "value_counts": value_counts,
    "value_counts_long": value_counts_long,
    "class_distribution": class_distribution,
    "distinct_labels": distinct_labels,
    "table_equal": table_equal,
    "correlation_matrix": correlation_matrix,
    "correlation_spearman": correlation_spearman,
    "correlation_kendall": correlation_kendall,
    "value_index": value_index,
    "row_ids": row_ids,
    "table_equal_unkeyed": table_equal_unkeyed,
    "feature_clusters": feature_clusters,
    "important_features": important_features,
}

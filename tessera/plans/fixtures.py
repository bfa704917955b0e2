"""Derived inputs shared by the Spark queries and their SQL twins.

The test tables hold no nulls, infinities or constant columns, so the
profiling fixture injects them with expressions written once here and used
verbatim by both dialects (Spark SQL and DuckDB accept the same text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.session import table

# (name, type, expression) -- expression text valid in Spark SQL and DuckDB
PROFILE_COLUMNS = [
    ("l_orderkey", "bigint", "l_orderkey"),
    ("l_linenumber", "int", "l_linenumber"),
    ("l_quantity", "double", "l_quantity"),
    ("l_extendedprice", "double", "l_extendedprice"),
    ("l_discount", "double", "l_discount"),
    ("l_tax", "double", "l_tax"),
    ("l_returnflag", "string", "l_returnflag"),
    ("l_linestatus", "string", "l_linestatus"),
    ("sparse_tax", "double", "CASE WHEN l_discount >= 0.09 THEN l_tax END"),
    ("inf_qty", "double",
     "CASE WHEN l_discount = 0 THEN CAST('Infinity' AS DOUBLE) "
     "WHEN l_discount = 0.1 THEN CAST('-Infinity' AS DOUBLE) ELSE l_quantity END"),
    ("nan_price", "double",
     "CASE WHEN l_tax = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice END"),
    ("const_one", "double", "CASE WHEN l_returnflag <> 'R' THEN CAST(1 AS DOUBLE) END"),
    ("flag_r", "int", "CAST(l_returnflag = 'R' AS INT)"),
    ("blank_status", "string", "CASE WHEN l_linestatus = 'F' THEN '' ELSE l_linestatus END"),
    ("all_null", "double", "CASE WHEN l_discount > 1 THEN CAST(1 AS DOUBLE) END"),
]


def profile_select_sql() -> str:
    return ", ".join(f"{expr} AS {name}" for name, _, expr in PROFILE_COLUMNS)


def profile_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        *[f"{expr} AS {name}" for name, _, expr in PROFILE_COLUMNS])


# Numeric columns for correlation and clustering: two near-copies
# (price and net price), an opposite copy (must not cluster), a constant.
CORR_COLUMNS = [
    ("l_quantity", "l_quantity"),
    ("l_extendedprice", "l_extendedprice"),
    ("net_price", "l_extendedprice * (1 - l_discount)"),
    ("neg_price", "-l_extendedprice"),
    ("l_discount", "l_discount"),
    ("l_tax", "l_tax"),
    ("const_col", "CAST(l_linenumber * 0 + 3 AS DOUBLE)"),
    ("sparse_tax", "CASE WHEN l_discount >= 0.09 THEN l_tax END"),
]


def corr_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in CORR_COLUMNS])


def corr_select_sql() -> str:
    return ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in CORR_COLUMNS)

"""Sources and sinks.

Readers take explicit schemas (no ``inferSchema`` scans); writers produce
the reference's submission layouts.  Nothing here collects rows: summaries
are written as tables, ids are assigned by distributed offsets.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordering import row_numbers


# ------------------------------------------------------------------ scans
def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row and a declared schema."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Header row, every value a string (no inference pass)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_label_first(spark: SparkSession, path: str, n_features: int,
                     label_type: str = "double", value_type: str = "double",
                     vector_col: str = "features") -> DataFrame:
    """S3: header-less numeric matrix, label in column 0, features after."""
    fields = [T.StructField("label", T._parse_datatype_string(label_type))] + [
        T.StructField(f"x{i}", T._parse_datatype_string(value_type)) for i in range(n_features)]
    df = spark.read.schema(T.StructType(fields)).option("header", False).csv(path)
    return df.select("label", F.array(*[F.col(f"x{i}").cast("double")
                                        for i in range(n_features)]).alias(vector_col))


def read_positional(spark: SparkSession, path: str, schema: T.StructType | str,
                    skip_prefix: str | None = None) -> DataFrame:
    """Fixed-layout rows; lines whose first field starts with
    ``skip_prefix`` (a header) are dropped.  The first field is read as text
    for that, so a header before a number or a time stamp is seen, and then
    takes its declared type (null if it does not parse)."""
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not skip_prefix:
        return spark.read.schema(declared).option("header", False).csv(path)
    first = declared.fields[0]
    raw = T.StructType([T.StructField(first.name, T.StringType()), *declared.fields[1:]])
    df = spark.read.schema(raw).option("header", False).csv(path)
    df = df.where(~F.coalesce(F.col(f"`{first.name}`").startswith(skip_prefix), F.lit(False)))
    return df.withColumn(first.name, F.col(f"`{first.name}`").try_cast(first.dataType))


def read_numbered(spark: SparkSession, pattern: str, schema: T.StructType | str,
                  key: str = "dataset") -> DataFrame:
    """Many numbered files in one scan, the number parsed from the path."""
    df = spark.read.schema(schema).option("header", False).csv(pattern)
    return df.withColumn(key, F.regexp_extract(F.input_file_name(), r"(\d+)\.[^/.]+$", 1)
                         .cast("int"))


# ------------------------------------------------------------ summaries
def save_summary(summary: DataFrame, label_counts: DataFrame | None, path: str,
                 n_rows: int | None = None) -> None:
    """Summary table, row count and label counts as three Parquet tables.
    The row count is ``n_rows``, or else the summary's ``n_rows`` column, the
    sum of the label counts, or what a column's null count and share imply."""
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    if n_rows is not None:
        n = summary.sparkSession.createDataFrame([(int(n_rows),)], "n_rows long")
    elif "n_rows" in summary.columns:
        n = summary.select(F.coalesce(F.max("n_rows"), F.lit(0)).cast("long").alias("n_rows"))
    elif label_counts is not None:
        n = label_counts.select(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"))
    else:
        n = summary.select(F.max(F.bround(F.try_divide("n_null", "perc_null"))).cast("long").alias("n_rows"))
    n.write.mode("overwrite").parquet(f"{path}/meta")
    if label_counts is not None:
        label_counts.write.mode("overwrite").parquet(f"{path}/label_counts")


def load_summary(spark: SparkSession, path: str):
    """(summary, meta, label_counts or None)."""
    lc = f"{path}/label_counts"
    label_counts = spark.read.parquet(lc) if _exists(spark, lc) else None
    return spark.read.parquet(f"{path}/summary"), spark.read.parquet(f"{path}/meta"), label_counts


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached_model(spark: SparkSession, path: str, fit, loader):
    """Load a saved model if present, else fit, save and return it."""
    if _exists(spark, path):
        return loader(path)
    model = fit()
    model.write().overwrite().save(path)
    return model


# ---------------------------------------------------------------- sinks
def write_submission(df: DataFrame, path: str, id_col: str, label_col: str,
                     names=("Id", "Label")) -> None:
    """Id + predicted label, CSV with header."""
    df.select(F.col(id_col).alias(names[0]), F.col(label_col).alias(names[1])) \
      .write.mode("overwrite").option("header", True).csv(path)


def class_columns(df: DataFrame, id_col: str, prob_col: str, classes) -> DataFrame:
    """Id + one probability column per class, columns in the order of
    the class labels' own type (``classes`` lists the labels in model index
    order)."""
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(prob_col) if dict(df.dtypes)[prob_col] != "array<double>" \
        else F.col(prob_col)
    cols = [arr[i].alias(str(c)) for i, c in sorted(enumerate(classes), key=lambda t: t[1])]
    return df.select(F.col(id_col).alias("id"), *cols)


def fixed_decimals(df: DataFrame, cols, digits: int = 9) -> DataFrame:
    """Numbers rendered with a fixed number of decimals (%0.9f)."""
    return df.select(*[F.format_string(f"%.{digits}f", F.col(c)).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Engineered table out, no positional index column."""
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)


def with_row_ids(df: DataFrame, order_cols, out: str = "ImageId", start: int = 1) -> DataFrame:
    """1..n ids in an explicit order, by distributed offsets."""
    return row_numbers(df, list(order_cols), out, start)


def timestamped(path_prefix: str, ext: str = "csv", ts: int | None = None) -> str:
    """``<prefix>-<epoch seconds>.<ext>``."""
    return f"{path_prefix}-{int(ts if ts is not None else time.time())}.{ext}"


def descending_columns(df: DataFrame) -> DataFrame:
    """Columns sorted by name, descending, before writing."""
    return df.select(*sorted(df.columns, reverse=True))


"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import scratch_path, ship_package

#: Rows handed to a Python worker at a time; with very long texts a batch of
#: Spark's default 10,000 rows would not fit a worker.
BATCH_ROWS = 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the workers and bound the Arrow batches."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that none of ``taken`` uses (Spark ignores case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below spark.checkpoint.dir and read it back:
    a lineage cut that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(col: str) -> Column:
    """The text of a document, null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]],
              fields: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """``df[keep]`` plus ``fields`` computed batch by batch.

    ``make`` is called once per task and returns the function from a batch to
    the list of new arrays, one per field."""
    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    schema = T.StructType([*df.select(*keep).schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        names = keep + [n for n, _ in fields]
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *fn(b)], names=names)

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, col: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(col).cast(pa.binary()).to_pylist()]


def _bytes(side: DataFrame) -> Column:
    """About the bytes that a row takes in memory."""
    total = F.lit(16)
    for f in side.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            total = total + 8
    return total


def beside(df: DataFrame, side: DataFrame, on: Column, how: str = "left",
           max_bytes: int = 8 << 20) -> DataFrame:
    """Join a table that is mostly small (written before, as it is read
    twice): broadcast only if its measured bytes are at most ``max_bytes``,
    else a shuffle join, whose hot keys AQE splits."""
    size = side.agg(F.coalesce(F.sum(_bytes(side).cast("long")), F.lit(0))).first()[0]
    return df.join(F.broadcast(side) if size <= max_bytes else side, on, how)

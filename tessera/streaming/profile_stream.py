"""Stateful stream jobs (R1-R3): running column profile and running value
counts with Structured Streaming.

Both are keyed streaming aggregations.  Their state lives in Spark's state
store and is updated by each micro-batch; each batch's result is written by
``foreachBatch`` to a table under the shared checkpoint folder (overwrite =
idempotent on replay, so a retried batch never double counts), next to the
query's own checkpoint.  A query listener reports the progress of every batch
as it ends, however many there are.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tessera.functions.scalar import nan_to_null
from tessera.operators import profile
from tessera.session import scratch_path

#: Seconds to wait for a finished query's last progress event.
LISTENER_WAIT = 60


class BatchProgress(StreamingQueryListener):
    """Passes the progress of every batch of one named query on, in
    order.  An error of the callback is kept and raised by ``wait``."""

    def __init__(self, name: str, on_progress):
        self.name, self.on_progress = name, on_progress
        self.run_id, self.ended, self.error = None, threading.Event(), None

    def onQueryStarted(self, event):
        if event.name == self.name:
            self.run_id = str(event.runId)

    def onQueryProgress(self, event):
        if event.progress.name == self.name and self.error is None:
            try:
                self.on_progress(event.progress)
            except Exception as e:      # a listener's own errors are only logged
                self.error = e

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if str(event.runId) == self.run_id:
            self.ended.set()

    def wait(self) -> None:
        """Events arrive after the query's own end: wait for the last one."""
        if not self.ended.wait(LISTENER_WAIT):
            raise TimeoutError(f"no end of {self.name} was reported")
        if self.error is not None:
            raise self.error


def file_stream(spark: SparkSession, directory: str, name: str, schema=None,
                max_files: int | None = None) -> DataFrame:
    """A file source over ``directory`` restricted to files matching ``name``
    (e.g. ``events.parquet``); schema taken from a batch read if not given."""
    if schema is None:
        schema = spark.read.parquet(f"{directory.rstrip('/')}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory)


def _run(agg: DataFrame, spark: SparkSession, label: str, on_progress=None, path: str | None = None) -> str:
    """Run over what is there.  With ``path`` (shared storage) the result and
    the query's checkpoint stay below it, and the next run goes on from them."""
    out = f"{path}/result" if path else scratch_path(spark, f"{label}-out")
    ckpt = f"{path}/checkpoint" if path else scratch_path(spark, f"{label}-ckpt")
    name = f"{label}-{uuid.uuid4().hex[:12]}"
    listener = BatchProgress(name, on_progress) if on_progress is not None else None
    if listener is not None:
        spark.streams.addListener(listener)
    try:
        q = (agg.writeStream.outputMode("complete").queryName(name)
             .foreachBatch(lambda batch, _epoch: batch.write.mode("overwrite").parquet(out))
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
        if listener is not None:
            listener.wait()
    finally:
        if listener is not None:
            spark.streams.removeListener(listener)
    return out


def stream_value_counts(stream: DataFrame, col: str, on_progress=None, path: str | None = None) -> DataFrame:
    """R2: running value -> count, complete mode.  Given a ``path``, a later
    run continues the counts there with the files that are new."""
    spark = stream.sparkSession
    agg = stream.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return spark.read.schema(agg.schema).parquet(_run(agg, spark, "value-counts", on_progress, path))


def stream_summary(stream: DataFrame, cols=None, label: str | None = None, cap: int = 1000, on_progress=None,
                   path: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The big-file summary as a running profile, and the label counts.

    Equal to ``profile.column_summary_capped`` and ``label_counts_capped`` over
    all that the stream has delivered, NaN read as null; ``n_distinct_approx``
    is the value sets' own count, exact beyond the cap too up to twice the cap.
    Every cell of a row goes to its
    column's key, and the state holds per column its counts, bounds and capped
    value sets (bounded, and exact to the cap), and a count per distinct label.
    Tasks add up their own cells first, so a batch sends a row per task and
    column.  The label counts are ``None`` without a label or beyond the cap.
    Given a ``path``, a later run goes on with the files that are new."""
    spark, types = stream.sparkSession, profile._types(stream, cols)
    no_label = F.lit(None).cast("string")
    read = stream.withColumns({c: nan_to_null(F.col(f"`{c}`"), t) for c, t in types if t in profile.FLOATING})
    cells = [F.struct(F.lit(i).alias("a"), no_label.alias("label"), blank.alias("blank"), num.alias("num"), text.alias("text"))
             for i, (blank, num, text) in enumerate(profile.capped_cells(types))]
    labels = []
    if label is not None:
        labels = [F.struct(F.lit(-1).alias("a"), F.col(f"`{label}`").cast("string").alias("label"), F.lit(False).alias("blank"),
                           F.lit(None).cast("double").alias("num"), no_label.alias("text"))]
    long = read.select(F.inline(F.array(*cells, *labels)))
    agg = long.groupBy("a", "label").agg(*profile.capped_stats(F.col("blank"), F.col("num"), F.col("text"), cap))
    state = spark.read.schema(agg.schema).parquet(_run(agg, spark, "profile", on_progress, path))
    summary = profile.capped_result(state.filter("a >= 0").drop("label"), types, cap, "n_distinct_approx")
    if label is None:
        return summary, None
    counts = state.filter("a = -1").select("label", F.col("n_rows").alias("n"))
    # stripped values that differ, as the batch form counts them
    over = counts.select(F.trim("label").alias("v")).distinct().limit(cap + 1).count() > cap
    return summary, None if over else counts


def stream_profile(stream: DataFrame, cols=None, on_progress=None, path: str | None = None, cap: int = 1000) -> DataFrame:
    """The summary of ``stream_summary`` alone."""
    return stream_summary(stream, cols, None, cap, on_progress, path)[0]

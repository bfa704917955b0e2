"""Registered streaming queries: the events table read as a file stream,
run to completion with ``availableNow``; results equal the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.streaming.profile_stream import file_stream, stream_profile, stream_summary, stream_value_counts


def stream_value_counts_q(spark: SparkSession, sf: str) -> DataFrame:
    return stream_value_counts(file_stream(spark, sf, "events.parquet"), "event_type")


def stream_profile_q(spark: SparkSession, sf: str) -> DataFrame:
    return stream_profile(file_stream(spark, sf, "events.parquet")).drop("n_distinct_approx")


def stream_label_counts_q(spark: SparkSession, sf: str) -> DataFrame:
    return stream_summary(file_stream(spark, sf, "events.parquet"), ["value"], label="event_type")[1]


QUERIES = {
    "stream_value_counts": stream_value_counts_q,
    "stream_profile": stream_profile_q,
    "stream_label_counts": stream_label_counts_q,
}

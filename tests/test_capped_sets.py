"""Bounded value sets of the big-file summary, in batch and in a stream."""

import pytest
from pyspark.sql import functions as F
from tessera.operators import profile as P
from tessera.plans.fixtures import profile_input
from tessera.sources import io
from tessera.streaming.profile_stream import file_stream, stream_summary, stream_value_counts

SF = "/root/testdata/sf0.001"


def plain(df):
    """Rows with NaN comparable."""
    return sorted(tuple("nan" if x != x else x for x in r) for r in
                  [[str(v) if v is not None else "" for v in row] for row in df.collect()])


@pytest.mark.parametrize("n,cap,want", [(10, 10, "10"), (11, 10, "> 10"), (1000, 1000, "1000"), (1001, 1000, "> 1000"),
                                        (50_000, 1000, "> 1000"), (1, 1, "1"), (2, 1, "> 1")])
def test_counts_are_exact_to_the_cap(spark, n, cap, want):
    df = spark.range(0, n * 3, 1, 13).select((F.col("id") % n).alias("i"), (F.col("id") % n / 7).alias("d"),
                                             F.concat(F.lit("v"), F.col("id") % n).alias("s"))
    assert {r["n_uniq"] for r in P.column_summary_capped(df, cap=cap).collect()} == {want}


def test_text_numbers_blanks_and_decimals(spark):
    df = spark.createDataFrame([("1", " a", "1.0"), ("1.0", "a ", "2"), (None, "", "x"), (" 2 ", "b", "")],
                               "n string, s string, m string").withColumn("dec", F.lit("0.10").cast("decimal(20,2)"))
    got = {r["attribute"]: r for r in P.column_summary_capped(df).collect()}
    assert (got["n"]["n_uniq"], got["n"]["min"], got["n"]["max"], got["n"]["n_null"]) == ("3", 1.0, 2.0, 1)
    assert (got["s"]["n_uniq"], got["s"]["min"], got["s"]["n_null"]) == ("3", None, 1)
    assert (got["m"]["n_uniq"], got["m"]["max"]) == ("4", None)
    assert (got["dec"]["n_uniq"], got["dec"]["n_rows"]) == ("1", 4)


def _shuffled(df):
    """Rows and bytes that the query's shuffles write, from the plan's own metrics."""
    df.collect()
    plan, rows, size = df._jdf.queryExecution().executedPlan(), 0, 0
    todo = [plan]
    while todo:
        p = todo.pop()
        if hasattr(p, "getClass") and p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if p.getClass().getSimpleName() == "ShuffleExchangeExec":
            m = p.metrics()
            rows += m.apply("shuffleRecordsWritten").value()
            size += m.apply("dataSize").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows, size


def test_shuffle_is_bounded_by_columns_tasks_and_cap(spark):
    """Ten times the rows and distinct values: the same rows and bytes cross."""
    tasks, cap, cols = 6, 100, 3
    seen = []
    for n in (20_000, 200_000):
        df = spark.range(0, n, 1, tasks).select("id", (F.col("id") / 3).alias("d"), F.col("id").cast("string").alias("s"))
        seen.append(_shuffled(P.capped_sets(df, cap=cap)))
    entries = 2 ** (P.set_bits(cap) + 1)
    for rows, size in seen:
        assert rows <= tasks + tasks * cols
        # each set crosses in the tasks' row and in its column's row; two sets a column
        assert size <= 2 * tasks * cols * 2 * (8 * entries + 200)
    assert seen[1][1] < 1.3 * seen[0][1] and seen[1][0] == seen[0][0]


def test_merge_groups_give_the_same_result(spark):
    df = profile_input(spark, SF).repartition(7)
    types = P._types(df)
    results = [plain(P.capped_result(P.capped_sets(df, groups=g), types, 1000)) for g in (1, 3, 1024)]
    assert results[0] == results[1] == results[2]


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "group long, a string, n_rows double")
    rows = P.column_summary_capped(df).collect()
    assert [(r["n_rows"], r["n_null"], r["n_uniq"], r["perc_null"]) for r in rows] == [(0, 0, "0", None)] * 3
    df = spark.createDataFrame([(1, "x", 2.0), (2, "y", None)], "group long, a string, n_rows double")
    got = {r["attribute"]: r["n_uniq"] for r in P.column_summary_capped(df).collect()}
    assert got == {"group": "2", "a": "2", "n_rows": "2"}
    with pytest.raises(ValueError):
        P.column_summary_capped(df, cap=0)


def test_label_counts_at_the_cap(spark):
    df = spark.createDataFrame([("a",), ("b",), (" b",), (None,), ("",)], "l string")
    assert P.label_counts_capped(df, "l", cap=3) is None
    assert {(r["label"], r["n"]) for r in P.label_counts_capped(df, "l", cap=4).collect()} == {
        ("a", 1), ("b", 1), (" b", 1), (None, 1), ("", 1)}
    assert P.label_counts_capped(df.filter("false"), "l").collect() == []


def test_summary_store_has_the_row_count(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")       # no nulls to infer it from
    for i, s in enumerate((P.column_summary(df), P.column_summary_capped(df), P.column_summary(df.filter("false")))):
        io.save_summary(s, P.label_counts(df, "y"), str(tmp_path / str(i)))
        assert io.load_summary(spark, str(tmp_path / str(i)))[1].first()["n_rows"] == (0 if i == 2 else 2)


def test_stream_equals_the_batch_summary_across_a_restart(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn(
        "sparse", F.when(F.col("value") > 5, F.col("value"))).withColumn("blank", F.when(F.col("user_id") > 20, F.lit(" ")))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.filter("event_id % 3 = 0").repartition(2).write.parquet(src)

    def run():
        s = file_stream(spark, src, "*.parquet", schema=events.schema, max_files=1)
        return stream_summary(s, label="event_type", cap=200, path=out)

    for part in ("event_id % 3 = 0", "event_id % 3 < 2", "true"):
        if part != "event_id % 3 = 0":
            k = 1 if "<" in part else 2
            events.filter(f"event_id % 3 = {k}").repartition(2).write.mode("append").parquet(src)
        now = events.filter(part)
        summary, labels = run()
        assert plain(summary.drop("n_distinct_approx")) == plain(P.column_summary_capped(now, cap=200))
        assert plain(labels) == plain(P.label_counts_capped(now, "event_type", cap=200).withColumn("n", F.col("n")))
    assert stream_summary(file_stream(spark, src, "*.parquet", schema=events.schema), ["value"], "event_type", cap=2)[1] is None


def test_every_batch_is_reported(spark, tmp_path):
    """More batches than the engine remembers."""
    src = str(tmp_path / "in")
    spark.range(0, 103, 1, 103).select((F.col("id") % 2).alias("v")).write.parquet(src)
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        s = file_stream(spark, src, "*.parquet", schema="v long", max_files=1)
        counts = {r["value"]: r["n"] for r in stream_value_counts(s, "v", seen.append).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert counts == {0: 52, 1: 51}
    assert len(seen) >= 103 and sum(p.numInputRows for p in seen) == 103
    assert [p.batchId for p in seen] == sorted(p.batchId for p in seen)


def test_a_failing_callback_is_raised(spark):
    def fail(_):
        raise ValueError("callback")
    with pytest.raises(ValueError, match="callback"):
        stream_value_counts(file_stream(spark, SF, "events.parquet"), "event_type", fail)

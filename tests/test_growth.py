"""Steps whose cost must not grow faster than their input."""
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tessera.operators import models, prep, profile
from tessera.plans import catalog_models


def test_boxcox_stops_when_the_slope_is_rounding_only(spark, monkeypatch):
    """With very many rows the slope's rounding alone is above ``SLOPE``."""
    calls = []

    def noisy(df, lambdas, centre, shift=0.0):
        calls.append(dict(lambdas))
        noise = 1e-4 if len(calls) % 2 else -1e-4
        return spark.createDataFrame([(c, -1e9 * (lam - 0.7) + noise, -1e9) for c, lam in lambdas.items()],
                                     "attribute string, slope double, curvature double")

    monkeypatch.setattr(prep, "boxcox_slopes", noisy)
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,)], "x double")
    model = prep.BoxCox(["x"], shift=1.0).fit(df)
    assert abs(model.getOrDefault("lambdas")[0] - 0.7) < 1e-9
    assert len(calls) <= 4


def test_term_counts_cut_the_corpus_by_its_bytes(spark, monkeypatch):
    rows = [(i % 40, f"word{i % 7} word{i % 11} Word{i % 7} x") for i in range(200)] + [(None, "word1 word1"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, w.lower()) for i, x in rows for w in (x or "").split() if len(w) > 1)
    monkeypatch.setattr(prep, "PARTITION_TEXT", 100, raising=False)
    counts = prep.term_counts(docs, "doc_id", "text")
    need = sum(len(x or "") for _, x in rows) // 100
    assert counts.rdd.getNumPartitions() >= need > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r["doc_id"], r["term"]): r["tf"] for r in counts.collect()} == want


def average_ranks(x):
    x = np.array(x)
    return [(x < y).sum() + ((x == y).sum() + 1) / 2 for y in x]


def test_spearman_ranks_whole_rows_and_once_for_a_column_with_nulls(spark, monkeypatch):
    """No pair of a null-free column is counted apart, rows are not taken to pieces."""
    def tagged(base, pairs):
        raise AssertionError("pairs counted apart")

    monkeypatch.setattr(profile, "_spearman_pairs", tagged)
    rows = [(float((i * 37) % 101), float(i % 5), 0.0 if i % 2 else -0.0, 3.0, float((i * 13) % 17) if i % 3 else None)
            for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, zero double, const double, sparse double")
    for limit in (1 << 24, 0):                     # broadcast and shuffled rank tables
        monkeypatch.setattr(profile, "RANKS_BYTES", limit, raising=False)
        got = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_matrix(df, method="spearman").collect()}
        assert len(got) == 25
        for i, x in enumerate(df.columns):
            for j, y in enumerate(df.columns):
                if {x, y} & {"zero", "const"}:
                    assert got[x, y] is None
                    continue
                both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
                u, v = (average_ranks(column) for column in zip(*both))
                want = np.corrcoef(u, v)[0, 1]
                assert abs(got[x, y] - want) < 1e-9
    nothing = df.where("a < 0")
    assert all(r["corr"] is None for r in profile.correlation_matrix(nothing, method="spearman").collect())


def test_rows_that_fits_read_again_go_to_enough_tasks(spark, monkeypatch, tmp_path):
    """A file of few bytes is one partition, however many rows it has."""
    rows = [(i, f"2024-01-{i % 28 + 1:02d} {i % 24:02d}:00:00", float(i % 97), "abc"[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, ts string, value double, event_type string")
    df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    few = catalog_models._events_features(spark, str(tmp_path))
    monkeypatch.setattr(models, "TASK_ROWS", 50, raising=False)
    many = catalog_models._events_features(spark, str(tmp_path))
    sizes = many.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert few.rdd.getNumPartitions() == 1 and len(sizes) == 12 and max(sizes) < 100
    assert not many.inputFiles() and sorted(map(str, many.collect())) == sorted(map(str, few.collect()))

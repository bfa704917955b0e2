import hashlib
import math

import pytest
from pyspark.sql import functions as F
from tessera.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy int"


def make(n=400):
    rows = [(i, "t" * (i % 7), "big" if i % 3 == 0 else f"s{i % 5}", 9) for i in range(n)]
    return rows + [(None, "null id", "s1", 9), (None, None, None, 9), (n, "", None, 9), (3, rows[3][1], rows[3][2], 9)]


def brute_counts(rows, weights=None, total=None, seed=mixing.SEED):
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(t or "") + 1
    w = {s: 1.0 if weights is None else weights.get(s, 0.0) for s in size}
    scale = (sum(size.values()) if total is None else total) / (sum(w.values()) or 1.0)
    for i, t, s, _ in rows:
        rate = w[s] * scale / size[s]
        parts = max(math.ceil(rate / mixing.PART), 1)
        key = str(i) if i is not None else hashlib.sha256((t or "").encode()).hexdigest()
        n = 0
        for part in range(1, parts + 1):
            u = (int(hashlib.md5(f"{seed}|{part}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            mean, k = rate / parts, 0
            p = cdf = math.exp(-mean)
            while cdf <= u and k < 400:
                k += 1
                p *= mean / k
                cdf += p
            n += k
        yield i, t, s, n


@pytest.mark.parametrize("weights,total", [(None, None), ({"big": 1.0, "s1": 3.0, None: 0.5}, None),
                                           ({"s2": 1.0}, 40000)])
def test_counts_equal_brute_force(spark, weights, total):
    rows = make()
    out = mixing.replicate(spark.createDataFrame(rows, SCHEMA).drop("copy"), weights, total).collect()
    want = sorted((i, t, s, c) for i, t, s, n in ((str(i), str(t), str(s), n) for i, t, s, n in brute_counts(
        rows, weights, total)) for c in range(1, n + 1))
    assert sorted((str(r["doc_id"]), str(r["text"]), str(r["source"]), r["copy"]) for r in out) == want
    assert [r["order_key"] for r in out] == sorted(r["order_key"] for r in out)


@pytest.mark.parametrize("run", [7, 32])
def test_runs_make_every_copy_once(spark, monkeypatch, run):
    monkeypatch.setattr(mixing, "RUN", run)
    rows = [(1, "rare", "one", 0), (1, "rare", "one", 0), (None, None, None, 0),
            *((i, "x" * 40, "rest", 0) for i in range(2, 60))]
    out = mixing.replicate(spark.createDataFrame(rows, SCHEMA).drop("copy")).collect()
    want = sorted((str(i), str(t), c) for i, t, _, n in brute_counts(rows) for c in range(1, n + 1))
    assert sorted((str(r["doc_id"]), str(r["text"]), r["copy"]) for r in out) == want
    assert max(r["copy"] for r in out) > 2 * run
    assert [r["order_key"] for r in out] == sorted(r["order_key"] for r in out)


def test_runs_of_one_document_go_to_many_tasks(spark):
    rows = [(1, "r", "one"), *((i, "x" * 3000, "rest") for i in range(2, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.replicate(df)
    assert out.filter("doc_id = 1").count() > 50 * mixing.RUN
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1  # only runs of the documents with many copies


def test_mean_count_follows_the_rate(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"),
                                   F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.replicate(df).groupBy("source").count().collect()}
    assert abs(got["a"] - 10000) < 500 and abs(got["b"] - 10000) < 500


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame(make(20), SCHEMA)
    out = mixing.replicate(df)
    assert sorted(out.columns) == sorted([*df.columns, "order_key"])  # the number of the copy takes the name
    assert mixing.replicate(df.filter("false")).count() == 0
    dotted = mixing.replicate(df.withColumnRenamed("copy", "a.b"))
    assert "a.b" in dotted.columns and {r["a.b"] for r in dotted.collect()} == {9}


def test_weights_must_be_numbers(spark):
    with pytest.raises(ValueError):
        mixing.source_rates(spark.createDataFrame(make(5), SCHEMA), {"big": -1.0})

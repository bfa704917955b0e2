import pytest
from pyspark.sql import functions as F
from tessera.operators import features
from tessera.session import broadcast_if_small, require_shared


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [0, 100_000])
def test_sample_is_exact_at_any_size(spark, monkeypatch, few):
    monkeypatch.setattr(features, "FEW_ROWS", few)
    df = spark.range(20_000).withColumn("place", F.lit("x"))
    h = F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 1)
    ranked = [r["id"] for r in df.select("id", h.alias("h")).orderBy("h", "id").select("id").collect()]
    for n in (0, 1, 4999, 20_000, 30_000):
        got = features.sample_rows(df, "id", n, seed=3)
        assert got.columns == df.columns and "Limit" not in plan(got)
        assert sorted(r["id"] for r in got.collect()) == sorted(ranked[:n])


def test_repeated_and_null_keys_are_rows_of_their_own(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).when(F.col("id") < 2000, F.col("id")).alias("k"))
    for n in (500, 1500, 2999):
        assert features.sample_rows(df, "k", n).count() == n
    assert features.sample_rows(df.filter("false"), "k", 5).collect() == []


def test_scratch_must_be_shared_on_a_cluster():
    for master in ("local", "local[*]", "local[4]", "local[2,3]"):
        require_shared("file", master)
    require_shared("hdfs", "spark://host:7077")
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            require_shared("file", master)


def test_broadcasts_go_by_bytes(spark):
    few_but_wide = spark.range(20).select("id", F.repeat(F.lit("x"), 1_000_000).alias("s"))
    many_but_slim = spark.range(200_000)
    hinted = ["broadcast" in broadcast_if_small(d, 8 << 20)._jdf.queryExecution().logical().toString().lower()
              for d in (few_but_wide, many_but_slim)]
    assert hinted == [False, True]

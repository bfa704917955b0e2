"""Stream answers equal batch answers; sources and sinks round-trip."""

import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators import prep
from tessera.sources import io
from tessera.streaming.profile_stream import file_stream, stream_profile, stream_value_counts

SF = "/root/testdata/sf0.001"


def test_stream_value_counts_equal_batch(spark):
    s = stream_value_counts(file_stream(spark, SF, "events.parquet"), "event_type")
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type").count()
    assert {(r["value"], r["n"]) for r in s.collect()} == \
        {(r["event_type"], r["count"]) for r in batch.collect()}


def test_stream_profile_equal_batch(spark):
    prog = []
    s = {r["attribute"]: r for r in
         stream_profile(file_stream(spark, SF, "events.parquet"), ["value"], prog.append).collect()}
    b = spark.read.parquet(f"{SF}/events.parquet").agg(F.count("*"), F.min("value"),
                                                       F.max("value")).first()
    assert s["value"]["n_rows"] == b[0] and s["value"]["min"] == b[1] and s["value"]["max"] == b[2]
    assert prog and "numInputRows" in prog[0]


def test_csv_sources_and_sinks(spark):
    d = tempfile.mkdtemp(prefix="tessera-io-")
    p = os.path.join(d, "m.csv")
    with open(p, "w") as fh:
        fh.write("3,1.0,2.0\n5,0.5,0.25\n")
    m = io.read_label_first(spark, p, 2, label_type="int").collect()
    assert m[0]["label"] == 3 and m[1]["features"] == [0.5, 0.25]
    h = os.path.join(d, "h.csv")
    with open(h, "w") as fh:
        fh.write("a,b\n1,x\n,y\n")
    s = io.read_csv_strings(spark, h)
    assert dict(s.dtypes) == {"a": "string", "b": "string"}
    ids = io.with_row_ids(s, ["b"]).orderBy("ImageId").collect()
    assert [r["ImageId"] for r in ids] == [1, 2]
    out = io.fixed_decimals(spark.createDataFrame([(0.5,)], "p double"), ["p"]).first()["p"]
    assert out == "0.500000000"
    assert io.timestamped("pred", ts=12).endswith("pred-12.csv")
    io.write_submission(s, os.path.join(d, "sub"), "a", "b")
    assert spark.read.option("header", True).csv(os.path.join(d, "sub")).columns == ["Id", "Label"]


def test_scalers_semantics(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    std = prep.PopulationStandardScaler(inputCols=["x", "c"]).fit(df).transform(df).collect()
    assert [r["x_out"] for r in std] == [-1.0, 1.0]          # population std
    assert [r["c_out"] for r in std] == [0.0, 0.0]           # constant -> 0
    mm = prep.RangeScaler(inputCols=["x", "c"], lower=-10, upper=10).fit(df).transform(df).collect()
    assert [r["c_out"] for r in mm] == [-10.0, -10.0]        # constant -> lower bound
    one = spark.createDataFrame([(2.0,)], "x double")
    assert prep.PopulationStandardScaler(inputCols=["x"]).fit(one).transform(one).first()["x_out"] == 0.0


def test_boxcox_fit_recovers_lambda(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    y = rng.normal(5, 0.5, size=2000)
    x = (y * 0.5 + 1) ** 2 - 0.5          # inverse Box-Cox with lambda 0.5, shift 0.5
    df = spark.createDataFrame([(float(v),) for v in x if v > 0], "x double")
    lam = prep.BoxCox(inputCols=["x"], shift=0.5).fit(df).getOrDefault("lambdas")[0]
    assert abs(lam - 0.5) < 0.15


def test_tfidf_smooth_idf(spark):
    long = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1)], "d int, term string, tf long")
    idf = {r["term"]: r["idf"] for r in prep.smooth_idf(long, "d", "term").collect()}
    import math
    assert idf["a"] == 1.0 and abs(idf["b"] - (math.log(3 / 2) + 1)) < 1e-12
    w = prep.tfidf_transform(long, prep.smooth_idf(long, "d", "term"), "d", "term")
    norms = w.groupBy("d").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in norms)


def test_summary_store_and_model_cache(spark):
    from pyspark.ml.feature import StringIndexer, StringIndexerModel
    from tessera.operators import profile as P
    d = tempfile.mkdtemp(prefix="tessera-sum-")
    df = spark.createDataFrame([("a", 1), ("b", None), ("a", 3)], "lab string, x int")
    summary = P.column_summary(df)
    io.save_summary(summary, P.label_counts(df, "lab"), d)
    s, meta, lc = io.load_summary(spark, d)
    assert s.count() == 2 and {r["label"]: r["n"] for r in lc.collect()} == {"a": 2, "b": 1}
    calls = []

    def fit():
        calls.append(1)
        return StringIndexer(inputCol="lab", outputCol="i").fit(df)
    path = os.path.join(d, "model")
    io.cached_model(spark, path, fit, StringIndexerModel.load)
    io.cached_model(spark, path, fit, StringIndexerModel.load)
    assert calls == [1]                                   # second call loads


def test_class_columns_sorted(spark):
    df = spark.createDataFrame([(7, [0.2, 0.8])], "id int, probability array<double>")
    out = io.class_columns(df, "id", "probability", ["Class_2", "Class_1"])
    assert out.columns == ["id", "Class_1", "Class_2"]
    r = out.first()
    assert r["Class_1"] == 0.8 and r["Class_2"] == 0.2


def test_table_equal_unkeyed(spark):
    from tessera.operators import profile as P
    a = spark.createDataFrame([(1, 1.004), (1, 1.004), (2, float("nan"))], "k int, v double")
    b = spark.createDataFrame([(2, float("nan")), (1, 1.0), (1, 1.0)], "k int, v double")
    assert P.table_equal_unkeyed(a, b, decimals=2).first()["equal"]
    r = P.table_equal_unkeyed(a, b.limit(2)).first()
    assert not r["equal"]


def test_prep_stages_in_a_pipeline_save_and_load(spark):
    from pyspark.ml import Pipeline, PipelineModel
    d = tempfile.mkdtemp(prefix="tessera-pipe-")
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0), (5.0, 4.0)], "a double, b double")
    pipe = Pipeline(stages=[prep.PopulationStandardScaler(inputCols=["a"], outputCols=["a_z"]),
                            prep.RangeScaler(inputCols=["b"], outputCols=["b_mm"]),
                            prep.BoxCox(inputCols=["b"], outputCols=["b_bc"], shift=0.5)])
    model = pipe.fit(df)
    out = model.transform(df).orderBy("a").collect()
    assert [r["b_mm"] for r in out] == [0.0, 1.0, 0.5]
    model.write().overwrite().save(os.path.join(d, "m"))
    again = PipelineModel.load(os.path.join(d, "m")).transform(df).orderBy("a").collect()
    assert [r["a_z"] for r in again] == [r["a_z"] for r in out]


def test_unfitted_pipeline_roundtrip(spark):
    from pyspark.ml import Pipeline
    d = tempfile.mkdtemp(prefix="tessera-pipe2-")
    pipe = Pipeline(stages=[prep.RangeScaler(inputCols=["a"], outputCols=["a_mm"], lower=-10,
                                             upper=10),
                            prep.BoxCox(inputCols=["a"], outputCols=["a_bc"], shift=1.0)])
    pipe.write().overwrite().save(os.path.join(d, "p"))
    back = Pipeline.load(os.path.join(d, "p"))
    rs, bc = back.getStages()
    assert rs.getOrDefault("lower") == -10.0 and bc.getOrDefault("shift") == 1.0


def test_numbered_datasets_cv(spark):
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from tessera.operators import models
    d = tempfile.mkdtemp(prefix="tessera-num-")
    rng = np.random.default_rng(0)
    for n in (1, 2):
        with open(os.path.join(d, f"{n}.data"), "w") as fh:
            for i in range(60):
                y = i % 2
                fh.write(f"{y},{rng.normal() + 3 * y:.4f},{rng.normal():.4f}\n")
    df = io.read_numbered(spark, os.path.join(d, "*.data"), "label double, a double, b double")
    df = df.withColumn("rid", F.monotonically_increasing_id())
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    scores = models.cv_per_dataset(df, "dataset", "rid", "label", models.gaussian_nb(), k=3)
    per = {r["dataset"]: r["n"] for r in scores.groupBy("dataset").agg(F.count("*").alias("n")).collect()}
    assert per == {1: 3, 2: 3}
    assert scores.agg(F.min("score")).first()[0] > 0.7

"""Scalar features, metrics, splits (FIXTURES section 3 cases + properties)."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import features, metrics, validate
from tessera.operators.ordering import row_numbers


def test_opposite_bearing(spark):
    df = spark.createDataFrame([(0.0,), (179.0,), (180.0,), (181.0,), (360.0,)], "x double")
    got = [r[0] for r in df.select(S.opposite_bearing("x")).collect()]
    assert got == [180.0, 359.0, 360.0, 1.0, 180.0]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(S.round_half_even("x")).collect()] == [0.0, 2.0, 2.0, -0.0]


def test_label_suffix_quirk(spark):
    df = spark.createDataFrame([("Class_1",), ("Class_9",), ("Class_10",)], "s string")
    assert [r[0] for r in df.select(S.label_suffix("s")).collect()] == [1, 9, 0]


def test_activations_and_errors(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.0,)], "x double")
    r = df.select(S.tribas("x").alias("t"), S.hardlim("x").alias("h"), S.relu("x").alias("r"),
                  S.sigmoid("x").alias("s")).collect()
    assert [x["t"] for x in r] == [0.0, 1.0, 0.0]
    assert [x["h"] for x in r] == [0.0, 0.0, 1.0]
    assert [x["r"] for x in r] == [0.0, 0.0, 2.0]
    assert r[1]["s"] == 0.5
    with pytest.raises(ValueError):
        S.activation("nope", F.col("x"))
    with pytest.raises(ValueError):
        S.polyharmonic(F.col("x"), 1.5)


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([5.0, 5.0, 1.0],)], "a array<double>")
    r = df.select(S.softmax_array("a").alias("p"), S.argmax_array("a").alias("k")).collect()
    e = [math.exp(x - 3) for x in (1, 2, 3)]
    assert r[0]["p"] == pytest.approx([x / sum(e) for x in e])
    assert r[0]["k"] == 2 and r[1]["k"] == 0          # first maximum wins


def test_stretch_constant_is_null(spark):
    df = spark.createDataFrame([(0.3,), (0.3,)], "p double")
    assert features.minmax_stretch(df, "p", "s").first()["s"] is None
    df = spark.createDataFrame([(0.2,), (0.6,), (1.0,)], "p double")
    assert [r["s"] for r in features.minmax_stretch(df, "p", "s").collect()] == \
        pytest.approx([0.0, 0.5, 1.0])


def test_log_loss_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (1.0, 0)], "p double, y int")
    r = metrics.log_loss_binary(df, "p", "y").first()
    eps = 1e-15
    hi = 1 - eps                                   # clip as numpy does, in float arithmetic
    exp = (-math.log(hi) - math.log(hi) - math.log(1 - hi)) / 3
    assert r["log_loss"] == pytest.approx(exp, rel=1e-9)


def test_classification_report_missing_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, yhat int")
    rep = {r["label"]: r for r in metrics.classification_report(df, "y", "yhat").collect()}
    assert rep[0]["precision"] == 1.0 and rep[0]["recall"] == 0.5
    assert rep[2]["precision"] == 0.0 and rep[2]["f1"] == 0.0      # never predicted
    cm = metrics.confusion_matrix(df, "y", "yhat").count()
    assert cm == 4
    acc = metrics.accuracy(df, "y", "yhat").first()["accuracy"]
    assert acc == 0.5


def test_rmsle(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0.5), (3.0, 1.0, 1.0)], "p double, y0 double, y1 double")
    r = metrics.rmsle(df, "p", "y0", "y1").first()["rmsle"]
    # round(2.0)=2 (half-even keeps 2), round(3.0)=3
    exp = math.sqrt(((math.log(2) - math.log(2)) ** 2 + (math.log(4) - math.log(3)) ** 2) / 2)
    assert r == pytest.approx(exp)


def test_stratified_folds_balance(spark):
    df = spark.range(0, 103).selectExpr("id", "CASE WHEN id < 70 THEN 'big' ELSE 'small' END AS y")
    f = validate.stratified_folds(df, "id", "y", k=5)
    sizes = {}
    for r in f.groupBy("y", "fold").count().collect():
        sizes.setdefault(r["y"], []).append(r["count"])
    for y, s in sizes.items():
        assert len(s) == 5 and max(s) - min(s) <= 1
    assert f.count() == 103 and f.select("id").distinct().count() == 103


def test_stratified_holdout_and_holdout(spark):
    df = spark.range(0, 200).selectExpr("id", "id % 2 AS y")
    h = validate.stratified_holdout(df, "id", "y", 0.15)
    per = {r["y"]: r["n"] for r in h.where("is_train").groupBy("y")
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per == {0: 15, 1: 15}
    s = validate.holdout_split(df, "id", 0.3, seed=4).where("is_test").count()
    assert 30 < s < 90


def test_row_numbers_consecutive(spark):
    df = spark.range(0, 1000).selectExpr("id * 7 % 1000 AS k")
    ids = sorted(r["row_id"] for r in row_numbers(df, ["k"]).collect())
    assert ids == list(range(1, 1001))
    first = row_numbers(df, ["k"]).where("k = 0").first()["row_id"]
    assert first == 1


def test_datetime_features(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2011-01-03 05:00:00' AS ts")   # a Monday
    r = features.datetime_features(df, "ts").first()
    assert (r["weekday"], r["hour"], r["year_off"], r["day"]) == (0, 5, 0, 3)


def test_null_label_rows_are_kept(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(40)],
                               "id long, y int")
    f = validate.stratified_folds(df, "id", "y", k=3)
    assert f.count() == 40
    h = validate.stratified_holdout(df, "id", "y", 0.5)
    assert h.count() == 40 and h.where("y IS NULL AND is_train").count() == 5

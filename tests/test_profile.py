"""Profiling quirks with hand-written rows (FIXTURES section 3)."""

import math

import numpy as np
import pandas as pd
import pytest

from tessera.operators import profile as P


def rows(df, key="attribute"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_null_rules_column_summary(spark):
    # None, NaN, '', ' ', 0, 0.0, false in separate typed columns
    df = spark.createDataFrame(
        [(None, float("nan"), "", 0, 0.0, False),
         (1, 1.5, " ", 0, 0.0, True),
         (2, float("nan"), "a", 3, None, None)],
        "i int, d double, s string, z int, zd double, b boolean")
    s = rows(P.column_summary(df))
    assert s["i"]["n_null"] == 1
    assert s["d"]["n_null"] == 2          # NaN counts as null
    assert s["s"]["n_null"] == 1          # '' is null, ' ' is not
    assert s["z"]["n_null"] == 0          # zero is a value
    assert s["zd"]["n_null"] == 1
    assert s["b"]["n_null"] == 1          # false is a value
    assert s["i"]["n_uniq"] == 3          # {1, 2} + the null bucket
    assert s["s"]["min"] is None          # ' ' and 'a' do not parse
    assert s["z"]["min"] == 0.0 and s["z"]["max"] == 3.0
    assert s["b"]["min"] == 0.0 and s["b"]["max"] == 1.0
    assert s["i"]["perc_null"] == pytest.approx(1 / 3)


def test_bounds_inf_and_bad_text(spark):
    df = spark.createDataFrame(
        [(float("inf"), "1", "1"), (1.0, "1.0", "x"), (-float("inf"), "2", "1d")],
        "d double, t string, u string")
    s = rows(P.column_summary(df))
    assert s["d"]["min"] is None and s["d"]["max"] is None   # infinite bounds -> null
    assert s["t"]["min"] == 1.0 and s["t"]["max"] == 2.0
    assert s["u"]["min"] is None                              # one bad value -> null bounds
    c = rows(P.column_summary_capped(df, cap=1000))
    assert c["t"]["n_uniq"] == "2"                            # '1' and '1.0' are one number
    assert c["u"]["n_uniq"] == "3"                            # '1d' rejected -> text
    assert c["u"]["min"] is None


def test_capped_distinct(spark):
    df = spark.range(0, 50).selectExpr("CAST(id AS STRING) AS a", "CAST(id % 3 AS STRING) AS b",
                                       "CASE WHEN id % 5 = 0 THEN ' ' ELSE 'x' END AS c")
    c = rows(P.column_summary_capped(df, cap=10))
    assert c["a"]["n_uniq"] == "> 10"
    assert c["b"]["n_uniq"] == "3"
    assert c["c"]["n_uniq"] == "2" and c["c"]["n_null"] == 10  # blank counted once
    assert P.label_counts_capped(df, "a", cap=10) is None
    assert P.label_counts_capped(df, "b", cap=10).count() == 3


def test_binary_columns(spark):
    df = spark.createDataFrame(
        [(None, 0, 1, 0, 0, 0.0, True, "0"),
         (None, 0, 1, 1, 1, 1.0, False, "1"),
         (None, 0, 1, 1, 2, 0.0, True, "0")],
        "allnull double, zero int, one int, zo int, three int, fl double, bo boolean, txt string")
    got = {r["attribute"] for r in P.binary_columns(df).collect()}
    assert got == {"allnull", "zero", "one", "zo", "fl", "bo"}


def test_uninformative_and_null_columns(spark):
    df = spark.createDataFrame(
        [(1, None, 5.0, float("nan")), (1, None, 6.0, 2.0), (None, 3, 7.0, 2.0), (1, None, 8.0, None),
         (1, None, 9.0, 2.0)],
        "c int, mostly_null int, v double, n double")
    assert {r["attribute"] for r in P.uninformative_columns(df).collect()} == {"c", "mostly_null", "n"}
    assert {r["attribute"] for r in P.null_columns(df, 0.8).collect()} == {"mostly_null"}
    prof = rows(P.null_profile(df, percent=False))
    assert prof["n"]["n_null"] == 2


def test_inf_profile(spark):
    df = spark.createDataFrame([(float("inf"), 1), (1.0, 2), (-float("inf"), 3), (2.0, 4)],
                               "x double, y int")
    p = rows(P.inf_profile(df))
    assert p["x"]["inf_frac"] == 0.5 and p["y"]["inf_frac"] == 0.0


def test_correlation_and_clusters(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=200)
    pdf = pd.DataFrame({"a": a, "b": a * 2 + 1, "neg": -a, "const": 1.0,
                        "noisy": a + rng.normal(size=200),
                        "holes": np.where(np.arange(200) % 7 == 0, np.nan, a)})
    df = spark.createDataFrame(pdf).replace(float("nan"), None, subset=["holes"])
    m = {(r["a"], r["b"]): r["corr"] for r in P.correlation_matrix(df).collect()}
    ref = pdf.corr()
    assert m[("a", "noisy")] == pytest.approx(ref.loc["a", "noisy"], abs=1e-9)
    assert m[("a", "holes")] == pytest.approx(1.0, abs=1e-9)     # pairwise complete
    assert m[("a", "const")] is None and m[("const", "const")] is None
    cl = {r["attribute"]: r["cluster"] for r in P.feature_clusters(df, thresh=0.95).collect()}
    assert cl["a"] == cl["b"] == cl["holes"]
    assert cl["neg"] != cl["a"]                                  # opposite must not cluster
    assert len({cl["const"], cl["a"], cl["neg"], cl["noisy"]}) == 4
    # clusters are invariant to row order
    cl2 = {r["attribute"]: r["cluster"]
           for r in P.feature_clusters(df.orderBy("noisy"), thresh=0.95).collect()}
    assert cl2 == cl


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10, size=300).astype(float)
    pdf = pd.DataFrame({"x": x, "y": x ** 3 + rng.normal(size=300), "z": rng.normal(size=300)})
    df = spark.createDataFrame(pdf)
    m = {(r["a"], r["b"]): r["corr"] for r in P.correlation_matrix(df, method="spearman").collect()}
    ref = pdf.corr(method="spearman")
    for a in "xyz":
        for b in "xyz":
            if a != b:
                assert m[(a, b)] == pytest.approx(ref.loc[a, b], abs=1e-9)


def test_table_equal(spark):
    a = spark.createDataFrame([(1, 1.004, "x"), (2, float("nan"), "y")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0, "x"), (2, float("nan"), "y")], "k int, v double, s string")
    r = P.table_equal(a, b, ["k"], decimals=2).first()
    assert r["equal"] and r["n_diff"] == 0                     # NaN equals NaN, rounding hides
    r = P.table_equal(a, b, ["k"]).first()
    assert not r["equal"] and r["n_diff"] == 1
    c = b.where("k = 1")
    r = P.table_equal(a, c, ["k"]).first()
    assert not r["equal"] and r["n_left"] == 2 and r["n_right"] == 1


def test_value_counts_and_distribution(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c string")
    vc = {r["value"]: r["n"] for r in P.value_counts(df, "c").collect()}
    assert vc == {"a": 2, "b": 1, None: 1}
    cd = {r["label"]: r["frac"] for r in P.class_distribution(df, "c").collect()}
    assert cd["a"] == 0.5
    long = {(r["attribute"], r["value"]): r["n"] for r in P.value_counts_long(df, ["c"]).collect()}
    assert long == {("c", "a"): 2, ("c", "b"): 1}


def test_important_features(spark):
    clusters = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "cluster int, attribute string")
    ranking = spark.createDataFrame([("a", 0.2), ("b", 0.5), ("c", 0.3)],
                                    "attribute string, importance double")
    got = [r["attribute"] for r in P.important_features(clusters, ranking).orderBy("rank").collect()]
    assert got == ["b", "c"]


def test_capped_booleans_are_text(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    r = P.column_summary_capped(df).first()
    assert r["min"] is None and r["max"] is None        # 'true' is not a number
    assert r["n_uniq"] == "3" and r["n_null"] == 1       # true, false, blank

"""Nulls, empty tables, ties, decimals, hot and odd values."""

import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import elm, hidden, models, neighbors, ordering, prep, profile, validate
from tessera.sources import io
from tessera.streaming.profile_stream import file_stream, stream_profile, stream_value_counts


def test_table_equal_sees_swapped_nulls_and_empty_tables(spark):
    s = "id int, a int, b int"
    left = spark.createDataFrame([(1, None, 5), (2, 1, 1), (2, 1, 1)], s)
    right = spark.createDataFrame([(1, 5, None), (2, 1, 1), (2, 1, 1)], s)
    assert tuple(profile.table_equal(left, right, ["id"]).first()) == (3, 3, 1, False)
    assert tuple(profile.table_equal(left, left, ["id"]).first()) == (3, 3, 0, True)
    fewer = spark.createDataFrame([(1, None, 5), (2, 1, 1)], s)
    assert tuple(profile.table_equal(left, fewer, ["id"]).first()) == (3, 2, 1, False)
    empty = left.where("false")
    assert tuple(profile.table_equal(empty, empty, ["id"]).first()) == (0, 0, 0, True)
    maps = spark.createDataFrame([(1, {"a": 1, "b": 2})], "id int, m map<string,int>")
    same = spark.createDataFrame([(1, {"b": 2, "a": 1})], "id int, m map<string,int>")
    assert profile.table_equal(maps, same, ["id"]).first()["equal"]


def test_profiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert {(r["attribute"], r["n_null"]) for r in profile.null_profile(df, percent=False).collect()} == {
        ("a", 0), ("b", 0)}
    assert all(r["null_frac"] is None for r in profile.null_profile(df).collect())
    assert profile.null_inf_profile(df).count() == 2 and profile.null_columns(df).count() == 0
    assert {r["n_uniq"] for r in profile.column_summary(df).collect()} == {0}


def test_decimals_keep_every_digit(spark):
    df = spark.createDataFrame([(Decimal("12345678901234567890.01"),), (Decimal("12345678901234567890.02"),),
                                (None,)], "d decimal(38,2)")
    assert profile.column_summary(df).first()["n_uniq"] == 3
    assert profile.column_summary_capped(df).first()["n_uniq"] == "3"


def test_capped_summary_counts_exactly_at_the_cap(spark):
    df = spark.range(1001).select(F.col("id"), F.least("id", F.lit(999)).alias("k"))
    got = {r["attribute"]: r["n_uniq"] for r in profile.column_summary_capped(df, cap=1000).collect()}
    assert got == {"id": "> 1000", "k": "1000"}


def test_spearman_ranks_the_common_rows_of_a_pair(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.integers(0, 9, 60).astype(float), "y": rng.normal(size=60),
                        "z": rng.normal(size=60).round(1), "c": 1.0, "f": rng.normal(size=60)})
    pdf.loc[rng.random(60) < 0.3, "x"] = None
    pdf.loc[rng.random(60) < 0.3, "z"] = None
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)],
                               "x double, y double, z double, c double, f double")
    got = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_matrix(df, method="spearman").collect()}
    want = pdf.corr("spearman")
    for a in pdf:
        for b in pdf:
            w = want.loc[a, b]
            assert (got[a, b] is None) if pd.isna(w) else math.isclose(got[a, b], w, abs_tol=1e-12), (a, b)


def test_value_index_is_sorted(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("b", 2), (None, 2)], "s string, n int")
    assert [tuple(r) for r in profile.value_index(df, ["s", "n"]).collect()] == [
        ("s", "b", 2), ("s", "a", 1), ("n", "1", 2), ("n", "2", 2)]


def test_labels_follow_their_own_type(spark):
    df = spark.createDataFrame([(10,), (2,), (1,), (11,), (None,)], "k int")
    assert {r["k"]: r["label_idx"] for r in prep.label_encode(df, "k").collect()} == {
        1: 0, 2: 1, 10: 2, 11: 3, None: None}
    classes = prep.label_classes(df.where("k > 1"), "k")
    assert {r["k"]: r["label_idx"] for r in prep.label_apply(df, classes, "k").collect()}[1] is None
    flags = prep.label_binarize(df, "k")
    assert flags.columns == ["k", "is_1", "is_2", "is_10", "is_11"]
    assert [r["is_2"] for r in flags.where("k is null").collect()] == [None]


def test_submission_columns_follow_the_class_type(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.3, 0.4])], "id int, p array<double>")
    out = io.class_columns(df, "id", "p", [11, 2, 1, 10])
    assert out.columns == ["id", "1", "2", "10", "11"] and tuple(out.first()) == (1, 0.3, 0.2, 0.4, 0.1)


def test_perfect_separator_ranks_first_and_large_means_keep_digits(spark):
    rows = [(f, y, v + 1e9) for y, (a, b, c) in enumerate([(0.0, 0.1, 1.0), (5.0, 0.3, 1.0)])
            for f, v in (("sep", a), ("noise", b), ("const", c)) for v in ((v, v) if f != "noise" else (v, v + 1.0))]
    got = {r["f"]: r["f_score"] for r in prep.anova_f(
        spark.createDataFrame(rows, "f string, y int, v double"), "f", "y", "v").collect()}
    assert got["sep"] == math.inf and got["const"] is None
    assert math.isclose(got["noise"], 0.04 / 0.5, rel_tol=1e-5)
    ranked = prep.select_k_best(spark.createDataFrame(list(got.items()), "f string, f_score double"), "f", 1)
    assert ranked.first()["f"] == "sep"


def _llf(x, lam):
    y = np.log(x) if abs(lam) < 1e-12 else (x ** lam - 1) / lam
    return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())


@pytest.mark.parametrize("power", [0.5, 6.0])
def test_boxcox_fits_with_nulls_and_far_lambdas(spark, power):
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(10, 1, 400)) ** (1 / power)
    rows = [(float(v),) for v in x] + [(None,)] * 300 + [(float("nan"),)] * 50
    model = prep.BoxCox(["x"], shift=0.0).fit(spark.createDataFrame(rows, "x double"))
    lam = model.getOrDefault(model.lambdas)[0]
    grid = np.arange(lam - 3, lam + 3, 0.01)
    assert _llf(x, lam) >= max(_llf(x, g) for g in grid) - 1e-3
    with pytest.raises(ValueError):
        prep.BoxCox(["x"], shift=0.0).fit(spark.createDataFrame([(1.0,), (0.0,)], "x double"))


def test_summary_store_has_its_row_count(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "n int, s string")
    io.save_summary(profile.column_summary(df), profile.label_counts(df, "s"), str(tmp_path / "one"))
    assert io.load_summary(spark, str(tmp_path / "one"))[1].first()["n_rows"] == 3
    io.save_summary(profile.column_summary(df), None, str(tmp_path / "two"))
    assert io.load_summary(spark, str(tmp_path / "two"))[1].first()["n_rows"] == 3


def test_header_before_a_number_or_time_is_dropped(spark, tmp_path):
    (tmp_path / "a.csv").write_text("stamp,v\n2020-01-02 03:04:05,1\n2020-01-03 00:00:00,2\n")
    df = io.read_positional(spark, str(tmp_path / "a.csv"), "stamp timestamp, v int", skip_prefix="stamp")
    assert df.count() == 2 and df.where("stamp is null").count() == 0
    assert dict(df.dtypes) == {"stamp": "timestamp", "v": "int"}


def test_rank_weights_are_the_leading_entries():
    assert [round(26 * w) for w in models.fibonacci_weights(3)] == [13, 8, 5]
    assert [round(32 * w) for w in models.fibonacci_weights(6)] == [13, 8, 5, 3, 2, 1]


def test_equal_width_layer_is_the_best_rotation(spark):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    h = rng.normal(size=(40, 5))
    u, _, vt = np.linalg.svd(h.T @ (h @ q))
    assert np.linalg.norm(h @ (u @ vt) - h @ q) < 1e-9
    df = spark.createDataFrame([(v.tolist(),) for v in h], "x array<double>")
    m = elm.DeepElmAutoEncoder(widths=[5], C=[0, 0], slopes=[1.0]).fit(df, "x")
    assert np.allclose(m.W_[0] @ m.W_[0].T, np.eye(5))
    got = np.array([r["values"] for r in m.reconstruct_values(df, "x").collect()])
    assert np.allclose(got, np.array([r["x"] for r in df.collect()]), atol=1e-8)  # a rotation loses nothing


def test_elm_keeps_text_labels_and_null_rows_aside(spark):
    rng = np.random.default_rng(5)
    rows = [([float(v) for v in rng.normal(size=3) + 4 * (i % 2)], ["no", "yes"][i % 2]) for i in range(80)]
    df = spark.createDataFrame([*rows, ([0.0, 0.0, 0.0], None)], "x array<double>, y string")
    pred = elm.ElmClassifier(n_hidden=30, density=1).fit(df, "x", "y").predict(df, "x")
    assert dict(pred.dtypes)["pred"] == "string" and pred.where("pred = y").count() >= 76
    with pytest.raises(ValueError):
        elm.ElmClassifier(n_hidden=10 ** 6).fit(df, "x", "y")


def test_rotation_subsets_overlap():
    rng = np.random.default_rng(6)
    cov = np.cov(rng.normal(size=(200, 12)).T, bias=True)
    m, b = elm.rotation_matrix(np.zeros(12), cov, seed=3)
    assert m.shape == (12, 12) and np.isfinite(m).all()
    one, _ = elm.rotation_matrix(np.zeros(12), np.eye(12), n_subsets=1, seed=8)
    assert np.allclose(np.abs(one[one != 0]), 1.0)


def test_rotation_forest_with_elm_and_neighbours(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 3, [float(v) for v in rng.normal(size=4) * 0.3 + np.eye(3, 4)[i % 3] * 3]) for i in range(240)]
    df = spark.createDataFrame(rows, "key long, label int, x array<double>")
    rf = models.RotationForest({"elm": models.ElmMember(n_hidden=30, density=1), "knn": models.NeighbourMember()},
                               n=3, n_subsets=6, seed=1).fit(df, "x")
    out = rf.predict(df, "x", "key").join(df, "key")
    assert out.count() == 240 and out.where("prediction = label").count() > 150


def test_rbf_takes_radii_and_callables(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "x array<double>")
    got = hidden.rbf_layer(df, "x", [[0.0, 0.0], [3.0, 4.0]], radius=[1.0, 5.0], kind=lambda d: d + 1).collect()
    assert [r["rbf"] for r in got] == [[1.0, 2.0], [6.0, 1.0]]
    wide = hidden.dense_layer(df, "x", np.ones((2, 3000)), np.zeros(3000), act="identity")
    assert {tuple(r["hidden"][:2]) for r in wide.collect()} == {(0.0, 0.0), (7.0, 7.0)}


def test_a_query_with_nan_keeps_its_neighbours(spark):
    ref = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(5)], "r long, v array<double>, y int")
    q = spark.createDataFrame([(100, [float("nan"), 0.0]), (101, [1.1, 0.0])], "q long, v array<double>")
    got = neighbors.knn(q, ref, "q", "r", "v", k=2, carry=["y"]).collect()
    assert sorted((r["q"], r["ref_id"]) for r in got) == [(100, 0), (100, 1), (101, 1), (101, 2)]


def test_row_numbers_of_ties_repeat(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "k int, v int").repartition(7)
    a = {r["v"]: r["row_id"] for r in ordering.row_numbers(df, ["k"]).collect()}
    b = {r["v"]: r["row_id"] for r in ordering.row_numbers(df.repartition(3), ["k"]).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 101))
    assert ordering.row_numbers(df.where("false"), ["k"]).count() == 0


def test_folds_take_few_jobs(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(300)], "key long, label int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("folds", "folds")
    validate.stratified_folds(df, "key", "label", 5).collect()
    jobs = len(tracker.getJobIdsForGroup("folds"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 16


def test_holdout_uses_the_share_as_given(spark):
    df = spark.range(200_000).withColumnRenamed("id", "key")
    n = validate.holdout_split(df, "key", 0.0004).where("is_test").count()
    assert 40 < n < 130


def test_stream_counts_nan_as_null_and_resumes(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    one = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "a")], "v double, s string")
    one.coalesce(1).write.parquet(str(src))
    stream = lambda: file_stream(spark, str(src), "*.parquet", schema=one.schema)
    (r,) = stream_profile(stream(), ["v"]).collect()
    assert (r["n_rows"], r["n_null"], r["min"], r["max"], r["n_distinct_approx"]) == (3, 2, 1.0, 1.0, 1)
    seen = []
    got = lambda: {r["value"]: r["n"] for r in stream_value_counts(
        stream(), "s", on_progress=seen.append, path=str(out)).collect()}
    assert got() == {"a": 2, "b": 1} and seen
    one.coalesce(1).write.mode("append").parquet(str(src))
    assert got() == {"a": 4, "b": 2}


@pytest.mark.parametrize("self_too", [False, True])
def test_pruned_search_equals_brute_force(spark, self_too):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5)) * 8
    x = centres[rng.integers(0, 6, 700)] + rng.normal(size=(700, 5))
    x[11] = x[12]
    ref = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "r long, v array<double>, y int")
    if self_too:
        q, rows = ref.select(F.col("r").alias("q"), "v"), x
    else:
        rows = centres[rng.integers(0, 6, 90)] + rng.normal(size=(90, 5)) * 3
        q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "q long, v array<double>")
    got = neighbors.knn(q, ref, "q", "r", "v", k=3, block_rows=40, exclude_self=self_too, carry=["y"]).collect()
    d = np.sqrt(((rows[:, None, :] - x[None]) ** 2).sum(-1))
    if self_too:
        np.fill_diagonal(d, np.inf)
    want = {(i, int(j), n + 1, int(j) % 4) for i in range(len(rows))
            for n, j in enumerate(np.lexsort((np.arange(700), d[i]))[:3])}
    assert {(r["q"], r["ref_id"], r["rank"], r["y"]) for r in got} == want


def test_every_row_finds_itself_whatever_the_cells(spark):
    x = np.random.default_rng(9).normal(size=(600, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    got = neighbors.knn(df, df.withColumnRenamed("k", "r"), "k", "r", "v", k=1, block_rows=50)
    assert got.count() == got.where("k = ref_id").count() == 600


def test_nested_and_binary_columns_are_profiled(spark):
    df = spark.createDataFrame(
        [([1, 2], {"a": 1, "b": 2}, bytearray(b"x"), (1, "p")), ([1, 2], {"b": 2, "a": 1}, bytearray(b"y"), (1, "p")),
         (None, None, None, None)], "a array<int>, m map<string,int>, b binary, s struct<i:int,t:string>")
    assert {r["attribute"] for r in profile.uninformative_columns(df).collect()} == {"a", "m", "s"}
    for summary in (profile.column_summary(df), profile.column_summary_capped(df)):
        got = {r["attribute"]: (r["n_null"], int(r["n_uniq"]), r["min"]) for r in summary.collect()}
        assert got == {"a": (1, 2, None), "m": (1, 2, None), "b": (1, 3, None), "s": (1, 2, None)}

"""Every public operator on nulls, NaN, null vectors, empty tables, columns
without a value and repeated rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions import scalar as S
from tessera.operators import centroid, elm, features, hidden, images, metrics, neighbors, prep, profile, validate

NAN, INF = float("nan"), float("inf")


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize("fn,want", [
    (lambda c: S.clip(c, 0.0, 1.0), [0.0, 0.5, 1.0, None, NAN]), (S.relu, [0.0, 0.5, 3.0, None, NAN]),
    (S.tribas, [0.0, 0.5, 0.0, None, NAN]), (lambda c: S.clip(c, lo=0.0), [0.0, 0.5, 3.0, None, NAN])])
def test_scalars_keep_null_and_nan(spark, fn, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-2.0, 0.5, 3.0, None, NAN])], "i int, x double")
    got = [r["y"] for r in df.select("i", fn("x").alias("y")).orderBy("i").collect()]
    assert str(got) == str(want)


def test_losses_score_only_known_rows(spark):
    df = spark.createDataFrame([(0.8, 1.0), (None, 0.0), (NAN, 1.0), (0.5, None)], "p double, y double")
    r = one(metrics.log_loss_binary(df, "p", "y"))
    assert r["n"] == 1 and r["log_loss"] == pytest.approx(-math.log(0.8))
    r = one(metrics.log_loss_multi(df, "p"))
    assert r["n"] == 2 and r["log_loss"] == pytest.approx(-(math.log(0.8) + math.log(0.5)) / 2)
    for empty in (df.filter("false"), df.filter("p is null")):
        assert one(metrics.log_loss_binary(empty, "p", "y")) == {"log_loss": None, "n": 0}
        assert one(metrics.log_loss_multi(empty, "p")) == {"log_loss": None, "n": 0}
    m = spark.createDataFrame([(1.0, 1.0, 0.0), (None, 1.0, 0.0), (2.0, NAN, 1.0)], "p double, a double, b double")
    assert one(metrics.rmsle(m, "p", "a", "b")) == {"rmsle": 0.0, "n": 1}


def test_scalers_leave_nan_out(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (NAN, None), (None, None), (5.0, None)], "`a.b` double, e double")
    for est in (prep.PopulationStandardScaler(["a.b", "e"], ["z", "ze"]), prep.RangeScaler(["a.b", "e"], ["z", "ze"]),
                prep.RangeScaler(["a.b", "e"], ["z", "ze"], eps=1e-4)):
        rows = est.fit(df).transform(df).collect()
        z = [r["z"] for r in rows]
        assert z[3] is None and math.isnan(z[2]) and all(math.isfinite(z[i]) for i in (0, 1, 4))
        assert [r["ze"] for r in rows] == [None] * 5
        assert est.fit(df.filter("false")).transform(df.filter("false")).collect() == []
    z = [r["s"] for r in features.minmax_stretch(df, "a.b", "s").collect()]
    assert z[:2] == [0.0, 0.5] and z[4] == 1.0 and z[3] is None and math.isnan(z[2])
    assert [r["s"] for r in features.minmax_stretch(df, "e", "s").collect()] == [None] * 5


def test_anova_ignores_nan_and_null_labels(spark):
    rows = [(f, y, v) for f in (0, 1) for y, v in [("a", 1.0), ("a", 1.2), ("b", 1.1 + f), ("b", 1.3 + f)]]
    df = spark.createDataFrame(rows, "f int, y string, v double")
    odd = df.unionByName(spark.createDataFrame([(0, "a", NAN), (0, None, 9.0), (1, "b", None)], df.schema))
    want = {r["f"]: r["f_score"] for r in prep.anova_f(df, "f", "y", "v").collect()}
    got = {r["f"]: r["f_score"] for r in prep.anova_f(odd, "f", "y", "v").collect()}
    assert got == want and prep.select_k_best(prep.anova_f(odd, "f", "y", "v"), "f", 1).first()["f"] == 1


def test_equality_keeps_big_integers_apart(spark):
    a = spark.createDataFrame([(1, 2 ** 60, 1.004, None)], "k int, i long, d double, x decimal(38,3)").withColumn(
        "x", F.lit("12345678901234567890123456789.125").cast("decimal(38,3)"))
    b = a.withColumn("i", F.col("i") + 1)
    c = a.withColumn("x", F.lit("12345678901234567890123456789.250").cast("decimal(38,3)"))
    same = a.withColumn("d", F.lit(1.0))
    for fn in (lambda x, y: profile.table_equal(x, y, ["k"], decimals=2), lambda x, y: profile.table_equal_unkeyed(x, y, 2)):
        assert fn(a, same).first()["equal"] and not fn(a, b).first()["equal"] and not fn(a, c).first()["equal"]


VECS = [(i, "ab"[i % 2], [float(i % 2) * 4 + i / 10, 1.0, i / 7], i % 3) for i in range(24)]
ODD = [(100, None, [9.0, 9.0, 9.0], 0), (101, "a", None, 1), (102, None, None, 2)]
SCHEMA = "id long, label string, v array<double>, fold int"


def test_nearest_mean_has_no_null_class(spark):
    df, odd = spark.createDataFrame(VECS, SCHEMA), spark.createDataFrame(VECS + ODD, SCHEMA)
    want = {r["id"]: r["pred_all"] for r in centroid.nearest_mean_oof(df, "id", "label", "v", "fold").collect()}
    got = {r["id"]: r["pred_all"] for r in centroid.nearest_mean_oof(odd, "id", "label", "v", "fold").collect()}
    assert {i: got[i] for i in want} == want and None not in want.values()
    assert got[100] in "ab" and got[101] is None and got[102] is None and len(got) == 27
    assert centroid.nearest_mean_oof(odd.filter("false"), "id", "label", "v", "fold").collect() == []


@pytest.mark.parametrize("block", [4096, 5])
def test_knn_without_null_vectors(spark, block):
    df, odd = spark.createDataFrame(VECS, SCHEMA), spark.createDataFrame(VECS + ODD[1:], SCHEMA)
    args = dict(k=2, block_rows=block, exclude_self=True, carry=["label"])
    want = sorted(map(tuple, neighbors.knn(df, df, "id", "id", "v", **args).collect()))
    assert sorted(map(tuple, neighbors.knn(odd, odd, "id", "id", "v", **args).collect())) == want
    empty = df.filter("false")
    assert neighbors.knn(df, empty, "id", "id", "v", **args).collect() == []
    assert neighbors.knn(empty, df, "id", "id", "v", **args).collect() == []


def test_learning_machines_skip_null_vectors(spark):
    df, odd = spark.createDataFrame(VECS, SCHEMA), spark.createDataFrame(VECS + ODD, SCHEMA)
    a = elm.ElmClassifier(n_hidden=8, density=1, alpha=1e-6).fit(df, "v", "label")
    b = elm.ElmClassifier(n_hidden=8, density=1, alpha=1e-6).fit(odd, "v", "label")
    assert np.allclose(a.beta_, b.beta_)
    got = {r["id"]: r["pred"] for r in b.predict(odd, "v").collect()}
    assert got[101] is None and got[102] is None and got[100] in "ab" and sum(got[i] == y for i, y, *_ in VECS) > 20
    assert b.predict(odd.filter("false"), "v").collect() == []
    assert [r["pred"] for r in b.predict(odd.filter("id = 101"), "v").collect()] == [None]
    mu, cov = elm.covariance(odd.filter("id <> 100"), "v")
    assert np.allclose(cov, np.cov(np.array([r[2] for r in VECS]).T, bias=True))
    z = {r["id"]: r["pcs"] for r in elm.pca_transform(odd, "v", *elm.pca_components(df, "v", 2)[:2]).collect()}
    assert z[101] is None and len(z[0]) == 2
    for empty in (df.filter("false"), odd.filter("v is null")):
        with pytest.raises(ValueError, match="no vector"):
            elm.covariance(empty, "v")
    with pytest.raises(ValueError, match="max_width=4"):
        elm.ElmClassifier(n_hidden=8, max_width=4).fit(df, "v", "label")


def test_sparse_features_and_radius(spark):
    df, odd = spark.createDataFrame(VECS, SCHEMA), spark.createDataFrame(VECS + ODD[1:], SCHEMA)
    W = np.random.default_rng(0).normal(size=(2, 3))
    want = {r["id"]: r["sf"] for r in hidden.sparse_filter_activation(df, "v", W).collect()}
    got = {r["id"]: r["sf"] for r in hidden.sparse_filter_activation(odd, "v", W).collect()}
    assert got.pop(101) is None and got.pop(102) is None
    assert all(np.allclose(got[i], want[i]) for i in want) and got.keys() == want.keys()
    assert hidden.sparse_filter_activation(df.filter("false"), "v", W).collect() == []
    for centres in ([[1.0, 2.0]], [[1.0, 2.0]] * 3):
        with pytest.raises(ValueError, match="radius"):
            hidden.rbf_radius(np.array(centres))


def test_images_without_pixels(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 0.5, 0.9]), (2, None)], "id int, px array<double>")
    rows = images.rotate_images(df, "id", "px", width=2).collect()
    assert len(rows) == 4 and [r["px"] for r in rows if r["id"] == 2] == [None, None]
    got = {r["id"]: r["px"] for r in images.normalise_images(df, "px").collect()}
    assert got[2] is None and np.mean(got[1]) == pytest.approx(0)
    for empty in (df.filter("false"), df.filter("id = 2")):
        assert all(r["px"] is None for r in images.normalise_images(empty, "px").collect())


def test_repeated_keys_multiply_no_rows(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (None, "a", 4), (None, "b", 5), (2, "a", 6), (3, None, 7)],
                               "k long, y string, x int")
    for got in (validate.stratified_folds(df, "k", "y", 2), validate.stratified_holdout(df, "k", "y", 0.5)):
        rows = got.collect()
        assert sorted(r["x"] for r in rows) == [1, 2, 3, 4, 5, 6, 7]
        col = got.columns[-1]
        assert len({r[col] for r in rows if r["k"] == 1}) == 1
        assert got.filter("false").columns[:-1] == df.columns
    assert validate.stratified_folds(df.filter("false"), "k", "y", 2).collect() == []


def test_leave_one_out_equals_refitting(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(30, 4))
    Y = np.tanh(X @ rng.normal(size=(4, 2))) + rng.normal(size=(30, 2)) * 0.1
    P = rng.normal(size=(4, 3))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(X, Y)] + [(None, None)],
                               "x array<double>, y array<double>").repartition(4)
    target = lambda _, t: np.stack([np.asarray(v, float) for v in t])
    hide = lambda Z: np.tanh(Z @ P)
    stats = elm._total(elm.gram_sums(df, "x", hide, target, target_col="y"))
    alphas = [1e-3, 0.1, 1.0, 10.0]
    got = elm.leave_one_out(df, "x", hide, alphas, stats, target, "y")
    H = hide(X)
    for a in alphas:
        lost = []
        for i in range(30):
            keep = np.arange(30) != i
            mh, my = H[keep].mean(0), Y[keep].mean(0)
            A = H[keep] - mh
            B = np.linalg.solve(A.T @ A + a * np.eye(3), A.T @ (Y[keep] - my))
            lost.append(((Y[i] - my - (H[i] - mh) @ B) ** 2).mean())
        assert got[a] == pytest.approx(np.mean(lost), rel=1e-8)
    ae = elm.ElmAutoEncoder(k=2, alphas=alphas).fit(df.withColumn("id", F.monotonically_increasing_id()), "x", "id")
    assert ae.alpha_ == min(ae.errors_, key=ae.errors_.get)


def test_boxcox_slope_vanishes_at_the_fit(spark):
    """Plain numpy likelihood, its slope by differences and at the optimum."""
    rng = np.random.default_rng(5)
    cols = {"a": np.exp(rng.normal(size=400)), "b": rng.gamma(2.0, size=400) + 0.01, "c": (rng.normal(size=400) + 9) ** 3,
            "d": rng.uniform(0.5, 1.5, size=400), "one": np.full(400, 2.0)}
    df = spark.createDataFrame([tuple(float(v[i]) for v in cols.values()) for i in range(400)], list(cols))
    df = df.unionByName(spark.createDataFrame([(None, NAN, None, None, None)], df.schema))
    model = prep.BoxCox(list(cols), shift=0.0).fit(df)

    def llf(x, lam):
        z = np.log(x) if lam == 0 else (x ** lam - 1) / lam
        return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(z.var())

    fitted = dict(zip(cols, model.getOrDefault("lambdas")))
    assert fitted["one"] == 1.0
    centre = {c: float(np.log(x).mean()) for c, x in cols.items()}
    got = {r["attribute"]: r for r in prep.boxcox_slopes(df, fitted, centre).collect()}
    for c in "abcd":
        assert abs(got[c]["slope"]) < 1e-6 and got[c]["curvature"] < 0
        assert llf(cols[c], fitted[c]) >= max(llf(cols[c], fitted[c] + d) for d in (-1e-3, 1e-3))
    for lam in (-1.5, 1e-5, 0.0, 0.4):
        for r in prep.boxcox_slopes(df, {c: lam for c in "abcd"}, centre).collect():
            x, h = cols[r["attribute"]], 1e-4
            assert r["slope"] == pytest.approx((llf(x, lam + h) - llf(x, lam - h)) / (2 * h), rel=1e-3, abs=1e-2)
            assert r["curvature"] == pytest.approx((llf(x, lam + h) - 2 * llf(x, lam) + llf(x, lam - h)) / h ** 2, rel=5e-2, abs=1.0)
    assert prep.BoxCox(["a"], shift=0.0).fit(df.filter("false")).getOrDefault("lambdas") == [1.0]


def test_sparse_filter_gradient_and_descent(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(x.tolist(),) for x in X] + [(None,)], "v array<double>").repartition(3)
    W = rng.normal(size=(3, 5))

    def objective(W):
        Z = X - X.mean(1, keepdims=True)
        f = np.sqrt((Z @ W.T) ** 2 + 1e-8)
        g = f / np.sqrt((f * f).sum(0))
        return (g / np.sqrt((g * g).sum(1, keepdims=True))).sum()

    value, grad = hidden.sparse_filter_objective(df, "v", W)
    assert value == pytest.approx(objective(W), rel=1e-12)
    for i in range(3):
        for j in range(5):
            step = np.zeros_like(W)
            step[i, j] = 1e-6
            assert grad[i, j] == pytest.approx((objective(W + step) - objective(W - step)) / 2e-6, rel=1e-4, abs=1e-5)
    fitted, values = hidden.fit_sparse_filter(df, "v", 3, iterations=6, seed=1)
    assert len(values) > 3 and all(b < a for a, b in zip(values, values[1:]))
    assert values[-1] == pytest.approx(objective(fitted), rel=1e-9)
    with pytest.raises(ValueError, match="no vector"):
        hidden.fit_sparse_filter(df.filter("false"), "v", 3)

"""Gram-sum solvers equal a direct numpy answer; models clear a bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import elm, models
from tessera.plans.catalog_features import emb_folds

SF = "/root/testdata/sf0.001"


def _emb(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def _X(df):
    rows = sorted(df.select("vec_id", "embedding", "label").collect(), key=lambda r: r[0])
    return np.array([r[1] for r in rows], dtype=float), np.array([r[2] for r in rows])


def test_gram_sums_equal_numpy(spark):
    df = _emb(spark)
    X, _ = _X(df)
    s = elm._total(elm.gram_sums(df, "embedding", lambda A: np.tanh(A[:, :8]), None))
    H = np.tanh(X[:, :8])
    assert s["n"] == len(X)
    assert np.allclose(s["hh"], H.T @ H) and np.allclose(s["hy"], H.T @ X)
    assert np.isclose(s["yy"], (X * X).sum())


def test_ridge_from_sums_equals_lstsq(spark):
    rng = np.random.default_rng(0)
    H = rng.normal(size=(50, 4))
    Y = H @ rng.normal(size=(4, 2)) + 3 + rng.normal(size=(50, 2)) * 0.1
    s = dict(n=50.0, sh=H.sum(0), sy=Y.sum(0), hh=H.T @ H, hy=H.T @ Y, yy=(Y * Y).sum())
    B, c = elm.ridge_solve(s, 0.0)
    A = np.hstack([H, np.ones((50, 1))])
    sol = np.linalg.lstsq(A, Y, rcond=None)[0]
    assert np.allclose(B, sol[:4]) and np.allclose(c, sol[4])
    sse = elm.fold_sse(s, s, B, c)
    assert sse == pytest.approx(((Y - A @ sol) ** 2).sum())


def test_pca_matches_numpy(spark):
    df = _emb(spark)
    X, _ = _X(df)
    mu, comps, vals = elm.pca_components(df, "embedding", k=3)
    ref = np.linalg.eigvalsh(np.cov(X.T, bias=True))[::-1][:3]
    assert np.allclose(vals, ref)
    out = {r["vec_id"]: r["pcs"] for r in elm.pca_transform(df, "embedding", mu, comps).collect()}
    first = min(out)
    assert np.allclose(out[first], (X[0] - mu) @ comps)


def _blobs(spark, n=300, seed=0):
    """Separable fixture: three classes around distinct centres (the test
    embeddings carry no label signal, so bounds are asserted here)."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, size=n)
    X = rng.normal(size=(n, 6)) * 0.3 + np.eye(3, 6)[y] * 3
    rows = [(int(i), int(y[i]), list(map(float, X[i])), int(i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, fold int")


def test_elm_classifier_beats_majority(spark):
    f = _blobs(spark)
    clf = elm.ElmClassifier(n_hidden=50, density=1, seed=0).fit(f.where("fold != 0"),
                                                                 "embedding", "label")
    pred = clf.predict(f.where("fold = 0").select("vec_id", "label", "embedding"), "embedding")
    acc = pred.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.9


def test_deep_elm_and_rotation_forest_bounds(spark):
    f = _blobs(spark, seed=1)
    m = elm.DeepElmAutoEncoder(widths=[8, 8], C=[1e3, 0, 1e3], slopes=[1.0, 1.0]).fit(
        f.where("fold != 0"), "embedding", "label")
    p = m.reconstruct(f.where("fold = 0").select("vec_id", "label", "embedding"), "embedding")
    assert p.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0] > 0.6
    from pyspark.ml.classification import DecisionTreeClassifier
    rf = models.RotationForest({"tree": DecisionTreeClassifier(maxDepth=4, seed=0),
                                "nb": models.gaussian_nb()}, n=3, n_subsets=2, seed=0)
    rf.fit(f.where("fold != 0"), "embedding", "label", "vec_id")
    pr = rf.predict(f.where("fold = 0"), "embedding", "vec_id").join(f, "vec_id")
    assert pr.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.9


def test_elm_autoencoder_shapes(spark):
    df = _emb(spark).select("vec_id", "embedding")
    ae = elm.ElmAutoEncoder(k=8, seed=0).fit(df, "embedding", "vec_id")
    assert ae.components_.shape == (64, 8)
    assert len(ae.transform(df, "embedding").first()["ae"]) == 8
    with pytest.raises(ValueError):
        elm.ElmAutoEncoder(k=100).fit(df, "embedding", "vec_id")


def test_cv_scores_and_oof_cover_each_key_once(spark):
    f = models.with_vector(emb_folds(spark, SF), "embedding")
    scores = models.cv_scores(f, models.gaussian_nb())
    assert scores.count() == 5
    assert 0.0 <= scores.agg(F.avg("score")).first()[0] <= 1.0
    blobs = models.with_vector(_blobs(spark, seed=2), "embedding")
    assert models.cv_scores(blobs, models.gaussian_nb()).agg(F.min("score")).first()[0] > 0.9
    oof = models.oof_predict(f, "vec_id", models.gaussian_nb())
    assert oof.count() == f.count() == oof.select("vec_id").distinct().count()


def test_titles_must_match_groups(spark):
    f = emb_folds(spark, SF)
    with pytest.raises(ValueError):
        models.feature_group_cv(f, [(0, 32)], "label", models.gaussian_nb(), "embedding",
                                titles=["a", "b"])


def test_fibonacci_weights():
    w = models.fibonacci_weights(5)
    assert w == sorted(w, reverse=True) and abs(sum(w) - 1) < 1e-12


def test_neighbour_members_read_their_queries_once(spark):
    """A search reads its queries several times; each vote before it is not searched again."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            reads.add(len(pdf))
            yield pdf

    f = _blobs(spark, n=100, seed=3).select("vec_id", "label", "embedding")
    m = models.NeighbourMember(k=3, key="vec_id").fit(models.with_vector(f, "embedding"))
    cur = models.with_vector(f.mapInPandas(seen, f.schema), "embedding")
    for _ in range(3):
        cur = m.transform(cur).drop("prediction")
    assert cur.count() == 100 and reads.value == 100

"""Image moves, neighbours and hidden layers against numpy brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import hidden, images, neighbors


def _img(spark, lit):
    px = [0.0] * 16
    for p in lit:
        px[p] = 1.0
    return spark.createDataFrame([(1, 7, px)], "k long, label int, px array<double>")


def _grid(px):
    return np.asarray(px).reshape(4, 4)


def test_nudge_corner_and_centre(spark):
    df = _img(spark, [0, 5])             # corner (0,0) and interior (1,1)
    out = {r["shift"]: _grid(r["px"]) for r in images.nudge_images(df, "px", 4).collect()}
    assert len(out) == 5
    assert out["original"][0, 0] == 1 and out["original"][1, 1] == 1
    assert out["up"][0, 1] == 1 and out["up"].sum() == 1        # corner falls off the top
    assert out["left"][1, 0] == 1 and out["left"].sum() == 1
    assert out["right"][0, 1] == 1 and out["right"][1, 2] == 1
    assert out["down"][1, 0] == 1 and out["down"][2, 1] == 1


def test_nudge_multiplies_rows_by_five(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    n = df.count()
    out = images.nudge_images(df, "embedding", 8)
    assert out.count() == 5 * n
    assert images.translate_images(df, "embedding", 8).count() == 4 * n
    assert out.where("shift = 'original'").select(F.sum("label")).first()[0] == \
        df.select(F.sum("label")).first()[0]


def test_downsample_and_crop(spark):
    px = list(map(float, range(64)))
    df = spark.createDataFrame([(1, px)], "k long, px array<double>")
    d = images.downsample_images(df, "px", 8).first()["px"]
    g = np.arange(64.0).reshape(8, 8)
    exp = [g[r * 4:r * 4 + 2, c * 4:c * 4 + 2].mean() for r in range(2) for c in range(2)]
    assert d == pytest.approx(exp)
    c = images.crop_images(df, "px", 8, border=2).first()["px"]
    assert c == list(g[2:6, 2:6].ravel())


def test_rotate_keeps_original_and_thresholds(spark):
    df = _img(spark, [5, 6, 9, 10])
    out = images.rotate_images(df, "k", "px", 4, seed=1).collect()
    assert len(out) == 2
    rot = [r for r in out if r["copy"] == 1][0]["px"]
    assert all(v == 0.0 or v >= 0.15 for v in rot)


def test_spline_coefficients_solve_the_sample_equations():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 8, 40):
        x = rng.normal(size=(3, n, 2))
        c = images.spline_coefficients(x, 1)
        ends = np.concatenate([c[:, 1:2], c, c[:, -2:-1]], axis=1) if n > 1 else np.repeat(c, 3, axis=1)
        assert np.allclose((ends[:, :-2] + 4 * ends[:, 1:-1] + ends[:, 2:]) / 6, x, atol=1e-12)


def test_spline_rotation_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    h, w, turns = 5, 7, [0.0, 11.0, -17.0, 90.0]
    ims = [rng.uniform(size=h * w) for _ in turns]
    rows = [(i, list(map(float, im)), a) for i, (im, a) in enumerate(zip(ims, turns))] + [(9, None, 5.0)]
    df = spark.createDataFrame(rows, "k int, px array<double>, a double")
    got = {r["k"]: r["px"] for r in images.rotate_images(
        df, "k", "px", w, angles=[df["a"]], low=-1e9, high=1e9).where("copy = 1").collect()}

    def solved(n):
        m = np.zeros((n, n))
        for i in range(n):
            m[i, i] += 4 / 6
            for j in (i - 1, i + 1):
                m[i, abs(j) if j < n else 2 * n - 2 - j] += 1 / 6
        return np.linalg.inv(m)

    def bump(d):
        d = abs(d)
        return 2 / 3 - d * d + d ** 3 / 2 if d < 1 else max(2 - d, 0.0) ** 3 / 6

    for k, (im, a) in enumerate(zip(ims, turns)):
        c = solved(h) @ im.reshape(h, w) @ solved(w).T
        t, want = math.radians(a), np.zeros((h, w))
        for y in range(h):
            for x in range(w):
                dx, dy = x - (w - 1) / 2, y - (h - 1) / 2
                sx = math.cos(t) * dx + math.sin(t) * dy + (w - 1) / 2
                sy = -math.sin(t) * dx + math.cos(t) * dy + (h - 1) / 2
                if 0 <= sx <= w - 1 and 0 <= sy <= h - 1:
                    for v in range(-3, h + 3):
                        for u in range(-3, w + 3):
                            cv, cu = abs(v) if v < h else 2 * h - 2 - v, abs(u) if u < w else 2 * w - 2 - u
                            want[y, x] += c[cv, cu] * bump(sx - u) * bump(sy - v)
        assert np.allclose(np.reshape(got[k], (h, w)), want, atol=1e-9)
    assert np.allclose(got[0], ims[0]) and got[9] is None
    with pytest.raises(ValueError):
        images.rotate_images(df, "k", "px", w, order=2)


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(60, 5))
    y = rng.integers(0, 3, size=60)
    rows = [(int(i), int(y[i]), list(map(float, X[i]))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    q, r = df.where("id < 15"), df.where("id >= 15")
    nn = neighbors.knn(q, r, "id", "id", "v", k=3, block_rows=16, carry=("label",))
    got = {}
    for row in nn.collect():
        got.setdefault(row["id"], []).append(row["ref_id"])
    for i in range(15):
        d = np.sqrt(((X[15:] - X[i]) ** 2).sum(1))
        exp = list(np.argsort(d, kind="stable")[:3] + 15)
        assert sorted(got[i]) == sorted(exp)
    votes = neighbors.weighted_vote(nn, "id", "label").count()
    assert votes == 15


def test_vote_tie_goes_to_smallest_label(spark):
    nn = spark.createDataFrame([(1, 5, 1.0), (1, 2, 1.0)], "q long, label int, dist double")
    assert neighbors.weighted_vote(nn, "q", "label").first()["pred"] == 2


def test_dense_and_rbf_layers_match_numpy(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(20, 6))
    df = spark.createDataFrame([(i, list(map(float, X[i]))) for i in range(20)],
                               "id long, v array<double>")
    W, b = rng.normal(size=(6, 4)), rng.normal(size=4)
    h = {r["id"]: r["hidden"] for r in hidden.dense_layer(df, "v", W, b).collect()}
    assert h[3] == pytest.approx(np.tanh(X[3] @ W + b))
    C = rng.normal(size=(3, 6))
    rad = hidden.rbf_radius(C)
    rb = {r["id"]: r["rbf"] for r in hidden.rbf_layer(df, "v", C).collect()}
    d = np.sqrt(((X[4] - C) ** 2).sum(1)) / rad
    assert rb[4] == pytest.approx(np.exp(-d ** 2))


def test_sparse_filter_matches_numpy(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(30, 5))
    W = rng.normal(size=(3, 5))
    df = spark.createDataFrame([(i, list(map(float, X[i]))) for i in range(30)],
                               "id long, v array<double>")
    got = {r["id"]: r["sf"] for r in hidden.sparse_filter_activation(df, "v", W).collect()}
    Xt = X.T - X.T.mean(0)
    Fm = W @ Xt
    Fs = np.sqrt(Fm ** 2 + 1e-8)
    NFs = Fs / np.linalg.norm(Fs, axis=1)[:, None]
    Fhat = NFs.T / np.linalg.norm(NFs.T, axis=1)[:, None]
    for i in (0, 7, 29):
        assert got[i] == pytest.approx(Fhat[i])


def test_flatten_roundtrip(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0, 2.0, 0.5]), (2, [0.0, 0.0, 1.0, 1.0])],
                               "k long, px array<double>")
    back = {r["k"]: r["pixels"] for r in images.unflatten(images.flatten_long(df, "k", "px"),
                                                          "k").collect()}
    assert back == {1: [3.0, 1.0, 2.0, 0.5], 2: [0.0, 0.0, 1.0, 1.0]}


def test_callable_activation_with_arguments(spark):
    from tessera.functions import scalar as S
    df = spark.createDataFrame([(2.0,)], "x double")
    leaky = lambda c, slope: F.when(c > 0, c).otherwise(c * slope)
    assert df.select(S.activation(leaky, "x", slope=0.1)).first()[0] == 2.0
    W, b = np.eye(1), np.zeros(1)
    v = spark.createDataFrame([(1, [-1.0])], "id long, v array<double>")
    out = hidden.dense_layer(v, "v", W, b, act=leaky, slope=0.5).first()["hidden"]
    assert out == [-0.5]


def test_knn_string_keys(spark):
    rows = [(f"q{i}", [float(i), 0.0]) for i in range(3)]
    refs = [(f"r{i}", int(i % 2), [float(i) + 0.1, 0.0]) for i in range(5)]
    q = spark.createDataFrame(rows, "id string, v array<double>")
    r = spark.createDataFrame(refs, "rid string, label int, v array<double>")
    nn = neighbors.knn(q, r, "id", "rid", "v", k=1, carry=("label",))
    got = {x["id"]: x["ref_id"] for x in nn.collect()}
    assert got == {"q0": "r0", "q1": "r1", "q2": "r2"}

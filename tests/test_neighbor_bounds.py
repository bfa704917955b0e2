"""Bounds on an orthogonal basis: the same neighbours from fewer pairs."""

import numpy as np
import pytest
from tessera.operators import neighbors as nb


def clustered(n, d=64, groups=12, spread=0.3, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, d))[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * spread * 0.9 ** np.arange(d)


def basis(X, lead=16):
    values, vectors = np.linalg.eigh(np.cov(X.T))
    return nb.Bounds(vectors[:, ::-1], lead)


def test_lower_bounds_hold():
    for X in (clustered(300), np.random.default_rng(1).normal(size=(300, 64)) * 1e6, clustered(50) * 1e-8):
        b = basis(X)
        low = b.lower(b.turned(X[:40]), b.turned(X))
        assert (low <= nb._distances(X[:40], X) ** 2 + 1e-300).all()


@pytest.mark.parametrize("k", [1, 3, 10])
def test_same_neighbours_as_all_pairs(k):
    X = clustered(400)
    X[7] = X[3]                     # equal distances go by place
    X[9] = X[3]
    a, da, _ = nb.k_nearest(X[:60], X, k)
    b, db, n = nb.k_nearest(X[:60], X, k, basis(X))
    assert (a == b).all() and np.allclose(da, db, rtol=1e-12, atol=0) and n < 60 * 400 / 2


def test_values_that_are_not_finite_are_measured():
    X = clustered(100)
    Q = X[:5].copy()
    Q[1, 3], Q[2, 0] = np.nan, np.inf
    a, b = nb.k_nearest(Q, X, 3), nb.k_nearest(Q, X, 3, basis(X))
    assert (a[0] == b[0]).all() and (np.isinf(b[1][1])).all()
    R = X.copy()
    R[4, 4] = np.nan
    assert (nb.k_nearest(X[:5], R, 3)[0] == nb.k_nearest(X[:5], R, 3, basis(X))[0]).all()


@pytest.mark.parametrize("block", [4096, 150])
def test_knn_on_64_dimensions_measures_few_pairs(spark, block):
    X = clustered(600, seed=4)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    count = spark.sparkContext.accumulator(0)
    got = nb.knn(df, df, "id", "id", "v", k=3, block_rows=block, exclude_self=True, measured=count).collect()
    d = nb._distances(X, X)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert {(r["id"], r["rank"]): r["ref_id"] for r in got} == {(i, j + 1): int(want[i, j]) for i in range(600) for j in range(3)}
    assert 0 < count.value < 600 * 600 / 2
    plain = nb.knn(df, df, "id", "id", "v", k=3, block_rows=block, exclude_self=True, bound=False).collect()
    assert sorted((r["id"], r["rank"], r["ref_id"], round(r["dist"], 9)) for r in got) == sorted(
        (r["id"], r["rank"], r["ref_id"], round(r["dist"], 9)) for r in plain)


def test_embeddings_equal_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    rows = df.orderBy("vec_id").collect()
    ids, X = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float)
    d = nb._distances(X, X)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    got = nb.knn(df, df, "vec_id", "vec_id", "embedding", k=3, exclude_self=True).collect()
    assert {(r["vec_id"], r["rank"]): r["ref_id"] for r in got} == {
        (ids[i], j + 1): ids[want[i, j]] for i in range(len(ids)) for j in range(3)}


def test_no_basis_for_few_or_uneven_dimensions(spark):
    assert nb.basis_of(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), "v") is None
    assert nb.basis_of(spark.createDataFrame([([1.0] * 20,), ([1.0] * 30,)], "v array<double>"), "v") is None
    assert nb.basis_of(spark.createDataFrame([], "v array<double>"), "v") is None


def test_vectors_without_structure_are_not_all_measured(spark):
    """No coordinates hold most of a distance and no cell is far from another."""
    X = np.random.default_rng(5).normal(size=(1500, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    count = spark.sparkContext.accumulator(0)
    got = nb.knn(df.where("id < 300"), df.where("id >= 300"), "id", "id", "v", k=3, block_rows=150, measured=count).collect()
    want = np.argsort(nb._distances(X[:300], X[300:]), axis=1, kind="stable")[:, :3] + 300
    assert {(r["id"], r["rank"]): r["ref_id"] for r in got} == {(i, j + 1): int(want[i, j]) for i in range(300) for j in range(3)}
    assert count.value < 300 * 1200 / 4


def test_pairs_of_odd_rows_equal_all_pairs(monkeypatch):
    """Copies, huge values and values that are not finite, over several blocks."""
    X = np.random.default_rng(6).normal(size=(900, 20))
    X[100:160] = X[3]
    X[5, 2], X[6, 1], X[7, 0], X[700, 3], X[8] = np.nan, np.inf, -np.inf, np.nan, 1e155
    X[710], X[711] = 1e200, 1.1e155
    monkeypatch.setattr(nb, "Q_ROWS", 64)
    monkeypatch.setattr(nb, "R_ROWS", 50)
    with np.errstate(over="ignore", invalid="ignore"):
        for R in (X, X[:20], X[700:704]):
            for k in (1, 3, 8):
                a, b = nb.k_nearest(X, R, k), nb.k_nearest(X, R, k, nb.Bounds())
                assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
                most = a[1][:, -1]
                i, j, d, _ = nb.near_pairs(X, R, k, nb.Bounds(), most)
                got = {(x, y): z for x, y, z in zip(i, j, d)}
                assert all(got[x, y] == z for x in range(len(X)) for y, z in zip(a[0][x], a[1][x]))

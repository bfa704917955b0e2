"""Level-wise trees against plain recursive versions."""

import numpy as np
import pytest
from tessera.operators import trees as tr

SCHEMA = "id long, label string, x array<double>, fold int, prediction string"


def table(spark, n=240, dims=6, seed=1, classes="abc"):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = i % len(classes)
        x = rng.normal(size=dims) + np.eye(dims)[c] * 2
        rows.append((i, classes[c], [float(round(v, 3)) for v in x], i // 3 % 3, "old"))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def brute_tree(x, y, classes, tree, depth, k, seed, node=1, level=0):
    """{node: (feature, threshold, counts)} by recursion."""
    counts = np.array([(y == c).sum() for c in classes])
    out = {node: (None, None, counts.tolist())}
    if level == depth or counts.sum() < 2 or np.count_nonzero(counts) < 2:
        return out
    best = None
    for f in sorted(sorted(range(x.shape[1]), key=lambda f: (tr.draw(seed, "feature", tree, node, f), f))[:k]):
        lo, hi = np.nanmin(x[:, f]), np.nanmax(x[:, f])
        cut = lo + tr.draw(seed, "cut", tree, node, f) * (hi - lo)
        high = x[:, f] > cut
        if high.all() or not high.any():
            continue
        score = sum(sum(float((y[s] == c).sum()) ** 2 for c in classes) / s.sum() for s in (~high, high))
        if best is None or score > best[0]:
            best = (score, f, cut, high)
    if best is None:
        return out
    _, f, cut, high = best
    out[node] = (f, cut, counts.tolist())
    for child, s in ((2 * node, ~high), (2 * node + 1, high)):
        out.update(brute_tree(x[s], y[s], classes, tree, depth, k, seed, child, level + 1))
    return out


def by_node(forest):
    return {(m, t, n): (f, cut, s) for m, t, n, f, cut, s in forest.nodes()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, (f, cut, s) in want.items():
        assert got[k][0] == f and got[k][2] == s
        assert (got[k][1] is None) == (cut is None) and (cut is None or got[k][1] == pytest.approx(cut, abs=1e-12))


def test_extra_trees_equal_recursion(spark):
    rows, df = table(spark)
    forest = tr.extra_trees(df, "x", "label", trees=4, depth=4, seed=5)
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    want = {(None, t, n): v for t in range(4) for n, v in brute_tree(x, y, "abc", t, 4, 2, 5).items()}
    same(by_node(forest), want)


def test_levels_in_parts_and_folds_equal_single_models(spark, monkeypatch):
    rows, df = table(spark)
    whole = tr.extra_trees(df, "x", "label", trees=2, depth=3, seed=5, fold="fold")
    monkeypatch.setattr(tr, "MAX_CELLS", 40)     # a few nodes at a time
    same(by_node(tr.extra_trees(df, "x", "label", trees=2, depth=3, seed=5, fold="fold")), by_node(whole))
    for m in range(3):
        x = np.array([r[2] for r in rows if r[3] != m])
        y = np.array([r[1] for r in rows if r[3] != m])
        for t in range(2):
            same({k[2]: v for k, v in by_node(whole).items() if k[:2] == (m, t)}, brute_tree(x, y, "abc", t, 3, 2, 5))


def test_predictions_are_mean_leaf_shares(spark):
    rows, df = table(spark)
    forest = tr.extra_trees(df, "x", "label", trees=5, depth=3, seed=2)
    got = {r["id"]: r for r in tr.predict(df, forest, "x").collect()}
    assert set(got[0].asDict()) == {"id", "label", "x", "fold", "prediction", "probability"}
    hits = 0
    for i, label, x, *_ in rows:
        p = np.zeros(3)
        for t in range(5):
            s = forest.stats[t, forest.route(t, np.array([x]))[0]]
            p += s / s.sum() / 5
        assert got[i]["probability"] == pytest.approx(p.tolist())
        assert got[i]["prediction"] == "abc"[np.round(p, 9).argmax()]
        hits += got[i]["prediction"] == label
    assert hits / len(rows) > 0.7


def test_out_of_fold_rows_meet_unseen_models(spark):
    rows, df = table(spark)
    forest = tr.extra_trees(df, "x", "label", trees=10, depth=5, seed=2, fold="fold")
    got = tr.predict(df, forest, "x", "fold").collect()
    acc = np.mean([r["prediction"] == r["label"] for r in got])
    assert len(got) == len(rows) and 0.6 < acc < 1
    other = spark.createDataFrame([(1, "a", rows[0][2], 9, ""), (2, "a", rows[0][2], None, "")], SCHEMA)
    assert [(r["prediction"], r["probability"]) for r in tr.predict(other, forest, "x", "fold").collect()] == [(None, None)] * 2


def test_nulls_nan_repeats_and_empty_tables(spark):
    rows, _ = table(spark, n=60, dims=3)
    odd = [(900, None, rows[0][2], 0, ""), (901, "a", None, 0, ""), (902, "b", [float("nan"), 1.0, 0.5], 0, ""),
           (903, "b", [None, 1.0, 0.5], 0, ""), rows[0], rows[0]]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    fit = [r for r in rows + odd if r[1] and r[2]]
    x = np.array([[np.nan if v is None else v for v in r[2]] for r in fit])
    y = np.array([r[1] for r in fit])
    forest = tr.extra_trees(df, "x", "label", trees=3, depth=3, candidates=3, seed=1)
    same(by_node(forest), {(None, t, n): v for t in range(3) for n, v in brute_tree(x, y, "abc", t, 3, 3, 1).items()})
    got = {r["id"]: r for r in tr.predict(df, forest, "x").collect()}
    assert got[901]["prediction"] is None and got[901]["probability"] is None
    assert got[902]["probability"] == got[903]["probability"] and got[900]["prediction"] in "abc"
    empty = df.filter("false")
    assert tr.predict(empty, forest, "x").collect() == []
    for f in (tr.extra_trees, tr.boost):
        with pytest.raises(ValueError):
            f(empty, "x", "label")
    with pytest.raises(ValueError, match="one length"):
        tr.extra_trees(spark.createDataFrame([(1, "a", [1.0], 0, ""), (2, "b", [1.0, 2.0], 0, "")], SCHEMA), "x", "label")


def test_constant_columns_and_one_class_stay_leaves(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], [1.0, 2.0], 0, "") for i in range(10)], SCHEMA)
    assert [n[2:4] + (n[5],) for n in tr.extra_trees(df, "x", "label", 1, 3, 2).nodes()] == [(1, None, [5.0, 5.0])]
    one = spark.createDataFrame([(i, "a", [float(i)], 0, "") for i in range(10)], SCHEMA)
    forest = tr.extra_trees(one, "x", "label", 1, 3, 1)
    assert forest.nodes()[0][5] == [10.0] and len(forest.nodes()) == 1


def numpy_boost(x, y, k, rounds, depth, rate, cuts):
    """The same boosting by recursion over arrays."""
    prior = np.bincount(y, minlength=k) / len(y)
    m = np.tile(np.log(prior), (len(y), 1))
    losses = [-np.log(tr.softmax(m)[np.arange(len(y)), y]).mean()]

    def leafs(at, r, level):
        best = None
        if level < depth and len(at) >= 2:
            for f in range(x.shape[1]):
                lo, hi = x[at, f].min(), x[at, f].max()
                for j in range(1, cuts + 1):
                    cut = lo + (hi - lo) * (j / (cuts + 1))
                    high = x[at, f] > cut
                    if high.any() and not high.all():
                        score = r[at][~high].sum() ** 2 / (~high).sum() + r[at][high].sum() ** 2 / high.sum()
                        if best is None or score > best[0] + 1e-12:
                            best = (score, high)
        if best is None:
            yield at
        else:
            yield from leafs(at[~best[1]], r, level + 1)
            yield from leafs(at[best[1]], r, level + 1)

    for _ in range(rounds):
        p, step = tr.softmax(m), np.zeros_like(m)
        for c in range(k):
            r = (y == c) - p[:, c]
            for at in leafs(np.arange(len(y)), r, 0):
                step[at, c] = rate * (k - 1) / k * r[at].sum() / (np.abs(r[at]) * (1 - np.abs(r[at]))).sum()
        m += step
        losses.append(-np.log(tr.softmax(m)[np.arange(len(y)), y]).mean())
    return m, losses


def test_boosting_equals_numpy_and_its_loss_falls(spark):
    rows, df = table(spark, n=150, dims=4, seed=9)
    model = tr.boost(df, "x", "label", rounds=4, depth=2, rate=0.3, cuts=5)
    x, y = np.array([r[2] for r in rows]), np.array(["abc".index(r[1]) for r in rows])
    margins, losses = numpy_boost(x, y, 3, 4, 2, 0.3, 5)
    assert model.losses == pytest.approx(losses, abs=1e-9)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))
    got = {r["id"]: r["probability"] for r in tr.boosted_predict(df, model, "x").collect()}
    assert np.allclose([got[i] for i in range(150)], tr.softmax(margins), atol=1e-9)

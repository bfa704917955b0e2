import math
import random

import numpy as np
from tessera.llm import embed_dedup


def vectors():
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for g in range(40):
        base = rng.standard_normal(24)
        for _ in range(rng.integers(1, 9)):
            v = base + rng.standard_normal(24) * rng.choice([0.0, 0.02, 0.2, 0.26, 0.3])
            rows.append((n, v.astype(np.float32).tolist(), int(g % 3)))
            n += 1
    base = rng.standard_normal(24)
    rows += [(n + i, (base + rng.standard_normal(24) * 0.05).tolist(), 1) for i in range(80)]
    n += 80
    bad = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]
    rows += [(n + i, v, 1) for i, v in enumerate(bad * 2)]
    n += 12
    rows += [(n, base.tolist(), None), (n + 1, base.tolist(), None), (n + 2, [1.0, 2.0], 1), (n + 3, [2.0, 4.0], 1),
             (n + 4, [1e-30, 2e-30], 1), (None, base.tolist(), 1), (None, [0.0] * 24, 1), (n + 5, [5.0], 1),
             (n + 6, [7.0], 1), (n + 7, [-7.0], 1)]
    random.Random(2).shuffle(rows)
    return [(*r, -1) for r in rows]


def brute(rows, cosine=0.93):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.asarray(np.asarray(v, np.float32), np.float64)
        a = a / np.abs(a).max()
        return a / np.linalg.norm(a)

    u = [unit(r[1]) if r[2] is not None else None for r in rows]
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if u[i] is not None and u[j] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) \
                    and float(u[i] @ u[j]) >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], k, least.get(find(i)), r[0] == least.get(find(i)))
                   for i, (r, k) in enumerate(zip(rows, links))), key=str)


def test_links_and_components_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links int")
    got = embed_dedup.near_duplicates(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_hot_groups_are_cut(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "MOST", 20)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links int")
    assert sorted((tuple(r) for r in embed_dedup.near_duplicates(df).collect()), key=str) == brute(rows)


def test_list_decoding_finds_all_filters_above_the_height():
    rng = np.random.default_rng(3)
    x = embed_dedup.unit_vectors(rng.standard_normal((200, 16)))
    rotation, c1, c2, alpha = embed_dedup.product_code(16, 5000)
    full = ((x @ rotation)[:, :8] @ c1.T)[:, :, None] + ((x @ rotation)[:, 8:] @ c2.T)[:, None, :]
    sizes = []
    for found, s in zip(embed_dedup.list_decode(x, 5000), full.reshape(200, -1)):
        over = np.flatnonzero(s >= alpha)
        sizes.append(len(over))
        if len(over) >= embed_dedup.LEAST_FILTERS:
            assert found.tolist() == over.tolist()
        else:
            best = np.argsort(-s)[:embed_dedup.LEAST_FILTERS]
            assert sorted(best.tolist()) == found.tolist()
    assert 20 < np.mean(sizes) < 48


def test_recall_at_the_threshold(spark):
    """Pairs of cosine 0.93 to 0.95, the hardest to find."""
    rng = np.random.default_rng(4)
    a = embed_dedup.unit_vectors(rng.standard_normal((1500, 64)))
    b = embed_dedup.unit_vectors(a + 0.345 * embed_dedup.unit_vectors(rng.standard_normal((1500, 64))))
    cos = (a * b).sum(1)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([a, b]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(df).collect()}
    hard = np.flatnonzero((cos >= 0.93) & (cos < 0.95))
    assert len(hard) > 300 and np.mean([got[int(i)] == 1 for i in hard]) >= 0.998


def test_misses_stay_level_as_the_table_grows():
    """Pairs of cosine 0.93 that share no filter, among ten million vectors."""
    rng = np.random.default_rng(5)
    x = embed_dedup.unit_vectors(rng.standard_normal((4000, 64)))
    u = rng.standard_normal((4000, 64))
    u = embed_dedup.unit_vectors(u - (u * x).sum(1, keepdims=True) * x)
    y = 0.93 * x + math.sqrt(1 - 0.93 ** 2) * u
    found = [embed_dedup.list_decode(v, 10_000_000) for v in (x, y)]
    missed = sum(not len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*found))
    assert missed <= 12


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.near_duplicates(df).count() == 0

import random
import re

import numpy as np
import xxhash
from tessera.llm import simhash
from tessera.llm.graph import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, prints):
    root = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    least = {}
    for i, r in zip(ids, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in root]


def test_golay_keys_share_within_two_bits():
    table = simhash.golay_keys()
    sets = [set(r[r >= 0].tolist()) for r in table]
    assert {len(s) for s in sets} <= {1, 6}
    rng = random.Random(1)
    flips = [1 << a for a in range(16)] + [1 << a | 1 << b for a in range(16) for b in range(a)]
    for w in rng.sample(range(1 << 16), 600):
        for f in flips:
            assert sets[w] & sets[w ^ f]


def test_keys_find_every_pair_within_three_bits():
    table, rng = simhash.golay_keys(), random.Random(2)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        row, key = simhash.candidate_keys(np.array([a, b], np.uint64), table)
        assert set(key[row == 0]) & set(key[row == 1])


def test_spanning_links_connect_what_is_linked():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(5)]
    fp = np.array([b ^ (1 << rng.randrange(64)) for b in base for _ in range(30)], np.uint64)
    unit = np.zeros(len(fp), np.int64)
    a, b = simhash.spanning_links(unit, fp, 3)
    assert all((int(x) ^ int(y)).bit_count() <= 64 for x, y in zip(a, b))
    distinct = np.unique(fp)
    assert len(a) <= len(distinct)
    roots = {int(x): int(x) for x in distinct}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for x, y in zip(a, b):
        roots[find(int(y))] = find(int(x))
    for x in distinct:
        for y in distinct:
            if (int(x) ^ int(y)).bit_count() <= 3:
                assert find(int(x)) == find(int(y))


def make_docs():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        text = [rng.choice(words) for _ in range(200)]
        for c in range(6):
            t = list(text)
            if c:
                t[rng.randrange(len(t))] = "changed"
            rows.append((len(rows), " ".join(t)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "one"), (104, "ONE"), (None, "one"), (None, "alone here"),
             (105, "x " * 30000), (7, rows[7][1]), (7, rows[7][1])]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = make_docs()
    df = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    prints = [brute_print(t) for _, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(
        rows, prints, brute_components([i for i, _ in rows], prints))), key=str)
    assert sorted([tuple(r) for r in got], key=str) == want


def test_hot_group_is_cut_and_still_joined(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 7)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base ^ (1 << rng.randrange(64)) for _ in range(60)})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    comp = components(simhash.links(df)).collect()
    assert len({r["root"] for r in comp}) == 1 and {r["node"] for r in comp} == {
        int(np.uint64(f).view(np.int64)) for f in fps}


def test_keep_one_keeps_one_row_of_each_group(spark):
    rows = make_docs()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _hash string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] for r in kept.collect()), key=str)
    prints = [brute_print(t) for _, t in rows]
    comps = brute_components([i for i, _ in rows], prints)
    want = sorted([*{c for c in comps if c is not None}, *(None for c in comps if c is None)], key=str)
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def test_components_of_a_long_chain(spark):
    rng = random.Random(6)
    names = rng.sample(range(-1000, 1000), 400)
    edges = [(a, b) for a, b in zip(names[:199], names[1:200])] + [(a, b) for a, b in zip(names[200:], names[201:])]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(names)
    assert {got[n] for n in names[:200]} == {min(names[:200])}
    assert {got[n] for n in names[200:]} == {min(names[200:])}

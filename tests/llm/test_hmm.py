import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import hmm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def toks(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


def random_states(rng, k, m):
    p = lambda *s: rng.random(s) + 0.05
    start, move, emit = p(k), p(k, k), p(m, k)
    return hmm.States(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def paths(seq, m):
    k = len(m.start)
    for path in itertools.product(range(k), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, o in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[o, b]
        yield path, p


def test_forward_and_counts_equal_sums_over_paths(monkeypatch):
    monkeypatch.setattr(hmm, "SYMBOLS", 5)
    rng = np.random.default_rng(1)
    m = random_states(rng, 3, 5)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 2, 5, 5)]
    got = hmm.log_likelihood(seqs, m)
    pi, xi, em = hmm.expected_counts(seqs, m)
    wpi, wxi, wem = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s, ll in zip(seqs, got):
        total = sum(p for _, p in paths(s, m))
        assert math.isclose(ll, math.log(total), rel_tol=1e-12)
        for path, p in paths(s, m):
            wpi[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                wxi[a, b] += p / total
            for o, a in zip(s, path):
                wem[o, a] += p / total
    assert np.allclose(pi, wpi) and np.allclose(xi, wxi) and np.allclose(em, wem)


def corpus():
    """Two made-up languages; each text keeps to one."""
    rng = random.Random(2)
    langs = [[f"{c}{i}" for i in range(80)] for c in "ab"]
    rows = [(i, " ".join(rng.choice(langs[i % 2]) for _ in range(rng.randrange(20, 400)))) for i in range(240)]
    return rows + [(500, None), (501, ""), (502, "UPPER Case upper"), (None, "a1 a2"), (7, rows[7][1]),
                   (503, "never-seen-" + "x" * 5000), (504, "a1 " * 20000), (505, "a1\x0b\x0ca2\xa0a3")]


@pytest.fixture
def small_vocabulary(monkeypatch):
    """Fewer known words than the corpus has, so that every route is taken."""
    monkeypatch.setattr(hmm, "KNOWN", 60)
    monkeypatch.setattr(hmm, "FREQUENT", 30)
    monkeypatch.setattr(hmm, "CLASSES", 8)
    monkeypatch.setattr(hmm, "END", 38)
    monkeypatch.setattr(hmm, "SYMBOLS", 39)


def base_scores(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(t for i, x in rows if not held(i) for t in toks(x))
    n, v = sum(c.values()), len(c)
    for i, x in rows:
        t = toks(x)
        yield (i, held(i), len(t), sum(c[w] > 0 for w in t), n,
               round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6))


def test_base_columns_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    got = hmm.fit_and_score(df, rounds=(16, 16)).collect()
    assert sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got), key=str) == sorted(
        base_scores(rows), key=str)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the states learn the languages


def test_probabilities_of_all_words_sum_to_one(spark):
    """Every single word of the vocabulary, and one unseen word for each class."""
    rows = corpus()
    counts = hmm.count_words(spark.createDataFrame([(x or "",) for _, x in rows], "text string"))
    v = hmm.vocabulary(counts)
    symbols = v.symbol_counts()
    m = hmm.set_up(symbols)
    first = m.emit @ m.start
    total = first[hmm.END]
    e = hmm.Encoder(v.words, v.counts, v.n_end)
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    size = v.class_tokens + v.class_types + 1
    for w in c:
        if not w:
            continue
        s = int(e.encode(w)[0][0])
        total += first[s] * ((c[w] + 1) / size[s - hmm.FREQUENT] if s >= hmm.FREQUENT else 1.0)
    # the unit that each class keeps for unseen words, and the symbols without a word
    total += sum(first[hmm.FREQUENT + k] / size[k] for k in range(hmm.CLASSES))
    total += first[len(v.words):hmm.FREQUENT].sum()
    assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_score_is_the_model_probability(small_vocabulary):
    rng = np.random.default_rng(5)
    m = random_states(rng, 3, hmm.SYMBOLS)
    words = [f"w{i}".encode() for i in range(60)]
    e = hmm.Encoder(words, np.arange(60, 0, -1.0), 9)
    sym, base, classed, known, away = e.encode(b"W1 w40 w41 zzz")
    assert list(sym[:1]) == [1] and sym[-1] == hmm.END and away == Counter([b"zzz"]) and known == 4
    assert math.isclose(base, math.log10(60) + math.log10(21) + math.log10(20) + math.log10(10))
    assert math.isclose(classed, math.log10(21) + math.log10(20))
    total = sum(p for _, p in paths(sym, m))
    assert math.isclose(hmm.log_likelihood([sym], m)[0], math.log(total), rel_tol=1e-12)


def test_baum_welch_does_not_lower_the_likelihood(spark):
    rows = corpus()[:120]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(
        F.col("doc_id"), F.lit(False).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    v = hmm.vocabulary(hmm.count_words(df.select("text")))
    sent = spark.sparkContext.broadcast((v.words, v.counts, v.n_end))
    enc = hmm.encode(df, sent).withColumn("part", F.lit(0)).cache()
    seqs = [np.frombuffer(r["symbols"], np.uint16) for r in enc.collect()]
    ll = [hmm.log_likelihood(seqs, hmm.train(enc, v.symbol_counts(), 2, (16,) * n)).sum() for n in (0, 1, 2, 4)]
    assert ll[0] < ll[1] < ll[2] < ll[3]


def test_no_training_texts_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = hmm.fit_and_score(df, held=F.lit(True)).collect()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 3, 0, 0, 0.0)
    assert r["score"] < 0
    assert hmm.fit_and_score(df.filter("false")).count() == 0


def test_a_round_without_counts_keeps_the_states(spark):
    """States that became alike could never part again."""
    counts = np.zeros(hmm.SYMBOLS)
    counts[:5] = 7
    start = hmm.set_up(counts, 3)
    none = spark.createDataFrame([], "part int, symbols binary")
    kept = hmm.train(none, counts, 3, (16, 16))
    assert np.array_equal(kept.emit, start.emit) and np.array_equal(kept.move, start.move)
    assert not np.allclose(kept.emit[:, 0], kept.emit[:, 1])


def test_every_round_takes_all_texts():
    assert set(hmm.ROUNDS) == {16} and len(hmm.ROUNDS) == 7

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import toxicity as tx
from tessera.session import table

DOCS = "doc_id long, text string, toxic int, held_out int"


def grams(text):
    """Distinct n-grams in plain Python."""
    t = f" {' '.join(text.lower().split())} "
    return {t[i:i + n] for n in tx.SIZES for i in range(len(t) - n + 1)}


def sample(n, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "river", "stone", "window", "Garden", "über", "paper", "light", "cold", "music"]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = rng.choices(words, k=rng.randint(3, 30))
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["nastyfool", "NASTYfools", "grumblepest"]))
        docs.append((i, " ".join(text), None, 9))
        labels.append((i, int(bad)))
    return docs, labels


def test_buckets_are_one_per_distinct_ngram():
    for text in ("", "a", "Hello  World\n", "straße ß 日本語🙂", "aaaaaaaa"):
        got = tx.buckets(text)
        assert len(got) == sum(max(len(f" {' '.join(text.lower().split())} ") - n + 1, 0) for n in tx.SIZES)
        assert len(set(got.tolist())) == len(grams(text))    # no collision among so few


def test_long_text_holds_what_its_parts_hold():
    text = "one two three " * 20000 + "nastyfool"
    (_, doc, feature), = tx.presence([text])
    assert set(doc.tolist()) == {0} and len(feature) == len(grams(text))


def test_counts_and_ratios_equal_brute_force(spark):
    docs, labels = sample(60)
    rows = spark.createDataFrame([(t, dict(labels)[i]) for i, t, *_ in docs], "text string, toxic int").repartition(5)
    got = {r["bucket"]: r for r in tx.ratios(tx.class_counts(rows), 15, 45).collect()}
    want = {}
    for i, t, *_ in docs:
        for b in set(tx.buckets(t).tolist()):
            c = want.setdefault(b, [0, 0])
            c[1 - dict(labels)[i]] += 1
    assert {b: [r["toxic"], r["other"]] for b, r in got.items()} == want
    for b, (p, q) in want.items():
        assert got[b]["ratio"] == pytest.approx(math.log((p + 1) / 17) - math.log((q + 1) / 47))


def test_scores_equal_the_formula_and_held_out_is_right(spark):
    docs, labels = sample(400)
    docs += [(5000, None, 1, 1), (5001, "", 1, 1), (None, "nastyfool", 1, 1), docs[3]]
    d = spark.createDataFrame(docs, DOCS)
    lab = spark.createDataFrame(labels + [(7, None), (None, 1)], "doc_id long, toxic int")
    got = tx.classify(d, lab).collect()
    assert len(got) == len(docs)
    model = tx.train(tx.labelled(d, lab, ~tx.held_out()))
    weight = dict(zip(model.inputs, model.weights))
    text = {i: t for i, t, *_ in docs}
    right = []
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1)
        z = model.intercept + sum(weight.get(b, 0) for b in set(tx.buckets(text[r["doc_id"]] or "").tolist()))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
        assert r["predicted"] == (r["score"] >= 0.7)
        if r["held_out"] and r["doc_id"] in dict(labels):
            right.append(r["predicted"] == dict(labels)[r["doc_id"]])
    assert np.mean(right) > 0.99 and len(right) > 80
    empty = {r["score"] for r in got if not text[r["doc_id"]]}
    assert len(empty) == 1


def test_labels_of_held_out_documents_do_not_matter(spark):
    docs, labels = sample(200)
    d = spark.createDataFrame(docs, DOCS)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in
                   tx.classify(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(2, 0), (3, 0), (9, None)], None)])
def test_no_classifier_without_both_classes(spark, labels, score):
    d = spark.createDataFrame([(i, "some text", 1, 1) for i in range(5)], DOCS)
    got = tx.classify(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    n = sum(1 for i, y in labels if y is not None and zlib.crc32(str(i).encode()) % 3 != 1)
    assert {r["predicted"] for r in got} == {0}
    assert [r["score"] for r in got] == [pytest.approx(score or 1 / (n + 2))] * 5


def test_empty_table(spark):
    d = spark.createDataFrame([], DOCS)
    assert tx.classify(d, spark.createDataFrame([], "doc_id long, toxic int")).collect() == []


def test_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = tx.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).join(
        table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").filter("held_out")
    r = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"),
                F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false")).first()
    assert r["recall"] > 0.7 and r["false"] < 0.005

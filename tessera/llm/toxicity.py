"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes
log-count ratios.

1. **Features** are the character n-grams (``SIZES``) of the lower-cased text,
   present or absent, hashed to ``BUCKETS``.  White space is one space, and a
   space is put at both ends, so an n-gram can hold the start or end of a word.
2. **Ratios.**  Spark counts, over all labelled training texts of all
   partitions, in how many toxic and other texts each bucket is present.  A
   bucket's ratio is r = ln((p + 1) / (P + 2)) - ln((q + 1) / (Q + 2)), with p
   of P toxic and q of Q other texts.
3. **Classifier.**  The ``FEATURES`` buckets with the largest signed root of
   the log-likelihood ratio are the model's inputs, each scaled by its r.
   Logistic regression, fitted by Spark over all labelled training texts with
   both classes of equal weight in all, gives their weights.
4. **Scores.**  Every whole text gets 1 / (1 + exp(-(b + sum of w r))) over the
   inputs that it holds.

The model is ``FEATURES`` numbers, whatever the corpus.  A text's label is the
largest of the labels given for its id; labels that are null, and ids that are
null, label nothing.

Defined results: a null text is empty; an empty text holds no n-gram and gets
the score of the intercept.  Repeated rows are counted and scored each.  With
no labelled training text, or labels of one class only, there is no classifier,
and every text gets the share of toxic labels with one of each class added
(0.5 without labels).  An empty table gives an empty result.  Only the named
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import beside, map_arrow, prepare, stored, whole_text

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 20
FEATURES = 8192
#: Strength of the L2 penalty, and the score from which a text counts as toxic.
PENALTY, TOXIC_FROM = 1e-3, 0.7
#: Characters whose n-grams are held at a time (a longer text is held whole).
CHUNK = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def buckets(text: str) -> np.ndarray:
    """Bucket of every n-gram of a text, one after another, with repeats."""
    c = _points(text)
    if len(c) < 3:
        return np.empty(0, np.int64)
    shift, out, h = np.uint64(64 - BUCKETS.bit_length() + 1), [], c.copy()
    for n in range(2, max(SIZES) + 1):
        if len(c) < n:
            break
        h = h[:-1] * _MULT + c[n - 1:]
        if n in SIZES:
            mixed = (h ^ (h >> np.uint64(31))) * _MULT
            out.append(((mixed ^ (mixed >> np.uint64(29))) * _MULT >> shift).astype(np.int64))
    return np.concatenate(out)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``CHUNK`` characters."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def presence(texts: list[str], slot: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text numbers, buckets) without repeats within a text; with
    ``slot`` the buckets are mapped by it and those below 0 are left out."""
    for a, b in _chunks(texts):
        doc, feature = [], []
        for i in range(a, b):
            h = buckets(texts[i])
            if slot is not None:
                h = slot[h]
                h = h[h >= 0].astype(np.int64)
            doc.append(np.full(len(h), i - a, np.int64))
            feature.append(h)
        both = np.concatenate(doc) * BUCKETS + np.concatenate(feature)
        both.sort()
        if len(both):
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        yield a, both // BUCKETS, both % BUCKETS


def labelled(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text",
             label: str = "toxic") -> DataFrame:
    """(text, toxic 0/1) of the documents of the training part that have a label."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("known")).agg(
        F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    src = docs.filter(train & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), whole_text(text).alias("text"))
    return beside(src, stored(known, "labels"), F.col("id") == F.col("known"), "inner").select("text", "toxic")


def class_counts(rows: DataFrame) -> DataFrame:
    """(bucket, toxic, other): texts of each class that hold the bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            texts, y = b.column("text").to_pylist(), b.column("toxic").to_numpy()
            for first, doc, feature in presence(texts):
                of = y[first + doc]
                for k in (0, 1):
                    counts[k] += np.bincount(feature[of == k], minlength=BUCKETS)
        some = np.flatnonzero(counts.any(axis=0))
        for a in range(0, len(some), 1 << 16):
            at = some[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1, at]), pa.array(counts[0, at])],
                                             names=["bucket", "toxic", "other"])

    parts = rows.mapInArrow(run, "bucket long, toxic long, other long")
    return parts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def ratios(counts: DataFrame, n_toxic: int, n_other: int) -> DataFrame:
    """(bucket, toxic, other, ratio, strength): the log-count ratio and the
    log-likelihood ratio of presence against class."""
    n = n_toxic + n_other

    def term(k: Column, total: Column | int, size: int) -> Column:
        expected = total * F.lit(size / n)
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    p, q = F.col("toxic").cast("double"), F.col("other").cast("double")
    here, away = p + q, F.lit(float(n)) - p - q
    strength = (term(p, here, n_toxic) + term(q, here, n_other)
                + term(n_toxic - p, away, n_toxic) + term(n_other - q, away, n_other))
    return counts.withColumns({
        "ratio": F.log((p + 1) / (n_toxic + 2)) - F.log((q + 1) / (n_other + 2)),
        "strength": F.round(strength, 6)})


class Model:
    """Slots of the buckets that are inputs, their weights (classifier weight
    times ratio) and the intercept."""

    def __init__(self, inputs: list[int], weights: list[float], intercept: float):
        self.inputs, self.weights, self.intercept = inputs, np.asarray(weights, float), intercept

    def slots(self) -> np.ndarray:
        slot = np.full(BUCKETS, -1, np.int32)
        slot[self.inputs] = np.arange(len(self.inputs))
        return slot


def train(rows: DataFrame, features: int = FEATURES, penalty: float = PENALTY) -> Model:
    """The model of labelled texts (text, toxic)."""
    spark = prepare(rows.sparkSession)
    got = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = got.get(1, 0), got.get(0, 0)
    if not n_toxic or not n_other:
        return Model([], [], math.log((n_toxic + 1) / (n_other + 1)))
    best = (ratios(class_counts(rows), n_toxic, n_other)
            .orderBy(F.col("strength").desc(), "bucket").limit(features).select("bucket", "ratio").collect())
    inputs, r = [x["bucket"] for x in best], np.array([x["ratio"] for x in best])
    slot = spark.sparkContext.broadcast(Model(inputs, r, 0.0).slots())
    size = len(inputs)

    def sparse(b: pa.RecordBatch) -> list:
        texts = b.column("text").to_pylist()
        ends, held = np.zeros(len(texts) + 1, np.int64), []
        for first, doc, feature in presence(texts, slot.value):
            np.add.at(ends, first + doc + 1, 1)
            held.append(feature.astype(np.int32))
        return [pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)),
                                         pa.array(np.concatenate(held) if held else np.empty(0, np.int32)))]

    held = stored(map_arrow(rows, lambda: sparse, [("held", "array<int>")], ["toxic"]), "held_inputs")
    scale = [float(x) for x in r]
    vector = F.udf(lambda h: Vectors.sparse(size, h, [scale[i] for i in h]), VectorUDT())
    data = stored(held.select(F.col("toxic").cast("double").alias("label"), vector("held").alias("features"),
                              F.when(F.col("toxic") == 1, n_other / n_toxic).otherwise(1.0).alias("weight")), "vectors")
    fit = LogisticRegression(weightCol="weight", maxIter=60, regParam=penalty, standardization=False, tol=1e-7).fit(data)
    return Model(inputs, fit.coefficients.toArray() * r, float(fit.intercept))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and the score of every whole text."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.inputs, model.weights, model.intercept))
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]

    def make():
        m = Model(*shared.value)
        slot = m.slots()

        def run(b: pa.RecordBatch) -> list:
            texts = [x or "" for x in b.column(text).cast(pa.string()).to_pylist()]
            z = np.full(len(texts), m.intercept)
            if len(m.inputs):
                for first, doc, feature in presence(texts, slot):
                    np.add.at(z, first + doc, m.weights[feature])
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))]

        return run

    return map_arrow(docs, make, [(out, "double")], keep)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for ids whose crc32, taken of the decimal id, is 1 mod 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels are
    learnt from documents that are not held out."""
    model = train(stored(labelled(docs, labels, ~held_out()), "labelled"))
    src = docs.select("doc_id", held_out().alias("held_out"), whole_text("text").alias("text"))
    return score(src, model, keep=["doc_id", "held_out"]).withColumn(
        "predicted", (F.col("score") >= TOXIC_FROM).cast("int"))

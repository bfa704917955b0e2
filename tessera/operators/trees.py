"""Trees grown level by level: extra-trees (C2) and multi-class gradient
boosting on one softmax loss (C3).

All trees of all models (folds) grow together.  A level is two passes over the
rows: the bounds of each node's candidate features, and the statistics on both
sides of the thresholds drawn between them.  Tasks add up their own rows with
numpy and emit a row per (model, tree, node, candidate); Spark adds those up
and picks each node's best split, so only the splits reach the driver.  Rows
find their node by walking the trees so far, which travel with the task; no
row is ever moved.  A model holds ``trees * 2 ** depth`` splits, set by
parameters.  Levels whose sums pass ``MAX_CELLS`` are done a part at a time.

* **Extra-trees**: every node draws ``candidates`` features and one threshold
  each, uniform between the node's smallest and largest value; the split with
  the best Gini sum wins, the smaller feature on ties.  Draws come from MD5 of
  (seed, tree, node, feature), so a fit is repeatable on any cluster.
* **Boosting**: a round grows one tree a class on the residuals y - p of the
  shared softmax, with ``cuts`` even thresholds for every feature, least
  squares splits, and Newton leaf values (K-1)/K sum(r) / sum(|r|(1-|r|)).
  Each row carries its margins, rewritten once a round.

Defined results: rows with a null label or vector are not fitted on; a null
vector is predicted as null.  NaN and null components are at or below every
threshold and don't count in bounds.  A node is a leaf if it has fewer than
``min_rows`` rows, one class only, or no candidate that varies.  Without a
row to fit on, ``fit`` raises ValueError.  Repeated rows count as often as
they occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import scratch_path

#: Numbers that a task adds up at a time, and most classes of a label.
MAX_CELLS, MAX_CLASSES = 1 << 23, 10_000


def draw(*parts) -> float:
    """A number in [0, 1) from the MD5 of the parts."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2.0 ** 52


@dataclass
class Forest:
    """Trees of one depth for one or more models.  Node 1 is a root, node n
    has children 2n (value <= threshold) and 2n + 1; feature -1 is a leaf."""
    classes: list
    models: list
    trees: int
    depth: int
    width: int
    feature: np.ndarray = field(init=False)
    threshold: np.ndarray = field(init=False)
    stats: np.ndarray = field(init=False)

    def __post_init__(self):
        shape = (len(self.models) * self.trees, 2 << self.depth)
        self.feature, self.threshold = np.full(shape, -1), np.full(shape, np.nan)
        self.stats = np.zeros((*shape, self.width))

    def route(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            f = self.feature[tree, node]
            at = np.flatnonzero(f >= 0)
            if not len(at):
                break
            down = x[at, f[at]] > self.threshold[tree, node[at]]
            node[at] = 2 * node[at] + down
        return node

    def nodes(self) -> list[tuple]:
        """(model, tree, node, feature or None, threshold or None, statistics)."""
        out = []
        for t in range(len(self.feature)):
            todo = [1]
            while todo:
                n = todo.pop()
                f = int(self.feature[t, n])
                out.append((self.models[t // self.trees], t % self.trees, n, f if f >= 0 else None,
                            float(self.threshold[t, n]) if f >= 0 else None, self.stats[t, n].tolist()))
                if f >= 0:
                    todo += [2 * n, 2 * n + 1]
        return out


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _array(df: DataFrame, vec: str):
    c = F.col(f"`{vec}`")
    return vector_to_array(c) if isinstance(df.schema[vec].dataType, VectorUDT) else c.cast("array<double>")


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; null components are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if n and (sizes != sizes[0]).any() or width is not None and n and sizes[0] != width:
        raise ValueError("vectors must have one length")
    return flat.reshape(n, -1)


def _rows(df: DataFrame, vec: str, label: str, fold: str | None) -> tuple[DataFrame, list, list, int]:
    """(x, y, fold) of the rows to fit on, written once; classes, models, length."""
    src = df.filter(F.col(f"`{vec}`").isNotNull() & F.col(f"`{label}`").isNotNull()).select(
        _array(df, vec).alias("x"), F.col(f"`{label}`").alias("label"),
        (F.col(f"`{fold}`") if fold else F.lit(None).cast("int")).alias("fold"))
    src = _written(src, "tree_rows")
    classes = sorted(r[0] for r in src.select("label").distinct().limit(MAX_CLASSES + 1).collect())
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"a label with more than {MAX_CLASSES} values is no class")
    if not classes:
        raise ValueError("no row has both a label and a vector")
    models = sorted(r[0] for r in src.select("fold").distinct().collect() if r[0] is not None) if fold else [None]
    least, width = src.select(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != width:
        raise ValueError(f"vectors must have one length, not {least} to {width}")
    return src, classes, models, width


class _Level:
    """Active nodes of a level with their candidates, as sent to the tasks."""

    def __init__(self, forest: Forest, active: list[tuple[int, int]], candidates: np.ndarray, cuts: np.ndarray | None):
        self.forest, self.active, self.candidates, self.cuts = forest, active, candidates, cuts
        self.place = {t: np.full(2 << forest.depth, -1) for t, _ in active}
        for i, (t, n) in enumerate(active):
            self.place[t][n] = i

    def members(self, x: np.ndarray, fold: pa.Array | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(tree, rows, active node of each) of the rows that a tree learns from."""
        mine = {}
        for t, place in self.place.items():
            model = self.forest.models[t // self.forest.trees]
            if model not in mine:      # a model learns from the rows outside its fold
                mine[model] = np.arange(len(x)) if model is None else np.flatnonzero(
                    pc.fill_null(pc.not_equal(fold, model), True).to_numpy(zero_copy_only=False))
            rows = mine[model]
            node = place[self.forest.route(t, x[rows])]
            yield t, rows[node >= 0], node[node >= 0]


def _emit(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(at, slot, stats) rows of the node and candidate pairs that were seen."""
    for a in range(0, len(keys), 4096):
        k, v = keys[a:a + 4096], values[a:a + 4096]
        yield pa.RecordBatch.from_arrays(
            [pa.array(k[:, 0]), pa.array(k[:, 1]), pa.ListArray.from_arrays(
                pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))],
            names=["at", "slot", "stats"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(at, slot, stats) added up by key, from rows sorted by key.  Plain sums:
    class counts stay whole numbers."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        at, slot, stats = b.column("at").to_numpy(), b.column("slot").to_numpy(), _matrix(b.column("stats"))
        if rest is not None:
            at, slot, stats = (np.concatenate(x) for x in zip(rest, (at, slot, stats)))
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (slot[1:] != slot[:-1])]))
        at, slot, stats = at[first], slot[first], np.add.reduceat(stats, first, axis=0)
        if len(at) > 1:
            yield at[:-1], slot[:-1], stats[:-1]
        rest = at[-1:], slot[-1:], stats[-1:]          # its rows may go on in the next batch
    if rest is not None:
        yield rest


_PARTS = "at long, slot long, stats array<double>"


def _bounds(rows: DataFrame, level: _Level) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of every node's candidates."""
    shared = rows.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        lv = shared.value
        shape = lv.candidates.shape
        lo, hi = np.full(shape, np.inf), np.full(shape, -np.inf)
        for b in batches:
            x = _matrix(b.column("x"))
            for _, at, node in lv.members(x, b.column("fold")):
                for k in range(shape[1]):
                    v = x[at, lv.candidates[node, k]]
                    np.fmin.at(lo[:, k], node, v)
                    np.fmax.at(hi[:, k], node, v)
        seen = np.argwhere(lo <= hi)
        yield from _emit(seen, np.stack([lo[lo <= hi], hi[lo <= hi]], axis=1))

    got = rows.mapInArrow(run, _PARTS).groupBy("at", "slot").agg(
        F.min(F.get("stats", 0)).alias("lo"), F.max(F.get("stats", 1)).alias("hi")).collect()   # nodes x candidates
    lo, hi = np.full(level.candidates.shape, np.nan), np.full(level.candidates.shape, np.nan)
    for r in got:
        lo[r["at"], r["slot"]], hi[r["at"], r["slot"]] = r["lo"], r["hi"]
    return lo, hi


def _best(rows: DataFrame, level: _Level, weigh: Callable, score: Callable, width: int) -> list:
    """Per active node its best split: candidate, cut and the statistics on
    both sides.  ``weigh(batch, tree, rows)`` gives the rows' statistics,
    ``score`` how good the statistics of a side are."""
    shared = rows.sparkSession.sparkContext.broadcast(level)
    bins = level.cuts.shape[2] + 1

    def run(batches):
        lv = shared.value
        nodes, slots = lv.candidates.shape
        total = np.zeros((nodes, slots, bins * width))
        seen = np.zeros(nodes, bool)
        for b in batches:
            x = _matrix(b.column("x"))
            for t, at, node in lv.members(x, b.column("fold")):
                w = weigh(b, t, at)
                seen[node] = True
                for k in range(slots):
                    v = x[at, lv.candidates[node, k]]
                    cell = node * bins + (v[:, None] > lv.cuts[node, k]).sum(axis=1)
                    for j in range(width):
                        total[:, k, j::width] += np.bincount(cell, w[:, j], nodes * bins).reshape(nodes, bins)
        at = np.flatnonzero(seen)
        keys = np.stack([np.repeat(at, slots), np.tile(np.arange(slots), len(at))], axis=1)
        yield from _emit(keys, total[at].reshape(-1, bins * width))

    def choose(batches):
        lv = shared.value
        for at, slot, stats in _sums(batches):
            s = stats.reshape(-1, bins, width)
            left = np.cumsum(s, axis=1)[:, :-1]
            right = s.sum(axis=1)[:, None] - left
            gain, ok = score(left, right)
            gain = np.where(ok, gain, -np.inf)
            cut = gain.argmax(axis=1)          # the smaller cut on ties
            i = np.arange(len(s))
            both = np.concatenate([left[i, cut], right[i, cut]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(gain[i, cut]), pa.array(-lv.candidates[at, slot]), pa.array(slot), pa.array(cut),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, both.size + 1, 2 * width, dtype=np.int32)), pa.array(both.ravel()))],
                names=["at", "gain", "low", "slot", "cut", "stats"])

    parts = rows.mapInArrow(run, _PARTS).repartition("at", "slot").sortWithinPartitions("at", "slot")
    best = parts.mapInArrow(choose, "at long, gain double, low long, slot long, cut long, stats array<double>")
    return best.groupBy("at").agg(F.max(F.struct("gain", "low", "slot", "cut", "stats")).alias("s")).select("at", "s.*").collect()


def grow(rows: DataFrame, forest: Forest, size: int, candidates_of: Callable, cuts_of: Callable, weigh: Callable,
         score: Callable, splits: Callable) -> Forest:
    """Grow all trees of ``forest`` level by level.

    ``candidates_of(active)``: features tried by each active (tree, node);
    ``cuts_of(active, candidates, lo, hi)``: their thresholds;
    ``splits(stats)``: whether a node with these statistics is split further."""
    active = [(t, 1) for t in range(len(forest.feature))]
    for level in range(forest.depth):
        following = []
        per_node = size * (len(forest.classes) + 1) * 2
        step = max(1, MAX_CELLS // per_node)
        for a in range(0, len(active), step):
            part = active[a:a + step]
            cand = candidates_of(part)
            lo, hi = _bounds(rows, _Level(forest, part, cand, None))
            cuts = cuts_of(part, cand, lo, hi)
            for r in _best(rows, _Level(forest, part, cand, cuts), weigh, score, forest.width):
                t, n = part[r["at"]]
                left, right = np.split(np.array(r["stats"]), 2)
                if n == 1:
                    forest.stats[t, 1] = left + right
                if r["gain"] == -np.inf or not splits(left + right):
                    continue
                following.append((r["at"] + a, t, n, cand[r["at"], r["slot"]], cuts[r["at"], r["slot"], r["cut"]], left, right))
        active = []
        for _, t, n, f, cut, left, right in sorted(following, key=lambda x: x[0]):
            forest.feature[t, n], forest.threshold[t, n] = f, cut
            forest.stats[t, 2 * n], forest.stats[t, 2 * n + 1] = left, right
            active += [(t, c) for c, s in ((2 * n, left), (2 * n + 1, right)) if splits(s)]
        if not active:
            break
    return forest


# ------------------------------------------------------------ extra-trees
def _gini(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over both sides of (sum of squared class counts) / rows."""
    n = left.sum(axis=-1), right.sum(axis=-1)
    ok = (n[0] > 0) & (n[1] > 0)
    return sum((s * s).sum(axis=-1) / np.maximum(k, 1) for s, k in zip((left, right), n)), ok


def _class_index(column: pa.Array, classes: list) -> np.ndarray:
    return pc.index_in(column, value_set=pa.array(classes, column.type)).to_numpy(zero_copy_only=False)


def extra_trees(df: DataFrame, vec: str, label: str, trees: int = 100, depth: int = 8, candidates: int | None = None,
                min_rows: int = 2, seed: int = 0, fold: str | None = None) -> Forest:
    """A forest of extremely randomised trees.  With ``fold``, one model a
    fold, learnt from the other folds' rows in the same passes.  ``candidates``
    is the square root of the vector's length by default."""
    rows, classes, models, size = _rows(df, vec, label, fold)
    k = candidates or max(1, int(np.sqrt(size)))
    forest = Forest(classes, models, trees, depth, len(classes))

    def candidates_of(active):
        return np.array([sorted(sorted(range(size), key=lambda f: (draw(seed, "feature", t % trees, n, f), f))[:k])
                         for t, n in active])

    def cuts_of(active, cand, lo, hi):
        u = np.array([[draw(seed, "cut", t % trees, n, f) for f in row] for (t, n), row in zip(active, cand)])
        return (lo + u * (hi - lo))[:, :, None]

    def weigh(batch, tree, at):
        return np.eye(len(classes))[_class_index(batch.column("label"), classes)[at]]

    def splits(counts):
        return counts.sum() >= min_rows and np.count_nonzero(counts) > 1

    return grow(rows, forest, k, candidates_of, cuts_of, weigh, _gini, splits)


def predict(df: DataFrame, forest: Forest, vec: str, fold: str | None = None, out: str = "prediction",
            probability: str = "probability") -> DataFrame:
    """``df`` with the mean class shares of the leaves that a row ends in, in
    order of ``forest.classes``, and the class with the largest (to nine
    places; the first on ties).  With ``fold``, a row is given to its own fold's
    model, which has not seen it; a fold without a model gets null."""
    leaf, classes = forest.stats / np.maximum(forest.stats.sum(axis=2, keepdims=True), 1), forest.classes
    shared = df.sparkSession.sparkContext.broadcast((forest, leaf))

    def shares(x: np.ndarray, folds) -> tuple[np.ndarray, np.ndarray]:
        f, leaf = shared.value
        p, known = np.zeros((len(x), len(f.classes))), np.zeros(len(x), bool)
        for m, model in enumerate(f.models):
            at = np.arange(len(x)) if model is None else np.flatnonzero(
                pc.fill_null(pc.equal(folds, model), False).to_numpy(zero_copy_only=False))
            known[at] = True
            for t in range(m * f.trees, (m + 1) * f.trees):
                p[at] += leaf[t, f.route(t, x[at])]
        return p / f.trees, known

    def top(p: np.ndarray, known: np.ndarray):
        return [classes[i] if k else None for i, k in zip(np.round(p, 9).argmax(axis=1), known)]

    return _with_scores(df, vec, fold, shares, top, classes, out, probability)


def _with_scores(df: DataFrame, vec: str, fold: str | None, scores: Callable, top: Callable, classes: list, out: str,
                 probability: str) -> DataFrame:
    kept = [c for c in df.columns if c.lower() not in (out.lower(), probability.lower())]
    x = "x"
    while x.lower() in {c.lower() for c in kept}:
        x += "_"
    kind = T.LongType() if isinstance(classes[0], int) else T.DoubleType() if isinstance(classes[0], float) else T.StringType()
    schema = T.StructType([*df.select(*[f"`{c}`" for c in kept]).schema.fields, T.StructField(out, kind),
                           T.StructField(probability, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            has = b.column(x).is_valid()
            got = b.filter(has)
            folds = got.column(fold) if fold else None
            p, known = scores(_matrix(got.column(x)), folds) if got.num_rows else (np.zeros((0, 1)), np.zeros(0, bool))
            best, probs = iter(top(p, known)), iter(p.tolist() if len(p) else [])
            labels, values = [], []
            known = iter(known)
            for ok in has.to_pylist():
                label, value, k = (next(best), next(probs), next(known)) if ok else (None, None, False)
                labels.append(label)
                values.append(value if k else None)
            arrow = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}[kind]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(labels, arrow),
                                              pa.array(values, pa.list_(pa.float64()))], names=[*kept, out, probability])

    return df.select(*[f"`{c}`" for c in kept], _array(df, vec).alias(x)).mapInArrow(run, schema)


# --------------------------------------------------------------- boosting
@dataclass
class Boosted:
    """Rounds of one tree a class; ``losses`` holds the mean log loss of the
    fitted rows before the first and after every round."""
    classes: list
    start: np.ndarray
    rounds: list
    losses: list

    def margins(self, x: np.ndarray) -> np.ndarray:
        m = np.tile(self.start, (len(x), 1))
        for forest, values in self.rounds:
            for k in range(len(self.classes)):
                m[:, k] += values[k, forest.route(k, x)]
        return m


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _least_squares(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over both sides of (sum of residuals)^2 / rows."""
    ok = (left[..., 1] > 0) & (right[..., 1] > 0)
    return sum(s[..., 0] ** 2 / np.maximum(s[..., 1], 1) for s in (left, right)), ok


def boost(df: DataFrame, vec: str, label: str, rounds: int = 20, depth: int = 3, rate: float = 0.1, cuts: int = 15,
          min_rows: int = 2) -> Boosted:
    """Gradient boosting of all classes on one softmax loss."""
    rows, classes, _, size = _rows(df, vec, label, None)
    k = len(classes)
    got = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = np.array([got[c] for c in classes], float)
    start = np.log(prior / prior.sum())
    rows = rows.withColumn("margin", F.array(*[F.lit(float(v)) for v in start]))
    model = Boosted(classes, start, [], [float(-(prior / prior.sum() * start).sum())])

    def residuals(batch, c, at):
        return (_class_index(batch.column("label"), classes)[at] == c) - softmax(_matrix(batch.column("margin"))[at])[:, c]

    def weigh(batch, c, at):
        r = residuals(batch, c, at)
        return np.stack([r, np.ones(len(r)), np.abs(r) * (1 - np.abs(r))], axis=1)

    every = np.arange(size)
    for _ in range(rounds):
        forest = grow(rows, Forest(classes, [None], k, depth, 3), size * (cuts + 1),
                      lambda active: np.tile(every, (len(active), 1)),
                      lambda active, cand, lo, hi: lo[..., None] + (hi - lo)[..., None] * (np.arange(1, cuts + 1) / (cuts + 1)),
                      weigh, _least_squares, lambda s: s[1] >= min_rows)
        r, h = forest.stats[..., 0], forest.stats[..., 2]
        values = rate * (k - 1) / k * np.divide(r, h, out=np.zeros_like(r), where=h > 1e-150)
        shared = rows.sparkSession.sparkContext.broadcast((forest, values))

        def step(batches):
            f, v = shared.value
            for b in batches:
                x, m = _matrix(b.column("x")), _matrix(b.column("margin"))
                for c in range(k):
                    m[:, c] += v[c, f.route(c, x)]
                p = softmax(m)[np.arange(len(m)), _class_index(b.column("label"), classes)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, k, dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("x"), b.column("label"), b.column("fold"), lists,
                                                  pa.array(-np.log(np.maximum(p, 1e-300)))],
                                                 names=["x", "label", "fold", "margin", "loss"])

        schema = T.StructType([f for f in rows.schema.fields if f.name != "loss"] + [T.StructField("loss", T.DoubleType())])
        rows = _written(rows.select("x", "label", "fold", "margin").mapInArrow(step, schema), "margins")
        model.rounds.append((forest, values))
        model.losses.append(rows.agg(F.avg("loss")).first()[0])
    return model


def boosted_predict(df: DataFrame, model: Boosted, vec: str, out: str = "prediction",
                    probability: str = "probability") -> DataFrame:
    """``df`` with the softmax of the margins and the class with the largest."""
    shared, classes = df.sparkSession.sparkContext.broadcast(model), model.classes

    def scores(x, _):
        return softmax(shared.value.margins(x)), np.ones(len(x), bool)

    def top(p, known):
        return [classes[i] for i in np.round(p, 9).argmax(axis=1)]

    return _with_scores(df, vec, None, scores, top, classes, out, probability)

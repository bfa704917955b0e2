"""Embedding near-duplicates found by spherical-cap filters.

Every unit vector is turned by a fixed random rotation and its two halves are
compared with the codewords of two random codes; a filter is a pair of
codewords, its direction the two joined and scaled to length one.  List
decoding finds all filters whose direction exceeds a vector by the cap height
``alpha`` without visiting the others: a first half can only take part if it
exceeds with the best second half, and the other way round.  The height is
that of a cap holding ``n_filters`` of the code's directions for a vector, and
the code grows with the number of vectors, so a filter holds about
``PER_FILTER`` of them at every size.  The cap gets higher as the table grows
and two near vectors share fewer of their filters, so each vector takes more
of them.  A vector above fewer than three quarters of ``n_filters``
directions takes its best ones.  Vectors with a label and a
filter in common are compared in double precision.

Two vectors of cosine 0.93 share each filter of either with probability 0.56
among 8,000 vectors and 0.27 among 100 million.  Simulated misses at that
cosine are in the README for tables of every size; closer pairs are missed
less.  A pair counts in the first filter it shares, so nothing is
counted twice and pairs need not be listed: a group yields link counts and
links that span it; a row carries its filters up to the group's.  Groups above ``MOST`` vectors are cut into pairs of parts
over several tasks; with pairs tested for their first meeting a bounded
number at a time, that keeps a task's memory bounded.  Equal vectors are one
class with a number of members.

Defined results: a null label, and a vector that is null, empty, all zeros or
holds a null, NaN or infinity, links with nothing.  Vectors of different
lengths never link.  A null id is not a smallest id; a component without any
other has a null ``component_id`` and counts as kept.  Repeated rows are
vectors of their own.  An empty table gives an empty result.  Other columns
are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, prepare, stored
from tessera.llm.graph import components, in_units, whole_units

#: Filters of a vector among up to ``FEW`` vectors, and the power of the table's size they grow with above.
FILTERS = 32
LEAST_FILTERS = 24
FEW = 8000
GROWTH = 0.14
PER_FILTER = 32
#: Products of vectors and codewords held at a time.
CELLS = 1 << 22
MOST = 1024
SMALL = 16
SEED = 71


def cap_height(dim: int, share: float) -> float:
    """Height of the cap that holds ``share`` of the unit sphere."""
    if dim == 1:
        return 1.0 if share <= 0.5 else -1.0
    t = np.cos(np.linspace(0.0, math.pi, 200_001))  # the angle's density is sin ** (dim - 2)
    density = np.sin(np.linspace(0.0, math.pi, 200_001)) ** (dim - 2)
    area = np.cumsum(density)
    return float(t[np.searchsorted(area / area[-1], min(max(share, 0.0), 1.0))])


def n_filters(n_vectors: int) -> int:
    """The filters of a vector that keep the share of missed pairs level."""
    return math.ceil(FILTERS * max(1.0, n_vectors / FEW) ** GROWTH)


@lru_cache(maxsize=4)
def product_code(dim: int, n_vectors: int) -> tuple:
    """(rotation, codewords of the first half, of the second, threshold)."""
    rng = np.random.default_rng(SEED + dim)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    filters = n_filters(n_vectors)
    size = max(8, math.ceil(math.sqrt(n_vectors * filters / PER_FILTER)))
    half = [dim // 2, dim - dim // 2] if dim > 1 else [0, 1]
    code = []
    for d in half:
        c = rng.standard_normal((size, d))
        code.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) / math.sqrt(2))
    return rotation, code[0], code[1], cap_height(dim, filters / size ** 2)


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def list_decode(x: np.ndarray, n_vectors: int) -> list[np.ndarray]:
    """The sorted filter numbers of each row of unit vectors."""
    rotation, c1, c2, alpha = product_code(x.shape[1], n_vectors)
    turned = x @ rotation
    h = x.shape[1] // 2
    size, out = len(c2), []
    least = LEAST_FILTERS * n_filters(n_vectors) // FILTERS
    rows = max(1, CELLS // size)
    products = ((turned[k:k + rows, :h] @ c1.T, turned[k:k + rows, h:] @ c2.T) for k in range(0, len(x), rows))
    for a, b in (pair for block in products for pair in zip(*block)):
        height = alpha
        while True:
            i, j = np.flatnonzero(a >= height - b.max()), np.flatnonzero(b >= height - a.max())
            both = a[i][:, None] + b[j][None, :]
            over = both >= height
            if over.sum() >= min(least, size * size):
                break
            height -= 0.05
        if height < alpha:  # lowered: only the best ones
            over = both >= np.partition(both[over], -least)[-least] \
                if over.sum() > least else over
        r, c = np.nonzero(over)
        out.append(np.sort(i[r] * size + j[c]).astype(np.int64))
    return out


def _usable(col: str):
    x = F.col(col)
    return (x.isNotNull() & (F.size(x) > 0)
            & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists(x, lambda v: v != 0))


class Meetings:
    """The sorted filters of a block's rows up to their group's, to tell where two rows first meet."""

    def __init__(self, filters: pa.ChunkedArray):
        arr = filters.combine_chunks()
        self.flat = arr.flatten().to_numpy().astype(np.int64)
        self.start = np.asarray(arr.offsets)[:-1].astype(np.int64) - arr.offsets[0].as_py()
        size = np.diff(np.asarray(arr.offsets))
        self.base = int(self.flat.max(initial=0)) + 1
        # row and filter in one number; sorted, as rows and their filters are
        self.codes = np.repeat(np.arange(len(size), dtype=np.int64), size) * self.base + self.flat

    def first(self, i: np.ndarray, j: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Whether rows i and j share no filter before ``now``, a filter of both."""
        early = np.searchsorted(self.codes, i * self.base + now) - self.start[i]
        out, ends = np.ones(len(i), bool), np.cumsum(early)
        at = 0
        while at < len(i):  # so many filters at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20))))
            n = early[at:to]
            pair = np.repeat(np.arange(at, to), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[i[at:to]], n)
            wanted = j[pair] * self.base + self.flat[place]
            found = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
            out[pair[self.codes[found] == wanted]] = False
            at = to
        return out


def _compare(t: pa.Table, cosine: float) -> tuple[np.ndarray, ...]:
    """(node, added links) and spanning links (a, b) of sorted units."""
    unit, node = t["unit"].to_numpy(), t["node"].to_numpy()
    members, now = t["members"].to_numpy(), t["filter"].to_numpy()
    part, same = t["part"].to_numpy(), t["same"].to_numpy(zero_copy_only=False)
    meet = Meetings(t["filters"])
    vec = t["embedding"].combine_chunks()
    x_flat, off = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64), vec.offsets.to_numpy()
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    size = np.diff(np.r_[starts, len(unit)])
    dim = np.diff(off)
    added = np.zeros(len(unit), np.int64)
    ea, eb = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    x = None
    if len(set(dim.tolist())) == 1:
        x = unit_vectors(x_flat[off[0]:off[-1]].reshape(len(unit), -1))

    def count(i, j):
        first = meet.first(i, j, now[i])
        i, j = i[first], j[first]
        np.add.at(added, i, members[j])
        np.add.at(added, j, members[i])
        return i, j

    small = np.repeat(size <= SMALL, size)
    if x is not None:
        for d in range(1, SMALL):
            i = np.flatnonzero(small[:-d] & (unit[d:] == unit[:-d]))
            i = i[(same[i] | (part[i] != part[i + d])) & (node[i] != node[i + d])]
            i = i[np.einsum("ij,ij->i", x[i], x[i + d]) >= cosine]
            i, j = count(i, i + d)
            ea.append(node[i])
            eb.append(node[j])
    for s, n in zip(starts, size):
        if n < 2 or (n <= SMALL and x is not None):
            continue
        for k in set(dim[s:s + n].tolist()):  # vectors of one length
            at = s + np.flatnonzero(dim[s:s + n] == k)
            xs = x[at] if x is not None else unit_vectors(np.stack([x_flat[off[r]:off[r] + k] for r in at]))
            linked = (xs @ xs.T) >= cosine
            linked &= same[at][:, None] | (part[at][:, None] != part[at][None, :])
            linked &= node[at][:, None] != node[at][None, :]
            i, j = np.nonzero(np.triu(linked, 1))
            count(at[i], at[j])
            left = np.ones(len(at), bool)
            for r in range(len(at)):  # stars over what hangs together in this group
                if left[r]:
                    left[r], todo = False, [r]
                    while todo:
                        new = np.flatnonzero(linked[todo.pop()] & left)
                        left[new] = False
                        todo.extend(new.tolist())
                        ea.append(np.full(len(new), node[at[r]]))
                        eb.append(node[at[new]])
    hit = np.flatnonzero(added)
    return node[hit], added[hit], np.concatenate(ea), np.concatenate(eb)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label", cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links (other vectors of the label at ``cosine`` or more),
    component_id (the smallest id that links reach) and kept."""
    prepare(vectors.sparkSession)
    src = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
                         F.col(embedding).alias("embedding"))
    usable = F.col("label").isNotNull() & _usable("embedding")
    node = F.when(usable, F.xxhash64("label", "embedding"))
    classes = stored(src.withColumn("node", node).filter("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        F.count(F.lit(1)).alias("members"), F.min("vec_id").alias("least")), "vectors")
    total = classes.count()

    # filters below 2**31, as some six hundred million vectors have, take four bytes
    kind = "int" if len(product_code(2, total)[2]) ** 2 < 1 << 31 else "long"

    def make():
        def run(b):
            vec = b.column("embedding")
            flat, off = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64), vec.offsets.to_numpy()
            off = off - off[0]
            out = [None] * b.num_rows
            dim = np.diff(off)
            for k in set(dim.tolist()):
                at = np.flatnonzero(dim == k)
                for row, filters in zip(at, list_decode(
                        unit_vectors(np.stack([flat[off[r]:off[r + 1]] for r in at])), total)):
                    out[row] = filters
            ends = np.cumsum([0, *map(len, out)], dtype=np.int32)
            flat = pa.array(np.concatenate(out)).cast(pa.int32() if kind == "int" else pa.int64())
            return [pa.ListArray.from_arrays(pa.array(ends), flat)]

        return run

    listed = map_arrow(classes, make, [("filters", f"array<{kind}>")], ["node", "label", "embedding", "members"])
    rows = listed.select("node", "label", "embedding", "members", "filters",
                         F.posexplode("filters").alias("place", "filter"))
    rows = rows.withColumn("filters", F.slice("filters", F.lit(1), F.col("place") + 1)).drop("place")
    rows = rows.withColumn("key", F.xxhash64("label", "filter"))
    dealt = in_units(rows, "key", "node", MOST).select(
        "unit", "part", "same", "node", "members", "filter", "filters", "embedding")

    def compare(batches):
        for t in whole_units(batches):
            n, added, a, b = _compare(t, cosine)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[n, a]), pa.array(np.r_[added, b]),
                 pa.array(np.r_[np.ones(len(n), bool), np.zeros(len(a), bool)])], names=["a", "b", "counts"])

    found = stored(dealt.mapInArrow(compare, "a long, b long, counts boolean"), "links")
    linked = found.filter("counts").groupBy("a").agg(F.sum("b").alias("linked"))
    parts = components(found.filter("not counts").select("a", "b"))
    per_class = (classes.select("node", "members", "least")
                 .join(linked, F.col("node") == F.col("a"), "left")
                 .join(parts.withColumnRenamed("node", "part_node"), F.col("node") == F.col("part_node"), "left")
                 .select("node", "least", F.coalesce("root", "node").alias("root"),
                         (F.coalesce("linked", F.lit(0)) + F.col("members") - 1).alias("n_links")))
    ids = per_class.groupBy("root").agg(F.min("least").alias("component"))
    by_node = per_class.join(ids, "root").select("node", "n_links", "component")
    out = src.select("vec_id", node.alias("node")).join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))

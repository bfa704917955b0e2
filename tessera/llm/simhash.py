"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A text's fingerprint has 64 bits.  It is cut into four segments of 16 bits;
two fingerprints that differ in at most three bits agree in some segment
exactly and differ in at most two bits in the segment after it (if one
segment holds all three errors, the other three agree).  The second segment,
padded to 23 bits, is decoded to nearby codewords of the perfect binary Golay
code: to the nearest one, and, when that is three bits away, also to the five
at four bits.  Two words at most two bits apart always share one of these
codewords.  So (segment, codeword of the next segment) gives about 21 keys a
fingerprint; fingerprints that share a key are compared.

Distinct fingerprints are compared, not documents, so copies cost nothing.
Inside a group of candidates a spanning star of every linked part is emitted,
never all pairs; groups above ``MOST`` fingerprints are cut into pairs of
parts over several tasks.  Components come from star rounds in Spark.

Defined results: null and empty texts have fingerprint zero and link like any
other.  A null id takes part in the links, but does not count as a smallest
id; a component without any other id has a null ``component_id``.  Repeated
rows are kept, each with the same result.  An empty table gives an empty
result.  Other columns are ignored by ``near_duplicates`` and passed through
by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, map_arrow, prepare, stored, utf8, whole_text
from tessera.llm.graph import components, in_units, whole_units

SEED = 42
MOST = 4096
#: Generator polynomial of the (23, 12) Golay code.
GENERATOR = 0xC75


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z read as a-z."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, SEED) for g in grams], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        part = h[i:i + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def golay_keys() -> np.ndarray:
    """For each 16-bit word the codewords (numbers 0 to 4095) near it: a row
    of six, -1 where there are fewer."""
    code = np.zeros(4096, np.int64)
    for i in range(12):
        code ^= np.where(np.arange(4096) >> i & 1, GENERATOR << i, 0)
    out = np.full((1 << 16, 6), -1, np.int16)
    for at in range(0, 1 << 16, 2048):
        words = np.arange(at, at + 2048)
        far = np.bitwise_count(words[:, None] ^ code[None, :])
        near = far.min(1)
        use = (far <= np.where(near == 3, 4, near)[:, None])
        row, col = np.nonzero(use)
        first = np.searchsorted(row, np.arange(2048))
        out[at + row, np.arange(len(row)) - first[row]] = col
    return out


def candidate_keys(fp: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, key) of every key of the fingerprints."""
    seg = [(fp >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    rows, keys = [], []
    for i in range(4):
        near = table[seg[(i + 1) % 4]].astype(np.int64)
        row, col = np.nonzero(near >= 0)
        rows.append(row)
        keys.append(i << 28 | seg[i][row] << 12 | near[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def spanning_links(unit: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, within each unit, what is linked: all pairs of a short
    unit, stars for a longer one.  ``unit`` is sorted."""
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    size = np.diff(np.r_[starts, len(unit)])
    small = np.repeat(size <= 8, size)
    for d in range(1, 8):
        i = np.flatnonzero(small[:-d] & (unit[d:] == unit[:-d]))
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
        a.append(fp[i])
        b.append(fp[i + d])
    for s, n in zip(starts[size > 8], size[size > 8]):
        left = np.unique(fp[s:s + n])
        while len(left) > 1:
            root, todo, left = left[0], [left[0]], left[1:]
            while todo and len(left):
                hit = np.bitwise_count(left ^ todo.pop()) <= max_bits
                if hit.any():
                    new, left = left[hit], left[~hit]
                    todo.extend(new)
                    a.append(np.full(len(new), root))
                    b.append(new)
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, long) that
    connect whatever chains of at most ``max_bits`` differing bits connect."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the segment keys find up to 3 differing bits")
    table = fps.sparkSession.sparkContext.broadcast(golay_keys())

    def keyed(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for s in range(0, len(fp), 1 << 14):
                row, key = candidate_keys(fp[s:s + (1 << 14)], table.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(fp[s:s + (1 << 14)][row].view(np.int64))], names=["key", "fp"])

    def compare(batches):
        for t in whole_units(batches):
            a, b = spanning_links(t["unit"].to_numpy(), t["fp"].to_numpy().view(np.uint64), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                             names=["a", "b"])

    rows = fps.mapInArrow(keyed, "key long, fp long")
    dealt = in_units(rows, "key", "fp", MOST).select("unit", "fp")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _fingerprints(docs: DataFrame, text: str, shingle: int, keep: list[str], out: str) -> DataFrame:
    def make():
        return lambda b: [pa.array(np.array([fingerprint(x, shingle) for x in utf8(b, text)], "<u8")
                                   .view(np.int64))]

    return map_arrow(docs, make, [(out, "long")], keep)


def _groups(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root): the component of each distinct fingerprint of ``fps``."""
    distinct = stored(fps.select("fp").distinct(), "fingerprints")
    found = components(links(distinct, max_bits))
    return (distinct.join(found, F.col("fp") == F.col("node"), "left")
            .select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id
    of the documents that links reach) of every document."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    fps = stored(_fingerprints(src, "text", shingle, ["doc_id"], "fp"), "simhash")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = least.join(_groups(fps, max_bits), "fp")
    ids = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = groups.join(ids, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One document of each group of near-duplicates, with its columns: the
    one with the smallest id (nulls last; of several with that id, the one
    with the smallest hash of its columns; of equal rows, one)."""
    prepare(docs.sparkSession)
    row = F.xxhash64(*docs.columns)
    src = docs.select(F.col(doc_id).alias("id"), row.alias("row"), whole_text(text).alias("text"))
    fps = stored(_fingerprints(src, "text", shingle, ["id", "row"], "fp"), "simhash")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")
    groups = fps.groupBy("fp").agg(first).join(_groups(fps, max_bits), "fp")
    kept = groups.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.id").alias("kept_id"), F.col("first.row").alias("kept_row"))
    kept = kept.join(fps.groupBy("id", "row").agg(F.count(F.lit(1)).alias("kept_n")),
                     F.col("kept_id").eqNullSafe(F.col("id")) & (F.col("kept_row") == F.col("row"))
                     ).select("kept_id", "kept_row", "kept_n")
    names = {n: fresh(docs.columns, f"_{n}") for n in ("kept_id", "kept_row", "kept_n", "hash")}
    kept = stored(kept.select(*(F.col(n).alias(names[n]) for n in ("kept_id", "kept_row", "kept_n"))), "kept")
    hit = docs.withColumn(names["hash"], row).join(
        kept, F.col(doc_id).eqNullSafe(F.col(names["kept_id"]))
        & (F.col(names["hash"]) == F.col(names["kept_row"])))
    once = hit.filter(F.col(names["kept_n"]) == 1).select(*docs.columns)
    again = hit.filter(F.col(names["kept_n"]) > 1).dropDuplicates([names["hash"], names["kept_id"]])
    return once.unionByName(again.select(*docs.columns))

"""Alignment of two tokenizers over the same text by galloping intersection.

Each text is encoded twice: by a byte-level BPE vocabulary (A, with a space in
front) and by a sentencepiece model (B, which adds that space itself).  The end
offsets of both token lists are increasing lists of bytes.

1. **Galloping intersection.**  The shorter end list drives: each of its ends
   starts where the one before was found in the longer list, doubles its step
   until it has passed, and halves back.  Numpy does this for runs of ``RUN``
   ends side by side.
2. **Groups and links.**  Ends that both lists hold cut the tokens into
   groups.  The rank of an end in the longer list, less the rank of the end
   before, is the range of tokens that the driving token overlaps: its links.
3. **Counts.**  Spark sums the links of every id pair over all documents;
   tasks add up their own first.  A second pass looks each link up.  The table
   of pairs is sent in slices of at most ``SLICE`` pairs (16 bytes each), one
   slice a pass, so it may have any size.

Texts, ids and link counts are of whole texts.  Encoding is done once; the ids
are written below spark.checkpoint.dir, two bytes a token.

Defined results: texts that are null or empty, or whose joined bytes of A or B
differ from space + text, have no tokens: all counts are 0 and the digest is ''.
Repeated rows are rows of their own and count in the pairs; a null id is kept.
An empty table gives an empty result.  Only the two named columns are read, so
other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, prepare, stored, whole_text

#: Ends of a run, bytes of tokens handled at a time, and pairs of a slice.
RUN, CHUNK, SLICE = 64, 2 << 20, 4 << 20
#: White space in a row from which a text is cut into pre-tokens here.
BLANK = 1000


def byte_alphabet() -> dict[str, int]:
    """Byte of every printable character of a byte-level vocabulary: printable
    Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of the ids of a byte-level BPE file in JSON, added tokens left
    out.  Ids must follow the order of the merges, so an id is a rank."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    added = {t["id"] for t in model["added_tokens"]}
    alphabet = byte_alphabet()
    ids = {i: p for p, i in model["model"]["vocab"].items() if i not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    first = len(ids) - len(merges)
    if sorted(ids) != list(range(len(ids))) or any(ids[first + k] != a + b for k, (a, b) in enumerate(merges)):
        raise ValueError(f"{path}: ids must follow the order of the merges")
    return [bytes(alphabet[c] for c in ids[i]) for i in range(len(ids))]


def piece_tokens(model: bytes) -> list[bytes]:
    """Bytes of the ids of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i)
            else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]


@dataclass
class Vocabularies:
    """Both vocabularies as sent to the tasks."""
    a: list[bytes]
    b: list[bytes]
    model: bytes
    pattern: str

    @property
    def dtype(self) -> str:
        return "<u2" if max(len(self.a), len(self.b)) <= 1 << 16 else "<u4"

    def encoders(self) -> tuple[Callable[[str], list[int]], Callable[[list[str]], list[list[int]]]]:
        import regex
        import sentencepiece
        import tiktoken

        a = tiktoken.Encoding("a", pat_str=self.pattern, mergeable_ranks={t: i for i, t in enumerate(self.a)},
                              special_tokens={})
        b = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        find, blank = regex.compile(self.pattern).findall, regex.compile(r"\s{%d}" % BLANK).search
        piece = a._encode_single_piece

        def encode_a(text: str) -> list[int]:
            if not blank(text):
                return a.encode_ordinary(text)
            # the library's own search recurses over a run of white space
            return [i for pre in find(text) for i in piece(pre.encode())]

        return encode_a, lambda texts: b.encode(texts, num_threads=1)


def vocabularies(a_path: str, b_path: str, pattern: str) -> Vocabularies:
    with open(b_path, "rb") as f:
        model = f.read()
    return Vocabularies(byte_level_tokens(a_path), piece_tokens(model), model, pattern)


def encoded(docs: DataFrame, voc: Vocabularies, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, a, b): the ids of both tokenizers, packed; empty where
    the text has no tokens."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(voc)

    def make():
        v = shared.value
        encode_a, encode_b = v.encoders()
        of_a, of_b = v.a.__getitem__, v.b.__getitem__

        def run(batch):
            out_a, out_b = [], []
            texts = batch.column("text").to_pylist()
            for i, j in chunks([len(t) for t in texts]):
                for t, b in zip(texts[i:j], encode_b(texts[i:j])):
                    a, want = (encode_a(" " + t), b" " + t.encode()) if t else ([], b"")
                    same = t and b"".join(map(of_a, a)) == want and b"".join(map(of_b, b)) == want
                    out_a.append(np.array(a if same else [], v.dtype).tobytes())
                    out_b.append(np.array(b if same else [], v.dtype).tobytes())
            return [pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())]

        return run

    src = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    src = src.withColumn("row", F.monotonically_increasing_id())
    return stored(map_arrow(src, make, [("a", "binary"), ("b", "binary")], ["doc_id", "row", "text"]).drop("text"), "ids")


def chunks(sizes: list[int], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to about ``most``."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def gallop(ends: np.ndarray, x: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each x the first place from its ``low`` on with ends[place] >= x:
    steps of 1, 2, 4, ... until x is passed, then halving."""
    low, high, step, last = low.copy(), low.copy(), 1, len(ends) - 1
    todo = np.flatnonzero(ends[high] < x)
    while len(todo):
        at = high[todo]
        low[todo] = at + 1
        high[todo] = at = np.minimum(at + step, last)
        step *= 2
        todo = todo[ends[at] < x[todo]]
    todo = np.flatnonzero(low < high)
    while len(todo):
        mid = low[todo] + high[todo] >> 1
        less = ends[mid] < x[todo]
        low[todo[less]] = mid[less] + 1
        high[todo[~less]] = mid[~less]
        todo = todo[low[todo] < high[todo]]
    return low


def places(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Place in ``long`` of the first end at or after each end of ``short``;
    ``start`` is where the text of an end begins in ``long``.  Ends grow over
    all texts; runs of ``RUN`` ends advance side by side."""
    out = np.empty(len(short), np.int64)
    heads = np.arange(0, len(short), RUN)
    low = start[heads]
    for k in range(min(RUN, len(short))):
        at = heads + k
        at = at[at < len(short)]
        low = out[at] = gallop(long, short[at], np.maximum(low[:len(at)], start[at]))
    return out


class Alignment:
    """Groups and links of a run of texts, from their packed ids.

    ``a``, ``b``: ids of all texts; ``a_at``, ``b_at``: where each text's begin.
    ``link_a``, ``link_b``: places of linked tokens, by driving token.
    ``cut_a``, ``cut_b``: whether a token's end is shared."""

    def __init__(self, a: list[bytes], b: list[bytes], dtype: str, size_a: np.ndarray, size_b: np.ndarray):
        width = np.dtype(dtype).itemsize
        self.a, self.b = (np.frombuffer(b"".join(x), dtype).astype(np.int64) for x in (a, b))
        self.a_at, self.b_at = (np.cumsum([0, *(len(y) // width for y in x)]) for x in (a, b))
        ends = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])   # texts have the same bytes in both
        n = np.diff(self.a_at), np.diff(self.b_at)
        driver = n[0] <= n[1]                                          # A is the shorter list
        self.cut_a, self.cut_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        links = [np.empty((2, 0), np.int64)]
        for which, mine, other in ((driver, 0, 1), (~driver, 1, 0)):
            at = (self.a_at, self.b_at)
            pick = np.flatnonzero(np.repeat(which, n[mine]))
            if not len(pick):
                continue
            first = np.repeat(at[other][:-1], n[mine])[pick]
            rank = places(ends[mine][pick], ends[other], first)
            cut = ends[other][rank] == ends[mine][pick]
            head = np.zeros(len(ends[mine]) + 1, bool)
            head[at[mine][:-1]] = True
            head = head[:-1][pick]
            # the range begins after the rank of the end before, or at it if not shared
            low = np.where(head, first, np.concatenate([[0], rank[:-1] + cut[:-1]]))
            span = rank - low + 1
            total = np.cumsum(span)
            one = np.repeat(pick, span)
            two = np.arange(len(one)) + np.repeat(low - total + span, span)
            links.append(np.stack([one, two] if mine == 0 else [two, one]))
            (self.cut_a, self.cut_b)[mine][pick[cut]] = True
            (self.cut_a, self.cut_b)[other][rank[cut]] = True
        self.link_a, self.link_b = np.concatenate(links, axis=1)

    def codes(self, n_b: int) -> np.ndarray:
        """Each link's id pair as one number."""
        return self.a[self.link_a] * n_b + self.b[self.link_b]

    def doc_sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of every link by text."""
        doc = np.searchsorted(self.a_at, self.link_a, "right") - 1
        out = np.zeros(len(self.a_at) - 1, np.int64)
        np.add.at(out, doc, values)
        return out

    def canonical(self, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries of ``words`` in the order of the written form, and where
        each text's begin."""
        after_a, after_b = np.cumsum(self.cut_a), np.cumsum(self.cut_b)
        group_a, group_b = after_a - self.cut_a, after_b - self.cut_b
        end_a, end_b = np.flatnonzero(self.cut_a) + 1, np.flatnonzero(self.cut_b) + 1
        out = np.empty(len(self.a) + len(self.b), np.int64)
        before_b = np.concatenate([[0], end_b])[group_a] if len(self.a) else group_a
        out[np.arange(len(self.a)) + before_b] = self.a + n_a * self.cut_a
        mark = self.cut_b.astype(np.int64)
        mark[self.b_at[1:][np.diff(self.b_at) > 0] - 1] = 2       # the text's last token
        out[np.arange(len(self.b)) + (end_a[group_b] if len(self.b) else group_b)] = 2 * n_a + self.b + n_b * mark
        return out, self.a_at + self.b_at


def words(n_a: int, n_b: int) -> list[bytes]:
    """Written ids with what follows them: A ',' or '|'; B ',', ';' or nothing."""
    return [b"%d%s" % (i, s) for n, ends in ((n_a, (b",", b"|")), (n_b, (b",", b";", b""))) for s in ends for i in range(n)]


class _Task:
    """What a task needs of the vocabularies."""

    def __init__(self, voc: Vocabularies):
        self.n_a, self.n_b, self.dtype = len(voc.a), len(voc.b), voc.dtype
        self.size_a, self.size_b = (np.array([len(t) for t in x]) for x in (voc.a, voc.b))

    def alignments(self, batch: pa.RecordBatch) -> Iterator[Alignment]:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        for i, j in chunks([len(x) for x in a]):
            yield Alignment(a[i:j], b[i:j], self.dtype, self.size_a, self.size_b)


def _add(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n, first)


def pair_counts(ids: DataFrame, shared: Broadcast) -> DataFrame:
    """(code, n, best): the links of every id pair over all documents, and
    whether no pair of the same B id has more; written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, sums, size = _Task(shared.value), [], [], 0

        def flush():
            code, n = _add(held, sums)
            for i in range(0, len(code), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(code[i:i + (1 << 16)]), pa.array(n[i:i + (1 << 16)])],
                                                 names=["code", "n"])

        for batch in batches:
            for x in task.alignments(batch):
                code, n = np.unique(x.codes(task.n_b), return_counts=True)
                if len(code):
                    held.append(code)
                    sums.append(n.astype(np.int64))
                    size += len(code)
                if size > SLICE:
                    code, n = _add(held, sums)
                    held[:], sums[:], size = [code], [n], len(code)
                    if size > SLICE // 2:      # this task's pairs leave; Spark adds them up
                        yield from flush()
                        held[:], sums[:], size = [], [], 0
        if size:
            yield from flush()

    n_b = len(shared.value.b)
    counts = ids.select("a", "b").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = stored(counts, "pairs")
    b_id = F.col("code") % n_b
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))     # one row per id of the vocabulary
    return stored(counts.join(F.broadcast(most), b_id == F.col("b_id")).select(
        "code", "n", (F.col("n") == F.col("most")).alias("best")), "pair_counts")


def aligned(ids: DataFrame, voc: Vocabularies) -> DataFrame:
    """(doc_id, row, a_ends, b_ends): per document the token numbers at which
    each group ends on either side."""
    shared = ids.sparkSession.sparkContext.broadcast(voc)

    def make():
        task = _Task(shared.value)

        def run(batch):
            cut_a, cut_b = [], []
            for x in task.alignments(batch):
                for cut, at, out in ((x.cut_a, x.a_at, cut_a), (x.cut_b, x.b_at, cut_b)):
                    out += [(np.flatnonzero(cut[i:j]) + 1).tolist() for i, j in zip(at, at[1:])]
            return [pa.array(c, pa.list_(pa.int64())) for c in (cut_a, cut_b)]

        return run

    return map_arrow(ids, make, [("a_ends", "array<long>"), ("b_ends", "array<long>")],
                     ["doc_id", "row", "a", "b"]).drop("a", "b")


def _slices(pairs: DataFrame, most: int) -> list[DataFrame]:
    n = pairs.count()
    parts = -(-n // most)
    if parts <= 1:
        return [pairs]
    slice_of = F.pmod(F.xxhash64("code"), F.lit(parts))
    return [pairs.filter(slice_of == i) for i in range(parts)]


def _lookup(spark: SparkSession, pairs: DataFrame) -> Broadcast:
    """Sorted codes and their counts; a count is negative where it is the best."""
    t = pairs.select("code", F.when(F.col("best"), -F.col("n")).otherwise(F.col("n")).alias("n")).toArrow()
    code, n = t["code"].to_numpy(), t["n"].to_numpy()
    order = np.argsort(code)
    return spark.sparkContext.broadcast((code[order], n[order]))


def align(docs: DataFrame, voc: Vocabularies, slice_pairs: int = SLICE) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256."""
    spark = prepare(docs.sparkSession)
    ids = encoded(docs, voc)
    shared = spark.sparkContext.broadcast(voc)
    slices = [_lookup(spark, s) for s in _slices(pair_counts(ids, shared), slice_pairs)]

    def sums(lookup: Broadcast, first: bool):
        def make():
            task = _Task(shared.value)
            code, count = lookup.value
            written = words(task.n_a, task.n_b).__getitem__ if first else None

            def run(batch):
                cols = [[] for _ in range(7 if first else 2)]
                for x in task.alignments(batch):
                    want = x.codes(task.n_b)
                    if len(code):
                        at = np.minimum(np.searchsorted(code, want), len(code) - 1)
                        n = np.where(code[at] == want, count[at], 0)
                    else:
                        n = np.zeros(len(want), np.int64)
                    got = [x.doc_sums(n < 0), x.doc_sums(np.abs(n))]
                    if first:
                        groups = np.diff(np.concatenate([[0], np.cumsum(x.cut_a)])[x.a_at])
                        order, at = x.canonical(task.n_a, task.n_b)
                        digest = [hashlib.sha256(b"".join(map(written, order[i:j].tolist()))).hexdigest() if j > i else ""
                                  for i, j in zip(at, at[1:])]
                        got += [np.diff(x.a_at), np.diff(x.b_at), groups, x.doc_sums(np.ones(len(n), np.int64)), digest]
                    for c, g in zip(cols, got):
                        c.extend(g if isinstance(g, list) else g.tolist())
                return [pa.array(c, pa.string() if i == 6 else pa.int64()) for i, c in enumerate(cols)]

            return run

        return make

    numbers = ["n_best", "count_sum", "n_a", "n_b", "n_groups", "n_links"]
    fields = [(c, "long") for c in numbers] + [("groups_sha256", "string")]
    keep = ["doc_id", "row", "a", "b"]
    out = map_arrow(ids, sums(slices[0], True), fields, keep).drop("a", "b")
    for s in slices[1:]:
        more = map_arrow(ids, sums(s, False), fields[:2], keep).select(
            F.col("row").alias("of"), F.col("n_best").alias("more_best"), F.col("count_sum").alias("more_sum"))
        out = out.join(more, F.col("row") == F.col("of")).withColumns({
            "n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")}).drop(
            "of", "more_best", "more_sum")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

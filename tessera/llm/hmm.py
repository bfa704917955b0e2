"""Hidden Markov language model.

Spark counts every word of the training texts.  The most frequent words are
symbols of the model; every other word is emitted through its class (a hash of
its last bytes), and within the class with add-one probability from its count,
one unit being kept for unseen words.  Baum-Welch trains the latent states:
tasks run the scaled forward-backward recursion over windows of the training
texts and emit expected counts, Spark adds them up, and the driver normalises
them.  Every round takes all training texts.
A text's likelihood is exact: one scaled forward recursion over all of its
tokens, whatever its length.

Counts of words outside the ``KNOWN`` most frequent ones reach the documents
through a join on the word; what is sent to every task (the frequent words and
the model) has a fixed bound.  The expected counts have one row for each
symbol, from as many tasks as there are cores.

Defined results: null and empty texts consist of the end token alone.  A null
id belongs to the training texts.  Repeated rows count each time and are scored
alike.  A round that gathers no count (no training texts) leaves the states as
they were.  An empty table gives an empty result.  Columns besides the named
ones are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, prepare, stored, utf8, whole_text

STATES = 8
#: Words whose counts every task holds, the longest such word, and those of
#: them that are symbols by themselves.
KNOWN, LONGEST, FREQUENT = 1 << 18, 64, 28_671
CLASSES = 4096
END = FREQUENT + CLASSES
SYMBOLS = END + 1
WINDOW = 256
#: Sixteenths of the training texts that each round of Baum-Welch takes: all.
ROUNDS = (16,) * 7
#: Weight of the words' overall frequencies in each state, in tokens.
PRIOR = 200.0
_FLUSH = 400_000
_TOKENS_AT_ONCE = 1 << 21


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, A-Z read as a-z; the end token is not among them."""
    return text.lower().split()


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _class_column(word: Column) -> Column:
    tail = F.when(F.length(word) <= 3, word).otherwise(F.substring(word, F.length(word) - 2, F.lit(3)))
    return (F.crc32(tail) % CLASSES).cast("int")


def held_out(doc_id: Column) -> Column:
    """Whether the contract keeps a document out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all ``texts`` (column text); the end token is the empty
    word.  Tasks count first and flush before the counts outgrow them."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            words = pa.array(seen.keys(), pa.binary())
            return pa.RecordBatch.from_arrays([words, pa.array(seen.values(), pa.int64())], names=["word", "c"])

        for b in batches:
            texts = utf8(b, "text")
            seen[b""] += len(texts)
            for x in texts:
                seen.update(tokens(x))
                if len(seen) >= _FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Totals of the training tokens and the frequent words by rank."""

    words: list[bytes]
    counts: np.ndarray
    n_end: int
    n_tokens: int
    n_types: int
    class_tokens: np.ndarray  # of the words that are not symbols by themselves
    class_types: np.ndarray

    def symbol_counts(self) -> np.ndarray:
        out = np.zeros(SYMBOLS)
        top = self.counts[:FREQUENT]
        out[:len(top)] = top
        out[FREQUENT:END] = self.class_tokens
        out[END] = self.n_end
        return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From stored word counts.  The known words are those above the lowest
    count (in sixteenths of a power of two) that at most ``KNOWN`` words
    reach, so no task has to sort them; they are collected, with a row for
    each class, and each has at most ``LONGEST`` bytes."""
    fit = counts.filter((F.length("word") <= LONGEST) & (F.length("word") > 0)).withColumn(
        "height", F.floor(F.log2("c") * 16).cast("int"))
    height, total = None, 0
    for r in sorted(fit.groupBy("height").count().collect(), reverse=True):  # about 1,000 rows at most
        total += r["count"]
        if total > KNOWN:
            break
        height = r["height"]
    top = fit.filter(F.col("height") >= (height if height is not None else 1 << 30)).select("word", "c").toArrow()
    ranked = sorted(zip((-n for n in top["c"].to_pylist()), map(bytes, top["word"].to_pylist())))
    words, c = [w for _, w in ranked], np.array([-n for n, _ in ranked], float)
    tokens_of, types_of = np.zeros(CLASSES), np.zeros(CLASSES)
    n_end = n_tokens = n_types = 0
    rows = counts.groupBy((F.length("word") == 0).alias("end"), _class_column(F.col("word")).alias("k")).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    for r in rows:
        n_tokens, n_types = n_tokens + r["n"], n_types + r["v"]
        if r["end"]:
            n_end += r["n"]
        else:
            tokens_of[r["k"]] += r["n"]
            types_of[r["k"]] += r["v"]
    for w, n in zip(words[:FREQUENT], c):
        tokens_of[word_class(w)] -= n
        types_of[word_class(w)] -= 1
    return Vocabulary(words, c, n_end, n_tokens, n_types, tokens_of, types_of)


class Encoder:
    """Texts to symbols, with what the known words add to the base score."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n_end: int):
        self.rank = {w: i for i, w in enumerate(words)}
        self.symbol = np.array([i if i < FREQUENT else FREQUENT + word_class(w)
                                for i, w in enumerate(words)] or [0], np.uint16)
        self.gain = np.log10(np.append(counts, 0.0) + 1.0)
        self.n_end = n_end

    def encode(self, text: bytes) -> tuple:
        """(symbols, sum of log10(c + 1) over the known tokens, the same over
        those of them that are emitted through a class, number of known
        tokens, Counter of the words that are not known here)."""
        words = tokens(text)
        get = self.rank.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        sym = np.empty(len(words) + 1, np.uint16)
        sym[:-1] = self.symbol[at]
        sym[-1] = END
        away = np.flatnonzero(at < 0)
        for i in away:
            sym[i] = FREQUENT + word_class(words[i])
        known = len(words) - len(away)
        base = float(self.gain[at[at >= 0]].sum()) + float(np.log10(self.n_end + 1.0))
        classed = float(self.gain[at[at >= FREQUENT]].sum())
        return sym, base, classed, known + (self.n_end > 0), Counter(words[i] for i in away)


def encode(docs: DataFrame, encoder) -> DataFrame:
    """``docs`` (doc_id, held_out, text) with symbols (16-bit numbers)."""

    def make():
        e = Encoder(*encoder.value)

        def run(b):
            sym, base, classed, known, words, times, ends, size = [], [], [], [], [], [], [0], []
            for x in utf8(b, "text"):
                s, g, c, k, away = e.encode(x)
                sym.append(s.tobytes())
                base.append(g)
                classed.append(c)
                known.append(k)
                size.append(len(s))
                words.extend(away.keys())
                times.extend(away.values())
                ends.append(len(words))
            pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())],
                                               ["word", "n"])
            return [pa.array(size, pa.int64()), pa.array(sym, pa.binary()), pa.array(base, pa.float64()),
                    pa.array(classed, pa.float64()), pa.array(known, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]

        return run

    return map_arrow(docs, make, [("n_tokens", "long"), ("symbols", "binary"), ("base", "double"),
                                  ("classed", "double"), ("known", "long"),
                                  ("away", "array<struct<word:binary,n:long>>")], ["doc_id", "held_out"])


@dataclass
class States:
    """Start, transition (from, to) and emission (symbol, state) probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def set_up(symbol_counts: np.ndarray, states: int = STATES, seed: int = 3) -> States:
    """States that stay, each with its own random tilt of the frequencies."""
    rng = np.random.default_rng(seed)
    emit = (symbol_counts[:, None] + 1.0) * np.exp(rng.standard_normal((len(symbol_counts), states)))
    move = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(move, 0.95)
    return States(np.full(states, 1.0 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def maximise(pi: np.ndarray, xi: np.ndarray, emission: np.ndarray, symbol_counts: np.ndarray) -> States:
    """New probabilities from expected counts, all kept above zero."""
    start = pi + 1.0
    move = xi + 1.0
    prior = (symbol_counts + 1.0) / (symbol_counts + 1.0).sum() * PRIOR
    emit = emission + prior[:, None]
    return States(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _side_by_side(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length: (order, time-major symbols, how many of
    them are longer than t)."""
    size = np.array([len(s) for s in seqs])
    order = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[order], -np.arange(size.max()), side="left")
    flat = np.empty(int(size.sum()), np.uint16)
    at = np.r_[0, np.cumsum(alive)]
    for col, i in enumerate(order):  # step t of the sequence in column col is at[t] + col
        flat[at[:size[i]] + col] = seqs[i]
    return order, flat, at


def log_likelihood(seqs: list[np.ndarray], m: States) -> np.ndarray:
    """Natural log of the probability of each sequence: scaled forward
    recursion over all sequences side by side."""
    order, flat, at = _side_by_side(seqs)
    total = np.zeros(len(seqs))
    alpha = None
    for t in range(len(at) - 1):
        n = at[t + 1] - at[t]
        b = m.emit[flat[at[t]:at[t + 1]]]
        alpha = m.start * b if alpha is None else (alpha[:n] @ m.move) * b
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(seqs))
    out[order] = total
    return out


def expected_counts(seqs: list[np.ndarray], m: States) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of sequences: starts, moves and emissions."""
    k = len(m.start)
    _, flat, at = _side_by_side(seqs)
    flat, steps = flat.astype(np.intp), len(at) - 1
    b = m.emit[flat]
    alpha, inverse, ones = np.empty((len(flat), k)), np.empty((len(flat), 1)), np.ones(k)
    for t in range(steps):
        s, e = at[t], at[t + 1]
        a = alpha[s:e]
        if t:
            np.matmul(alpha[at[t - 1]:at[t - 1] + e - s], m.move, out=a)
            a *= b[s:e]
        else:
            np.multiply(m.start, b[s:e], out=a)
        np.divide(1.0, (a @ ones)[:, None], out=inverse[s:e])
        a *= inverse[s:e]
    b *= inverse
    xi, beta, back = np.zeros((k, k)), None, np.ascontiguousarray(m.move.T)
    for t in range(steps - 1, -1, -1):
        s, e = at[t], at[t + 1]
        now = np.ones((e - s, k))
        if beta is not None:
            n = len(beta)
            ahead = b[e:e + n]
            ahead *= beta
            xi += alpha[s:s + n].T @ ahead
            np.matmul(ahead, back, out=now[:n])
        beta = now
        alpha[s:e] *= beta  # from here on the posterior of the states
    emission = np.stack([np.bincount(flat, c, SYMBOLS) for c in np.ascontiguousarray(alpha.T)], axis=1)
    return alpha[:at[1]].sum(0), xi * m.move, emission


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Symbols of the texts in windows, so many at a time."""
    out, size = [], 0
    for b in batches:
        for raw in b.column("symbols").to_pylist():
            s = np.frombuffer(raw, np.uint16)
            for i in range(0, len(s), WINDOW):
                out.append(s[i:i + WINDOW])
                size += len(out[-1])
                if size >= _TOKENS_AT_ONCE // 8:
                    yield out
                    out, size = [], 0
    if out:
        yield out


def train(encoded: DataFrame, symbol_counts: np.ndarray, states: int = STATES,
          rounds: tuple[int, ...] = ROUNDS) -> States:
    """Baum-Welch over the training rows of ``encoded`` (part, symbols)."""
    spark = encoded.sparkSession
    model = set_up(symbol_counts, states)
    cols = [f"k{i}" for i in range(states)]
    for share in rounds:
        sent = spark.sparkContext.broadcast(model)

        def run(batches):
            pi, xi, em = np.zeros(states), np.zeros((states, states)), np.zeros((SYMBOLS, states))
            for seqs in _windows(batches):
                for total, x in zip((pi, xi, em), expected_counts(seqs, sent.value)):
                    total += x
            keep = np.flatnonzero(em.sum(1))
            rows = np.r_[em[keep], xi, pi[None]]
            names = np.r_[keep, SYMBOLS + np.arange(states + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), *(pa.array(rows[:, i]) for i in range(states))],
                names=["symbol", *cols])

        got = (encoded.filter(F.col("part") < share).select("symbols")
               .coalesce(spark.sparkContext.defaultParallelism)
               .mapInArrow(run, "symbol int, " + ", ".join(f"{c} double" for c in cols))
               .groupBy("symbol").agg(*(F.sum(c).alias(c) for c in cols)).toArrow())
        full = np.zeros((SYMBOLS + states + 1, states))
        if got.num_rows:
            full[got["symbol"].to_numpy()] = np.stack([got[c].to_numpy() for c in cols], axis=1)
        if full[:SYMBOLS].any():      # without counts all states would become alike, for good
            model = maximise(full[-1], full[SYMBOLS:-1], full[:SYMBOLS], symbol_counts)
        sent.unpersist()
    return model


def _likelihoods(rows: DataFrame, model, spare) -> DataFrame:
    """(row, log10 probability of the symbols and classes) of stored rows."""

    def flush(ids, seqs):
        lost = spare.value  # log10 of each class's size
        ll = log_likelihood(seqs, model.value) / np.log(10.0)
        for i, s in enumerate(seqs):
            ll[i] -= lost[s].sum()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ll)], names=["at", "likelihood"])

    def run(batches):
        ids, seqs, size = [], [], 0
        for b in batches:
            for row, raw in zip(b.column("row").to_pylist(), b.column("symbols").to_pylist()):
                ids.append(row)
                seqs.append(np.frombuffer(raw, np.uint16))
                size += len(seqs[-1])
                if size >= _TOKENS_AT_ONCE:
                    yield flush(ids, seqs)
                    ids, seqs, size = [], [], 0
        if ids:
            yield flush(ids, seqs)

    return rows.select("row", "symbols").mapInArrow(run, "at long, likelihood double")


def fit_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  held: Column | None = None, states: int = STATES,
                  rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """Train on the documents that are not ``held`` out (by default by the
    contract's rule) and score all: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score (log10)."""
    spark = prepare(docs.sparkSession)
    sc = spark.sparkContext
    src = docs.select(F.col(doc_id).alias("doc_id"),
                      (held_out(F.col(doc_id)) if held is None else held).alias("held_out"),
                      whole_text(text).alias("text"))
    counts = stored(count_words(src.filter("not held_out").select("text")), "word-counts")
    v = vocabulary(counts)
    encoder = sc.broadcast((v.words, v.counts, v.n_end))
    rows = stored(encode(src, encoder).withColumns({
        "row": F.monotonically_increasing_id(), "part": F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(16))}),
        "symbols")
    model = sc.broadcast(train(rows.filter("not held_out"), v.symbol_counts(), states, rounds))
    size = np.zeros(SYMBOLS)
    size[FREQUENT:END] = np.log10(v.class_tokens + v.class_types + 1.0)
    found = _likelihoods(rows, model, sc.broadcast(size))
    away = rows.select("row", F.explode("away").alias("w")).select("row", "w.word", "w.n")
    gains = (away.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("gain"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"))
        .withColumnRenamed("row", "away_row"))
    total = float(np.log10(v.n_tokens + v.n_types + 1.0))
    return (rows.select("row", "doc_id", "held_out", "n_tokens", "base", "classed", "known")
            .join(found, F.col("row") == F.col("at")).join(gains, F.col("row") == F.col("away_row"), "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
                    F.lit(v.n_tokens).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * total).alias("base_score"),
                    (F.col("likelihood") + F.col("classed") + F.coalesce("gain", F.lit(0.0))).alias("score")))

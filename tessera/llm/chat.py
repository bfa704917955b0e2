"""Chat formatting: roles of a transcript's lines by a hidden Markov model.

A transcript is plain text in which some lines begin with a speaker marker
("User:", "### Response:", "Q:").  The states of the model are the roles, each
at the first line of a turn or further inside it.  A line is observed through
its marker and a few features: whether it is blank or follows a blank line,
whether it asks, its length and its shape.  All probabilities are counted by
Spark over transcripts with known roles.  Viterbi recovers the states, and the
turns are rendered in one canonical form.

A conversation is cut into segments by the place of its turns in their order,
whatever their numbers: at most ``TURNS`` turns and, but for its last text,
``BYTES`` bytes.  Long conversations are ordered over many tasks, and no task
ever holds more than one segment whole.  The result is still the best path over the whole
conversation: each segment yields the best score from every state to every
state, these small tables are chained per conversation, and each segment is
decoded with the states found at its ends.  A segment's first line counts as
following a blank one.

Defined results: null text reads as empty; turns with equal numbers are
ordered by role and text; a null or unknown role reads as ``user``, and a null
conversation id is a conversation of its own.  Equal scores go to the state
that comes first.  An empty table gives an empty result.  Columns besides the
named ones are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, prepare, stored
from tessera.operators.ordering import global_prefix
from tessera.session import broadcast_if_small

ROLES = ("system", "user", "assistant")
#: Turns of a conversation, and bytes of their texts, that one task holds at most.
TURNS = 2000
BYTES = 1 << 20
#: Words that may mark a speaker; which role they mean is learned.
MARKERS = ("system", "context", "note", "user", "human", "question", "q", "instruction", "prompt", "customer",
           "assistant", "ai", "bot", "model", "response", "answer", "a", "agent")
K = 2 * len(ROLES)
_NONE, _OTHER = len(MARKERS), len(MARKERS) + 1
#: Number of values of each feature: marker, blank, after a blank line, asks, length, shape.
SIZES = (len(MARKERS) + 2, 2, 2, 2, 5, 3)
_MARKER = re.compile(r"[ \t]{0,8}(?:#{1,6}[ \t]{0,4}|<\|?|\[|\*\*)?([A-Za-z]{1,16})(?:\|?>|\]|\*\*)?[ \t]{0,4}:[ \t]?")
_LENGTHS = np.array([1, 20, 80, 200])


def features(lines: list[str]) -> np.ndarray:
    """The observed features of a segment's lines, a row each."""
    out = np.zeros((len(lines), len(SIZES)), np.int64)
    blank = True
    for i, line in enumerate(lines):
        m = _MARKER.match(line)
        word = m[1].lower() if m else None
        marker = _NONE if m is None else MARKERS.index(word) if word in MARKERS else _OTHER
        plain = line.strip()
        shape = 1 if plain[:1] in "-*+>" and plain[:1] else 2 if line[:1] in " \t" and plain else 0
        out[i] = (marker, not plain, blank, plain.endswith("?"),
                  np.searchsorted(_LENGTHS, len(plain), side="right"), shape)
        blank = not plain
    return out


class Model:
    """Logs of start, transition and emission probabilities from counts,
    each count raised by ``smooth``."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray], smooth: float = 0.1):
        def logs(x):
            x = x + smooth
            return np.log(x / x.sum(-1, keepdims=True))

        self.start, self.move, self.emit = logs(start), logs(move), [logs(e) for e in emit]
        # a turn goes on inside; inside a role comes only after that role
        self.move = self.move.copy()
        for r in range(len(ROLES)):
            for s in range(K):
                if s // 2 != r:
                    self.move[s, 2 * r + 1] = -1e9
            self.start[2 * r + 1] = -1e9

    def scores(self, lines: list[str]) -> np.ndarray:
        f = features(lines)
        return sum(self.emit[v][:, f[:, v]] for v in range(len(SIZES))).T


def transfer(model: Model, lines: list[str]) -> np.ndarray:
    """Best score to each state at the last line, from each state before the
    first and, in the last row, from the start of a conversation."""
    best = None
    for e in model.scores(lines):
        best = (np.vstack([model.move, model.start]) if best is None
                else (best[:, :, None] + model.move[None]).max(1)) + e[None]
    return best


def viterbi(model: Model, lines: list[str], before: int | None = None, at_end: int | None = None) -> list[int]:
    """The best states of the lines: after state ``before`` (None: at the
    start of a conversation) and ending in ``at_end`` (None: in any)."""
    if not lines:
        return []
    e = model.scores(lines)
    v = (model.start if before is None else model.move[before]) + e[0]
    back = np.zeros((len(lines), K), np.int64)
    for t in range(1, len(lines)):
        reach = v[:, None] + model.move
        back[t] = reach.argmax(0)
        v = reach.max(0) + e[t]
    path = [int(v.argmax()) if at_end is None else at_end]
    for t in range(len(lines) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return path[::-1]


def known_states(turns: list[tuple[str, str]]) -> tuple[list[str], list[int]]:
    """Lines and states of turns (role, text): a turn begins at its first line
    that is not blank."""
    lines, states, last = [], [], None
    for role, text in turns:
        r = ROLES.index(role) if role in ROLES else 1
        begun = False
        for line in (text or "").split("\n"):
            if not begun and not line.strip() and last is not None:
                lines.append(line)
                states.append(2 * last + 1)
            else:
                lines.append(line)
                states.append(2 * r + 1 if begun else 2 * r)
                begun, last = True, r
    return lines, states


def render(lines: list[str], states: list[int], continued: bool = False) -> str:
    """Canonical turns.  ``continued``: the first line goes on with a turn of
    the segment before."""
    turns: list[tuple[int | None, list[str]]] = [(None, [])] if continued else []
    for line, s in zip(lines, states):
        if s % 2 == 0 or not turns:
            m = _MARKER.match(line)
            turns.append((s // 2, [line[m.end():] if m else line]))
        else:
            turns[-1][1].append(line)
    out = []
    for role, body in turns:
        text = "\n".join(body).strip()
        out.append((f"<|{ROLES[role]}|>\n" if role is not None else "") + text)
    return "\n<|end|>\n".join(out)


def segments(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: Column | str = "text") -> DataFrame:
    """(conv_id, segment, turns) with up to ``TURNS`` turns each, in order."""
    t = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    src = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                       F.lower(F.col(role).cast("string")).alias("role"), t.alias("text"))
    # a turn counts as one and as its text's share of BYTES, so one sum bounds both
    src = src.withColumn("weight", 1 + F.floor(F.octet_length("text") * F.lit(TURNS) / BYTES).cast("long"))
    long = stored(src.groupBy("conv_id").agg(F.sum("weight").alias("n")).filter(F.col("n") > TURNS)
                  .select(F.col("conv_id").alias("long_id")), "long")
    if long.isEmpty():
        src = src.withColumn("segment", F.lit(0).cast("long"))
    else:
        same = F.col("conv_id").eqNullSafe(F.col("long_id"))
        rest = src.join(broadcast_if_small(long), same, "left_anti").withColumn("segment", F.lit(0).cast("long"))
        # rows that tie on all columns are alike, so any order of them will do
        tied = src.join(broadcast_if_small(long), same, "left_semi").withColumn(
            "tie", F.monotonically_increasing_id())
        placed = global_prefix(tied, ["conv_id", "turn", "role", "text", "tie"], "weight", "place")
        starts = placed.groupBy(F.col("conv_id").alias("long_id")).agg(F.min("place").alias("start"))
        placed = placed.join(broadcast_if_small(starts), same).withColumn(
            "segment", F.floor((F.col("place") - F.col("start")) / TURNS).cast("long"))
        src = rest.unionByName(placed.select(*rest.columns))
    grouped = src.groupBy("conv_id", "segment").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda x: F.struct(
        x["role"].alias("role"), x["text"].alias("text"))))


def _turns(batch: pa.RecordBatch) -> list[list[tuple[str, str]]]:
    return [[(t["role"], t["text"]) for t in row] for row in batch.column("turns").to_pylist()]


def train(known: DataFrame) -> Model:
    """Counts over segments with known roles (conv_id, segment, turns)."""

    def run(batches):
        total: dict = defaultdict(int)
        for b in batches:
            for turns in _turns(b):
                lines, states = known_states(turns)
                if not lines:
                    continue
                total["start", 0, states[0]] += 1
                for x, y in zip(states, states[1:]):
                    total["move", x, y] += 1
                for row, s in zip(features(lines).tolist(), states):
                    for v, value in enumerate(row):
                        total[f"emit{v}", s, value] += 1
        kinds = [k for k, _, _ in total]
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array([i for _, i, _ in total], pa.int32()),
             pa.array([j for _, _, j in total], pa.int32()), pa.array(total.values(), pa.int64())],
            names=["kind", "i", "j", "n"])

    start, move = np.zeros(K), np.zeros((K, K))
    emit = [np.zeros((K, n)) for n in SIZES]
    # a row for each state and feature value: a fixed number
    for r in known.mapInArrow(run, "kind string, i int, j int, n long").groupBy("kind", "i", "j").agg(
            F.sum("n").alias("n")).collect():
        if r["kind"] == "start":
            start[r["j"]] = r["n"]
        elif r["kind"] == "move":
            move[r["i"], r["j"]] = r["n"]
        else:
            emit[int(r["kind"][4:])][r["i"], r["j"]] = r["n"]
    return Model(start, move, emit)


def _ends(model, rows: DataFrame) -> DataFrame:
    """(conv_id, segment, before, at_end) of conversations of several segments:
    the states just before and at the end of each, on the best path."""
    many = (rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select(F.col("conv_id").alias("many_id")))

    def make():
        def run(b):
            return [pa.array([transfer(model.value, text.split("\n")).ravel().tolist()
                              for text in b.column("text").to_pylist()], pa.list_(pa.float64()))]

        return run

    some = rows.join(many, F.col("conv_id").eqNullSafe(F.col("many_id")), "left_semi")
    tables = map_arrow(some, make, [("table", "array<double>")], ["conv_id", "segment"])

    def chain(batch):  # one row of numbers for each segment of a conversation
        batch = batch.sort_values("segment")
        best, reach = None, []
        for t in batch["table"]:
            t = np.asarray(t).reshape(K + 1, K)
            if best is None:  # the first line starts the conversation
                reach.append(None)
                best = t[K]
            else:
                step = best[:, None] + t[:K]
                reach.append(step.argmax(0))
                best = step.max(0)
        end, ends = int(best.argmax()), []
        for r in reversed(reach):
            before = -1 if r is None else int(r[end])
            ends.append((before, end))
            end = before
        batch = batch[["conv_id", "segment"]].copy()
        batch["before"], batch["at_end"] = zip(*reversed(ends))
        return batch

    kind = dict(rows.dtypes)["conv_id"]
    return tables.groupBy("conv_id").applyInPandas(
        chain, f"conv_id {kind}, segment long, before int, at_end int")


def parse(texts: DataFrame, model: Model) -> DataFrame:
    """``texts`` (conv_id, segment, text, more columns) with ``states`` (a
    number for each line: twice the role, one more inside a turn) and the
    canonical ``rendered`` turns."""
    spark = prepare(texts.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    ends = _ends(sent, texts).select(F.col("conv_id").alias("end_id"), F.col("segment").alias("end_segment"),
                                     "before", "at_end")
    joined = texts.join(ends, F.col("conv_id").eqNullSafe(F.col("end_id"))
                        & (F.col("segment") == F.col("end_segment")), "left")

    def make():
        def run(b):
            states, out = [], []
            for text, before, at_end in zip(*(b.column(c).to_pylist() for c in ("text", "before", "at_end"))):
                lines = text.split("\n")
                s = viterbi(sent.value, lines, before if before is not None and before >= 0 else None, at_end)
                states.append(s)
                out.append(render(lines, s, bool(before is not None and before >= 0 and s[0] % 2)))
            return [pa.array(states, pa.list_(pa.int32())), pa.array(out, pa.string())]

        return run

    keep = list(texts.columns)
    return map_arrow(joined.select(*keep, "before", "at_end"), make,
                     [("states", "array<int>"), ("rendered", "string")], keep)


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """Conversation rows with speaker markers put before their texts.  The
    style depends on the conversation; the last style marks only the first two
    turns and sets the others off by a blank line."""
    style = F.pmod(F.xxhash64(F.col("conv_id").cast("string")), F.lit(4))
    role = F.coalesce(F.lower("role"), F.lit("user"))
    names = [("System", "User", "Assistant"), ("Context", "Human", "AI"), ("Note", "Q", "A"),
             ("### System", "### Instruction", "### Response")]
    marker = F.lit("")
    for i, (system, user, assistant) in enumerate(names):
        word = F.when(role == "system", system).when(role == "assistant", assistant).otherwise(user)
        marker = F.when(style == i, F.concat(word, F.lit(": "))).otherwise(marker)
    bare = (style == 3) & (F.col("turn") > 1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.withColumn("text", F.concat(F.when(bare, F.lit("\n")).otherwise(marker), text))


def format_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """Transcripts of all conversations, parsed back and rendered: conv_id,
    segment, n_lines, n_turns (recovered), true_turns, n_agree (lines whose
    recovered role is the given one), n_model (transcript lines trained on)
    and text."""
    prepare(conversations.sparkSession)
    src = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                               F.col(role).alias("role"), F.col(text).alias("text"))
    rows = stored(segments(as_transcripts(src)), "transcripts")
    model = train(rows)
    texts = rows.select("conv_id", "segment", "turns", F.array_join(
        F.transform("turns", lambda t: t["text"]), "\n").alias("text"))
    parsed = parse(texts, model)

    def make():
        def run(b):
            agree = []
            for turns, states in zip(_turns(b), b.column("states").to_pylist()):
                truth = known_states(turns)[1]
                agree.append(sum(x // 2 == y // 2 for x, y in zip(truth, states)))
            return [pa.array(agree, pa.int64())]

        return run

    out = map_arrow(parsed, make, [("n_agree", "long")], ["conv_id", "segment", "turns", "states", "rendered"])
    return out.select(
        "conv_id", "segment", F.size("states").cast("long").alias("n_lines"),
        F.size(F.filter("states", lambda s: s % 2 == 0)).cast("long").alias("n_turns"),
        F.size("turns").cast("long").alias("true_turns"), "n_agree", F.col("rendered").alias("text"))

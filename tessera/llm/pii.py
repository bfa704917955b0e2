"""Personal data by bootstrapped contextual extraction.

Base rules find e-mail addresses, IP addresses, card and phone numbers.  Those
are the seeds.  Every identifier-shaped token (white-space free, with a digit
or an @; neighbours joined by one space form one token) is an instance.  Its context is
taken from the whole text: words are runs of letters, another token stands as
one placeholder, and both ends of the text have a mark.  Its lexical patterns
are the two items before it, the two after it, one on each side, and one word
on either side alone; each holds at least one word.  Spark scores the graph of
patterns and instances in rounds: a pattern's confidence for a kind is the mean
score of its distinct instances, if seeds or scores of at least ``SUPPORT``
(``NARROW`` times that for a single word) stand behind it; an instance's score
is the noisy-or of its patterns.  Unknown instances in a pattern of high
confidence become new spans if their characters fit the kind.  Base spans stay
as they are, and a new span never overlaps one.  Everything is built from
Spark SQL functions.

Defined results: null text reads as empty, an empty text has no spans.  Rows
with a null or repeated id keep their own result row.  An empty table gives an
empty result.  Columns besides the named ones are ignored by ``find_spans``
and passed through by ``redact``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import beside, fresh, stored, whole_text
from tessera.llm.spans import SPANS, Rule, count_kind, let, matches, rule_spans, spans_text


def _digits(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", ""))


def _is_ip(hit: Column, _: Column) -> Column:
    def small(part: Column) -> Column:
        n = F.regexp_replace(part, "^0+", "")
        return (F.length(n) <= 3) & (F.coalesce(n.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(hit, r"\."), small)


def _is_card(hit: Column, _: Column) -> Column:
    n = _digits(hit)
    return F.when((n >= 14) & (n <= 19), F.call_function("luhn_check", F.regexp_replace(hit, "[ -]", ""))).otherwise(False)


#: Fixed by the contract: kinds in this order, their patterns and checks.
#: A match may start where the last one ended or at the start of a run; from
#: inside a run nothing new matches, and the loops are possessive.
RULES = [
    Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda hit, value: F.lit(True), hint=lambda t: F.contains(t, F.lit("@"))),
    Rule("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", _is_ip,
         hint=lambda t: F.contains(t, F.lit("."))),
    Rule("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", _is_card),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda hit, value: (_digits(hit) >= 10) & (_digits(hit) <= 15),
         hint=lambda t: F.contains(t, F.lit("+"))),
]
KINDS = [r.kind for r in RULES]
#: Runs of tokens with a digit or an @, separated by single spaces.
_TOKEN = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
TOKENS = rf"(?<![^\x20\x09-\x0D]){_TOKEN}(?:\x20{_TOKEN})*+"
SUPPORT = 3
#: A single word is weaker evidence, so it needs this many times the support.
NARROW = 4
CONFIDENCE = 0.8
ROUNDS = 3
#: Items of a context that are no words: both ends of the text, another token.
START, END, TOKEN = "^", "$", "#"
#: Words beside a token are looked for in this many characters first and, if
#: these hold too few, in the whole text up to the next token.
_NEAR = 96
#: What a new span of each kind must hold at least.
_FITS = [
    lambda text, digits: F.contains(text, F.lit("@")),
    lambda text, digits: (digits >= 4) & F.contains(text, F.lit(".")),
    lambda text, digits: (digits >= 12) & (digits <= 24) & ~text.rlike(r"\p{L}"),
    lambda text, digits: (digits >= 7) & (digits <= 15) & ~text.rlike(r"\p{L}"),
]


def base_spans(text: Column) -> Column:
    """Sorted array<struct<start, kind, end>> of the base rules."""
    return F.array_sort(F.concat(*(rule_spans(text, r, i) for i, r in enumerate(RULES))))


def _edge_words(piece: Column, last: bool) -> Column:
    """The last (first) two words of the text between two tokens, or fewer if
    it has no more."""

    def words(part: Column) -> Column:
        return F.filter(F.split(F.lower(F.regexp_replace(part, r"[^\p{L}\s]", " ")), r"\s+"), lambda w: w != "")

    # with a third word in sight the second is whole
    near = words(F.right(piece, F.lit(_NEAR)) if last else F.substring(piece, 1, _NEAR))
    found = let(near, lambda w: F.when((F.size(w) > 2) | (F.length(piece) <= _NEAR), w).otherwise(words(piece)))
    return let(found, _last_two) if last else F.slice(found, 1, 2)


def _last_two(items: Column) -> Column:
    return F.slice(items, F.greatest(F.size(items) - 1, F.lit(1)), 2)


def _contexts(tokens: Column) -> Column:
    """array<struct<before, after>>: the two items before and after each of
    ``tokens`` (fewer at the ends of the text), nearest to the token last and
    first."""
    n = F.size(tokens)
    pieces = F.concat(F.transform(tokens, lambda m: m["left"]), F.array(F.get(tokens, n - 1)["right"]))
    sides = F.transform(pieces, lambda x, k: F.struct(
        F.concat(F.array(F.when(k == 0, START).otherwise(TOKEN)), _edge_words(x, True)).alias("tail"),
        F.concat(_edge_words(x, False), F.array(F.when(k == n, END).otherwise(TOKEN))).alias("head")))
    none = F.array().cast("array<string>")
    return let(sides, lambda s: F.transform(tokens, lambda _, i: F.struct(
        let(F.concat(F.coalesce(F.get(s, i - 1)["tail"], none), s[i]["tail"]), _last_two).alias("before"),
        F.slice(F.concat(s[i + 1]["head"], F.coalesce(F.get(s, i + 2)["head"], none)), 1, 2).alias("after"))))


def _patterns(before: Column, after: Column) -> Column:
    """array<struct<p, narrow>>: the hashes of a context's patterns."""

    def is_word(item: Column) -> Column:
        return ~item.isin(START, END, TOKEN)

    near, next_ = F.element_at(before, -1), F.element_at(after, 1)
    kinds = [
        ("before", (F.size(before) == 2) & F.exists(before, is_word), before, False),
        ("after", (F.size(after) == 2) & F.exists(after, is_word), after, False),
        ("around", is_word(near) | is_word(next_), F.array(near, next_), False),
        ("word before", is_word(near), near, True),
        ("word after", is_word(next_), next_, True)]
    return F.filter(F.array(*(
        F.when(ok, F.struct(F.xxhash64(F.lit(kind), items).alias("p"), F.lit(narrow).alias("narrow")))
        for kind, ok, items, narrow in kinds)), lambda p: p.isNotNull())


def _candidates(text: Column) -> Column:
    """array of the identifier-shaped tokens: place, hash, patterns, whether a
    base rule matches inside, the seed kind, and the kinds that would fit."""

    def one(m: Column, context: Column) -> Column:
        core = F.regexp_extract(m["hit"], r"[\p{L}0-9+(@](?s:.*)", 0)
        core = F.regexp_replace(core, r"(?<![^\p{L}0-9)])[^\p{L}0-9)]++$", "")
        lead = F.length(m["hit"]) - F.length(F.regexp_extract(m["hit"], r"[\p{L}0-9+(@](?s:.*)", 0))
        hits = F.array(*[F.size(rule_spans(m["hit"], r, i)) > 0 for i, r in enumerate(RULES)])
        n_hit = F.size(F.filter(hits, lambda x: x))
        digits = _digits(core)
        return F.struct(
            (m["start"] + lead).alias("start"), (m["start"] + lead + F.length(core)).alias("end"),
            F.xxhash64(F.lower(core)).alias("x"),
            _patterns(context["before"], context["after"]).alias("patterns"),
            (n_hit > 0).alias("known"),
            F.when(n_hit == 1, F.array_position(hits, True) - 1).cast("int").alias("seed"),
            F.array(*[f(core, digits) for f in _FITS]).alias("fits"))

    found = let(matches(text, TOKENS), lambda tokens: F.when(tokens.isNotNull(), let(
        _contexts(tokens), lambda c: F.transform(tokens, lambda m, i: one(m, c[i])))))
    return F.filter(found, lambda c: (F.size(c["patterns"]) > 0) & (
        c["known"] | F.exists(c["fits"], lambda x: x)))


def score_patterns(edges: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(p, c0, c1, ...): the confidence of each pattern for each kind, from
    distinct ``edges`` (p, x, seed); seed is the kind of a known instance.
    Patterns that a column ``narrow`` marks need ``NARROW`` times the support."""
    k = range(len(KINDS))
    edges = edges if "narrow" in edges.columns else edges.withColumn("narrow", F.lit(False))
    need = F.when(F.col("narrow"), support * NARROW).otherwise(support)
    nodes = stored(edges.groupBy("x").agg(*(
        F.max(F.when(F.col("seed") == i, 1.0).otherwise(0.0)).alias(f"s{i}") for i in k)), "instances")
    seeds = nodes
    pairs = edges.select("p", "x", "narrow")
    for r in range(rounds):
        total = pairs.join(nodes, "x").groupBy("p").agg(
            F.max("narrow").alias("narrow"), F.count(F.lit(1)).alias("n"),
            *(F.sum(f"s{i}").alias(f"t{i}") for i in k))
        patterns = stored(total.filter(reduce(lambda a, b: a | b, [F.col(f"t{i}") >= need for i in k]))
                          .select("p", *(F.when(F.col(f"t{i}") >= need, F.col(f"t{i}") / F.col("n"))
                                         .otherwise(0.0).alias(f"c{i}") for i in k)), "patterns")
        if r + 1 < rounds:
            miss = pairs.join(patterns, "p").groupBy("x").agg(*(
                F.sum(F.log(F.lit(1.0) - F.least(F.col(f"c{i}"), F.lit(0.999)))).alias(f"m{i}") for i in k))
            nodes = stored(seeds.join(miss, "x", "left").select("x", *(
                F.greatest(F.col(f"s{i}"), F.lit(1.0) - F.exp(F.coalesce(f"m{i}", F.lit(0.0)))).alias(f"s{i}")
                for i in k)), "instances")
    return patterns


def _all_spans(rows: DataFrame, support: int, confidence: float, rounds: int) -> DataFrame:
    """(row, base, spans) from stored rows (row, base, candidates)."""
    flat = (rows.filter(F.size("candidates") > 0)
            .select("row", F.explode("candidates").alias("c")).select("row", "c.*"))
    edges = flat.select(F.explode("patterns").alias("e"), "x", F.when(F.col("known"), F.col("seed")).alias("seed"))
    edges = stored(edges.groupBy("e.p", "x").agg(F.max("seed").alias("seed"), F.max("e.narrow").alias("narrow")),
                   "pattern-instances")
    patterns = score_patterns(edges, support, rounds)
    unknown = flat.filter(~F.col("known")).select("row", "start", "end", "fits",
                                                  F.explode("patterns.p").alias("p"))
    best = [F.when(F.element_at("fits", i + 1) & (F.col(f"c{i}") >= confidence),
                   F.struct(F.col(f"c{i}").alias("c"), F.lit(-i).alias("k"))) for i in range(len(KINDS))]
    found = (unknown.join(patterns, "p")
             .withColumn("best", F.greatest(*best)).filter(F.col("best").isNotNull())
             .groupBy("row", "start", "end").agg(F.max("best").alias("best"))
             .groupBy("row").agg(F.collect_list(F.struct(
                 "start", (-F.col("best.k")).alias("kind"), "end")).alias("new")))
    found = stored(found.withColumnRenamed("row", "found_row"), "found")
    out = beside(rows.drop("candidates"), found, F.col("row") == F.col("found_row"))
    new = F.filter("new", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    return out.withColumn("spans", F.array_sort(F.concat(
        "base", F.coalesce(new, F.array().cast(SPANS))))).drop("new", "found_row")


def _scanned(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """Stored rows (row, keep, base, candidates) of documents with ``text``;
    ``row`` numbers the rows and stays as stored."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), *keep,
                              base_spans(F.col("text")).alias("base"),
                              F.coalesce(_candidates(F.col("text")), F.array()).alias("candidates")),
                  "personal-data")


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT,
               confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, spans): per document the base spans and all spans, as
    sorted arrays of struct<start, kind, end>."""
    src = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    return _all_spans(_scanned(src, [F.col("doc_id")]), support, confidence, rounds).drop("row")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the base counts, the digest of the base spans and all spans."""
    found = find_spans(docs, doc_id, text)
    return found.select(
        "doc_id", *(count_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(spans_text(F.col("base"), KINDS), 256).alias("base_sha256"),
        spans_text(F.col("spans"), KINDS).alias("spans"))


def _masked(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the tag of its
    first span."""
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh_one = F.concat(acc["out"], F.array(
            F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(tags, s["kind"] + 1)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] < acc["at"], acc["out"]).otherwise(fresh_one).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(
        F.concat_ws("", acc["out"]), F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", support: int = SUPPORT,
           confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with every span replaced by a tag such as <EMAIL>, and its
    length (if there is such a column) brought up to date.

    Texts join the spans found on their hash and length, so equal texts are
    scanned for spans alike and rows need no number."""
    names = {n: fresh(docs.columns, f"_{n}") for n in ("key", "spans", "found_key")}
    key = F.sha2(whole_text(text), 256)
    src = docs.select(key.alias("key"), whole_text(text).alias("text"))
    rows = _scanned(src, [F.col("key")])
    found = (_all_spans(rows, support, confidence, rounds).filter(F.size("spans") > 0)
             .groupBy("key").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))
             .select(F.col("key").alias(names["found_key"]),
                     F.array_distinct("spans").alias(names["spans"])))
    out = docs.withColumn(names["key"], key).join(
        found, F.col(names["key"]) == F.col(names["found_key"]), "left")
    masked = F.when(F.col(names["spans"]).isNull(), F.col(text)).otherwise(
        _masked(F.col(text), F.col(names["spans"])))
    new = out.withColumn(text, masked)
    if n_chars in docs.columns:
        new = new.withColumn(n_chars, F.when(F.col(names["spans"]).isNull(), F.col(n_chars))
                             .otherwise(F.length(text).cast(docs.schema[n_chars].dataType)))
    return new.select(*docs.columns)

"""Regular-expression matches with code-point positions, as Spark columns.

``split`` and ``regexp_extract_all`` walk the same matches, so the lengths of
the pieces between them give each match's place.  Patterns must loop without
back-tracking over groups (possessive loops), or very long texts would
overflow the stack of Java's regular expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths of matches are summed in blocks of so many, these in blocks again,
#: and so on, so a match's place takes few additions however many come before.
_BLOCK = 32
_LEVELS = 3


@dataclass(frozen=True)
class Rule:
    """A kind of span: matches of ``pattern`` that pass ``valid``, a function
    of the whole match and of ``group``.  ``hint`` is a cheap test that holds
    for every text with a match."""

    kind: str
    pattern: str
    valid: Callable[[Column, Column], Column]
    group: int = 0
    hint: Callable[[Column], Column] | None = None
    version: str = "1"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _total(lens: Column, start: Column, size: Column) -> Column:
    return F.aggregate(F.slice(lens, start, size), F.lit(0), lambda a, x: a + x)


def _with_levels(lens: Column, body: Callable[[list[Column]], Column], above: int = _LEVELS) -> Column:
    """``body`` of the list of ``lens``, their sums by blocks, the sums of those by blocks, ..."""
    if above == 0:
        return body([lens])
    sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(lens) / _BLOCK).cast("int")),
                       lambda b: _total(lens, b * _BLOCK + 1, F.lit(_BLOCK)))
    return let(sums, lambda up: _with_levels(up, lambda rest: body([lens, *rest]), above - 1))


def _before(levels: list[Column], i: Column) -> Column:
    """Sum of the first ``i`` of the lengths: whole blocks of the highest
    level, then what is left of a block on each lower one."""
    out = F.lit(0)
    for lens in levels[:-1]:
        up = F.floor(i / _BLOCK).cast("int")
        rest = (i - up * _BLOCK).cast("int")
        out = out + F.when(rest > 0, _total(lens, up * _BLOCK + 1, rest)).otherwise(0)
        i = up
    return out + F.when(i > 0, _total(levels[-1], F.lit(1), i)).otherwise(0)


def matches(text: Column, pattern: str, group: int = 0,
            hint: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, end, hit, value, left, right>> of all matches:
    places in code points (end exclusive), the whole match, its ``group``,
    and what lies between it and its neighbours."""
    p = F.lit(pattern)
    full = F.struct(F.split(text, pattern, -1).alias("parts"),
                    F.regexp_extract_all(text, p, F.lit(0)).alias("hits"),
                    F.regexp_extract_all(text, p, F.lit(group)).alias("values"))

    def place(m: Column) -> Column:
        # piece i and hit i together, so hit i starts after i of these and piece i
        lens = F.zip_with(m["parts"], m["hits"],
                          lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0)))
        return let(lens, lambda one: _with_levels(one, lambda levels: F.transform(
            m["hits"], lambda h, i: let(
                _before(levels, i) + F.length(m["parts"][i]),
                lambda at: F.struct(at.alias("start"), (at + F.length(h)).alias("end"), h.alias("hit"),
                                    m["values"][i].alias("value"), m["parts"][i].alias("left"),
                                    m["parts"][i + 1].alias("right"))))))

    some = text.rlike(pattern)
    if hint is not None:
        some = hint(text) & some
    return F.when(some, let(full, place))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind, end>> (kind: ``order``) of a rule's spans."""
    good = F.filter(matches(text, rule.pattern, rule.group, rule.hint),
                    lambda m: rule.valid(m["hit"], m["value"]))
    spans = F.transform(good, lambda m: F.struct(
        m["start"].alias("start"), F.lit(order).alias("kind"), m["end"].alias("end")))
    return F.coalesce(spans, F.array().cast(SPANS))


SPANS = "array<struct<start:int,kind:int,end:int>>"


def spans_text(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, order: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == order)).cast("long")

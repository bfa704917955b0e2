"""Column profiling (A1-A15, T1): one scan per profile, long output.

Null/inf/constant/binary profiles are a single ``agg`` over all requested
columns (partial aggregation on the map side, one tiny row to the reducer)
followed by ``inline`` into ``(attribute, ...)`` rows.  The exact summary
works on the typed long form ``(column, value)`` grouped with counts, which
shuffles only distinct pairs and never builds one ``Expand`` copy per
column; every statistic is then read from a column's distinct values.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import (finite_or_null, is_missing, is_null_or_blank,
                                      is_trimmed_blank, nan_to_null, try_double)
from tessera.operators.ordering import average_ranks

INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
FLOATING = {"float", "double"}


def _types(df: DataFrame, cols=None) -> list[tuple[str, str]]:
    d = dict(df.dtypes)
    cols = list(cols) if cols is not None else list(df.columns)
    return [(c, d[c]) for c in cols]


def _is_numeric(t: str) -> bool:
    return t in INTEGRAL or t in FLOATING or t.startswith("decimal")


def _long(agg_row: DataFrame, names: list[str], fields: dict) -> DataFrame:
    """Turn a one-row wide aggregate into one row per attribute.
    ``fields`` maps output name -> format string for the wide column name."""
    structs = [F.struct(F.lit(n).alias("attribute"),
                        *[F.col(fmt.format(i)).alias(out) for out, fmt in fields.items()])
               for i, n in enumerate(names)]
    return agg_row.select(F.inline(F.array(*structs)))


def _q(c: str):
    return F.col(f"`{c}`")


# ------------------------------------------------------------ null / inf
def _flat(c, t: str):
    """A column that can be compared and printed: maps as sorted entries."""
    return F.array_sort(F.map_entries(c)) if t.startswith("map") else c


def _text(c, t: str):
    """Text that is equal for equal values: nested values as JSON, bytes as
    hex, everything else as Spark prints it."""
    if t == "binary":
        return F.concat(F.lit("x"), F.hex(c))      # the letter keeps it from reading as a number
    if t.startswith(("array", "map", "struct")):
        return F.when(c.isNotNull(), F.to_json(F.struct(_flat(c, t).alias("v"))))
    return c.cast("string")


def _count_if(cond):
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def null_inf_counts(df: DataFrame, cols=None) -> DataFrame:
    """(attribute, n_rows, n_null, n_inf) in one pass. n_inf is null for
    non-numeric columns (the source's ``isinf`` only takes numbers)."""
    types = _types(df, cols)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, (c, t) in enumerate(types):
        aggs.append(_count_if(is_missing(_q(c), t in FLOATING)).alias(f"nn{i}"))
        if t in FLOATING:
            aggs.append(_count_if(F.abs(_q(c)) == F.lit(math.inf)).alias(f"ni{i}"))
        elif _is_numeric(t):
            aggs.append(F.lit(0).cast("long").alias(f"ni{i}"))
        else:
            aggs.append(F.lit(None).cast("long").alias(f"ni{i}"))
    wide = df.agg(*aggs)
    names = [c for c, _ in types]
    return _long(wide, names, {"n_rows": "n_rows", "n_null": "nn{}", "n_inf": "ni{}"})


def _frac_or_count(counts: DataFrame, col: str, percent: bool, out: str) -> DataFrame:
    v = F.try_divide(F.col(col), F.col("n_rows")) if percent else F.col(col)
    return counts.select("attribute", v.alias(out))


def null_profile(df: DataFrame, cols=None, sort: bool = True, percent: bool = True) -> DataFrame:
    """A4: per-column null (None/NaN) count or fraction, ascending if sort."""
    out = "null_frac" if percent else "n_null"
    res = _frac_or_count(null_inf_counts(df, cols), "n_null", percent, out)
    return res.orderBy(out, "attribute") if sort else res


def inf_profile(df: DataFrame, cols=None, sort: bool = True, percent: bool = True) -> DataFrame:
    """A5: per numeric column +-inf count or fraction."""
    types = [c for c, t in _types(df, cols) if _is_numeric(t)]
    out = "inf_frac" if percent else "n_inf"
    res = _frac_or_count(null_inf_counts(df, types), "n_inf", percent, out)
    return res.orderBy(out, "attribute") if sort else res


def null_inf_profile(df: DataFrame, cols=None, sort: bool = True,
                     percent: bool = True) -> DataFrame:
    """Both profiles from the same single aggregate."""
    c = null_inf_counts(df, cols)
    if percent:
        res = c.select("attribute", F.try_divide("n_null", "n_rows").alias("null_frac"),
                       F.try_divide("n_inf", "n_rows").alias("inf_frac"))
        key = "null_frac"
    else:
        res = c.select("attribute", "n_null", "n_inf")
        key = "n_null"
    return res.orderBy(key, "attribute") if sort else res


def null_columns(df: DataFrame, frac: float = 0.8, cols=None) -> DataFrame:
    """A2: columns whose null fraction is >= frac (inclusive)."""
    c = null_inf_counts(df, cols)
    return c.where(F.try_divide("n_null", "n_rows") >= frac) \
            .select("attribute")


# ------------------------------------------------------- constant / binary
def uninformative_columns(df: DataFrame, cols=None) -> DataFrame:
    """A1: exactly one distinct non-null value.  min == max over non-null
    values is the same test and needs no distinct at all.  All-null columns
    are not returned."""
    types = _types(df, cols)
    aggs = []
    for i, (c, t) in enumerate(types):
        v = _flat(nan_to_null(_q(c), t), t)
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    wide = df.agg(*aggs).select(*[
        (F.col(f"lo{i}").isNotNull() & (F.col(f"lo{i}") == F.col(f"hi{i}"))).alias(f"k{i}")
        for i in range(len(types))])
    return _long(wide, [c for c, _ in types], {"keep": "k{}"}) \
        .where("keep").select("attribute")


def binary_columns(df: DataFrame, cols=None) -> DataFrame:
    """A3: non-null distinct values form a subset of {0, 1}.  All-null
    columns qualify; booleans qualify; text '0'/'1' does not (the source
    compares against the numbers 0 and 1)."""
    types = _types(df, cols)
    flags = []
    for i, (c, t) in enumerate(types):
        v = nan_to_null(_q(c), t)
        if t == "boolean":
            flags.append(F.lit(0).alias(f"b{i}"))
        elif _is_numeric(t):
            flags.append(F.max(F.when(v.isNotNull() & ~v.isin(0, 1), 1)).alias(f"b{i}"))
        else:
            flags.append(F.max(F.when(v.isNotNull(), 1)).alias(f"b{i}"))
    wide = df.agg(*flags)
    return _long(wide, [c for c, _ in types], {"bad": "b{}"}) \
        .where(F.col("bad").isNull() | (F.col("bad") == 0)).select("attribute")


# ------------------------------------------------------------- summaries
def _as_text_key(c, t: str):
    """Text form for value counts of mixed columns; -0.0 folds into 0.0."""
    if t in FLOATING:
        return F.when(~F.isnan(c), (c + F.lit(0.0)).cast("string"))
    return c.cast("string")


def column_summary(df: DataFrame, cols=None) -> DataFrame:
    """A7 (exact summary): attribute, min, max, n_null, n_uniq, perc_null.

    * null = None/NaN/'' (zero and false are values);
    * min/max: float parse of non-null values; any unparsable value, or an
      infinite bound, gives a null bound;
    * n_uniq: distinct non-null values, plus one if any null/blank exists.

    One scan: every cell becomes (column, typed value) with blanks as the
    null bucket, grouped with counts (map-side combined, so only distinct
    pairs cross the network); each statistic is then a small aggregate over
    a column's distinct values.
    """
    types = _types(df, cols)
    names = [c for c, _ in types]
    nl, nd, ns = (F.lit(None).cast("long"), F.lit(None).cast("double"),
                  F.lit(None).cast("string"))
    structs = []
    for i, (c, t) in enumerate(types):
        col = _q(c)
        keep = ~is_null_or_blank(col, t)
        if t in INTEGRAL or t == "boolean":
            lv, dv, sv = col.cast("long"), nd, ns
        elif t in FLOATING:
            lv, dv, sv = nl, col.cast("double"), ns
        else:      # text, dates and times and nested values (which never parse), and
            # decimals: a column has one scale, so equal ones print alike in full
            lv, dv, sv = nl, nd, _text(col, t)
        structs.append(F.struct(F.lit(i).alias("a"), F.when(keep, lv).alias("lv"),
                                F.when(keep, dv).alias("dv"), F.when(keep, sv).alias("sv")))
    long = df.select(F.inline(F.array(*structs)))
    groups = long.groupBy("a", "lv", "dv", "sv").agg(F.count(F.lit(1)).alias("cnt"))
    present = F.col("lv").isNotNull() | F.col("dv").isNotNull() | F.col("sv").isNotNull()
    num = F.coalesce(F.col("lv").cast("double"), F.col("dv"), try_double(F.col("sv")))
    per = groups.groupBy("a").agg(
        F.sum("cnt").alias("n_rows"),
        F.sum(F.when(~present, F.col("cnt")).otherwise(0)).alias("n_null"),
        F.count(F.when(present, 1)).alias("n_distinct"),
        F.count(F.when(present & num.isNull(), 1)).alias("bad"),
        F.min(F.when(present, num)).alias("lo"), F.max(F.when(present, num)).alias("hi"))
    # every requested column gets a row, even for an empty input
    allcols = df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("a"))
    j = allcols.join(F.broadcast(per) if len(names) <= 100_000 else per, "a", "left")
    n_null = F.coalesce(F.col("n_null"), F.lit(0)).cast("long")
    ok_bounds = F.col("bad") == 0
    return j.select(
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("a") + 1).alias("attribute"),
        F.when(ok_bounds, finite_or_null(F.col("lo"))).alias("min"),
        F.when(ok_bounds, finite_or_null(F.col("hi"))).alias("max"),
        n_null.alias("n_null"),
        (F.coalesce(F.col("n_distinct"), F.lit(0)) + F.when(n_null > 0, 1).otherwise(0))
        .cast("long").alias("n_uniq"),
        F.try_divide(n_null.cast("double"), F.col("n_rows")).alias("perc_null"),
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """Label value counts, nulls included (as given, not stripped)."""
    return df.groupBy(_q(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


#: Groups of tasks whose capped sets are merged before the last merge.
MERGE_GROUPS = 1024


def set_bits(cap: int) -> int:
    """Log2 of the size up to which a capped set is exact: at least twice the
    cap, so a count past it can't read as one below the cap."""
    bits = max((2 * (cap + 1) - 1).bit_length(), 4)
    if not 1 <= cap or bits > 26:
        raise ValueError(f"cap must be between 1 and {(1 << 25) - 1}, not {cap}")
    return bits


def capped_cells(types: list[tuple[str, str]]) -> list[tuple]:
    """(blank, number, text) of each column, as the big-file summary reads
    it.  Numbers have no text; decimals have both, since theirs is exact."""
    out = []
    for c, t in types:
        if _is_numeric(t):      # booleans stay text: 'true' does not parse as a float
            out.append((_q(c).isNull(), _q(c).cast("double"),
                        _q(c).cast("string") if t.startswith("decimal") else F.lit(None).cast("string")))
        else:
            s = F.trim(_text(_q(c), t))
            out.append((is_trimmed_blank(s), try_double(s), s))
    return out


def capped_stats(blank, num, text, cap: int) -> list:
    """Aggregates of one column's cells.  The value sets are theta sketches:
    below ``2 ** set_bits(cap)`` values they hold every distinct 64-bit hash
    and count exactly; beyond it they keep the smallest hashes and no more, so
    a set takes the same bytes in a task, in the shuffle and in a stream's
    state whatever it has read.  Two of m values share a hash with a chance of
    m^2 / 2^64."""
    bits = F.lit(set_bits(cap))
    return [F.count(F.lit(1)).alias("n_rows"), _count_if(blank).alias("n_null"),
            _count_if(~blank & num.isNull()).alias("bad"),
            F.min(F.when(~blank, num)).alias("lo"), F.max(F.when(~blank, num)).alias("hi"),
            F.theta_sketch_agg(F.when(~blank, num), bits).alias("nums"),
            F.theta_sketch_agg(F.when(~blank, text), bits).alias("texts")]


def capped_result(per: DataFrame, types: list[tuple[str, str]], cap: int, estimate: str | None = None) -> DataFrame:
    """The summary from one row of ``capped_stats`` per column number ``a``;
    columns without a row (no input) get counts of zero.  ``estimate`` names a
    column for the distinct non-null values, exact to ``2 ** set_bits(cap)``."""
    names = [c for c, _ in types]
    allcols = per.sparkSession.createDataFrame(
        [(i, c, t.startswith("decimal")) for i, (c, t) in enumerate(types)], "i int, attribute string, exact boolean")
    j = allcols.join(F.broadcast(per) if len(names) <= 10_000 else per, F.col("i") == F.col("a"), "left")
    numeric = F.coalesce(F.col("bad"), F.lit(0)) == 0
    n_null = F.coalesce("n_null", F.lit(0)).cast("long")
    n = F.theta_sketch_estimate(F.when(numeric & ~F.col("exact"), F.col("nums")).otherwise(F.col("texts")))
    total = F.coalesce(n, F.lit(0)) + F.when(n_null > 0, 1).otherwise(0)
    return j.select(
        "attribute", F.when(numeric, finite_or_null(F.col("lo"))).alias("min"),
        F.when(numeric, finite_or_null(F.col("hi"))).alias("max"), n_null.alias("n_null"),
        F.when(total <= cap, total.cast("string")).otherwise(F.lit(f"> {cap}")).alias("n_uniq"),
        F.try_divide(n_null.cast("double"), F.col("n_rows")).alias("perc_null"),
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
        *([] if estimate is None else [F.coalesce(n, F.lit(0)).alias(estimate)]))


def capped_sets(df: DataFrame, cols=None, cap: int = 1000, groups: int = MERGE_GROUPS) -> DataFrame:
    """One row of ``capped_stats`` per column (number ``a``), in one scan.

    A task keeps a set per column and sends one row with all of them; ``groups``
    tasks merge those, and each column's sets meet in a task of their own, so
    no task reads more than its share of the tasks' rows."""
    types = _types(df, cols)
    bits = F.lit(set_bits(cap))
    stats = ["n_rows", "n_null", "bad", "lo", "hi", "nums", "texts"]
    aggs = [agg.alias(f"{k}{i}") for i, cell in enumerate(capped_cells(types))
            for k, agg in zip(stats, capped_stats(*cell, cap))]
    group = "group"
    while group.lower() in {c.lower() for c in df.columns}:
        group += "_"
    wide = (df.withColumn(group, F.pmod(F.spark_partition_id(), F.lit(groups)))
            .groupBy(group).agg(*aggs))
    rows = wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("a"), *[F.col(f"{k}{i}").alias(k) for k in stats]) for i in range(len(types))])))
    return rows.groupBy("a").agg(
        *[F.sum(k).cast("long").alias(k) for k in stats[:3]], F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        *[F.theta_union_agg(k, bits).alias(k) for k in stats[5:]])


def column_summary_capped(df: DataFrame, cols=None, cap: int = 1000) -> DataFrame:
    """The big-file summary.  Values are text, stripped; blank = null.

    * min/max only when every non-blank value parses as a float;
    * n_uniq over parsed values (whole column numeric) or stripped text, with
      the blank value counted once; shown as ``'> cap'`` above the cap;
    * n_rows, for the summary store.

    One scan with bounded sets (``capped_sets``): whatever a column holds, a
    task sends at most 2 ** (set_bits(cap) + 1) hashes for it.  Columns typed
    as numbers skip the text round trip (their text always parses back to the
    same number; only null is blank).
    """
    return capped_result(capped_sets(df, cols, cap), _types(df, cols), cap)


def label_counts_capped(df: DataFrame, label: str, cap: int = 1000) -> DataFrame | None:
    """Label counts of the big-file summary; ``None`` when the label has more
    than ``cap`` distinct values (as the source does), null and blank being
    values of their own.  The capped set decides before anything is grouped."""
    v = F.trim(_q(label).cast("string"))
    n = df.select(v.alias("v")).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS))).groupBy("g").agg(
        F.theta_sketch_agg("v", F.lit(set_bits(cap))).alias("s"), F.max((F.col("v") == "").cast("int")).alias("blank"),
        F.max(F.col("v").isNull().cast("int")).alias("null"))
    r = n.agg(F.theta_sketch_estimate(F.theta_union_agg("s", F.lit(set_bits(cap)))).alias("n"),
              F.max("blank").alias("blank"), F.max("null").alias("null")).first()
    if (r["n"] or 0) + (r["blank"] or 0) + (r["null"] or 0) > cap:
        return None
    return label_counts(df, label)


# ---------------------------------------------------------- value counts
def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Raw value -> count, nulls as given (map-side combined)."""
    return df.groupBy(_q(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def value_counts_long(df: DataFrame, cols) -> DataFrame:
    """A10: (attribute, value, n) for many columns at once, nulls excluded."""
    t = dict(df.dtypes)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("attribute"), _as_text_key(_q(c), t[c]).alias("value"))
        for c in cols])))
    return (long.where(F.col("value").isNotNull())
            .groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n")))


def value_index(df: DataFrame, cols) -> DataFrame:
    """The value counts of many columns as a sorted index: columns in
    their given order, then most frequent first, ties by value."""
    place = F.element_at(F.map_from_arrays(F.array(*[F.lit(c) for c in cols]),
                                           F.array(*[F.lit(i) for i in range(len(cols))])), F.col("attribute"))
    return (value_counts_long(df, cols).withColumn("_place", place)
            .orderBy("_place", F.desc("n"), "value").drop("_place"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n, frac).  The window runs over the grouped result, one
    row per class."""
    g = df.groupBy(_q(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("frac", F.col("n") / F.sum("n").over(Window.partitionBy()))


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    return df.select(_q(label).alias("label")).distinct()


def dtype_counts(df: DataFrame) -> dict[str, int]:
    """Columns per type, from metadata only."""
    out: dict[str, int] = {}
    for _, t in df.dtypes:
        out[t] = out.get(t, 0) + 1
    return out


# ---------------------------------------------------------- table equality
def _rounded(c, t: str, decimals: int):
    """Half-to-even rounding; integers and decimals in their own type, as a
    double can't hold them all."""
    return F.bround(c.cast("double") if t in FLOATING else c, decimals)


def table_equal(a: DataFrame, b: DataFrame, keys: list[str],
                decimals: int | None = None) -> DataFrame:
    """Keyed comparison -> one row (n_left, n_right, n_diff, equal).

    Both sides are tagged and unioned, then grouped by the whole row and by
    key: no join, duplicate keys never multiply, and values are compared
    themselves, not by a hash.  NaN equals NaN and null equals null; numbers
    are rounded half-to-even to ``decimals`` first when given.  Two empty
    tables are equal.
    """
    if sorted(a.columns) != sorted(b.columns):
        return a.sparkSession.createDataFrame(
            [(None, None, None, False)],
            "n_left long, n_right long, n_diff long, equal boolean")
    t = dict(a.dtypes)
    values = [c for c in a.columns if c not in keys]

    def norm(c):
        col = _q(c)
        if decimals is not None and _is_numeric(t[c]):
            return _rounded(col, t[c], decimals)
        if t[c].startswith("map"):                 # maps cannot be grouped; their sorted entries can
            return F.array_sort(F.map_entries(col))
        return col

    def tagged(df, side):
        return df.select(*[_q(k).alias(f"k{i}") for i, k in enumerate(keys)],
                         *[norm(c).alias(f"v{i}") for i, c in enumerate(values)],
                         F.lit(side).cast("long").alias("side"))

    ks = [f"k{i}" for i in range(len(keys))]
    u = tagged(a, 0).unionByName(tagged(b, 1))
    # equal rows of a key must be as many on the left as on the right
    rows = u.groupBy(*ks, *[f"v{i}" for i in range(len(values))]).agg(
        F.sum(1 - F.col("side")).alias("na"), F.sum("side").alias("nb"))
    per_key = rows.groupBy(*ks).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"),
                                    F.max(F.col("na") != F.col("nb")).alias("differs"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_key.agg(
        zero("na").alias("n_left"), zero("nb").alias("n_right"),
        _count_if(F.col("differs")).alias("n_diff")).withColumn(
        "equal", (F.col("n_left") == F.col("n_right")) & (F.col("n_diff") == 0))


# ----------------------------------------------------------- correlation
def correlation_matrix(df: DataFrame, cols=None, method: str = "pearson") -> DataFrame:
    """Long correlation matrix (a, b, corr), pairwise-complete.

    Pearson takes two passes.  The first gives each column's mean; the second
    sums, per task and in numpy, the products of the mean-shifted values, of
    their squares and of the presence flags, so every pair has its count,
    sums and squares over its common rows and the moments are numerically
    stable at any number of columns.  Only p x p sums reach the driver.  A
    constant column gives null (no division by zero under ANSI).

    Spearman correlates average ranks from a distributed rank table: a column
    is ranked once for all pairs of null-free columns, and anew over the rows
    of each column with nulls, for its pairs with the null-free ones, and over
    the common rows of each pair of columns with nulls.  Kendall is the exact
    tau-b of each pair's common rows.
    """
    cols = list(cols) if cols is not None else [c for c, t in df.dtypes if _is_numeric(t)]
    t = dict(df.dtypes)
    base = df.select(*[nan_to_null(_q(c), t[c]).cast("double").alias(c) for c in cols])
    if method == "spearman":
        return _spearman(base, cols)
    if method == "kendall":
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
        tau = _kendall_pairs(base, pairs)
        return df.sparkSession.createDataFrame(
            [(a, b, tau[a, b] if (a, b) in tau else tau[b, a]) for a in cols for b in cols],
            "a string, b string, corr double")
    if method != "pearson":
        raise ValueError("method must be 'pearson', 'spearman' or 'kendall'")
    means = base.agg(*[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return df.sparkSession.createDataFrame(_pearson(base, cols, means), "a string, b string, corr double")


def _pearson(base: DataFrame, cols: list[str], means) -> list[tuple]:
    """Rows (a, b, corr) of double columns (nulls, no NaN) in one pass."""
    from tessera.operators.elm import gram_sums
    p = len(cols)
    shifted = F.array(*[F.coalesce(_q(c) - F.lit(means[i] if means[i] is not None else 0.0),
                                   F.lit(math.nan)) for i, c in enumerate(cols)])

    def blocks(X):
        import numpy as np
        there = ~np.isnan(X)
        Z = np.where(there, X, 0.0)
        return np.hstack([Z, there.astype(float), Z * Z])

    stats = gram_sums(base.select(shifted.alias("_x")), "_x", blocks, lambda X, _: X[:, :1] * 0.0,
                      max_width=3 * p)
    rows = []
    hh = stats[0]["hh"] if stats else None
    for i in range(p):
        for j in range(p):
            r = None
            if hh is not None:
                n, sa, sb = hh[p + i, p + j], hh[i, p + j], hh[j, p + i]
                va = hh[2 * p + i, p + j] - sa * sa / n if n else 0.0
                vb = hh[2 * p + j, p + i] - sb * sb / n if n else 0.0
                if va > 0 and vb > 0:
                    r = 1.0 if i == j else float((hh[i, j] - sa * sb / n) / math.sqrt(va * vb))
            rows.append((cols[i], cols[j], r))
    return rows


def _rank_columns(base: DataFrame, cols) -> DataFrame:
    """Replace each column, free of nulls, by its average rank.  Rows stay
    whole and look their ranks up column by column: a short rank table is
    broadcast, so a value that most rows share moves no row, and only a column
    of many values is joined by a shuffle, whose hot keys AQE splits."""
    from tessera.session import broadcast_if_small, cut_lineage
    long = base.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("attribute"), _q(c).alias("value")) for i, c in enumerate(cols)])))
    ranks = cut_lineage(average_ranks(long, "attribute", "value").select("attribute", "value", "avg_rank"))
    out = base.select(*[(_q(c) + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)])   # -0.0 is 0.0
    for i in range(len(cols)):
        side = ranks.where(F.col("attribute") == i).select(F.col("value").alias("_value"), F.col("avg_rank").alias("_rank"))
        out = out.join(broadcast_if_small(side, RANKS_BYTES), F.col(f"x{i}") == F.col("_value")) \
            .withColumn(f"x{i}", F.col("_rank")).drop("_value", "_rank")
    return out.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(cols)])


#: A longer rank table of a column is not broadcast.
RANKS_BYTES = 16 << 20


def _rank_correlations(base: DataFrame, cols: list[str], n: int) -> dict:
    """Spearman of all pairs of columns without nulls, over ``n`` rows."""
    if not n:
        return {(a, b): None for a in cols for b in cols}
    mean = [(n + 1) / 2] * len(cols)                # of the ranks of n rows
    return {(a, b): r for a, b, r in _pearson(_rank_columns(base, cols), cols, mean)}


def _spearman(base: DataFrame, cols: list[str]) -> DataFrame:
    """Long Spearman matrix of double columns (nulls, no NaN)."""
    counts = base.agg(F.count(F.lit(1)).alias("n"),
                      *[F.count(_q(c)).alias(f"k{i}") for i, c in enumerate(cols)]).first()
    full = [c for i, c in enumerate(cols) if counts[f"k{i}"] == counts["n"]]
    rows = {}
    if len(full) > 1:
        rows = _rank_correlations(base.select(*map(_q, full)), full, counts["n"])
    for i, c in enumerate(cols):
        if full and c not in full:
            # the pairs of c with null-free columns share their rows
            of = [*full, c]
            found = _rank_correlations(base.where(_q(c).isNotNull()).select(*map(_q, of)), of, counts[f"k{i}"])
            rows |= {k: r for k, r in found.items() if c in k}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:] if (a, b) not in rows]
    if pairs:
        rows |= _spearman_pairs(base, pairs)
    out = [(a, b, rows[a, b] if (a, b) in rows else rows[b, a]) for a in cols for b in cols]
    return base.sparkSession.createDataFrame(out, "a string, b string, corr double")


def _pair_cells(base: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Written counts m of (pair, x, y) over the rows where both have a value."""
    from tessera.session import cut_lineage
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), (_q(a) + F.lit(0.0)).alias("x"),
                               (_q(b) + F.lit(0.0)).alias("y")) for i, (a, b) in enumerate(pairs)])
    return cut_lineage(base.select(F.inline(cells)).where("x is not null and y is not null")
                       .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("m")))


def _with_pair_ranks(cells: DataFrame) -> DataFrame:
    """``cells`` with the average ranks rx and ry of their values in the pair."""
    ranks = average_ranks(cells.select(F.inline(F.array(
        F.struct((2 * F.col("pair")).alias("side"), F.col("x").alias("value"), "m"),
        F.struct((2 * F.col("pair") + 1).alias("side"), F.col("y").alias("value"), "m")))),
        "side", "value", weight="m")
    rx = ranks.where("side % 2 = 0").select((F.col("side") / 2).cast("int").alias("pair"),
                                            F.col("value").alias("x"), F.col("avg_rank").alias("rx"))
    ry = ranks.where("side % 2 = 1").select(((F.col("side") - 1) / 2).cast("int").alias("pair"),
                                            F.col("value").alias("y"), F.col("avg_rank").alias("ry"))
    return cells.join(rx, ["pair", "x"]).join(ry, ["pair", "y"])


def _spearman_pairs(base: DataFrame, pairs: list[tuple[str, str]]) -> dict:
    """Spearman of each pair over the rows where both have a value."""
    cells = _pair_cells(base, pairs)
    # ranks of a pair of n rows centre on (n + 1) / 2
    n = cells.groupBy("pair").agg(F.sum("m").alias("n"))
    j = _with_pair_ranks(cells).join(F.broadcast(n), "pair")
    u, v, m = F.col("rx") - (F.col("n") + 1) / 2, F.col("ry") - (F.col("n") + 1) / 2, F.col("m")
    sums = j.groupBy("pair").agg(F.sum(m * u * v).alias("uv"), F.sum(m * u * u).alias("uu"),
                                 F.sum(m * v * v).alias("vv")).collect()  # one row per pair of columns
    out = {p: None for p in pairs}
    for r in sums:
        if r["uu"] > 0 and r["vv"] > 0:
            out[pairs[r["pair"]]] = r["uv"] / math.sqrt(r["uu"] * r["vv"])
    return out


def _kendall_pairs(base: DataFrame, pairs: list[tuple[str, str]]) -> dict:
    """Kendall's tau-b of each pair without comparing rows with each other.

    A discordant pair of rows has x before and y after.  Their y ranks first
    differ in one bit, so they meet in one group of the bits above it, the
    earlier row with a 1 and the later one with a 0.  Rows go once into each
    of the log2(n) groups, and a running count in the order of x gives the
    1s before every 0; it is summed across tasks by ``global_prefix``."""
    from tessera.operators.ordering import global_prefix
    from tessera.session import cut_lineage
    cells = _pair_cells(base, pairs)
    choose = lambda c: F.sum((F.col(c) * (F.col(c) - 1) / 2).cast("decimal(38,1)"))
    ranked = cut_lineage(_with_pair_ranks(cells).select(
        "pair", (2 * F.col("rx")).cast("long").alias("rx"), (2 * F.col("ry")).cast("long").alias("ry"), "m"))
    total = {r["pair"]: r for r in ranked.groupBy("pair").agg(
        F.sum("m").alias("n"), choose("m").alias("both"), F.max("ry").alias("top")).collect()}
    ties = {}
    for side in ("rx", "ry"):
        sizes = ranked.groupBy("pair", side).agg(F.sum("m").alias("k"))
        ties[side] = {r["pair"]: r["t"] for r in sizes.groupBy("pair").agg(choose("k").alias("t")).collect()}
    levels = max((r["top"].bit_length() for r in total.values()), default=1)
    bits = ranked.withColumn("b", F.explode(F.array(*[F.lit(i) for i in range(levels)])))
    one = F.expr("shiftright(ry, b) & 1")
    groups = bits.groupBy("pair", "b", F.expr("shiftright(ry, b + 1)").alias("g"), "rx").agg(
        F.sum(F.when(one == 1, F.col("m")).otherwise(0)).alias("ones"),
        F.sum(F.when(one == 0, F.col("m")).otherwise(0)).alias("zeros"))
    before = global_prefix(groups, ["pair", "b", "g", "rx"], weight="ones", out_col="before")
    per_group = before.groupBy("pair", "b", "g").agg(
        F.sum((F.col("zeros") * F.col("before")).cast("decimal(38,0)")).alias("reach"),
        F.sum("zeros").alias("zeros"), F.min("before").alias("start"))
    swapped = {r["pair"]: r["d"] for r in per_group.groupBy("pair").agg(F.sum(
        F.col("reach") - (F.col("zeros") * F.col("start")).cast("decimal(38,0)")).alias("d")).collect()}
    out = {p: None for p in pairs}
    for i, r in total.items():
        n0 = r["n"] * (r["n"] - 1) // 2
        nx, ny, nxy, d = (int(v) for v in (ties["rx"][i], ties["ry"][i], r["both"], swapped.get(i, 0)))
        if n0 > nx and n0 > ny:
            c = n0 - nx - ny + nxy - d
            out[pairs[i]] = (c - d) / (math.sqrt(n0 - nx) * math.sqrt(n0 - ny))
    return out


def feature_clusters(df: DataFrame, cols=None, thresh: float = 0.95,
                     method: str = "pearson") -> DataFrame:
    """Clusters of columns joined by ``corr >= thresh`` (signed, so two
    opposite columns do not cluster).  Output (cluster, attribute); clusters
    are numbered in first-seen column order.  Only the p x p matrix reaches
    the driver; a constant column is its own cluster."""
    cols = list(cols) if cols is not None else [c for c, t in df.dtypes if _is_numeric(t)]
    corr = correlation_matrix(df, cols, method).where(
        (F.col("a") != F.col("b")) & (F.col("corr") >= thresh)).collect()
    adj = {c: set() for c in cols}
    for r in corr:
        adj[r["a"]].add(r["b"])
    assigned, rows = {}, []
    for c in cols:
        if c in assigned:
            continue
        k = len(set(assigned.values()))
        queue = deque([c])
        assigned[c] = k
        while queue:
            n = queue.popleft()
            for m in sorted(adj[n]):
                if m not in assigned:
                    assigned[m] = k
                    queue.append(m)
    rows = [(assigned[c], c) for c in cols]
    return df.sparkSession.createDataFrame(rows, "cluster int, attribute string")


def important_features(clusters: DataFrame, ranking: DataFrame) -> DataFrame:
    """Walk features in importance order and keep the first one of
    each cluster.  ``ranking`` is (attribute, importance); output
    (attribute, rank, cluster) with rank 1 = most important overall."""
    ranked = ranking.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("importance"), "attribute")))
    first = Window.partitionBy("cluster").orderBy("rank")
    return (ranked.join(clusters, "attribute")
            .withColumn("_k", F.row_number().over(first))
            .where(F.col("_k") == 1).select("attribute", "rank", "cluster"))


def table_equal_unkeyed(a: DataFrame, b: DataFrame, decimals: int | None = None) -> DataFrame:
    """A12 without a key: multiset difference both ways (``exceptAll``),
    after the same optional half-even rounding of numbers.  One row
    (n_left, n_right, n_only_left, n_only_right, equal).  NaN equals NaN
    (Spark groups NaN with NaN)."""
    if sorted(a.columns) != sorted(b.columns):
        return a.sparkSession.createDataFrame(
            [(None, None, None, None, False)],
            "n_left long, n_right long, n_only_left long, n_only_right long, equal boolean")
    t = dict(a.dtypes)
    cols = sorted(a.columns)

    def norm(df):
        return df.select(*[(_rounded(_q(c), t[c], decimals) if decimals is not None
                            and _is_numeric(t[c]) else _q(c)).alias(c) for c in cols])
    na, nb = norm(a), norm(b)
    only_a = na.exceptAll(nb).count()
    only_b = nb.exceptAll(na).count()
    n_left, n_right = a.count(), b.count()
    return a.sparkSession.createDataFrame(
        [(n_left, n_right, only_a, only_b, n_left == n_right and only_a == 0 and only_b == 0)],
        "n_left long, n_right long, n_only_left long, n_only_right long, equal boolean")

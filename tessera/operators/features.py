"""Engineered features (P5-P20): projections only, no shuffles.

Global statistics needed by a projection (min/max for a stretch) come from a
one-row aggregate whose values are inlined as literals -- a bounded, single
row, never a join against the data.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import nan_to_null
from tessera.operators.ordering import global_positions


def pairwise_features(df: DataFrame, cols, kinds=("sum", "abs_diff"),
                      sep: str = "_") -> DataFrame:
    """P9 generator over column pairs: ``a+b`` (sum), ``|a+b|`` (abs_sum),
    ``|a-b|`` (abs_diff)."""
    exprs = []
    for a, b in combinations(cols, 2):
        ca, cb = F.col(a), F.col(b)
        for k in kinds:
            if k == "sum":
                e = ca + cb
            elif k == "abs_sum":
                e = F.abs(ca + cb)
            elif k == "abs_diff":
                e = F.abs(ca - cb)
            elif k == "diff":
                e = ca - cb
            else:
                raise ValueError(f"unknown pair feature {k!r}")
            exprs.append(e.alias(f"{a}{sep}{b}{sep}{k}"))
    return df.select("*", *exprs)


def datetime_features(df: DataFrame, ts_col: str, base_year: int = 2011) -> DataFrame:
    """Weekday (Monday = 0), hour, year - base_year, day of month."""
    ts = F.col(ts_col)
    return df.select("*", F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour"),
                     (F.year(ts) - base_year).alias("year_off"),
                     F.dayofmonth(ts).alias("day"))


def column_range(df: DataFrame, col: str) -> tuple:
    """One-row aggregate -> (min, max) on the driver (two numbers)."""
    x = nan_to_null(F.col(f"`{col}`"), dict(df.dtypes)[col])
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    return r["lo"], r["hi"]


def minmax_stretch(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(p - min) / (max - min) over the whole column; null when the
    column is constant (max == min), not an error."""
    lo, hi = column_range(df, col)
    out = out or f"{col}_stretch"
    if lo is None or hi is None or hi == lo:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, (F.col(f"`{col}`") - F.lit(float(lo))) / F.lit(float(hi - lo)))


def linear_combination(a: str, b: str, weight: float = 1.0) -> Column:
    """A - weight * b."""
    return F.col(a) - F.lit(weight) * F.col(b)


def to_features(df: DataFrame, exclude, vector_col: str = "features") -> DataFrame:
    """Every column but ``exclude`` assembled into one vector."""
    from pyspark.ml.feature import VectorAssembler
    cols = [c for c in df.columns if c not in set(exclude)]
    return VectorAssembler(inputCols=cols, outputCol=vector_col,
                           handleInvalid="keep").transform(df)


def generated_columns(prefix: str, n: int, start: int = 1) -> list[str]:
    """Names ``prefix1..prefixN`` (e.g. feat_1..feat_90) for a select."""
    return [f"{prefix}{i}" for i in range(start, start + n)]


def positional_columns(df: DataFrame, start: int, stop: int | None = None) -> list[str]:
    """Columns by position (label = column 0, features = the rest)."""
    return df.columns[start:stop]


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns); the row count is one distributed count."""
    return df.count(), len(df.columns)


def shuffle_rows(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A seeded row order from a hash of the key (independent of
    partitioning); rarely needed, since nothing depends on row order."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))


#: Bits of the order value that a round of ``sample_rows`` splits by, and the
#: rows at the threshold from which they are numbered.
ROUND_BITS, FEW_ROWS = 12, 100_000


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Exactly n rows without replacement (all if there are fewer), those
    first in a hash order of the key; ``order`` replaces the hash by a long
    from 0 to 2^63 - 1.

    Rounds count the rows of 4,096 ranges of the order value, each inside the
    range where the n-th row lies, until that range holds few rows.  Rows
    below it are taken by a filter, and only those inside it are numbered, over
    many tasks; so no task holds the sample, whatever n is.  Rows that tie are
    ordered by key, then by a hash of all columns."""
    h = F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`"), F.lit(seed)), 1) if order is None else order
    if n <= 0:
        return df.where(F.lit(False))
    bits, prefix, taken = 0, 0, 0
    while True:
        here = h.isNotNull() if not bits else F.shiftright(h, 63 - bits) == prefix
        more = min(63, bits + ROUND_BITS)
        counts = df.where(here).groupBy(F.shiftright(h, 63 - more).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        for p, count in sorted(map(tuple, counts.collect())):       # at most 2^ROUND_BITS rows
            if taken + count >= n:
                bits, prefix = more, p
                break
            taken += count
        else:
            return df if not bits else df.where(F.shiftright(h, 63 - bits) <= prefix)
        if count <= FEW_ROWS or bits == 63 or taken + count == n:
            break
    at = F.shiftright(h, 63 - bits)
    if taken + count == n:
        return df.where(at <= prefix)
    place = "place"
    while place.lower() in {c.lower() for c in df.columns}:
        place += "_"
    names = [f"{place}_{i}" for i in range(3)]
    edge = df.where(at == prefix).withColumns({names[0]: h, names[1]: F.col(f"`{key}`"), names[2]: F.xxhash64(*[f"`{c}`" for c in df.columns])})
    last = global_positions(edge, names, place).where(F.col(place) < n - taken).select(*[f"`{c}`" for c in df.columns])
    return df.where(at < prefix).unionByName(last)


def feature_union(df: DataFrame, array_cols, out: str = "union") -> DataFrame:
    """Concatenate the outputs of several transformers (array columns)."""
    return df.withColumn(out, F.concat(*[F.col(c).cast("array<double>") for c in array_cols]))

"""Splits and fold assignment.

Fold numbers are exact per class (class shares differ by at most one row)
and come from distributed global offsets, never from a window partitioned by
the class label: a class holding a third of all rows is still spread over
all tasks.  Randomness is a hash of the key and a seed, so the assignment is
independent of partitioning and of executor loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import within_group_numbers
from tessera.session import broadcast_if_small


def hash_order(key: str, seed: int = 0) -> Column:
    """Deterministic pseudo-random order of rows."""
    return F.xxhash64(F.col(key), F.lit(seed))


def _attach(df: DataFrame, key: str, narrow: DataFrame, cols) -> DataFrame:
    """Join per-key results computed on a narrow projection back to the full
    rows (null-safe on the key; Spark broadcasts the result if its measured
    size allows).  Wide rows cross the network once, never checkpointed.  Rows
    that share a key (null is one too) share the least of their results, so
    none is multiplied."""
    side = narrow.select(F.col(key).alias("_k"), *cols)
    side = side.groupBy("_k").agg(*[F.min(c).alias(c) for c in side.columns[1:]])
    return df.join(side, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 10,
                     order: Column | None = None, out: str = "fold") -> DataFrame:
    """fold = (position of the row inside its class) mod k, positions
    taken in ``order`` (default: the key).  With unique keys each fold holds
    floor or ceil of class_size / k rows of every class; rows that repeat a
    key all go to one fold.  Positions
    are computed on (key, label, order) only."""
    if k < 2:
        raise ValueError("k must be >= 2")
    o = order if order is not None else F.col(key)
    narrow = df.select(key, label, o.alias("_ord"))
    numbered = within_group_numbers(narrow, [label], ["_ord", key], out_col="_rn")
    return _attach(df, key, numbered, [(F.col("_rn") % k).cast("int").alias(out)])


def stratified_holdout(df: DataFrame, key: str, label: str, train_frac: float = 0.15,
                       order: Column | None = None, out: str = "is_train") -> DataFrame:
    """Per class, the first floor(train_frac * class_size) rows in
    (hash) order are training rows (computed on the narrow projection)."""
    o = order if order is not None else hash_order(key)
    narrow = df.select(key, label, o.alias("_ord"))
    numbered = within_group_numbers(narrow, [label], ["_ord", key], out_col="_rn")
    sizes = narrow.groupBy(F.col(label).alias("_lab")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per class; null is a class too, so the join is null-safe
    flagged = (numbered.join(broadcast_if_small(sizes), F.col(label).eqNullSafe(F.col("_lab")))
               .withColumn(out, (F.col("_rn") + 1) <= F.floor(F.col("_n") * train_frac)))
    return _attach(df, key, flagged, [out])


def holdout_split(df: DataFrame, key: str, test_frac: float, seed: int = 0,
                  bucket: Column | None = None, out: str = "is_test") -> DataFrame:
    """V4: random hold-out of the given share by the key's hash, compared
    with the share at full precision.  ``bucket`` (0 to 999) replaces it."""
    if bucket is not None:
        return df.withColumn(out, bucket < F.lit(test_frac * 1000))
    u = F.shiftrightunsigned(hash_order(key, seed), 11).cast("double") / float(1 << 53)
    return df.withColumn(out, u < F.lit(float(test_frac)))


def repeated_holdout(df: DataFrame, key: str, test_frac: float = 0.3, n: int = 4):
    """V5: n hold-out splits with seeds 0, 4, 8, ... (one column per repeat)."""
    out = df
    for i in range(n):
        out = holdout_split(out, key, test_frac, seed=4 * i, out=f"is_test_{i}")
    return out


def blocked_day_folds(start: int = 10, stop: int = 18) -> list[tuple[int, tuple[int, int]]]:
    """V6: fold d tests on days (d, d+1) for d in start..stop."""
    return [(d, (d, d + 1)) for d in range(start, stop + 1)]


def blocked_day_masks(day: Column, start: int = 10, stop: int = 18):
    """(fold, test mask) pairs for filtering one DataFrame per fold."""
    return [(d, day.isin(a, b)) for d, (a, b) in blocked_day_folds(start, stop)]

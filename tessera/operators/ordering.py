"""Global order statistics without single-partition windows.

A window with no ``partitionBy`` (or one partitioned by a low-cardinality key
such as a class label) moves a whole column into one task.  These helpers
compute exact global positions the way ``zipWithIndex`` does: range-partition
on the order, count each range, turn the (tiny) per-range totals into
offsets, and add a running count inside each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import broadcast_if_small, cut_lineage


def global_prefix(df: DataFrame, order_cols: list, weight: str | None = None,
                  out_col: str = "_prefix", partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = sum of ``weight`` (1 per row when None) over all rows
    strictly before this one in the global order of ``order_cols``.

    The order must be total (include a unique key) for a deterministic result.
    """
    w_expr = F.lit(1).cast("long") if weight is None else F.col(weight)
    staged = df.withColumn("_w", w_expr)
    # without an explicit count AQE may merge adjacent small ranges (order is
    # kept); the checkpoint below pins whatever partitioning it chose
    staged = (staged.repartitionByRange(partitions, *order_cols) if partitions
              else staged.repartitionByRange(*order_cols))
    ranged = staged.withColumn("_pid", F.spark_partition_id())
    # Pin the range assignment: the same partition ids must be seen by the
    # totals and by the rows, whatever AQE later does to the shuffle.
    ranged = cut_lineage(ranged)
    totals = ranged.groupBy("_pid").agg(F.sum("_w").alias("_tot"))
    # one row per range partition -> bounded by n_parts, safe to broadcast
    offsets = totals.withColumn(
        "_off", F.coalesce(F.sum("_tot").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, -1)
    return (ranged.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
            .withColumn(out_col, F.col("_off") + F.coalesce(F.sum("_w").over(local), F.lit(0)))
            .drop("_pid", "_off", "_w"))


def global_positions(df: DataFrame, order_cols: list, out_col: str) -> DataFrame:
    """Add ``out_col``: the row's zero-based place in the global order of
    ``order_cols``, which must include a unique key to be repeatable.

    One range shuffle, one sort inside the ranges and one written table;
    ``monotonically_increasing_id`` then numbers the rows of each range, and
    the sizes of the ranges (a row per partition) give the offsets."""
    numbered = cut_lineage(df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
                           .withColumn("_at", F.monotonically_increasing_id()))
    low = (1 << 33) - 1
    sizes = numbered.groupBy(F.shiftright("_at", 33).alias("_pid")).agg(F.max(F.col("_at").bitwiseAND(low)).alias("last"))
    offset, offsets = 0, {}
    for r in sorted(sizes.collect()):            # one row per range partition
        offsets[r["_pid"]] = offset
        offset += r["last"] + 1
    side = df.sparkSession.createDataFrame(list(offsets.items()), "_pid long, _off long")
    return (numbered.withColumn("_pid", F.shiftright("_at", 33)).join(F.broadcast(side), "_pid")
            .withColumn(out_col, F.col("_off") + F.col("_at").bitwiseAND(low)).drop("_pid", "_off", "_at"))


def row_numbers(df: DataFrame, order_cols: list, out_col: str = "row_id",
                start: int = 1) -> DataFrame:
    """Consecutive ids ``start..start+n-1`` in an explicit order.
    Rows that tie on the order are told apart by a hash of all columns."""
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    return global_positions(tied, [*order_cols, "_tie"], "_p").withColumn(
        out_col, (F.col("_p") + start).cast("long")).drop("_p", "_tie")


def within_group_numbers(df: DataFrame, group_cols: list, order_cols: list,
                         out_col: str = "rn") -> DataFrame:
    """Zero-based row number inside each group, in ``order_cols`` order.

    Equivalent to ``row_number() over (partition by group order by ..) - 1``
    but a hot group is spread over many tasks: the place in the global order
    of (group, order) minus the place of the group's first row (one row per
    group).
    """
    numbered = global_positions(df, [*group_cols, *order_cols], "_g")
    starts = numbered.groupBy(*[F.col(c).alias(f"_s_{c}") for c in group_cols]).agg(F.min("_g").alias("_start"))
    cond = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in group_cols]   # null is a group too
    return (numbered.join(broadcast_if_small(starts), cond)
            .withColumn(out_col, (F.col("_g") - F.col("_start")).cast("long"))
            .drop("_g", "_start", *[f"_s_{c}" for c in group_cols]))


def average_ranks(long_df: DataFrame, group_col: str, value_col: str,
                  out_col: str = "avg_rank", weight: str | None = None) -> DataFrame:
    """Average (fractional) rank of each distinct value inside each group,
    1-based, ties share ``first + (ties-1)/2``.  Input is long form
    ``(group, value, ...)``; output is ``(group, value, n, avg_rank)`` with
    one row per distinct value (nulls excluded).  ``weight`` names a column
    that says how many rows a row stands for."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = (long_df.where(F.col(value_col).isNotNull())
              .groupBy(group_col, value_col).agg(n.alias("n")))
    pref = global_prefix(counts, [group_col, value_col], weight="n", out_col="_before")
    # rows of earlier groups are subtracted with a per-group offset (one
    # row per group, e.g. per column of a rank correlation)
    sizes = counts.groupBy(group_col).agg(F.sum("n").alias("_gn"))
    first = global_prefix(sizes, [group_col], weight="_gn", out_col="_gstart").drop("_gn")
    return (pref.join(broadcast_if_small(first), group_col)
            .withColumn(out_col, (F.col("_before") - F.col("_gstart")).cast("double")
                        + (F.col("n") + 1) / 2.0)
            .drop("_before", "_gstart"))

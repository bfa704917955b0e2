"""Connected components and bounded candidate groups as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import beside, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest
    node that can be reached.

    Large-star and small-star rounds (each node's larger neighbours, then its
    smaller ones, move to its smallest) until the edges no longer change;
    hubs are pre-aggregated by ``min`` and their joins split by AQE.  Each
    round is written below spark.checkpoint.dir."""
    flat = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now, before = stored(flat.filter("a < b").distinct(), "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (both.filter("b > a").join(least, "a")
                 .select(F.col("m").alias("a"), "b").filter("a < b").distinct())
        # large: a is the smaller end; every b moves to its smallest neighbour
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(small, "b")
        now = stored(joined.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")
                     .unionByName(small.select(F.col("m").alias("a"), "b")).distinct(), "edges")
    # only stars are left: every b hangs on its root
    return (now.select(F.col("b").alias("node"), F.col("a").alias("root"))
            .unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()))


def in_units(rows: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """Rows dealt to units of bounded size, sorted by unit in each partition.

    A key with up to ``most`` rows is one unit.  A larger key is cut into
    parts by a hash of ``item``, with a unit for each pair of parts, so every
    two rows of a key still meet, and no task holds the whole key.  Added
    columns: ``unit`` (long), ``part`` and ``same`` (the unit is one part
    with itself; elsewhere only rows of different parts are to be compared)."""
    hot = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
                 .select(F.col(key).alias("hot_key"), F.ceil(F.col("n") / most).alias("parts")), "hot")
    if hot.isEmpty():
        dealt = rows.select("*", F.col(key).alias("unit"), F.lit(0).alias("part"),
                            F.lit(True).alias("same"))
    else:
        full = beside(rows, hot, F.col(key) == F.col("hot_key"))
        full = full.withColumn("parts", F.coalesce("parts", F.lit(1)))
        full = full.withColumn("part", F.pmod(F.xxhash64(item, F.lit(7)), F.col("parts")).cast("int"))
        full = full.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
        dealt = full.withColumns({
            "unit": F.when(F.col("parts") > 1, F.xxhash64(key, F.least("part", "other"),
                                                          F.greatest("part", "other")))
                     .otherwise(F.col(key)),
            "same": F.col("part") == F.col("other")}).drop("hot_key", "parts", "other")
    return dealt.repartition("unit").sortWithinPartitions("unit")


def whole_units(batches: Iterator[pa.RecordBatch], unit: str = "unit") -> Iterator[pa.Table]:
    """Regroup sorted batches so that no unit is cut."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        u = t[unit].to_numpy()
        cut = int(np.searchsorted(u, u[-1]))  # sorted by unit
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest

"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of copies of its documents that brings its
share of all text (code points, plus one for each document) to its weight.  A
document's count is a Poisson variable of that mean: a number in (0, 1) hashed
from a seed and the document's id goes through the inverse of the source's
distribution.  The counts are written once with their documents.  Each document
is exploded by its count, one of many copies in runs of ``RUN`` that are dealt
over all tasks first; the copies are then sorted by a hash, which shuffles them
globally.  Everything is built from Spark SQL functions; no state or random
generator is involved, so a lost task draws the same counts again.

Defined results: a null source is a source of its own (``None`` among the
weights).  A source without a weight, or with weight 0, has rate 0.  Without
weights every source weighs the same.  A null id is replaced by the digest of
the text; rows with one id draw the same count.  Null and empty texts count as
one code point.  An empty table gives an empty result.  All columns pass
through, whatever their names, but for one that has the name asked for the
number of the copy or for its hash: name these otherwise to keep it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import beside, fresh, stored, whole_text

SEED = 20240607
#: Larger means are drawn as sums of Poisson variables with means up to this.
PART = 32.0
BITS = 52
#: Copies of a document that one task makes from one row.
RUN = 256


def hashed(*parts: Column) -> Column:
    """A long of 52 bits from the MD5 of the parts, joined by |."""
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None,
                 total: int | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """(source, size, rate): per source its code points (one more for each
    document) and the mean number of copies of its documents.  ``total`` is
    the wanted size of the mixture, by default that of the input."""
    sizes = stored(docs.groupBy(F.col(source).cast("string").alias("source"))
                   .agg(F.sum(F.length(whole_text(text)) + 1).cast("long").alias("size")), "sizes")
    if weights is None:
        w = F.lit(1.0)
    else:
        w = F.lit(0.0)
        for k, v in weights.items():
            if not (v >= 0 and math.isfinite(v)):
                raise ValueError(f"weight of {k!r} must be a finite number of at least 0")
            w = F.when(F.col("source").eqNullSafe(F.lit(k)), float(v)).otherwise(w)
    sizes = sizes.withColumn("weight", w)
    sums = sizes.agg(F.sum("weight").alias("w"), F.sum("size").alias("s")).first()
    scale = float(total if total is not None else sums["s"] or 0) / float(sums["w"] or 1.0)
    return sizes.select("source", "size", (F.col("weight") * scale / F.col("size")).alias("rate"))


def poisson_cdf(mean: Column) -> Column:
    """array of P(X <= 0), P(X <= 1), ... until the rest is below 2**-53."""
    last = F.ceil(mean + 10.0 * F.sqrt(mean) + 24.0).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"),
                        F.concat(acc["all"], F.array(acc["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def drawn(key: Column, parts: Column, cdf: Column, seed: int = SEED) -> Column:
    """The count of a document: one inversion for each part of its mean."""

    def draw(part: Column) -> Column:
        u = (hashed(F.lit(seed), part, key) + 0.5) / float(2 ** BITS)
        return F.size(F.filter(cdf, lambda c: c <= u))

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda a, part: a + draw(part))


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None,
              doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED,
              copy: str = "copy", order_key: str = "order_key") -> DataFrame:
    """The copies of ``docs`` in their shuffled order, with the number of each
    copy (from 1) and the hash that orders them."""
    names, taken = {}, [*docs.columns, copy, order_key]
    for n in ("rate", "parts", "cdf", "key", "count", "run", "rate_source"):
        names[n] = fresh([*taken, *names.values()], f"_{n}")
    c = {k: F.col(v) for k, v in names.items()}
    rates = source_rates(docs, weights, total, source, text)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    side = stored(rates.select(F.col("source").alias(names["rate_source"]), F.col("rate").alias(names["rate"]),
                               parts.alias(names["parts"]),
                               poisson_cdf(F.col("rate") / parts).alias(names["cdf"])), "rates")
    keep = ["`" + x.replace("`", "``") + "`" for x in docs.columns
            if x.lower() not in (copy.lower(), order_key.lower())]
    out = beside(docs, side, F.col(source).cast("string").eqNullSafe(c["rate_source"]), "inner")
    out = out.withColumn(names["key"], F.coalesce(F.col(doc_id).cast("string"), F.sha2(whole_text(text), 256)))
    out = out.withColumn(names["count"], drawn(c["key"], c["parts"], c["cdf"], seed))
    counted = stored(out.filter(c["count"] > 0).select(*keep, c["key"], c["count"]), "counts")

    def exploded(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        return rows.select(*keep, c["key"], F.explode(F.sequence(first, last)).alias(copy))

    few = exploded(counted.filter(c["count"] <= RUN), F.lit(1), c["count"])
    runs = counted.filter(c["count"] > RUN).withColumn(
        names["run"], F.explode(F.sequence(F.lit(1), c["count"], F.lit(RUN)))).repartition(c["key"], c["run"])
    many = exploded(runs, c["run"], F.least(c["run"] + (RUN - 1), c["count"]))
    out = few.unionByName(many).withColumn(order_key, hashed(F.lit(seed), F.lit("order"), F.col(copy), c["key"]))
    return out.orderBy(order_key, names["key"], copy).select(*keep, copy, order_key)

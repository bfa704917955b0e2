"""Feature preparation estimators (M1-M9, M11-M13) as Spark ML stages.

Each ``fit`` is a single aggregate over the input columns (one pass, partial
aggregation); the fitted statistics are a handful of numbers per column and
live as params, so models save/load with ``DefaultParamsWritable`` and slot
into ``pyspark.ml.Pipeline``.  Each ``transform`` is a pure projection.

Semantics follow the reference library where Spark ML differs:
* standard scaling uses the population std (Spark's ``StandardScaler``
  uses the sample std); a constant column scales to 0;
* min-max scaling maps a constant column to the lower bound (Spark's
  ``MinMaxScaler`` gives the midpoint);
* TF-IDF uses the smoothed ``ln((1+n)/(1+df)) + 1`` (Spark's ``IDF`` has no
  ``+1``) followed by an L2 row norm.
"""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import nan_to_null


class _Cols(HasInputCols, HasOutputCols):
    def _out(self):
        ins = self.getInputCols()
        if self.isDefined(self.outputCols) and self.getOutputCols():
            return self.getOutputCols()
        return [f"{c}_out" for c in ins]


def _stats(df: DataFrame, cols, *fns) -> list[list[float]]:
    """One aggregate -> per function, a list of values per column (NaN read
    as null; None for a column without a number)."""
    types = dict(df.dtypes)
    aggs = [fn(nan_to_null(F.col(f"`{c}`"), types[c])).alias(f"{k}_{i}") for k, fn in enumerate(fns) for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    return [[row[f"{k}_{i}"] for i in range(len(cols))] for k in range(len(fns))]


# ----------------------------------------------------------- standard scale
class PopulationStandardScalerModel(Model, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "column means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population stds", TypeConverters.toListFloat)

    def __init__(self, inputCols=None, outputCols=None, means=None, stds=None):
        super().__init__()
        self._set(**{k: v for k, v in dict(inputCols=inputCols, outputCols=outputCols,
                                            means=means, stds=stds).items() if v is not None})

    def _transform(self, df):
        m, s = self.getOrDefault(self.means), self.getOrDefault(self.stds)
        exprs = []
        for c, o, mu, sd in zip(self.getInputCols(), self._out(), m, s):
            scale = sd if sd and sd > 0 else 1.0
            exprs.append(((F.col(f"`{c}`") - F.lit(mu)) / F.lit(scale)).alias(o))
        return df.select("*", *exprs)


class PopulationStandardScaler(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """M1: (x - mean) / population std; constant column -> 0."""

    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in dict(inputCols=inputCols, outputCols=outputCols).items()
                     if v is not None})

    def _fit(self, df):
        cols = self.getInputCols()
        means, stds = _stats(df, cols, F.avg, F.stddev_pop)
        return PopulationStandardScalerModel(cols, self._out(), [float(x or 0.0) for x in means],
                                             [float(x or 0.0) for x in stds])


# ----------------------------------------------------------- range scalers
class RangeScalerModel(Model, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    mins = Param(Params._dummy(), "mins", "column minima", TypeConverters.toListFloat)
    maxs = Param(Params._dummy(), "maxs", "column maxima", TypeConverters.toListFloat)
    lower = Param(Params._dummy(), "lower", "output lower bound", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "output upper bound", TypeConverters.toFloat)
    eps = Param(Params._dummy(), "eps", "max-plus-eps mode when >= 0", TypeConverters.toFloat)

    def __init__(self, inputCols=None, outputCols=None, mins=None, maxs=None, lower=0.0,
                 upper=1.0, eps=-1.0):
        super().__init__()
        self._set(**{k: v for k, v in dict(inputCols=inputCols, outputCols=outputCols, mins=mins,
                                            maxs=maxs, lower=lower, upper=upper,
                                            eps=eps).items() if v is not None})

    def _transform(self, df):
        lo, hi = self.getOrDefault(self.lower), self.getOrDefault(self.upper)
        eps = self.getOrDefault(self.eps)
        exprs = []
        for c, o, mn, mx in zip(self.getInputCols(), self._out(), self.getOrDefault(self.mins),
                                self.getOrDefault(self.maxs)):
            x = F.col(f"`{c}`")
            if math.isnan(mn):       # no number was fitted on
                e = F.lit(None).cast("double")
            elif eps >= 0:   # M3: divides by max + eps, not by the range
                e = (x - F.lit(mn)) / F.lit(mx + eps)
            else:          # M2: constant column -> lower bound
                rng = (mx - mn) if mx != mn else 1.0
                e = (x - F.lit(mn)) / F.lit(rng) * F.lit(hi - lo) + F.lit(lo)
            exprs.append(e.alias(o))
        return df.select("*", *exprs)


class RangeScaler(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """M2 min-max scaling to [lower, upper]; with ``eps`` >= 0, M3's
    ``(x - min) / (max + eps)``.  NaN doesn't count in the bounds; a column
    without a number has none (kept as NaN) and gives nulls."""

    lower = Param(Params._dummy(), "lower", "output lower bound", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "output upper bound", TypeConverters.toFloat)
    eps = Param(Params._dummy(), "eps", "max-plus-eps mode when >= 0", TypeConverters.toFloat)

    def __init__(self, inputCols=None, outputCols=None, lower=0.0, upper=1.0, eps=-1.0):
        super().__init__()
        self._set(**{k: v for k, v in dict(inputCols=inputCols, outputCols=outputCols,
                                            lower=float(lower), upper=float(upper),
                                            eps=float(eps)).items() if v is not None})

    def _fit(self, df):
        cols = self.getInputCols()
        mins, maxs = _stats(df, cols, F.min, F.max)
        g = self.getOrDefault
        return RangeScalerModel(cols, self._out(), [math.nan if x is None else float(x) for x in mins],
                                [math.nan if x is None else float(x) for x in maxs], g(self.lower), g(self.upper),
                                g(self.eps))


def pixel_scale(c, factor: float = 255.0):
    """M4: constant scaling."""
    return F.col(c) / factor if isinstance(c, str) else c / factor


# ------------------------------------------------------------- encodings
def label_classes(df: DataFrame, label: str) -> DataFrame:
    """(label, index): the distinct labels in the order of their own type,
    numbered from 0.  Null is not a class.  Fit once, then ``label_apply``."""
    from pyspark.sql import Window
    found = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    # the window runs over one row per class
    return found.withColumn("index", F.row_number().over(Window.orderBy("label")) - 1)


def label_apply(df: DataFrame, classes: DataFrame, label: str, out: str = "label_idx") -> DataFrame:
    """``df`` with the index of its label; null for a null or unseen label."""
    from tessera.session import broadcast_if_small
    side = classes.select(F.col("label").alias("_label"), F.col("index").cast("int").alias(out))
    return df.join(broadcast_if_small(side), F.col(label) == F.col("_label"), "left").drop("_label")


def label_encode(df: DataFrame, label: str, out: str = "label_idx") -> DataFrame:
    """M7: sorted labels -> 0..k-1, sorted in their own type; null stays null."""
    return label_apply(df, label_classes(df, label), label, out)


def label_binarize(df: DataFrame, label: str, classes=None, prefix: str = "is_") -> DataFrame:
    """M8: one 0/1 column per class (the list of classes, which becomes the
    list of columns, is read once unless given); a two-class label gives a
    single column for the larger class.  Null is no class and has null flags."""
    if classes is None:
        found = df.where(F.col(label).isNotNull()).select(label).distinct().collect()
        classes = sorted(r[0] for r in found)
    if len(classes) == 2:
        classes = classes[1:]
    return df.select("*", *[(F.col(label) == F.lit(k)).cast("int").alias(f"{prefix}{k}")
                            for k in classes])


# --------------------------------------------------------------- Box-Cox
def boxcox_expr(x, lam: float, shift: float = 0.0):
    """((x+c)^lam - 1) / lam, or ln(x+c) when lam == 0."""
    xc = (F.col(x) if isinstance(x, str) else x) + F.lit(shift)
    if abs(lam) < 1e-12:
        return F.ln(xc)
    return (F.pow(xc, F.lit(float(lam))) - 1.0) / F.lit(float(lam))


def boxcox_loglik(df: DataFrame, cols, lambdas, shift: float = 0.0) -> DataFrame:
    """Box-Cox log-likelihood of every (column, lambda) in ONE aggregate:
    llf = (lam - 1) * sum(ln(x+c)) - n/2 * ln(var_pop(y_lam)), where n counts
    the column's values (nulls and NaN aside).
    ``lambdas`` is one grid for all columns or a dict column -> grid."""
    grids = lambdas if isinstance(lambdas, dict) else {c: list(lambdas) for c in cols}
    types, aggs = dict(df.dtypes), []
    for i, c in enumerate(cols):
        x = nan_to_null(F.col(c), types[c])
        aggs += [F.count(x).alias(f"n{i}"), F.sum(F.ln(x + F.lit(shift))).alias(f"sl{i}")]
        for j, lam in enumerate(grids[c]):
            aggs.append(F.var_pop(boxcox_expr(x, lam, shift)).alias(f"v{i}_{j}"))
    wide = df.agg(*aggs)
    structs = []
    for i, c in enumerate(cols):
        for j, lam in enumerate(grids[c]):
            llf = (F.lit(lam - 1.0) * F.col(f"sl{i}")
                   - F.col(f"n{i}") / 2.0 * F.ln(F.col(f"v{i}_{j}")))
            structs.append(F.struct(F.lit(c).alias("attribute"), F.lit(float(lam)).alias("lambda"),
                                    llf.alias("llf")))
    return wide.select(F.inline(F.array(*structs)))


def _boxcox_moments(u, lam: float):
    """Sums over the numbers of ``u`` of z, z', z'', z z, z z', z' z', z z'',
    and the least and greatest z, where z = (e^(lam u) - 1) / lam and z', z''
    are its derivatives by lam, taken from their series where lam u is small."""
    import numpy as np
    t = lam * u
    near = np.abs(t) < 0.02
    z = [np.empty(len(u)) for _ in range(3)]
    series = ((1, 1 / 2, 1 / 6, 1 / 24, 1 / 120, 1 / 720), (1 / 2, 1 / 3, 1 / 8, 1 / 30, 1 / 144, 1 / 840),
              (1 / 3, 1 / 4, 1 / 10, 1 / 36, 1 / 168, 1 / 960))
    for k in range(3):
        z[k][near] = u[near] ** (k + 1) * np.polynomial.polynomial.polyval(t[near], series[k])
    with np.errstate(all="ignore"):                    # powers out of range stay infinite
        if not near.all():
            f = t[~near]
            e = np.exp(f)
            z[0][~near] = np.expm1(f) / lam
            z[1][~near] = (e * (f - 1) + 1) / lam ** 2
            z[2][~near] = (e * (f * f - 2 * f + 2) - 2) / lam ** 3
        z0, z1, z2 = z
        return [z0.sum(), z1.sum(), z2.sum(), z0 @ z0, z0 @ z1, z1 @ z1, z0 @ z2, z0.min(), z0.max()]


def boxcox_slopes(df: DataFrame, lambdas: dict, centre: dict, shift: float = 0.0) -> DataFrame:
    """(attribute, slope, curvature) of the Box-Cox log-likelihood of each
    column at its own lambda, all in one aggregate.

    With u = ln(x + shift) less its mean ``centre`` and z = (e^(lambda u) - 1)
    / lambda, the likelihood is -n/2 ln var(z) and a constant, so its slope is
    -n cov(z, z') / var(z).  As u is centred, z is near 0 and plain sums lose
    no digits; numpy takes them batch by batch and a task gives one row a
    column.  Null where var(z) is 0."""
    import pyarrow as pa

    types, names = dict(df.dtypes), list(lambdas)
    u = df.select(*[(F.ln(nan_to_null(F.col(f"`{c}`"), types[c]) + F.lit(shift)) - F.lit(float(centre[c])))
                    .cast("double").alias(f"u{i}") for i, c in enumerate(names)])
    lams = [float(lambdas[c]) for c in names]
    sums = ["s0", "s1", "s2", "q00", "q01", "q11", "q02"]

    def run(batches):
        import numpy as np
        total = {}
        for b in batches:
            for i, lam in enumerate(lams):
                x = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                if not len(x):
                    continue
                m = np.array([len(x), *_boxcox_moments(x, lam)])
                old = total.get(i)
                total[i] = m if old is None else np.concatenate(
                    [old[:8] + m[:8], np.fmin(old[8:9], m[8:9]), np.fmax(old[9:], m[9:])])
        if total:
            rows = np.array([[i, *total[i]] for i in total])
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)),
                                              *(pa.array(rows[:, k]) for k in range(1, rows.shape[1]))],
                                             names=["i", "n", *sums, "low", "high"])

    parts = u.mapInArrow(run, "i int, n double, " + ", ".join(f"{c} double" for c in [*sums, "low", "high"]))
    g = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ["n", *sums]], F.min("low").alias("low"),
                               F.max("high").alias("high"))
    n = F.col("n")
    cov = lambda q, x, y: F.col(q) / n - F.col(x) / n * (F.col(y) / n)
    g = g.withColumns({"v": F.when(F.col("low") != F.col("high"), cov("q00", "s0", "s0")).otherwise(0.0),
                       "a": cov("q01", "s0", "s1"), "b": cov("q11", "s1", "s1"), "d": cov("q02", "s0", "s2")})
    v, a, b, d = (F.col(k) for k in "vabd")
    ratio = F.when(v > 0, a / v)
    found = g.select("i", (-n * ratio).alias("slope"),
                     F.when(v > 0, -n * ((b + d) / v - 2 * ratio * ratio)).alias("curvature"))
    side = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, attribute string")
    return side.join(F.broadcast(found), "i", "left").select("attribute", "slope", "curvature")


class BoxCoxModel(Model, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    lambdas = Param(Params._dummy(), "lambdas", "fitted lambdas", TypeConverters.toListFloat)
    shift = Param(Params._dummy(), "shift", "added before transform", TypeConverters.toFloat)

    def __init__(self, inputCols=None, outputCols=None, lambdas=None, shift=0.5):
        super().__init__()
        self._set(**{k: v for k, v in dict(inputCols=inputCols, outputCols=outputCols,
                                            lambdas=lambdas, shift=shift).items() if v is not None})

    def _transform(self, df):
        sh = self.getOrDefault(self.shift)
        return df.select("*", *[boxcox_expr(c, lam, sh).alias(o) for c, o, lam in zip(
            self.getInputCols(), self._out(), self.getOrDefault(self.lambdas))])


class BoxCox(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """M9: per column lambda by maximum likelihood on the training data,
    reused on new data.  Newton's method on the likelihood's slope, for all
    columns together: one aggregate a step gives every column's slope and
    curvature at its own lambda.  A step that leaves the bracket of the root,
    or has no use for its curvature, is replaced by halving (or by doubling
    while the bracket is open).  A column is done when its slope is below
    ``SLOPE``, its next Newton step is below ``STEP`` of lambda (the slope's
    rounding grows with the rows, that of the step does not), or its bracket is
    as narrow as a double allows.

    Nulls and NaN are left out; a value that is not positive after the shift is
    an error; a column with no two different values keeps lambda 1, and a
    maximum beyond +-``FARTHEST`` is given as that bound."""

    SLOPE, STEP, FARTHEST, STEPS = 1e-7, 1e-10, 1024.0, 100

    shift = Param(Params._dummy(), "shift", "added before transform", TypeConverters.toFloat)

    def __init__(self, inputCols=None, outputCols=None, shift=0.5):
        super().__init__()
        self._set(**{k: v for k, v in dict(inputCols=inputCols, outputCols=outputCols,
                                            shift=float(shift)).items() if v is not None})

    @property
    def _shift(self) -> float:
        return self.getOrDefault(self.shift)

    def _fit(self, df):
        cols = self.getInputCols()
        types = dict(df.dtypes)
        value = {c: nan_to_null(F.col(f"`{c}`"), types[c]) for c in cols}
        found = df.agg(*[F.min(value[c]).alias(f"m{i}") for i, c in enumerate(cols)],
                       *[F.avg(F.ln(value[c] + F.lit(self._shift))).alias(f"l{i}") for i, c in enumerate(cols)]).first()
        least, logs = found[:len(cols)], found[len(cols):]
        for c, m in zip(cols, least):
            if m is not None and m + self._shift <= 0:
                raise ValueError(f"Box-Cox needs positive values: the least of {c} plus the shift is {m + self._shift}")
        centre = {c: m for c, m in zip(cols, logs) if m is not None}
        lam, done = {c: 1.0 for c in cols}, set(cols) - set(centre)
        low, high = {c: -math.inf for c in cols}, {c: math.inf for c in cols}
        for _ in range(self.STEPS):
            todo = [c for c in cols if c not in done]
            if not todo:
                break
            for r in boxcox_slopes(df, {c: lam[c] for c in todo}, centre, self._shift).collect():
                c, slope, curve = r["attribute"], r["slope"], r["curvature"]
                if slope is None:                      # one value only: any lambda will do
                    done.add(c)
                elif not math.isfinite(slope):         # powers out of range: back towards 0
                    low[c], high[c] = (max(low[c], -abs(lam[c])), min(high[c], abs(lam[c])))
                    lam[c] = (low[c] + high[c]) / 2 if math.isfinite(low[c] + high[c]) else lam[c] / 2
                elif abs(slope) <= self.SLOPE:
                    done.add(c)
                elif curve is not None and curve < 0 and abs(slope / curve) <= self.STEP * max(1.0, abs(lam[c])):
                    lam[c] -= slope / curve
                    done.add(c)
                else:
                    if slope > 0:
                        low[c] = lam[c]
                    else:
                        high[c] = lam[c]
                    lam[c] = self._next(lam[c], slope, curve, low[c], high[c])
                    if abs(lam[c]) >= self.FARTHEST or high[c] - low[c] <= 4e-16 * max(1.0, abs(lam[c])):
                        done.add(c)
        return BoxCoxModel(cols, self._out(), [lam[c] for c in cols], self._shift)

    def _next(self, at: float, slope: float, curve: float, low: float, high: float) -> float:
        newton = at - slope / curve if curve is not None and curve < 0 else math.nan
        if low < newton < high and abs(newton - at) <= max(1.0, 2 * abs(at)):
            return newton
        if math.isfinite(low) and math.isfinite(high):
            return (low + high) / 2
        step = max(1.0, abs(at))
        return max(-self.FARTHEST, min(self.FARTHEST, at + (step if slope > 0 else -step)))


# ---------------------------------------------------------------- TF-IDF
def smooth_idf(long_df: DataFrame, doc: str, term: str, count: str = "tf",
               n_docs: int | None = None) -> DataFrame:
    """(term, idf) with idf = ln((1+n)/(1+df)) + 1; df counted from rows with
    a positive count; n defaults to the documents present in ``long_df``."""
    pos = long_df.where(F.col(count) > 0)
    if n_docs is None:
        n_docs = pos.select(doc).distinct().count()
    df_t = pos.groupBy(term).agg(F.count(F.lit(1)).alias("df"))   # (doc, term) rows are unique
    return df_t.select(term, (F.ln(F.lit(1.0 + n_docs) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def tfidf_transform(long_df: DataFrame, idf: DataFrame, doc: str, term: str,
                    count: str = "tf", out: str = "weight", max_bytes: int = 64 << 20) -> DataFrame:
    """M5: tf * idf, then L2 norm per document (terms missing from the
    fitted vocabulary are dropped, as a fitted vectorizer does).  The idf
    table is broadcast only if its measured bytes are at most ``max_bytes``."""
    from pyspark.sql import Window

    from tessera.session import broadcast_if_small
    w = long_df.join(broadcast_if_small(idf, max_bytes), term).withColumn("_w", F.col(count) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return w.select(doc, term, F.when(norm > 0, F.col("_w") / norm).otherwise(0.0).alias(out))


TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

#: About the bytes of text whose terms one task counts.
PARTITION_TEXT = 16 << 20


def term_counts(docs: DataFrame, doc: str, text: str, pattern: str = TOKEN_PATTERN,
                partitions: int | None = None) -> DataFrame:
    """(doc, term, tf) from raw text: lowercase, runs of 2+ word characters
    (the reference vectorizer's default token pattern), whole texts.

    Documents are hash-partitioned by ``doc`` first: the raw text crosses the
    network once (about 6 bytes per token, less than the ~16 bytes per token
    that (doc, term, count) partials would cost), every term count is then
    final inside its task, and later per-document windows reuse the same
    partitioning without another exchange.  There are as many partitions as the
    texts need for ``PARTITION_TEXT`` bytes each, so a task's memory does not
    grow with the corpus."""
    sel = docs.select(doc, text)
    if partitions is None:
        size = sel.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
        most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        partitions = needed if (needed := math.ceil(size / PARTITION_TEXT)) > most else None
    # by column only: AQE sizes (coalesces) the partitions at run time
    by_doc = sel.repartition(partitions, doc) if partitions else sel.repartition(doc)
    toks = by_doc.select(doc, F.explode(F.regexp_extract_all(F.lower(F.col(text)),
                                                             F.lit(pattern), 0)).alias("term"))
    return toks.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def top_vocabulary(counts: DataFrame, term: str = "term", count: str = "tf",
                   max_features: int = 10000) -> DataFrame:
    """M6 vocabulary cap: the max_features most frequent terms over the
    corpus, ties broken alphabetically (the cap is the feature)."""
    totals = counts.groupBy(term).agg(F.sum(count).alias("_total"))
    return totals.orderBy(F.desc("_total"), F.asc(term)).limit(max_features).select(term)


# ----------------------------------------------------------- ANOVA F test
def anova_f(long_df: DataFrame, feature: str, label: str, value: str) -> DataFrame:
    """T5: one-way ANOVA F per feature from (feature, label, value) rows.

    Counts, means and central moments per (feature, class) are combined
    around each feature's mean, so large means cost no digits.  Null and NaN
    values and rows with a null label are left out.  A feature that is constant within every class but not between them has F = +inf."""
    from pyspark.sql import Window
    long_df = long_df.where(F.col(label).isNotNull()).withColumn(
        value, nan_to_null(F.col(value).cast("double"), "double"))
    g = long_df.groupBy(feature, label).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n > 0")
    of = Window.partitionBy(feature)              # one row per class
    mean = F.sum(F.col("n") * F.col("m")).over(of) / F.sum("n").over(of)
    per = g.withColumn("d", F.col("m") - mean).groupBy(feature).agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * F.col("d") * F.col("d")).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"))
    f = F.try_divide(F.try_divide("ssb", F.col("k") - 1), F.try_divide("ssw", F.col("N") - F.col("k")))
    perfect = (F.col("ssw") == 0) & (F.col("ssb") > 0) & (F.col("N") > F.col("k"))
    return per.select(feature, F.when(perfect, F.lit(math.inf)).otherwise(f).alias("f_score"))


def select_k_best(scores: DataFrame, feature: str, k: int) -> DataFrame:
    """The k highest F scores (ties -> smaller feature id)."""
    from pyspark.sql import Window
    w = Window.orderBy(F.desc_nulls_last("f_score"), F.asc(feature))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

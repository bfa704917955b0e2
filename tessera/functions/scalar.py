"""Scalar Column functions (all JVM-side built-ins, codegen friendly).

Each function takes and returns ``Column`` objects so that it composes into
``select``/``withColumn`` without any Python in the row path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Colish = Column | str


def _c(x: Colish) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- null rules
def is_missing(c: Colish, numeric: bool = True) -> Column:
    """Rule 1 (pandas null): null, or NaN for floating columns."""
    c = _c(c)
    return (c.isNull() | F.isnan(c)) if numeric else c.isNull()


def is_null_or_blank(c: Colish, dtype: str) -> Column:
    """Rule 2: null, NaN or the empty string. Zero and false are not null;
    whitespace is not blank."""
    c = _c(c)
    if dtype in ("float", "double"):
        return c.isNull() | F.isnan(c)
    if dtype == "string":
        return c.isNull() | (c == F.lit(""))
    return c.isNull()


def is_trimmed_blank(c: Colish) -> Column:
    """Rule 3: strip, then empty (null counts as blank)."""
    c = _c(c)
    return c.isNull() | (F.trim(c.cast("string")) == F.lit(""))


def nan_to_null(c: Colish, dtype: str) -> Column:
    c = _c(c)
    if dtype in ("float", "double"):
        return F.when(~F.isnan(c), c)
    return c


# Float literal syntax accepted by Python's float(): optional sign, digits with
# an optional fraction, optional exponent, or inf/infinity/nan.  Spark's
# try_cast also accepts suffixes such as '1d' which Python rejects, so the
# text is checked against this pattern first.
NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def try_double(c: Colish) -> Column:
    """Float parse with failure -> null (F15), Python float() syntax."""
    s = F.trim(_c(c).cast("string"))
    return F.when(s.rlike(NUMERIC_TEXT), s.try_cast("double"))


# ------------------------------------------------------------- feature maps
def opposite_bearing(c: Colish) -> Column:
    """P5: x+180 > 360 -> x-180 else x+180 (180 maps to 360, not 0)."""
    c = _c(c)
    return F.when(c + 180 > 360, c - 180).otherwise(c + 180)


def negative_flag(c: Colish) -> Column:
    return _c(c) < 0


def euclid(a: Colish, b: Colish) -> Column:
    a, b = _c(a), _c(b)
    return F.sqrt(a * a + b * b)


def label_suffix(c: Colish) -> Column:
    """P10: last character as int (``Class_10`` -> 0, as in the source)."""
    return F.substring(_c(c), -1, 1).try_cast("int")


def clip(c: Colish, lo: float | None = None, hi: float | None = None) -> Column:
    """Null and NaN stay as they are."""
    x = c = _c(c)
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return _of_number(x, c)


def _of_number(x: Column, value: Column) -> Column:
    """``value`` where x is a number, else x: ``greatest`` and ``least`` skip
    nulls and put NaN above all numbers."""
    return F.when(x.isNull() | F.isnan(x.cast("double")), x).otherwise(value)


def threshold_value(c: Colish, low: float = 0.15, high: float = 0.8) -> Column:
    """< low -> 0, >= high -> 1, otherwise unchanged."""
    c = _c(c)
    return F.when(c < low, F.lit(0.0)).when(c >= high, F.lit(1.0)).otherwise(c)


def log_target(c: Colish) -> Column:
    return F.log1p(_c(c))


def inverse_log_target(c: Colish) -> Column:
    return F.expm1(_c(c))


def round_half_even(c: Colish, d: int = 0) -> Column:
    """Numpy-style half-to-even rounding."""
    return F.bround(_c(c), d)


# ---------------------------------------------------------------- activations
def sigmoid(c: Colish, slope: float = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-slope * _c(c)))


def relu(c: Colish) -> Column:
    c = _c(c)
    return _of_number(c, F.greatest(c, F.lit(0.0)))


def tribas(c: Colish) -> Column:
    """clip(1-|x|, 0, 1)."""
    return clip(1.0 - F.abs(_c(c)), 0.0, 1.0)


def hardlim(c: Colish) -> Column:
    return (_c(c) > 0).cast("double")


def gaussian(c: Colish, gamma: float = 1.0) -> Column:
    c = _c(c)
    return F.exp(-gamma * c * c)


def multiquadric(c: Colish, gamma: float = 1.0) -> Column:
    c = _c(c)
    return F.sqrt(1.0 + (gamma * c) * (gamma * c))


def polyharmonic(c: Colish, gamma: int = 2) -> Column:
    """(x+1e-8)^g, times ln(x+1e-8) when g is even; g an int >= 1."""
    if int(gamma) != gamma or gamma < 1:
        raise ValueError("polyharmonic gamma must be an integer >= 1")
    x = _c(c) + 1e-8
    out = F.pow(x, float(gamma))
    return out * F.ln(x) if gamma % 2 == 0 else out


def soft_abs(c: Colish, eps: float = 1e-8) -> Column:
    c = _c(c)
    return F.sqrt(c * c + eps)


def cross_entropy_term(p: Colish, y: Colish) -> Column:
    p, y = _c(p), _c(y)
    return -(y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p))


ACTIVATIONS = {
    "sigmoid": sigmoid,
    "tanh": lambda c: F.tanh(_c(c)),
    "sine": lambda c: F.sin(_c(c)),
    "sin": lambda c: F.sin(_c(c)),
    "relu": relu,
    "tribas": tribas,
    "hardlim": hardlim,
    "gaussian": gaussian,
    "multiquadric": multiquadric,
    "polyharmonic": polyharmonic,
    "softabs": soft_abs,
    "identity": _c,
}


def activation(name_or_fn, c: Colish, **kwargs) -> Column:
    """Look an activation up by name, or call a ``Column -> Column`` callable
    with keyword arguments (D1).  Unknown names are an error (F10)."""
    if callable(name_or_fn):
        return name_or_fn(_c(c), **kwargs)
    try:
        fn = ACTIVATIONS[name_or_fn]
    except KeyError:
        raise ValueError(f"unknown activation {name_or_fn!r}; "
                         f"choose from {sorted(ACTIVATIONS)} or pass a callable")
    return fn(_c(c), **kwargs)


def np_activation(name: str):
    """The same activations over numpy arrays, for mapInPandas matmul paths."""
    import numpy as np
    table = {
        "sigmoid": lambda x: 1.0 / (1.0 + np.exp(-x)),
        "tanh": np.tanh,
        "sine": np.sin, "sin": np.sin,
        "relu": lambda x: np.maximum(x, 0.0),
        "tribas": lambda x: np.clip(1.0 - np.abs(x), 0.0, 1.0),
        "hardlim": lambda x: (x > 0).astype(float),
        "gaussian": lambda x: np.exp(-x * x),
        "multiquadric": lambda x: np.sqrt(1.0 + x * x),
        "polyharmonic": lambda x: (x + 1e-8) ** 2 * np.log(x + 1e-8),
        "softabs": lambda x: np.sqrt(x * x + 1e-8),
        "identity": lambda x: x,
    }
    if callable(name):
        return name
    if name not in table:
        raise ValueError(f"unknown activation {name!r}")
    return table[name]


# ------------------------------------------------------------- array helpers
def array_dot(a: Colish, b: Colish) -> Column:
    """Dot product of two equal-length numeric arrays, in double."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def array_sqdist(a: Colish, b: Colish) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double"))
                   * (x.cast("double") - y.cast("double"))),
        F.lit(0.0), lambda acc, x: acc + x)


def array_sum(a: Colish) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def literal_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def broadcast_scalar(value: Column, like: Column) -> Column:
    """Repeat a per-row scalar to the length of ``like`` so a lambda can
    read it as an argument: referenced inside a lambda body it would be
    re-evaluated once per element."""
    return F.array_repeat(value, F.size(like))


def softmax_array(a: Colish) -> Column:
    """F2 row-wise softmax: subtract the row max, exponentiate, normalise.
    (The source subtracts the global max; the row max gives the same result
    and needs no extra pass.)  Linear in the array length."""
    a = F.transform(_c(a), lambda x: x.cast("double"))
    shifted = F.zip_with(a, broadcast_scalar(F.array_max(a), a), lambda x, m: F.exp(x - m))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(shifted, broadcast_scalar(total, shifted), lambda e, t: e / t)


def argmax_array(a: Colish) -> Column:
    """Zero-based position of the first maximum."""
    a = _c(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def finite_or_null(c: Colish) -> Column:
    c = _c(c)
    return F.when((F.abs(c) != F.lit(math.inf)) & ~F.isnan(c), c)

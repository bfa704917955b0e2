"""Image-table augmentation (G1-G8) over ``(key, label, pixels array)``.

Pixel moves are array lambdas evaluated row by row (no shuffle, no join):
a copy of every image per offset comes from ``explode`` over a fixed list
of offsets.  Only the rotation needs interpolation, done in Arrow batches
with numpy via ``mapInPandas``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import threshold_value

# Offsets (dr, dc) mean out[r][c] = in[r + dr][c + dc], zero outside.
# Nudge order of the source: original, up, left, right, down
# (convolution flips the kernel, so the kernel above centre moves the
# image up).  Translate order of the source: up, down, left, right.
NUDGE_OFFSETS = [("original", 0, 0), ("up", 1, 0), ("left", 0, 1), ("right", 0, -1),
                 ("down", -1, 0)]
TRANSLATE_OFFSETS = [("up", 1, 0), ("down", -1, 0), ("left", 0, 1), ("right", 0, -1)]


def shift_pixels(pixels: str, width: int, dr: int, dc: int, gain: float = 1.0) -> Column:
    """One shifted copy of a row-major ``width x height`` image."""
    arr = F.col(pixels)
    height = F.size(arr) / width

    def move(_x, i):
        r = F.floor(i / width) + dr
        c = i % width + dc
        ok = (r >= 0) & (r < height) & (c >= 0) & (c < width)
        src = (r * width + c + 1).cast("int")
        return F.when(ok, F.element_at(arr, src).cast("double") * gain).otherwise(F.lit(0.0))
    if dr == 0 and dc == 0:
        return F.transform(arr, lambda x: x.cast("double") * gain)
    return F.transform(arr, move)


def _copies(df: DataFrame, pixels: str, width: int, offsets, gain: float,
            keep_original_gain: bool) -> DataFrame:
    copies = [F.struct(F.lit(name).alias("shift"),
                       shift_pixels(pixels, width, dr, dc,
                                    1.0 if (keep_original_gain and dr == 0 and dc == 0) else gain)
                       .alias("_px"))
              for name, dr, dc in offsets]
    others = [c for c in df.columns if c != pixels]
    return (df.select(*others, F.explode(F.array(*copies)).alias("_c"))
            .select(*others, F.col("_c.shift").alias("shift"), F.col("_c._px").alias(pixels)))


def nudge_images(df: DataFrame, pixels: str, width: int, gain: float = 1.0) -> DataFrame:
    """G1: five copies per image (original + 4 one-pixel moves), labels and
    keys repeated.  ``gain`` multiplies the moved copies' values, as the
    source's nudge size does."""
    return _copies(df, pixels, width, NUDGE_OFFSETS, gain, keep_original_gain=True)


def translate_images(df: DataFrame, pixels: str, width: int) -> DataFrame:
    """Four one-pixel moves, original not kept."""
    return _copies(df, pixels, width, TRANSLATE_OFFSETS, 1.0, keep_original_gain=False)


def threshold_images(df: DataFrame, pixels: str, low: float = 0.15, high: float = 0.8) -> DataFrame:
    """< low -> 0, >= high -> 1."""
    return df.withColumn(pixels, F.transform(pixels, lambda x: threshold_value(x, low, high)))


def downsample_images(df: DataFrame, pixels: str, width: int, block: int = 4,
                      keep: int = 2) -> DataFrame:
    """One value per ``block x block`` tile: the mean of the tile's top
    left ``keep x keep`` pixels (as the source does)."""
    arr = F.col(pixels)
    out_w = width // block
    height = F.size(arr) / width
    out_h = F.floor(height / block).cast("int")

    def tile(j):
        R = F.floor(j / out_w)
        C = j % out_w
        vals = [F.element_at(arr, ((R * block + a) * width + C * block + b + 1).cast("int"))
                .cast("double") for a in range(keep) for b in range(keep)]
        total = vals[0]
        for v in vals[1:]:
            total = total + v
        return total / float(keep * keep)
    idx = F.sequence(F.lit(0), out_h * out_w - 1)
    return df.withColumn(pixels, F.transform(idx, tile))


def crop_images(df: DataFrame, pixels: str, width: int, border: int = 2) -> DataFrame:
    """Drop ``border`` pixels on every side."""
    arr = F.col(pixels)
    height = F.size(arr) / width

    def keep(_x, i):
        r = F.floor(i / width)
        c = i % width
        return (r >= border) & (r < height - border) & (c >= border) & (c < width - border)
    return df.withColumn(pixels, F.filter(arr, keep))


def flatten_long(df: DataFrame, key: str, pixels: str) -> DataFrame:
    """Long form (key, pos, value) of an image table; G7 is the inverse
    (``sort_array(collect_list(struct(pos, value)))`` grouped by key)."""
    return df.select(key, F.posexplode(pixels).alias("pos", "value"))


def rotation_angles(key: str, seed: int = 0, max_deg: int = 17) -> Column:
    """Angle per row in +-1..max_deg degrees from a hash of the key."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    mag = F.pmod(h, F.lit(max_deg)) + 1
    sign = F.when(F.pmod(F.floor(h / max_deg), F.lit(2)) == 0, 1).otherwise(-1)
    return (mag * sign).cast("double")


def spline_coefficients(im, axis: int):
    """Coefficients of the cubic B-spline through the samples of an array
    along ``axis``, mirrored at both ends: a recursive filter forwards and
    backwards, exact at the ends, over all other axes at once."""
    import numpy as np

    s = np.moveaxis(np.asarray(im, dtype=float), axis, 0) * 6.0
    n = len(s)
    if n == 1:
        return np.asarray(im, dtype=float)
    z = np.sqrt(3.0) - 2.0
    k = np.arange(n, dtype=float)
    # the endless mirrored signal summed in closed form
    w = z ** k
    w[1:-1] += z ** (2 * n - 2 - k[1:-1])
    c = np.empty_like(s)
    c[0] = np.tensordot(w, s, 1) / (1.0 - z ** (2 * n - 2))
    for i in range(1, n):
        c[i] = s[i] + z * c[i - 1]
    c[-1] = z / (z * z - 1.0) * (c[-1] + z * c[-2])
    for i in range(n - 2, -1, -1):
        c[i] = z * (c[i + 1] - c[i])
    return np.moveaxis(c, 0, axis)


def _cubic_weights(t):
    """Weights of the four coefficients around a place ``t`` past the second."""
    u = 1.0 - t
    return u ** 3 / 6, (4 - 3 * t * t * (2 - t)) / 6, (4 - 3 * u * u * (2 - u)) / 6, t ** 3 / 6


def _mirrored(i, n: int):
    """Indices mirrored about the first and the last of ``n``."""
    import numpy as np

    if n == 1:
        return np.zeros_like(i)
    i = np.mod(i, 2 * n - 2)
    return np.where(i < n, i, 2 * n - 2 - i)


def rotate_images(df: DataFrame, key: str, pixels: str, width: int, seed: int = 0,
                  max_deg: int = 17, copies: int = 1, low: float = 0.15,
                  high: float = 0.8, angles: list[Column] | None = None, order: int = 3) -> DataFrame:
    """Original + ``copies`` rotated copies (angle from a hash of the key
    and the copy number, or the given ``angles`` in degrees), thresholded.
    Turned about the image centre, zero outside, by cubic splines (``order``
    3, as in the source) or bilinear (``order`` 1).  The images of a batch are
    rotated together.  A null image stays null; a null or NaN pixel makes NaN
    of the pixels that depend on it, with splines the whole copy."""
    if order not in (1, 3):
        raise ValueError(f"order must be 1 (bilinear) or 3 (cubic), not {order}")
    import numpy as np
    import pandas as pd

    others = [c for c in df.columns if c not in (pixels,)]
    if angles is None:
        angles = [rotation_angles(key, seed + 7919 * i, max_deg) for i in range(copies)]
    copies = len(angles)
    angles = [a.cast("double").alias(f"_a{i}") for i, a in enumerate(angles)]
    src = df.select(*others, F.transform(pixels, lambda x: x.cast("double")).alias(pixels), *angles)
    from pyspark.sql.types import IntegerType
    out_schema = (src.drop(*[f"_a{i}" for i in range(copies)]).schema
                  .add("copy", IntegerType()))

    def bilinear(im, which, sx, sy):
        h = im.shape[1]
        x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
        fx, fy = sx - x0, sy - y0
        out = np.zeros(im.shape)
        for dy, wy in ((0, 1 - fy), (1, fy)):
            for dx, wx in ((0, 1 - fx), (1, fx)):
                X, Y = x0 + dx, y0 + dy
                ok = (X >= 0) & (X < width) & (Y >= 0) & (Y < h)
                v = im[which, np.clip(Y, 0, h - 1), np.clip(X, 0, width - 1)]
                out += np.where(ok, v, 0.0) * wx * wy
        return out

    def cubic(im, which, sx, sy):
        h = im.shape[1]
        c = spline_coefficients(spline_coefficients(im, 1), 2)
        x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
        wx, wy = _cubic_weights(sx - x0), _cubic_weights(sy - y0)
        out = np.zeros(im.shape)
        for j in range(4):
            Y = _mirrored(y0 + j - 1, h)
            for i in range(4):
                out += c[which, Y, _mirrored(x0 + i - 1, width)] * wx[i] * wy[j]
        inside = (sx >= 0) & (sx <= width - 1) & (sy >= 0) & (sy <= h - 1)
        return np.where(inside, out, 0.0)

    def rotate(im: np.ndarray, deg: np.ndarray) -> np.ndarray:
        n, h = len(im), im.shape[1]
        t = np.radians(deg)[:, None, None]
        cy, cx = (h - 1) / 2.0, (width - 1) / 2.0
        yy, xx = np.mgrid[0:h, 0:width]
        # inverse map: source coordinates of each output pixel
        sx = np.cos(t) * (xx - cx) + np.sin(t) * (yy - cy) + cx
        sy = -np.sin(t) * (xx - cx) + np.cos(t) * (yy - cy) + cy
        which = np.arange(n)[:, None, None]
        out = cubic(im, which, sx, sy) if order == 3 else bilinear(im, which, sx, sy)
        out = np.where(out < low, 0.0, out)
        return np.where(out >= high, 1.0, out)

    def fn(batches):
        for pdf in batches:
            parts = [pdf[others + [pixels]].assign(copy=0)]
            # a null image has no size and stays null
            flat = [None if p is None else np.asarray(p, dtype=float) for p in pdf[pixels]]
            sizes = np.array([-1 if p is None else len(p) for p in flat])
            for i in range(copies):
                rot, out = pdf[others].copy(), [None] * len(flat)
                for size in set(sizes.tolist()) - {-1}:   # images of one size together
                    at = np.flatnonzero(sizes == size)
                    im = np.stack([flat[j] for j in at]).reshape(len(at), size // width, width)
                    done = rotate(im, pdf[f"_a{i}"].to_numpy()[at]).reshape(len(at), size)
                    for j, row in zip(at, done):
                        out[j] = row
                rot[pixels] = pd.Series(out, index=rot.index, dtype=object)
                rot["copy"] = i + 1
                parts.append(rot)
            yield pd.concat(parts, ignore_index=True)

    return src.mapInPandas(fn, out_schema)


def normalise_images(df: DataFrame, pixels: str) -> DataFrame:
    """G8 normalisation: subtract the dataset mean pixel value and divide by
    the dataset std (one aggregate; two numbers reach the driver).  A null
    image stays null; a table without pixels stays as it is, as doubles."""
    st = df.select(F.explode(pixels).alias("v")).agg(F.avg("v").alias("m"),
                                                     F.stddev_pop("v").alias("s")).first()
    m, s = float(st["m"] or 0.0), float(st["s"] or 0.0) or 1.0
    return df.withColumn(pixels, F.transform(pixels, lambda x: (x.cast("double") - m) / s))


def flip_shift_images(df: DataFrame, pixels: str, width: int, bits: Column,
                      max_shift: int = 1) -> DataFrame:
    """Random horizontal flip and shift of each image, driven by a
    per-row integer ``bits`` (e.g. a hash of the key): bit 0 = flip,
    (bits >> 1) mod (2*max_shift+1) - max_shift = column shift,
    (bits >> 4) mod (2*max_shift+1) - max_shift = row shift; zero fill."""
    arr = F.col(pixels)
    height = F.size(arr) / width
    span = 2 * max_shift + 1
    flip = F.pmod(bits, F.lit(2)) == 1
    dc = F.pmod(F.floor(bits / 2), F.lit(span)) - max_shift
    dr = F.pmod(F.floor(bits / 16), F.lit(span)) - max_shift

    def move(_x, i):
        r = F.floor(i / width)
        c0 = i % width
        c = F.when(flip, width - 1 - c0).otherwise(c0)
        rr, cc = r + dr, c + dc
        ok = (rr >= 0) & (rr < height) & (cc >= 0) & (cc < width)
        return F.when(ok, F.element_at(arr, (rr * width + cc + 1).cast("int")).cast("double")) \
                .otherwise(F.lit(0.0))
    return df.withColumn(pixels, F.transform(arr, move))


def unflatten(long_df: DataFrame, key: str, pos: str = "pos", value: str = "value",
              out: str = "pixels") -> DataFrame:
    """Long pixels back to one array per image, in position order.  A
    group is one image (width x height values), so it is bounded."""
    return (long_df.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"),
                                                      F.col(value).alias("v")))).alias("_px"))
            .select(key, F.transform("_px", lambda s: s["v"]).alias(out)))

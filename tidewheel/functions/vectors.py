"""Vector and matrix functions: Column in, Column out, so that Catalyst can fuse them. Null vectors stay null."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: Sequence) -> Column:
    return F.array(*(F.lit(x) for x in values))


def select(v: Column, index: Sequence[int]) -> Column:
    """Elements at the given positions, in that order; a position beyond the vector is an error."""
    return F.transform(literal([int(i) for i in index]), lambda i: F.element_at(v, i + 1))


def take(v: Column, n: int) -> Column:
    return F.slice(v, 1, n)


def pad(v: Column, n: int, value: float = 0.0) -> Column:
    """Padded at the end to n elements; longer vectors stay as they are."""
    return F.concat(v, F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(v), F.lit(0))))


def every(m: Column, k: int, first: int = 0) -> Column:
    return F.filter(m, lambda _, i: (i - F.lit(first)) % k == 0)


def channels(v: Column, width: int, first: int) -> Column:
    """Of interleaved channels, those from `first` on."""
    return F.filter(v, lambda _, i: i % width >= first)


def rows_of(v: Column, width: int) -> Column:
    """A flat vector as a matrix of rows of `width`."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / width).cast("int") - 1), lambda r: F.slice(v, r * width + 1, width))


def bool_mask(dims: Sequence[int]) -> list[bool]:
    """Signed run lengths to a mask: 2, -1 is true, true, false."""
    return [d > 0 for d in dims for _ in range(abs(d))]


def bool_mask_column(dims: Column) -> Column:
    return F.flatten(F.transform(dims, lambda d: F.array_repeat(d > 0, F.abs(d))))


def shift(m: Column, state: Column, mask: Sequence[bool] | None, sign: int) -> Column:
    """Each row of m plus sign times state where the mask is true; without a mask m itself."""
    if mask is None:
        return m
    flags = literal([bool(x) for x in mask])
    n = len(mask)
    return F.transform(m, lambda row: F.transform(row, lambda x, i: F.when((i < n) & F.coalesce(F.get(flags, i), F.lit(False)), x + sign * F.get(state, i)).otherwise(x)))


def delta(m: Column, state: Column, mask: Sequence[bool] | None) -> Column:
    return shift(m, state, mask, -1)


def absolute(m: Column, state: Column, mask: Sequence[bool] | None) -> Column:
    return shift(m, state, mask, 1)


def zscore(v: Column, mean: Column, std: Column) -> Column:
    return F.transform(v, lambda x, i: (x - F.get(mean, i)) / (F.get(std, i) + EPS))


def zscore_back(v: Column, mean: Column, std: Column) -> Column:
    """Inverse of zscore; elements beyond the statistics have mean 0 and deviation 1."""
    return F.transform(v, lambda x, i: x * (F.coalesce(F.get(std, i), F.lit(1.0)) + EPS) + F.coalesce(F.get(mean, i), F.lit(0.0)))


def quantile_scale(v: Column, low: Column, high: Column) -> Column:
    """The range low..high onto -1..1, not clipped."""
    return F.transform(v, lambda x, i: (x - F.get(low, i)) / (F.get(high, i) - F.get(low, i) + EPS) * 2 - 1)


def quantile_scale_back(v: Column, low: Column, high: Column) -> Column:
    """Inverse of quantile_scale; elements beyond the statistics pass through."""
    return F.transform(v, lambda x, i: F.when(F.get(low, i).isNull(), x).otherwise((x + 1) / 2 * (F.get(high, i) - F.get(low, i) + EPS) + F.get(low, i)))


def discretize(x: Column) -> Column:
    """-1..1 in 256 bins; -1 below the range, 255 at its upper end and above."""
    return F.greatest(F.lit(-1), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 128)))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def norm_of_difference(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def rms_norm(v: Column, scale: float = 0.0) -> Column:
    return F.transform(v, lambda x: x / F.sqrt(total(F.transform(v, lambda y: y * y)) / F.size(v) + EPS) * (1 + scale))


def rope(v: Column, position: Column, n: int, base: float = 10_000.0) -> Column:
    """Rotary embedding of a vector of n elements, its halves as pairs."""
    half = n // 2
    speed = literal([base ** (-2 * i / n) for i in range(half)])
    angle = lambda i: position * F.element_at(speed, i + 1)
    a, b = (lambda i: F.element_at(v, i + 1)), (lambda i: F.element_at(v, i + half + 1))
    index = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(index, lambda i: a(i) * F.cos(angle(i)) - b(i) * F.sin(angle(i))), F.transform(index, lambda i: b(i) * F.cos(angle(i)) + a(i) * F.sin(angle(i))))


def sincos(position: Column, n: int, low: float, high: float) -> Column:
    """Sines, then cosines, of a scalar at n / 2 periods spaced geometrically from low to high."""
    half = n // 2
    rates = [2 * math.pi / (low * (high / low) ** (i / max(1, half - 1))) for i in range(half)]
    return F.concat(F.array(*(F.sin(position * r) for r in rates)), F.array(*(F.cos(position * r) for r in rates)))


def sincos_2d(h: int, w: int, width: int, base: float = 10_000.0) -> list[list[float]]:
    """Embeddings of the h x w cells of a grid, row by row: sines and cosines of x, then of y."""
    if width % 4 or width < 8:
        raise ValueError("width must be a multiple of 4, 8 at least")
    n = width // 4
    speed = [base ** -(i / (n - 1)) for i in range(n)]
    part = lambda p: [math.sin(p * s) for s in speed] + [math.cos(p * s) for s in speed]
    return [part(x) + part(y) for y in range(h) for x in range(w)]


def nonfinite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))

"""Normalisation and shaping of vectors, as expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least denominator of a normalisation.
FLOOR = 1e-8


def normalize(x: Column, method: str, lo: Column, hi: Column) -> Column:
    """'meanstd' with (mean, std), 'minmax' or 'quantile' with (low, high) mapped to [-1, 1]; denominators at least FLOOR."""
    if method == "meanstd":
        return F.zip_with(F.zip_with(x, lo, lambda v, m: v - m), hi, lambda v, s: v / F.greatest(s, F.lit(FLOOR)))
    span = F.zip_with(hi, lo, lambda h, low: F.greatest(h - low, F.lit(FLOOR)))
    return F.zip_with(F.zip_with(x, lo, lambda v, low: v - low), span, lambda v, s: 2 * v / s - 1)


def denormalize(y: Column, method: str, lo: Column, hi: Column) -> Column:
    """The inverse of ``normalize``."""
    if method == "meanstd":
        return F.zip_with(F.zip_with(y, hi, lambda v, s: v * F.greatest(s, F.lit(FLOOR))), lo, lambda v, m: v + m)
    span = F.zip_with(hi, lo, lambda h, low: F.greatest(h - low, F.lit(FLOOR)))
    return F.zip_with(F.zip_with(y, span, lambda v, s: (v + 1) / 2 * s), lo, lambda v, low: v + low)


def asinh_scaled(z: Column) -> Column:
    return F.asinh(z) / F.asinh(F.lit(1.0))


def asinh_inverse(y: Column) -> Column:
    return F.sinh(y * F.asinh(F.lit(1.0)))


def asinh_tails(z: Column, beta: float) -> Column:
    """The identity up to 1 in size, beyond it 1 + asinh(beta (|z| - 1)) / beta with the sign of z."""
    tail = 1 + F.asinh(beta * (F.abs(z) - 1)) / beta
    return F.when(F.abs(z) <= 1, z).otherwise(F.signum(z) * tail)


def bounded_scale(x: Column, lo: Column, hi: Column, limit: float = 1.5) -> Column:
    """Value between quantile bounds mapped to [-1, 1] and clipped to +-limit; 0 where unknown or the bounds coincide."""
    y = 2 * (x - lo) / (hi - lo) - 1
    ok = x.isNotNull() & ~F.isnan(x) & (hi > lo)
    return F.when(ok, F.greatest(F.lit(-limit), F.least(F.lit(limit), y))).otherwise(0.0)


def padded(x: Column, width: int) -> Column:
    """Zero-padded to ``width``; null where the vector is wider."""
    extra = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(width) - F.size(x)))
    return F.when(F.size(x) <= width, F.concat(x.cast("array<double>"), extra))


def scaled(x: Column, factors: list[float]) -> Column:
    return F.zip_with(x, F.array(*[F.lit(f) for f in factors]), lambda v, f: v * f)

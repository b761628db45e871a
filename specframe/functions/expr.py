"""Small column expressions used everywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest positive normal double: the floor under logarithms and denominators.
TINY = 2.2250738585072014e-308
# Spacing of doubles at 1.0: the floor under pooled variances.
EPS = 2.220446049250313e-16


def rnd(column, digits: int = 6) -> Column:
    """Round for reporting; the added zero turns -0.0 into 0.0."""
    return F.round(column, digits) + F.lit(0.0)


def floor_tiny(column) -> Column:
    return F.greatest(column, F.lit(TINY))


def ratio(numerator, denominator) -> Column:
    """numerator / denominator, NULL unless the denominator is positive."""
    return F.when(denominator > 0, F.try_divide(numerator, denominator))


def hash_hex(seed, *parts) -> Column:
    """md5 of ``seed:part:part``; the same text in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def hash_mod(modulus, seed, *parts) -> Column:
    """First fifteen hex digits of the hash (60 bits) as an integer, modulo ``modulus``."""
    return F.conv(F.substring(hash_hex(seed, *parts), 1, 15), 16, 10).cast("bigint") % modulus


def correlation(x, y, on_constant: float | None = None) -> Column:
    """Pearson correlation aggregate that does not throw on a constant column.

    The co-moment aggregates merge centred partial sums, so large means do not cancel.
    """
    both = x.isNotNull() & y.isNotNull()
    sx = F.stddev_pop(F.when(both, x))
    sy = F.stddev_pop(F.when(both, y))
    value = F.try_divide(F.covar_pop(x, y), sx * sy)
    fallback = F.lit(None).cast("double") if on_constant is None else F.lit(float(on_constant))
    return F.when((sx > 0) & (sy > 0), value).otherwise(fallback)


def window_weights(n: int, kind: str) -> list[float]:
    """Hann taper of length n: ``hann_sym`` (denominator n-1) or ``hann_periodic`` (denominator n)."""
    span = {"hann_sym": n - 1, "hann_periodic": n}[kind]
    return [0.5 - 0.5 * math.cos(2.0 * math.pi * i / span) for i in range(n)]


def taper(position, n: int, kind: str) -> Column:
    span = {"hann_sym": n - 1, "hann_periodic": n}[kind]
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2.0 * math.pi / span) * position)

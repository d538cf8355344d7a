"""Comparison algebra: match and difference of two values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_GUARD = 1e-7


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def inverse_match(d, ave) -> Column:
    """Match of massless values: ave - |d|."""
    return F.lit(ave) - F.abs(col(d))


def direct_match(a, b, ave) -> Column:
    """Match of massive values: min - |difference| / 2 - ave."""
    a, b = col(a), col(b)
    return F.least(a, b) - F.abs(b - a) / 2 - F.lit(ave)


def division_match(a, b, ave) -> Column:
    """Match of lengths: int(r) * min - int(r) * frac(r) / 2 - ave, with r the larger of both ratios."""
    a, b = col(a), col(b)
    r = F.greatest(b / a, F.lit(1.0) / (b / a))
    whole = F.floor(r).cast("double")
    return whole * F.least(a, b) - (whole * (r - whole)) / 2 - F.lit(ave)


def signed_min(a, b) -> Column:
    """min(|a|, |b|), negative where the signs differ (0 isn't negative)."""
    a, b = col(a), col(b)
    return F.when((a < 0) != (b < 0), -F.least(F.abs(a), F.abs(b))).otherwise(F.least(F.abs(a), F.abs(b)))


def wrapped(delta) -> Column:
    """An angle difference in [-pi, pi]."""
    d = col(delta)
    return F.atan2(F.sin(d), F.cos(d))


def angle_match(a, b, unit: bool = True) -> Column:
    """Cosine of the difference of two angles, as 0 to 1 or (unit False) -1 to 1."""
    c = F.cos(col(b) - col(a))
    return (c + 1) / 2 if unit else c


def angle_difference(a, b, turn: float = 1.0) -> Column:
    """Wrapped difference over turn * pi."""
    return wrapped(col(b) - col(a)) / (F.lit(3.141592653589793) * turn)


def guarded(x) -> Column:
    x = col(x)
    return F.when(x == 0, F.lit(ZERO_GUARD)).otherwise(x)


def relative_value(pairs: list[tuple], weights: list[float]) -> Column:
    """Sum of w * m / (m + |d|) over (m, d) pairs."""
    out = F.lit(0.0)
    for (m, d), w in zip(pairs, weights):
        out = out + F.lit(float(w)) * col(m) / guarded(col(m) + F.abs(col(d)))
    return out

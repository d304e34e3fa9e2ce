"""Percentiles by three rules, and exact statistics on aggregated cells."""

from __future__ import annotations

from math import ceil, comb, exp, floor, lgamma, log, log1p

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile_nearest(c: Column, share: float) -> Column:
    """Nearest rank: the value at ceil(n * share) (NUM2).

    For groups of bounded size; ``percentile_disc`` in SQL has the same rule for large ones."""
    values = F.sort_array(F.collect_list(c))
    return F.get(values, F.greatest(F.lit(0), F.ceil(F.size(values) * F.lit(share)).cast("int") - 1))


def percentile_floor(c: Column, share: float) -> Column:
    """The value at position floor(n * share) from 0, the last at most (NUM3)."""
    values = F.sort_array(F.collect_list(c))
    return F.get(values, F.least(F.size(values) - 1, F.floor(F.size(values) * F.lit(share)).cast("int")))


def percentile_linear(c: Column, share: float) -> Column:
    """Linear interpolation (NUM4)."""
    return F.percentile(c, share)


def rate(n: Column, of: Column, digits: int = 6) -> Column:
    """Null where the denominator is zero (NUM9)."""
    return F.round(F.try_divide(n.cast("double"), of.cast("double")), digits)


def nearest_rank(values: list[float], share: float) -> float | None:
    values = sorted(values)
    return values[max(0, ceil(len(values) * share) - 1)] if values else None


def floor_rank(values: list[float], share: float) -> float | None:
    values = sorted(values)
    return values[min(len(values) - 1, floor(len(values) * share))] if values else None


def mcnemar_exact(only_a: int, only_b: int) -> float:
    """Two-sided exact p of the discordant cells (NUM6)."""
    n = only_a + only_b
    if not n:
        return 1.0
    few = min(only_a, only_b)
    if n > 1000:
        return min(1.0, 2 * _at_most(few, n, 0.5))
    tail = sum(comb(n, k) for k in range(few + 1))
    return min(1.0, 2 * tail / 2**n)


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction: about sqrt(a + b) steps, so a
    binomial tail costs no sum over all its terms."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out, m = d, 0
    while True:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15 or m > 10**6:
            return out * exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a


def _at_most(k: int, n: int, p: float) -> float:
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    return _beta_share(n - k, k + 1, 1 - p)


def _bisect(f, lo: float = 0.0, hi: float = 1.0) -> float:
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(hits: int, n: int, confidence: float = 0.95) -> tuple[float, float] | None:
    """Exact interval of a share (NUM7)."""
    if not n:
        return None
    half = (1 - confidence) / 2
    low = 0.0 if hits == 0 else _bisect(lambda p: 1 - _at_most(hits - 1, n, p) < half)
    high = 1.0 if hits == n else _bisect(lambda p: _at_most(hits, n, p) > half)
    return low, high


def upper_bound(errors: int, n: int, confidence: float = 0.95) -> float | None:
    """One-sided exact upper bound of an error share (NUM8)."""
    if not n:
        return None
    return 1.0 if errors == n else _bisect(lambda p: _at_most(errors, n, p) > 1 - confidence)

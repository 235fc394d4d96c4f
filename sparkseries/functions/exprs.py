"""Expressions that treat nulls, NaN, infinities and zero denominators in one way."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """True for numbers other than NaN and the infinities; false for null."""
    x = col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(INF)), F.lit(False))


def finite_or_null(c: str | Column) -> Column:
    return F.when(is_finite(c), col(c).cast("double"))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double; null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def positive_zero(c: Column) -> Column:
    """-0.0 becomes 0.0, so that results compare equal as bits too."""
    return c + F.lit(0.0)


def rounded(c: str | Column, digits: int = 6) -> Column:
    return positive_zero(F.round(col(c).cast("double"), digits))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r as an aggregate; null where a side is constant or there are fewer than two pairs. Pairs with a null are left out."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to [low, high], either side open; null and NaN stay."""
    x = col(c)
    out = x
    if low is not None:
        out = F.when(~F.isnan(x) & (x < low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(~F.isnan(x) & (x > high), F.lit(high)).otherwise(out)
    return out


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Horner's rule, highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


#: Acklam's rational approximation of the inverse normal distribution (fixed values).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def normal_quantile(p: str | Column) -> Column:
    """The standard normal quantile, relative error about 1e-9; null outside (0, 1)."""
    x = col(p)
    low = F.sqrt(-2 * F.ln(F.when(x > 0, x)))
    high = F.sqrt(-2 * F.ln(F.when(x < 1, 1 - x)))
    r = (x - 0.5) * (x - 0.5)
    middle = polynomial(r, _A) * (x - 0.5) / polynomial(r, _B)
    return F.when((x <= 0) | (x >= 1), F.lit(None).cast("double")).when(x < 0.02425, polynomial(low, _C) / polynomial(low, _D)).when(x > 0.97575, -polynomial(high, _C) / polynomial(high, _D)).otherwise(middle)


def normal_density(x: str | Column, mean: str | Column, deviation: str | Column) -> Column:
    z = ratio(col(x) - col(mean), deviation)
    return F.exp(-0.5 * z * z) / (col(deviation) * math.sqrt(2 * math.pi))

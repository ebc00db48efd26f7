"""Missing values, rounding, normal quantiles and the Wilson interval."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and the infinities as NULL, which aggregates skip."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def rounded(c: Column | str, places: int = 6) -> Column:
    """Half to even, without a negative zero; non-finite values become NULL."""
    return F.bround(finite(c), places) + F.lit(0.0)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0 or either is NULL."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def z_for(alpha: float) -> float:
    """The two-sided normal quantile."""
    return NormalDist().inv_cdf(1 - alpha / 2)


def wilson(k: Column | str, n: Column | str, alpha: float = 0.05) -> tuple[Column, Column]:
    """Wilson's interval for k of n, clamped to [0, 1]; (0, 1) without observations."""
    k, n, z = col(k).cast("double"), col(n).cast("double"), z_for(alpha)
    p = F.try_divide(k, n)
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    known = n > 0
    return F.when(known, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(known, F.least(F.lit(1.0), centre + half)).otherwise(1.0)


def relative_error(counted: Column | str, true: Column | str) -> Column:
    """Absolute relative error of a count; NULL unless the true count is positive."""
    counted, true = col(counted).cast("double"), col(true).cast("double")
    return F.when(true > 0, F.abs(counted - true) / true)

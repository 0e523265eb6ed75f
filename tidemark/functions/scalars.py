"""Guarded arithmetic and the normal law as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.periods import ColumnOrName, _c


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den, NULL when the denominator is zero or missing."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def finite(x: ColumnOrName) -> Column:
    """NaN and infinities become NULL."""
    x = _c(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(x: ColumnOrName, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; NULL stays NULL (greatest/least alone would skip it)."""
    x = _c(x)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def log_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """ln(num / den) only where both are strictly positive."""
    n, d = _c(num), _c(den)
    return F.when((n > 0) & (d > 0), F.log(n) - F.log(d))


def logit(p: ColumnOrName) -> Column:
    p = _c(p)
    return F.when((p > 0) & (p < 1), F.log(p) - F.log1p(-p))


def expit(x: ColumnOrName) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


# Hart's rational approximation of the upper normal tail.
HART_NUM = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_DEN = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
# Acklam's rational approximation of the normal quantile.
PPF_A = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
PPF_B = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
PPF_C = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
PPF_D = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)


def _horner(coefs, x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefs[1:], F.lit(coefs[0]))


def normal_pdf(x: ColumnOrName) -> Column:
    x = _c(x)
    return F.exp(-x * x / 2) * 0.3989422804014327


def normal_cdf(x: ColumnOrName) -> Column:
    """Phi(x) to about 1e-15; built-in arithmetic only."""
    x = _c(x).cast("double")
    z = F.abs(x)
    near = F.exp(-z * z / 2) * _horner(HART_NUM, z) / _horner(HART_DEN, z)
    frac = z + 1.0 / (z + 2.0 / (z + 3.0 / (z + 4.0 / (z + 0.65))))
    far = F.exp(-z * z / 2) / (frac * 2.506628274631)
    tail = F.when(z > 37, 0.0).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def normal_ppf(p: ColumnOrName) -> Column:
    """Phi^-1(p) for 0 < p < 1, else NULL."""
    p = _c(p).cast("double")
    q = p - 0.5
    r = q * q
    mid = q * _horner(PPF_A, r) / _horner(PPF_B, r)
    tl = F.sqrt(-2.0 * F.log(p))
    tu = F.sqrt(-2.0 * F.log(1.0 - p))
    low = _horner(PPF_C, tl) / _horner(PPF_D, tl)
    high = -_horner(PPF_C, tu) / _horner(PPF_D, tu)
    return (
        F.when((p <= 0) | (p >= 1), None)
        .when(p < 0.02425, low)
        .when(p > 1 - 0.02425, high)
        .when(p.isNotNull(), mid)
    )


def two_sided_p(z: ColumnOrName) -> Column:
    return 2.0 * (1.0 - normal_cdf(F.abs(_c(z))))

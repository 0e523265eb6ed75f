"""Array expressions: interpolation, sums, monotone repair."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def arr_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def interp(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear value at x on increasing knots, flat beyond the ends."""
    n = F.size(xs)
    k = F.size(F.filter(xs, lambda v: v <= x))
    x0, x1 = F.element_at(xs, F.greatest(k, F.lit(1))), F.element_at(xs, F.least(k + 1, n))
    y0, y1 = F.element_at(ys, F.greatest(k, F.lit(1))), F.element_at(ys, F.least(k + 1, n))
    return (
        F.when(k == 0, F.element_at(ys, 1))
        .when(k == n, F.element_at(ys, n))
        .otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    )


def make_pool_adjacent():
    """Pool adjacent violators on sorted blocks; pooling is associative, so blocks of blocks are exact.

    Returned as a local function so that it travels to the workers by value."""

    def pool_adjacent(x_lo, x_hi, y, w):
        out = []
        for a, b, v, k in zip(x_lo, x_hi, y, w):
            out.append([a, b, v, k])
            while len(out) > 1 and out[-2][2] >= out[-1][2]:
                p, q = out[-2], out.pop()
                t = p[3] + q[3]
                out[-1] = [p[0], q[1], (p[2] * p[3] + q[2] * q[3]) / t, t]
        return out

    return pool_adjacent


def isotonic(vector: Column) -> Column:
    """Least-squares non-decreasing fit of a short vector (at most 99 levels), Arrow-batched."""
    pool = make_pool_adjacent()

    def fit_one(v):
        blocks = pool(range(len(v)), range(len(v)), v, [1.0] * len(v))
        return [m for lo, hi, m, _ in blocks for _ in range(hi - lo + 1)]

    def fit_all(vectors: pd.Series) -> pd.Series:
        return vectors.map(fit_one, na_action="ignore")

    return F.pandas_udf(fit_all, "array<double>")(vector)

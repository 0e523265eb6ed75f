"""Closed-form solves of tiny systems.

Row data never reaches these: a Spark aggregation first reduces it to the p x p
moments, then a Cramer expression (p <= 3) stays in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def det3(m) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def solve2(a11, a12, a22, b1, b2, tol: float = 1e-12) -> list[Column]:
    """Solve the symmetric 2x2 system; NULL when singular."""
    det = a11 * a22 - a12 * a12
    ok = F.abs(det) > tol
    return [F.when(ok, (b1 * a22 - b2 * a12) / det), F.when(ok, (a11 * b2 - a12 * b1) / det)]


def solve3(m, b, tol: float = 1e-9) -> list[Column]:
    """Solve a 3x3 system by Cramer's rule; NULL when singular."""
    det = det3(m)
    out = []
    for k in range(3):
        mk = [[b[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]
        out.append(F.when(F.abs(det) > tol, det3(mk) / det))
    return out


def gram_columns(xs: dict[str, Column], y: Column | None = None) -> list[Column]:
    """Sums of products of the regressors (and with y), upper triangle, one pass."""
    names = list(xs)
    out = [
        F.sum(xs[a] * xs[b]).alias(f"g_{a}_{b}")
        for i, a in enumerate(names)
        for b in names[i:]
    ]
    if y is not None:
        out += [F.sum(xs[a] * y).alias(f"gy_{a}") for a in names]
        out += [F.sum(y * y).alias("gyy"), F.count(F.lit(1)).alias("gn")]
    return out

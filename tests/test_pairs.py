"""Pair statistics on continuous columns against plain double loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import pairs as PR


def rows_of(spark, b, x, y, extra=()):
    rows = [(int(i), float(u), float(v)) for i, u, v in zip(b, x, y)] + list(extra)
    return spark.createDataFrame(rows, "b int, x double, y double").repartition(5)


def slow_pim(b, x, y):
    """Slope, information and variance by visiting every pair."""
    blocks = [np.flatnonzero(b == k) for k in np.unique(b)]
    z = [x[i][None, :] - x[i][:, None] for i in blocks]
    s = [(y[i][:, None] < y[i][None, :]) + 0.5 * (y[i][:, None] == y[i][None, :]) for i in blocks]
    beta = 0.0
    for _ in range(60):
        p = [1 / (1 + np.exp(-beta * d)) for d in z]
        beta += sum((d * (f - q)).sum() for d, f, q in zip(z, s, p)) / sum((d * d * q * (1 - q)).sum() for d, q in zip(z, p))
    p = [1 / (1 + np.exp(-beta * d)) for d in z]
    info = sum((d * d * q * (1 - q)).sum() for d, q in zip(z, p)) / 2
    u = [d * (f - q) for d, f, q in zip(z, s, p)]
    meat = sum((m.sum(axis=1) ** 2).sum() for m in u) - sum((m**2).sum() for m in u) / 2
    return beta, info, meat / info**2


@pytest.mark.parametrize("kind", ["continuous", "tied", "steep"])
def test_pim_equals_a_double_loop(spark, kind):
    rng = np.random.default_rng({"continuous": 1, "tied": 2, "steep": 3}[kind])
    n = 500
    b, x = rng.integers(0, 3, n), rng.normal(size=n) * 2
    y = 0.7 * x + rng.normal(size=n)
    if kind == "tied":
        x, y = np.round(x), np.round(y)
        y[: n // 3] = 1.0
    if kind == "steep":
        x[0] = 40.0
        y = 6 * x + rng.normal(size=n)
    beta, info, var = slow_pim(b, x, y)
    df = rows_of(spark, b, x, y, [(0, None, 1.0), (1, 2.0, None)])
    got = PR.pim_vcov(df, block=["b"], x="x", y="y")
    assert got["beta"] == pytest.approx(beta, rel=1e-9)
    assert got["information"] == pytest.approx(info, rel=1e-9)
    assert got["variance"] == pytest.approx(var, rel=1e-7)
    assert PR.pim_fit(df, block=["b"], x="x", y="y")["beta"] == pytest.approx(beta, rel=1e-9)


def test_ordered_sum_by_halves_equals_all_pairs():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=700), np.round(rng.normal(size=700), 1)
    cells = PR.Cells(x.min(), x.max(), PR.CELLS)
    kernel = PR._kernels(cells.shifts, cells.h, 1.3)["pair"]
    z = x[None, :] - x[:, None]
    want = (z * z * np.tanh(1.3 * z / 2))[y[:, None] < y[None, :]].sum()
    assert PR._ordered_sum(x, y, cells, 1.3, kernel, leaf=32) == pytest.approx(want, rel=1e-10)


def test_transforms_equal_direct_sums():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=5000), rng.normal(size=5000)
    assert np.allclose(PR._correlate(a, b), np.correlate(a, b, "full"), atol=1e-9)
    k = rng.normal(size=2 * 300 - 1)
    m = rng.normal(size=300)
    want = [sum(k[j - i + 299] * m[j] for j in range(300)) for i in range(300)]
    assert np.allclose(PR._far(m, k), want)
    padded = np.concatenate([np.zeros(299), m, np.zeros(299)])
    assert np.allclose(np.correlate(padded, k, "valid"), want)


def slow_below(b, x, y, w):
    out = {}
    for i in range(len(b)):
        at = (b == b[i]) & (x <= x[i]) & (y <= y[i])
        out[int(b[i]), float(x[i]), float(y[i])] = int(w[at].sum())
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_below_sums_equal_a_double_loop(spark, monkeypatch, hot):
    rng = np.random.default_rng(6)
    n = 600
    b, x, y, w = rng.integers(0, 2, n), np.round(rng.normal(size=n), 2), np.round(rng.normal(size=n), 2), rng.integers(0, 3, n)
    if hot:
        x[: n // 3], y[n // 4 : n // 2] = 0.25, -0.5
    df = spark.createDataFrame([(int(i), float(u), float(v), int(k), 7) for i, u, v, k in zip(b, x, y, w)], "b int, x double, y double, w int, _s int")
    df = df.unionByName(spark.createDataFrame([(0, None, 1.0, 5, 1)], df.schema))
    got = PR.below_sums(df, block=["b"], a="x", b="y", weights=["w"]).collect()
    assert {(r["b"], r["x"], r["y"]): r["below_w"] for r in got} == slow_below(b, x, y, w)
    assert len(got) == len(set(zip(b, x, y)))
    assert PR.below_sums(df.limit(0), block=["b"], a="x", b="y", weights=["w"]).count() == 0


def test_odd_slices_hold_one_value(spark):
    df = spark.createDataFrame([(float(k % 7 == 0) * 3.5 + float(k % 7 != 0) * k,) for k in range(400)], "v double")
    got = df.withColumn("s", PR.value_slices(df, "v", 400)).groupBy("s").agg(F.countDistinct("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("s").collect()
    assert all(r["n"] == 1 for r in got if r["s"] % 2)
    assert all(a["hi"] < b["lo"] for a, b in zip(got, got[1:]))


def slow_dominance(y, a, b, o, c):
    out = {}
    for k in np.unique(y):
        at = np.flatnonzero(y == k)
        n, dom, conc, inc, agree = len(at), 0, 0.0, 0, 0.0
        for i in at:
            for j in at:
                if a[i] <= a[j] and b[i] <= b[j] and (a[i] < a[j] or b[i] < b[j]):
                    dom += 1
                    conc += 1.0 if o[j] < o[i] else 0.5 if o[j] == o[i] else 0.0
                elif c[i] < c[j]:
                    inc += 1
                    agree += 1.0 if o[j] < o[i] else 0.5 if o[j] == o[i] else 0.0
        out[int(k)] = (n, dom, 2 * dom / (n * (n - 1)), conc / dom, inc, agree / inc)
    return out


@pytest.mark.parametrize("graded", [False, True])
def test_dominance_equals_a_double_loop(spark, graded):
    rng = np.random.default_rng(8)
    n = 240
    y, a, b, o = rng.integers(0, 3, n), rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    if graded:
        a, b, o = np.round(a), np.round(b * 2), np.round(o)
    c = a + 0.61803 * b
    rows = [(k, int(p), float(q), float(r), float(s), float(t)) for k, (p, q, r, s, t) in enumerate(zip(y, a, b, o, c))]
    df = spark.createDataFrame([*rows, (999, 0, None, 1.0, 1.0, 1.0)], "e int, y int, a double, b double, o double, c double")
    got = {r["y"]: r for r in PR.dominance_summary(df, block=["y"], axes=["a", "b"], outcome="o", composite="c").collect()}
    for k, want in slow_dominance(y, a, b, o, c).items():
        assert tuple(got[k])[1:] == pytest.approx(want, rel=1e-12)
    ranks = {r["e"]: r for r in PR.average_rank_local(df, block=["y"], axes=["a", "b"], entity="e").collect()}
    assert len(ranks) == n
    for i in range(0, n, 17):
        at = np.flatnonzero(y == y[i])
        low = sum(a[j] <= a[i] and b[j] <= b[i] and (a[j] < a[i] or b[j] < b[i]) for j in at)
        high = sum(a[j] >= a[i] and b[j] >= b[i] and (a[j] > a[i] or b[j] > b[i]) for j in at)
        assert (ranks[i]["below"], ranks[i]["above"]) == (low, high)
        assert ranks[i]["avg_rank"] == pytest.approx((low + 1) * (len(at) + 1) / (low + high + 2))


def test_merged_sums_equal_brute_force_and_walk_levels_not_points():
    import time

    rng = np.random.default_rng(2)
    for n, k in ((1, 2), (40, 3), (300, 50), (300, 10**6)):
        a, b, w = rng.integers(-k, k, n).astype(float), rng.integers(-k, k, n).astype(float), rng.integers(0, 5, n)
        want = ((a[None] <= a[:, None]) & (b[None] <= b[:, None])) @ w
        assert (PR._merged_sums(a, b, w) == want).all()
    n = 400_000
    start = time.process_time()
    PR._merged_sums(rng.random(n), rng.random(n), np.ones(n, np.int64))
    assert time.process_time() - start < 6  # before: 46 us a point

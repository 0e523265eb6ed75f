"""Correspondence axes, their clock and the order's significance against dense NumPy."""

import numpy as np
import pytest

from tidemark.operators import seriation as SE

NAMES = dict(period="period", part="part", amount="amount")


def frame(spark, x, start=100):
    rows = [(start + t, f"p{j}", float(v)) for t, r in enumerate(x) for j, v in enumerate(r) if v]
    return spark.createDataFrame(rows, "period int, part string, amount double").repartition(4)


def dense(x):
    p = x / x.sum()
    r, c = p.sum(1), p.sum(0)
    u, s, vt = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(len(s))])
    return u * sign, s, vt.T * sign, r, c


def test_axes_equal_a_dense_decomposition(spark):
    x = np.random.default_rng(1).lognormal(size=(12, 40))
    x[3, :30] = 0
    u, s, v, r, c = dense(x)
    rows, cols, share = SE.correspondence_axes(frame(spark, x), **NAMES)
    got = rows.orderBy("period").toPandas()
    assert np.allclose(got[["axis1", "axis2"]], (u * s / np.sqrt(r)[:, None])[:, :2], atol=1e-8)
    got = cols.toPandas().set_index("part").loc[[f"p{j}" for j in range(40)]]
    assert np.allclose(got[["axis1", "axis2"]], (v * s / np.sqrt(c)[:, None])[:, :2], atol=1e-8)
    assert share == pytest.approx((s**2 / (s**2).sum())[:2])


def drifting(t=16, j=30, seed=2):
    rng = np.random.default_rng(seed)
    centre = np.linspace(-2, t + 2, j)
    return np.exp(-((np.arange(t)[:, None] - centre[None, :]) ** 2) / 18) * rng.uniform(0.8, 1.2, (t, j))


def test_clock_uses_earlier_periods_only(spark):
    x = drifting()
    x[12:, 5] = 0
    x[:13, 29] = 0  # a part that appears late
    got = SE.mix_clock(frame(spark, x), **NAMES, min_train=8).toPandas().set_index("period")
    assert list(sorted(got.index)) == list(range(108, 116))
    for o in range(8, 16):
        past = x[:o][:, x[:o].sum(0) > 0]
        u, s, v, r, c = dense(past)
        known = np.column_stack([np.ones(o), (u * s / np.sqrt(r)[:, None])[:, :2]])
        beta = np.linalg.lstsq(known, np.arange(100.0, 100 + o), rcond=None)[0]
        new = x[o][x[:o].sum(0) > 0]
        place = (new / new.sum()) @ (v / np.sqrt(c)[:, None])[:, :2]
        assert got.loc[100 + o].fit == pytest.approx(np.append(1, place) @ beta, rel=1e-7)
        assert got.loc[100 + o]["last"] == 99 + o
    future = x.copy()
    future[14:] = 1.0
    again = SE.mix_clock(frame(spark, future), **NAMES, min_train=8).toPandas().set_index("period")
    assert np.allclose(again.fit.loc[108:113], got.fit.loc[108:113])


def test_local_maxima():
    assert SE.local_maxima(np.array([[1.0, 3, 2], [2, 1, 2], [2, 3, 2], [1, 1, 2]])) == 1 + 2 + 0


def test_order_is_significant_and_draws_are_reproducible(spark):
    x = np.rint(drifting(t=14, j=12) * 60)
    rng = np.random.default_rng(5)
    df = frame(spark, x[rng.permutation(14)])
    one = SE.seriation_significance(df, period="period", part="part", count="amount", draws=60).first()
    two = SE.seriation_significance(df.repartition(7), period="period", part="part", count="amount", draws=60).first()
    assert one == two and one["draws"] == 60 and one["maximum"] == 12 * 7
    assert one["observed"] == SE.seriated_maxima(x) and one["observed"] < one["expected"] and one["p"] == 0.0
    noise = np.random.default_rng(6).poisson(20, (14, 12)).astype(float)
    r = SE.seriation_significance(frame(spark, noise), period="period", part="part", count="amount", draws=60).first()
    assert 0.02 < r["p"] < 0.98


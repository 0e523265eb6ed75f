"""Association trees and sparse change points against planted cases and dense NumPy."""

import math

import numpy as np
import pytest

from tidemark.operators import partition as PT


def test_planted_tree_is_recovered(spark):
    rng = np.random.default_rng(1)
    n = 4000
    a, b, c, noise = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    mean = np.where(a <= 0.3, np.where(b <= -0.5, 0.0, np.where(c <= 0, 6.0, 9.0)), np.where(b <= 0.8, 20.0, 26.0))
    y = mean + 0.3 * rng.normal(size=n)
    rows = [(float(u), float(v), float(w), float(z), float(k)) for u, v, w, z, k in zip(a, b, c, noise, y)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, z double, y double").repartition(6)
    out, nodes = PT.association_tree(df, y="y", xs=["a", "b", "c", "z"], depth=3, alpha=0.001, min_bucket=50)
    got = {r["node"]: r for r in nodes.collect()}
    assert got[1]["feature"] == "a" and got[1]["cut"] == pytest.approx(0.3, abs=0.02)
    assert got[2]["feature"] == "b" and got[2]["cut"] == pytest.approx(-0.5, abs=0.02)
    assert got[3]["feature"] == "b" and got[3]["cut"] == pytest.approx(0.8, abs=0.02)
    assert got[5]["feature"] == "c" and got[5]["cut"] == pytest.approx(0.0, abs=0.02)
    assert got[4]["feature"] is None and {k for k, r in got.items() if r["feature"] is None} >= {4, 6, 7, 10, 11}
    # the cut of the root is the best of all by plain search, and rows lie where the cuts say
    order = np.argsort(a)
    s, total = np.cumsum(y[order])[:-1], y.sum()
    k = np.arange(1, n)
    gain = s**2 / k + (total - s) ** 2 / (n - k) - total**2 / n
    gain[(k < 50) | (k > n - 50)] = -1
    assert got[1]["cut"] == a[order][gain.argmax()] and got[1]["gain"] == pytest.approx(gain.max(), rel=1e-9)
    leaf = out.groupBy("node").agg({"y": "avg", "*": "count"}).collect()
    assert {r["node"]: r["count(1)"] for r in leaf} == {k: r["n"] for k, r in got.items() if r["feature"] is None}
    assert all(r["avg(y)"] == pytest.approx(got[r["node"]]["mean"]) for r in leaf)


def test_noise_gives_a_single_leaf(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(u), float(v)) for u, v in rng.normal(size=(500, 2))], "x double, y double")
    rows, nodes = PT.association_tree(df, y="y", xs=["x"], alpha=0.001)
    assert [r["node"] for r in nodes.collect()] == [1] and rows.where("node = 1").count() == 500
    assert PT.association_tree(df.limit(0), y="y", xs=["x"])[1].count() == 0
    still = spark.createDataFrame([(float(k > 100), 2.0, float(k > 100)) for k in range(200)], "x double, c double, y double")
    nodes = {r["node"]: r for r in PT.association_tree(still, y="y", xs=["c", "x"])[1].collect()}
    assert set(nodes) == {1, 2, 3} and nodes[1]["feature"] == "x" and nodes[1]["cut"] == 0.0


def panel(p=200, n=80, moved=10, at=30, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(p, n)) * rng.uniform(0.5, 3, p)[:, None]
    x[:moved, at:] += 1.6 * x[:moved].std(axis=1)[:, None] * np.where(np.arange(moved) % 2, 1, -1)[:, None]
    return x


def frame(spark, x):
    return spark.createDataFrame([(f"s{i}", int(100 + t), float(v)) for i, r in enumerate(x) for t, v in enumerate(r)], "s string, t int, v double").repartition(5)


def test_change_in_few_series_equals_dense_algebra(spark):
    x = panel()
    x[150] = 4.0  # never moves
    df = frame(spark, x)
    extra = spark.createDataFrame([("late", 120, 1.0), ("s1", 100, None)], df.schema)
    got, load = PT.sparse_changepoint(df.unionByName(extra), series="s", index="t", value="v")
    assert got["p"] == 200 and got["n"] == 80
    assert abs(got["split_at"] - 129) <= 1
    z = np.array([PT._scaled(r) if r.std() > 0 else np.zeros(80) for r in x])
    t = np.arange(1, 80)
    c = np.array([np.sqrt(t * (80 - t) / 80) * np.array([r[k:].mean() - r[:k].mean() for k in t]) for r in z])
    soft = np.sign(c) * np.maximum(np.abs(c) - math.sqrt(math.log(200 * math.log(80)) / 2), 0)
    v = np.linalg.svd(soft)[0][:, 0]
    have = {r["s"]: r["loading"] for r in load.collect()}
    mine = np.array([have[f"s{i}"] for i in range(200)])
    mine *= np.sign(mine @ v)
    assert np.allclose(mine, v, atol=1e-6)
    w = np.abs([math.sqrt(k * (80 - k) / 80) * ((v @ z)[k:].mean() - (v @ z)[:k].mean()) for k in t])
    assert got["split_at"] == 100 + int(np.argmax(w)) and got["stat"] == pytest.approx(w.max(), rel=1e-6)
    assert set(np.argsort(-np.abs(mine))[:10]) == set(range(10))


def test_two_changes_and_none(spark):
    x = panel(p=60, at=25)
    x[20:32, 55:] += 2.5 * x[20:32].std(axis=1)[:, None]
    got = sorted(r["split_at"] for r in PT.sparse_segmentation(frame(spark, x), series="s", index="t", value="v", threshold=8.5, min_size=10).collect())
    assert len(got) == 2 and abs(got[0] - 124) <= 1 and abs(got[1] - 154) <= 1
    calm = np.random.default_rng(8).normal(size=(40, 30))
    assert PT.sparse_segmentation(frame(spark, calm), series="s", index="t", value="v", threshold=8.5, min_size=10).count() == 0
    one, load = PT.sparse_changepoint(frame(spark, np.ones((3, 10))), series="s", index="t", value="v")
    assert one["split_at"] is None and load.count() == 0

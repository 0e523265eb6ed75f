"""The baseline ladder's scores and joint bootstrap against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ladder as L


def predictions(spark, seed=1, n=300):
    rng = np.random.default_rng(seed)
    e, y = rng.integers(0, 25, n), rng.integers(0, 2, n).astype(float)
    scores = {"good": y + rng.normal(size=n), "tied": np.round(y + rng.normal(size=n)), "flat": np.full(n, 0.5)}
    rows = [(str(k), f"e{e[k]}", m, float(y[k]), float(s[k])) for m, s in scores.items() for k in range(n)]
    return e, y, scores, spark.createDataFrame(rows, "row_id string, entity string, model string, label double, score double").repartition(6)


def weights_of(spark, names, reps, seed=11):
    ids = {r["e"]: r["h"] for r in spark.createDataFrame([(v,) for v in names], "e string").select("e", F.xxhash64("e").alias("h")).collect()}
    return {v: L.poisson_weights(np.array([ids[v]]), seed, reps)[0] for v in names}


def slow_auc(y, s, w):
    num = den = 0.0
    for i in np.flatnonzero(y == 1):
        for j in np.flatnonzero(y == 0):
            num += w[i] * w[j] * (1.0 if s[i] > s[j] else 0.5 if s[i] == s[j] else 0.0)
            den += w[i] * w[j]
    return num / den


def test_auc_of_every_replicate_equals_all_pairs(spark):
    e, y, scores, df = predictions(spark)
    w = weights_of(spark, [f"e{k}" for k in range(25)], 4)
    got = {(r["model"], r["rep"]): r["value"] for r in L.auc_replicates(df, reps=4).collect()}
    assert len(got) == 12
    for m, s in scores.items():
        for rep in range(4):
            assert got[m, rep] == pytest.approx(slow_auc(y, s, np.array([w[f"e{k}"][rep] for k in e])), rel=1e-10)


def test_errors_and_paired_differences(spark):
    e, y, scores, df = predictions(spark, 2)
    w = weights_of(spark, [f"e{k}" for k in range(25)], 41)
    per = {m: [np.average(np.abs(y - s), weights=[w[f"e{k}"][rep] for k in e]) for rep in range(41)] for m, s in scores.items()}
    got = {r["model"]: r for r in L.ladder_scores(df, kind="reg", pairs=[("good", "flat")], reps=40).collect()}
    assert set(got) == {"good", "tied", "flat", "good - flat"}
    for m, v in per.items():
        assert got[m]["value"] == pytest.approx(v[0]) and got[m]["lower"] == pytest.approx(np.percentile(v[1:], 2.5)) and got[m]["upper"] == pytest.approx(np.percentile(v[1:], 97.5))
    d = np.array(per["good"]) - np.array(per["flat"])
    assert got["good - flat"]["value"] == pytest.approx(d[0]) and got["good - flat"]["lower"] == pytest.approx(np.percentile(d[1:], 2.5))


def test_weights_are_poisson_and_reproducible():
    w = L.poisson_weights(np.arange(4000), 3, 50)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.01 and abs(w[:, 1:].var() - 1) < 0.02
    assert (w == L.poisson_weights(np.arange(4000), 3, 50)).all() and (w[:, 1:] != L.poisson_weights(np.arange(4000), 4, 50)[:, 1:]).any()


@pytest.mark.parametrize("kind", ["clf", "reg"])
def test_rungs_learn_from_training_rows(spark, kind):
    rng = np.random.default_rng(5)
    n = 400
    a, b = rng.normal(size=n), rng.normal(size=n)
    signal = a + 2 * b + 0.3 * rng.normal(size=n)
    y = (signal > 0).astype(float) if kind == "clf" else signal
    rows = [(f"r{k}", k % 40, "train" if k < 280 else "val", float(y[k]), None if k % 17 == 0 else float(a[k]), float("inf") if k % 23 == 0 else float(b[k]), None) for k in range(n)]
    task = spark.createDataFrame([*rows, ("x", 1, "val", None, 1.0, 1.0, None)], "row_id string, bank int, split string, label double, s_a double, r_b double, r_none double")
    preds = L.ladder_predictions(task, kind=kind, entity="bank", naive=F.col("s_a"), last=F.col("s_a") if kind == "reg" else None, iters=5)
    names = {r["model"]: r["count"] for r in preds.groupBy("model").count().collect()}
    rungs = {"naive", "linear_own", "linear_relational", "boosted_own", "boosted_relational"} | ({"train_median", "naive_last"} if kind == "reg" else set())
    assert names == {m: 120 for m in rungs}
    got = {r["model"]: r for r in L.ladder_scores(preds, kind=kind, pairs=[("linear_relational", "linear_own")], reps=30).collect()}
    better = (lambda p, q: p > q) if kind == "clf" else (lambda p, q: p < q)
    assert better(got["linear_relational"]["value"], got["linear_own"]["value"]) and better(got["boosted_relational"]["value"], got["boosted_own"]["value"])
    d = got["linear_relational - linear_own"]
    assert d["lower"] <= d["value"] <= d["upper"] and better(d["value"], 0.0)

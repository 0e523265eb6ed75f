"""Hand-sized cases for calendar, join, quality and source operators."""

import datetime as dt
import math
import zipfile
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import holidays as H
from tidemark.functions import scalars as S
from tidemark.functions.hashing import draw_int
from tidemark.operators import calendar as C
from tidemark.operators import joins as J
from tidemark.operators import quality as Q
from tidemark.operators import ranks as R


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_decumulate_full_year_then_next(spark):
    ytd = [(1, 8000 + i, v) for i, v in enumerate([10.0, 25.0, 21.0, 40.0, 8.0])]
    df = C.decumulate(spark.createDataFrame(ytd, "entity long, q int, ytd double"))
    assert [r.flow_q for r in df.orderBy("q").collect()] == [10.0, 15.0, -4.0, 19.0, 8.0]


def test_decumulate_gap_stays_missing(spark):
    data = [(1, 8000, 10.0), (1, 8002, 30.0), (1, 8003, 45.0), (2, 8001, 5.0)]
    df = C.decumulate(spark.createDataFrame(data, "entity long, q int, ytd double"))
    got = {(r.entity, r.q): (r.flow_q, r.missing_prior) for r in df.collect()}
    assert got == {(1, 8000): (10.0, False), (1, 8002): (None, True), (1, 8003): (15.0, False), (2, 8001): (None, True)}


def test_entrant_counts_first_filing(spark):
    df = spark.createDataFrame([(1, 8001, 5.0), (1, 8002, 9.0)], "entity long, q int, ytd double")
    got = C.entrant_rule(C.decumulate(df)).orderBy("q").collect()
    assert [r.flow_b for r in got] == [5.0, 4.0]


def test_discontinuity_flags(spark):
    df = spark.createDataFrame([(1, 8000, 5.0), (1, 8001, 4.0), (1, 8002, -1.0), (1, 8003, -2.0)], "entity long, q int, f double")
    got = C.discontinuity_flags(df, flow="f").orderBy("q").collect()
    assert [r.negative_flow for r in got] == [False, False, True, True]
    assert [r.sign_break for r in got] == [False, False, True, False]


def test_exp_smoothing_keeps_level_on_missing(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 10.0), (1, 3, None), (1, 4, 20.0)], "entity long, q int, v double")
    got = C.exp_smoothing(df, value="v", alpha=0.3).orderBy("q").collect()
    assert [r.level for r in got] == [None, 10.0, 10.0, pytest.approx(13.0)]


def test_ranks_match_pandas_under_skew(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.zeros(700), rng.integers(0, 50, 1300)]).astype(float)
    k = np.where(np.arange(2000) % 3 == 0, 1, rng.integers(2, 9, 2000))
    import pandas as pd

    pdf = pd.DataFrame({"id": range(2000), "k": k, "v": v})
    got = R.rank_average(spark.createDataFrame(pdf), ["k"], "v", "r").toPandas().set_index("id").sort_index()
    want = pdf.groupby("k").v.rank()
    assert np.allclose(got.r, want)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=3000), 2)
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)], "k int, v double")
    got = {(r.k, r.tau): r.qv for r in R.exact_quantiles(df, ["k"], "v", [0.0, 0.01, 0.37, 0.5, 1.0]).collect()}
    for (k, t), q in got.items():
        assert q == pytest.approx(np.quantile(v[k::2], t), abs=1e-12)
    assert len(got) == 10


def test_asof_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=int(i))
    left = [(i, int(rng.integers(0, 4)), day(rng.integers(0, 400))) for i in range(300)]
    right = [(i, int(rng.integers(0, 4)), day(rng.integers(30, 400)), float(i)) for i in range(120)]
    L = spark.createDataFrame(left, "id long, k int, t date")
    Rt = spark.createDataFrame(right, "rid long, k int, a date, v double")
    got = {r.id: r.v for r in J.asof_join(L, Rt, on="t", right_on="a", cols=["v"], by=["k"], order_tie="rid").collect()}
    for i, k, t in left:
        c = [(a, rid, v) for rid, kk, a, v in right if kk == k and a <= t]
        assert got[i] == (max(c)[2] if c else None)


def test_interval_counts_match_brute_force(spark):
    rng = np.random.default_rng(4)
    a = sorted({int(x) for x in rng.integers(0, 900, 150)})
    b = [int(x) for x in rng.integers(0, 900, 200)]
    A = spark.createDataFrame([(x,) for x in a], "t long")
    B = spark.createDataFrame([(x,) for x in b], "t long")
    got = {r.t: r.n_hits for r in J.interval_join_events(A, B, time="t", tol=5, tau=3).collect()}
    assert got == {t: sum(t - 8 <= x <= t - 3 for x in b) for t in a}


def test_unique_key_check_fails_loudly(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    with pytest.raises(Exception, match="duplicate key"):
        Q.assert_unique_key(df, ["a"]).collect()
    assert Q.assert_unique_key(df, ["a", "b"]).count() == 2


def test_normal_law(spark):
    xs = [-8.0, -3.0, -0.5, 0.0, 0.7, 2.5, 6.0]
    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.999]
    df = spark.createDataFrame(list(zip(xs, ps)), "x double, p double")
    for r in df.select("x", "p", S.normal_cdf("x").alias("c"), S.normal_ppf("p").alias("q")).collect():
        assert r.c == pytest.approx(NormalDist().cdf(r.x), rel=1e-10, abs=1e-16)
        assert r.q == pytest.approx(NormalDist().inv_cdf(r.p), rel=2e-8, abs=1e-8)


def test_holidays_and_release(spark):
    days = ["2021-06-18", "2022-06-20", "2021-07-05", "2021-11-25", "2021-12-24", "2021-12-31", "2023-01-02", "2023-01-16"]
    df = spark.createDataFrame([(d,) for d in days], "s string").withColumn("d", F.to_date("s"))
    got = {r.s: (r.h, r.f) for r in df.select("s", H.is_holiday("d").alias("h"), H.is_holiday("d", True).alias("f")).collect()}
    assert got["2021-06-18"] == (False, True)  # Saturday holiday: not moved / moved to Friday
    assert got["2022-06-20"] == (True, True) and got["2021-07-05"] == (True, True)
    assert got["2021-11-25"] == (True, True) and got["2021-12-24"] == (False, True)
    assert got["2023-01-02"] == (True, True) and got["2023-01-16"] == (True, True)
    r = spark.createDataFrame([("2024-03-08",)], "s string").select(H.release_timestamp(F.to_date("s")).alias("t")).first()
    assert str(r.t) == "2024-03-11 17:00:00"  # Monday after the clock change


def test_draws_do_not_depend_on_partitioning(spark):
    a = spark.range(500).repartition(7).select("id", draw_int(5, F.col("id")).alias("d"))
    b = spark.range(500).coalesce(1).select("id", draw_int(5, F.col("id")).alias("d"))
    assert rows(a, "id") == rows(b, "id")


def test_caret_zip(spark, tmp_path):
    from tidemark.sources.readers import read_caret_zip

    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("a.txt", "ID^DT^X\nid text^date^amount\n7^20200331^1.5\n8^20200331^--------\n".encode("latin-1"))
    df = read_caret_zip(spark, str(tmp_path), items=["X", "Y"], ids=["ID"], entity="ID", header=["ID", "DT", "X"])
    assert rows(df, "ID") == [(7, 1.5, None), (8, None, None)]


def test_aggregate_export_refuses_entities(spark, tmp_path):
    from tidemark.sources.writers import write_aggregates_only

    with pytest.raises(ValueError):
        write_aggregates_only(spark.createDataFrame([(1, 2.0)], "entity int, v double"), str(tmp_path / "x"), allowed=["entity", "v"])


def test_json_safe(spark):
    from tidemark.sources.writers import json_safe_export

    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")])], "a double, b array<double>")
    assert json_safe_export(df).first()[0] == '{"a":null,"b":[1.0,null]}'


def test_asof_join_deals_rows_to_more_tasks_than_the_session_has(spark, monkeypatch):
    monkeypatch.setattr(J, "PART_ROWS", 20)
    rng = np.random.default_rng(3)
    day = lambda n: [dt.date(2020, 1, 1) + dt.timedelta(int(x)) for x in rng.integers(0, 1500, n)]
    # one key has most rows; a null key and a null time are left rows too
    lk = [None if i % 29 == 0 else 1 if i % 3 else i % 7 for i in range(300)]
    left = [(i, k, None if i % 37 == 0 else t) for i, (k, t) in enumerate(zip(lk, day(300)))]
    right = [(i, None if i % 23 == 0 else 1 if i % 2 else i % 7, t) for i, t in enumerate(day(200))]
    L, Rt = spark.createDataFrame(left, "id int, k int, t date"), spark.createDataFrame(right, "rid int, k int, a date")
    got = J.asof_join(L, Rt, on="t", right_on="a", cols=["rid"], by=["k"], bucket="year", order_tie="rid")
    assert got.rdd.getNumPartitions() >= 500 // 20
    every = J.asof_join(L, Rt, on="t", right_on="a", cols=["rid"], bucket="month", order_tie="rid")

    def want(k, t, by):
        hits = [(a, i) for i, rk, a in right if t is not None and a <= t and (not by or rk == k)]
        return max(hits)[1] if hits else None

    assert {r.id: r.rid for r in got.collect()} == {i: want(k, t, True) for i, k, t in left}
    assert {r.id: r.rid for r in every.collect()} == {i: want(k, t, False) for i, k, t in left}


def test_rank_average_reads_its_values_once(spark):
    """A sum of doubles may differ when it is computed again; a random number always does."""
    import random

    draw = F.udf(lambda i: random.random(), "double").asNondeterministic()
    got = R.rank_average(spark.range(40).select((F.col("id") % 2).alias("k"), draw("id").alias("v")), ["k"], "v", "r").collect()
    assert sorted(r.r for r in got if r.k == 0) == sorted(r.r for r in got if r.k == 1) == [i + 1.0 for i in range(20)]


def test_mean_rank_shift_ties_at_their_smallest_rank(spark):
    from tidemark.operators import composition as K

    data = [(1, p, 1.0) for p in "abc"] + [(2, p, x) for p, x in zip("abc", (0.2, 0.3, 0.5))]
    got = K.mean_rank_shift(spark.createDataFrame(data, "period int, part string, share double")).collect()
    assert [tuple(r) for r in got] == [(2, 1.0, 3)]


def test_register_forecaster_moves_each_row_once(spark, capfd):
    from tidemark.operators.callbacks import register_forecaster

    def model(history):
        out = float(history["value"].sum()) + 1000 * len(history) + int(history["origin"].iloc[0])
        history["value"] = -1e9  # stays its own
        return out

    data = [(1, q, float(q)) for q in (3, 1, 2)] + [(None, 2, 5.0), (2, 9, 1.0), (1, None, 7.0)]
    got = register_forecaster(spark.createDataFrame(data, "entity int, q int, v double"), model, origins=[4, 1, 2, 2], value="v")
    want = {(1, 1): 1002.0, (1, 2): 2005.0, (1, 4): 3010.0, (None, 2): 1007.0, (None, 4): 1009.0}
    assert {(r.entity, r.origin): r.forecast for r in got.collect()} == want
    got.explain()
    assert "Generate" not in capfd.readouterr().out


def test_pit_meets_packed_curves(spark):
    from tidemark.operators import scoring

    tau = [0.25, 0.5, 0.75]
    curves = [(1, t, x) for t, x in zip(tau, (10.0, 20.0, 40.0))] + [(2, t, x) for t, x in zip(tau, (5.0, 5.0, 6.0))]
    ys = [(1, 9.0, 0.0), (1, 10.0, 0.25), (1, 15.0, 0.375), (1, 20.0, 0.5), (1, 40.0, 0.75), (1, 41.0, 1.0), (2, 5.0, 0.25), (2, 6.0, 0.75)]
    obs = spark.createDataFrame([(i, q, y) for i, (q, y, _) in enumerate(ys)], "entity int, q int, y double")
    got = scoring.pit(obs, spark.createDataFrame(curves, "q int, tau double, qv double"), keys=["entity", "q"], on="q")
    assert {r.entity: pytest.approx(r.pit) for r in got.collect()} == {i: p for i, (_, _, p) in enumerate(ys)}

"""Quantile functions and one-dimensional transport.

A law is either a long table (key, tau, qv) on a fixed level grid (at most 99 rows per key),
or a short array of bucket weights with a shared array of bucket positions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import arr_sum, interp, isotonic, make_pool_adjacent
from tidemark.functions.scalars import clip, normal_cdf, normal_ppf, ratio
from tidemark.operators.ranks import exact_quantiles, rank_average
from tidemark.session import cut_lineage

U99 = [round(i / 100, 2) for i in range(1, 100)]
U19 = [round(i / 20, 2) for i in range(1, 20)]


def cs_quantile_function(df: DataFrame, *, keys: list[str], value: str, levels: list[float] = U99) -> DataFrame:
    """Cross-section -> quantile function, exact and without a group in one task."""
    return exact_quantiles(df, keys, value, levels)


def inner_levels(df: DataFrame) -> DataFrame:
    """The 19 inner levels of a 99-level table."""
    return df.where((F.round(F.col("tau") * 100) % 5) == 0)


def w2sq_grid(a: DataFrame, b: DataFrame, keys: list[str], out: str = "w2sq") -> DataFrame:
    """Mean squared quantile gap over the shared levels."""
    x = a.select(*keys, "tau", F.col("qv").alias("_a")).join(b.select(*keys, "tau", F.col("qv").alias("_b")), [*keys, "tau"])
    return x.groupBy(*keys).agg(F.avg((F.col("_a") - F.col("_b")) ** 2).alias(out), F.count(F.lit(1)).alias("n_levels"))


def cumulative(p: Column) -> Column:
    """Cumulative shares of a weight array, the last one exactly 1."""
    tot = arr_sum(p)
    n = F.size(p)
    return F.transform(p, lambda _, i: F.when(i == n - 1, F.lit(1.0)).otherwise(arr_sum(F.slice(p, F.lit(1), i + 1)) / tot))


def merged_steps(df: DataFrame, p1: str, p2: str, x: Column, out: str = "_st") -> DataFrame:
    """Union of the breakpoints of two step laws as an array of (w, a, b).

    Cumulative shares and cuts are staged as columns, so each is computed once per row."""
    at = lambda c, m: F.element_at(F.col("_x"), F.least(F.size(F.filter(c, lambda v: v < m)) + 1, F.size("_x")))

    def piece(c, i):
        lo = F.when(i == 0, F.lit(0.0)).otherwise(F.element_at("_cuts", F.greatest(i, F.lit(1))))
        mid = (lo + c) / 2
        return F.struct((c - lo).alias("w"), at(F.col("_c1"), mid).alias("a"), at(F.col("_c2"), mid).alias("b"))

    z = df.withColumns({"_c1": cumulative(F.col(p1)), "_c2": cumulative(F.col(p2)), "_x": x})
    z = z.withColumn("_cuts", F.array_sort(F.array_distinct(F.filter(F.concat("_c1", "_c2"), lambda c: c > 0))))
    return z.withColumn(out, F.transform("_cuts", piece)).drop("_c1", "_c2", "_cuts", "_x")


def w2sq_discrete(df: DataFrame, p1: str, p2: str, x: Column, out: str = "w2sq") -> DataFrame:
    """Exact squared W2 between two step laws on ordered points."""
    z = merged_steps(df, p1, p2, x)
    gap = F.aggregate("_st", F.lit(0.0), lambda s, e: s + e["w"] * (e["a"] - e["b"]) * (e["a"] - e["b"]))
    return z.withColumn(out, gap).drop("_st")


def w2_decompose(df: DataFrame, p1: str, p2: str, x: Column) -> DataFrame:
    """loc + scale + shape = squared W2."""
    z = merged_steps(df, p1, p2, x)
    tot = lambda f: F.aggregate("_st", F.lit(0.0), lambda s, e: s + e["w"] * f(e))
    z = z.withColumns({"_m1": tot(lambda e: e["a"]), "_m2": tot(lambda e: e["b"]), "_aa": tot(lambda e: e["a"] * e["a"]), "_bb": tot(lambda e: e["b"] * e["b"]), "_ab": tot(lambda e: e["a"] * e["b"])})
    m1, m2 = F.col("_m1"), F.col("_m2")
    v1, v2 = F.greatest(F.col("_aa") - m1 * m1, F.lit(0.0)), F.greatest(F.col("_bb") - m2 * m2, F.lit(0.0))
    spread = F.sqrt(v1) - F.sqrt(v2)
    return z.withColumns({"loc": (m1 - m2) * (m1 - m2), "scale": spread * spread, "shape": v1 + v2 - 2 * (F.col("_ab") - m1 * m2) - spread * spread}).drop("_st", "_m1", "_m2", "_aa", "_bb", "_ab")


def w1_cdf_distance(df: DataFrame, *, column: str, row: str, a: str, b: str, step: float = 1.0) -> DataFrame:
    """Mean over columns of the summed absolute CDF gap (W1) and of the total variation.

    ``df`` holds two densities per (column, row); a column with no mass on a side is left out."""
    t = df.groupBy(column).agg(F.sum(a).alias("_ta"), F.sum(b).alias("_tb")).where("_ta > 0 AND _tb > 0")
    j = df.join(t, column).withColumn("_pa", F.col(a) / F.col("_ta")).withColumn("_pb", F.col(b) / F.col("_tb"))
    w = Window.partitionBy(column).orderBy(row)  # one row per raster row: a bounded image height
    j = j.withColumn("_g", F.abs(F.sum(F.col("_pa") - F.col("_pb")).over(w)))
    per = j.groupBy(column).agg((F.sum("_g") * step).alias("w1"), (0.5 * F.sum(F.abs(F.col("_pa") - F.col("_pb")))).alias("tv"))
    return per.agg(F.avg("w1").alias("w1"), F.avg("tv").alias("tv"), F.count(F.lit(1)).alias("n_columns"))


def barycenter(df: DataFrame, *, keys: list[str], weight: str | None = None) -> DataFrame:
    """W2 Frechet mean = (weighted) average of quantile functions, level by level."""
    v = F.avg("qv") if weight is None else ratio(F.sum(F.col("qv") * F.col(weight)), F.sum(weight))
    return df.groupBy(*keys, "tau").agg(v.alias("qv"))


def widen(df: DataFrame, *, keys: list[str], factors: list[float]) -> DataFrame:
    """Q(0.5) + s (Q - Q(0.5)) for each factor of a short list."""
    mid = df.where("abs(tau - 0.5) < 1e-9").select(*keys, F.col("qv").alias("_m"))
    s = F.explode(F.array(*[F.lit(float(f)) for f in factors]))
    return df.join(mid, keys).select(*keys, "tau", "qv", "_m", s.alias("s")).select(*keys, "tau", "s", (F.col("_m") + F.col("s") * (F.col("qv") - F.col("_m"))).alias("qv"))


def select_widening(q: DataFrame, cases: DataFrame, *, keys: list[str], factors: list[float], by: list[str], y: str = "y", scale: str = "scale") -> DataFrame:
    """Factor with the smallest pooled mean scaled quantile score per ``by``; ties go to the smallest factor.

    Each case row carries the whole bounded grid as an expression, so cases are read once."""
    arr = q.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tau", "qv"))).alias("_q"))
    j = cases.join(arr, keys)
    mid = F.element_at(F.filter("_q", lambda e: F.abs(e["tau"] - 0.5) < 1e-9), 1)["qv"]
    s = F.explode(F.array(*[F.lit(float(f)) for f in factors]))
    j = j.withColumn("_mid", mid).select(*by, y, scale, "_q", "_mid", s.alias("s"))

    def loss(e):
        u = F.col(y) - (F.col("_mid") + F.col("s") * (e["qv"] - F.col("_mid")))
        return u * (e["tau"] - F.when(u < 0, 1.0).otherwise(0.0))

    crps = 2.0 * arr_sum(F.transform("_q", loss)) / F.size("_q")
    g = j.withColumn("_l", crps / F.col(scale)).groupBy(*by, "s").agg(F.avg("_l").alias("score"))
    return g.groupBy(*by).agg(F.min_by("s", F.struct("score", "s")).alias("s"), F.min("score").alias("score"))


def linear_pool_quantiles(members: DataFrame, *, keys: list[str], member: str, levels: list[float]) -> DataFrame:
    """Exact quantiles of the equal-weight CDF mixture on the union of all knots.

    Each member's CDF is 0 below its first knot, piecewise linear between knots and 1 from its
    last knot on.  The knots of one key are bounded by members x levels."""
    per = members.groupBy(*keys, member).agg(F.sort_array(F.collect_list(F.struct(F.col("qv").alias("x"), F.col("tau").alias("t")))).alias("k"))
    key = per.groupBy(*keys).agg(F.collect_list("k").alias("ks"))
    knots = F.array_sort(F.array_distinct(F.flatten(F.transform("ks", lambda k: k["x"]))))

    def cdf(k, x, left: bool):
        lo, hi = F.element_at(k, 1)["x"], F.element_at(k, -1)["x"]
        mid = interp(x, k["x"], k["t"])
        below = (x <= lo) if left else (x < lo)
        above = (x > hi) if left else (x >= hi)
        return F.when(below, 0.0).when(above, 1.0).otherwise(mid)

    mean = lambda x, left: arr_sum(F.transform("ks", lambda k: cdf(k, x, left))) / F.size("ks")
    pts = F.flatten(F.transform("_x", lambda x: F.array(F.struct(x.alias("x"), mean(x, True).alias("f")), F.struct(x.alias("x"), mean(x, False).alias("f")))))
    g = key.withColumn("_x", knots).withColumn("_p", pts)
    tau = F.explode(F.array(*[F.lit(float(t)) for t in levels]))
    g = g.select(*keys, "_p", tau.alias("tau"))
    i = F.greatest(F.size(F.filter("_p", lambda e: e["f"] < F.col("tau"))), F.lit(1))
    p0, p1 = F.element_at("_p", i), F.element_at("_p", F.least(i + 1, F.size("_p")))
    frac = F.when(p1["f"] > p0["f"], clip((F.col("tau") - p0["f"]) / (p1["f"] - p0["f"]), 0, 1)).otherwise(1.0)
    return g.select(*keys, "tau", (p0["x"] + frac * (p1["x"] - p0["x"])).alias("qv"))


def trim_members(scores: DataFrame, *, by: list[str], member: str, score: str, limit: float = 1.25, min_keep: int = 2) -> DataFrame:
    """Members within ``limit`` times the best, and never fewer than ``min_keep`` (best first, then by name).

    A group is the short list of forecast methods."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    r = F.row_number().over(w.orderBy(score, member))
    return scores.withColumn("_best", F.min(score).over(w)).withColumn("_r", r).where((F.col(score) <= limit * F.col("_best")) | (F.col("_r") <= min_keep)).drop("_best", "_r")


def war_forecast(q: DataFrame, *, period: str = "q", h: int = 1) -> DataFrame:
    """Autoregression of quantile functions for every origin at once.

    With V_s = Q_s - Qbar_o the two inner products at origin o are running sums over the
    periods of Q_{s+h} Q_s, Q_s, Q_{s+h} and Q_s^2 per level, so no panel x origin copy is made.
    beta = clip(<V', V> / <V, V>, 0, 1) on the inner levels; Qhat = (1 - beta) Qbar + beta Q."""
    w = Window.partitionBy("tau").orderBy(period)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.max("qv").over(w.rangeBetween(h, h))
    x = q.withColumn("_n", nxt)
    # the pair (s, s+h) becomes visible at origin s + h
    pair = x.where(F.col("_n").isNotNull()).select(
        (F.col(period) + h).alias(period), "tau",
        (F.col("qv") * F.col("_n")).alias("_xy"), (F.col("qv") * F.col("qv")).alias("_xx"),
        F.col("qv").alias("_x"), F.col("_n").alias("_y"), F.lit(1.0).alias("_c"),
    )
    j = q.join(pair, [period, "tau"], "left").select(
        period, "tau", "qv", F.avg("qv").over(run).alias("qbar"),
        *[F.sum(c).over(run).alias(c) for c in ("_xy", "_xx", "_x", "_y", "_c")],
    )
    m = F.col("qbar")
    num = F.col("_xy") - m * F.col("_x") - m * F.col("_y") + F.col("_c") * m * m
    den = F.col("_xx") - 2 * m * F.col("_x") + F.col("_c") * m * m
    inner = (F.round(F.col("tau") * 100) % 5) == 0
    b = j.groupBy(period).agg(F.sum(F.when(inner, num)).alias("_num"), F.sum(F.when(inner, den)).alias("_den"), F.max("_c").cast("int").alias("n_pairs"))
    b = b.select(period, "n_pairs", ratio("_num", "_den").alias("beta_raw")).withColumn("beta", clip("beta_raw", 0, 1))
    return j.join(b, period).select(period, "tau", "n_pairs", "beta_raw", "beta", "qbar", ((1 - F.col("beta")) * m + F.col("beta") * F.col("qv")).alias("qhat"))


def probit_ranks(df: DataFrame, *, keys: list[str], value: str, out: str = "z") -> DataFrame:
    r = rank_average(df, keys, value, "_r", "_p")
    return r.withColumn(out, normal_ppf(F.col("_p"))).drop("_r", "_p")


def rank_map(df: DataFrame, qhat: DataFrame, *, value: str, levels: list[float], entity="entity", period="q") -> DataFrame:
    """Map each entity's origin rank through the pooled rank correlation to its predictive quantiles.

    rho at an origin pools all pairs (s, s+1) with s + 1 <= origin: running sums of five moments
    per period, so the pooled correlation needs one row per period."""
    z = probit_ranks(df, keys=[period], value=value).select(entity, period, "z").where("z IS NOT NULL")
    nxt = z.select(entity, (F.col(period) - 1).alias(period), F.col("z").alias("_zn"))
    mom = z.join(nxt, [entity, period]).groupBy((F.col(period) + 1).alias(period)).agg(
        F.count(F.lit(1)).alias("n"), F.sum("z").alias("sx"), F.sum("_zn").alias("sy"),
        F.sum(F.col("z") * F.col("_zn")).alias("sxy"), F.sum(F.col("z") * F.col("z")).alias("sxx"), F.sum(F.col("_zn") * F.col("_zn")).alias("syy"))
    w = Window.partitionBy(F.lit(0)).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)  # one row per calendar period
    c = mom.select(period, *[F.sum(x).over(w).alias(x) for x in ("n", "sx", "sy", "sxy", "sxx", "syy")])
    num = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    den = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2))
    rho = c.select(period, clip(F.when(F.col("n") >= 3, F.try_divide(num, den)), 0.0, 0.99).alias("rho"))
    # the 99-level grid of one period rides on that period's rows
    grid = qhat.groupBy(period).agg(F.sort_array(F.collect_list(F.struct("tau", "qhat"))).alias("_g"))
    j = z.join(rho.join(grid, period), period)
    tau = F.explode(F.array(*[F.lit(float(t)) for t in levels]))
    j = j.select(entity, period, "z", "rho", "_g", tau.alias("tau"))
    u = normal_cdf(F.col("rho") * F.col("z") + F.sqrt(1 - F.col("rho") ** 2) * normal_ppf(F.col("tau")))
    j = j.select(entity, period, "tau", "rho", u.alias("_u"), F.col("_g")["tau"].alias("_t"), F.col("_g")["qhat"].alias("_q"))
    return j.select(entity, period, "tau", "rho", interp(F.col("_u"), F.col("_t"), F.col("_q")).alias("qv"))


def _knots(x: Column, y: Column) -> Column:
    """Strictly increasing knots of a packed law: the first of equal x values is kept."""
    z = F.arrays_zip(x.alias("x"), y.alias("y"))
    return F.filter(z, lambda e, i: (i == 0) | (F.element_at(x, F.greatest(i, F.lit(1))) < e["x"]))


def ar_map_forecast(q: DataFrame, *, period: str = "q") -> DataFrame:
    """Autoregression of displacement maps: d_s(x) = Q_{s+1} - Q_s at x = Q_s, d_s ~ alpha d_{s-1}.

    Each period is one packed row of at most 99 levels; alpha is a ratio of running sums."""
    arr = q.groupBy(period).agg(F.sort_array(F.collect_list(F.struct("tau", "qv"))).alias("a"))
    arr = arr.select(period, F.col("a.tau").alias("t"), F.col("a.qv").alias("x"))
    p1 = arr.select((F.col(period) + 1).alias(period), F.col("x").alias("xm"))
    n1 = arr.select((F.col(period) - 1).alias(period), F.col("x").alias("xp"))
    j = arr.join(p1, period, "left").join(n1, period, "left")
    kn = _knots(F.col("xm"), F.zip_with("x", "xm", lambda a, b: a - b))
    j = j.withColumn("_k", kn).withColumns({"_kx": F.col("_k")["x"], "_ky": F.col("_k")["y"]})
    # displacement of the previous map at this period's own quantiles
    j = j.withColumn("dprev", F.transform("x", lambda v: interp(v, F.col("_kx"), F.col("_ky"))))
    inner = F.transform("t", lambda t: F.when(F.round(t * 100) % 5 == 0, 1.0).otherwise(0.0))
    dot = lambda a, b: arr_sum(F.zip_with(F.zip_with(a, b, lambda u, v: u * v), inner, lambda u, v: u * v))
    dcur = F.zip_with("xp", "x", lambda a, b: a - b)
    tri = j.where("xm IS NOT NULL AND xp IS NOT NULL").select((F.col(period) + 1).alias(period), dot(dcur, F.col("dprev")).alias("_num"), dot(F.col("dprev"), F.col("dprev")).alias("_den"))
    w = Window.partitionBy(F.lit(0)).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    al = j.select(period, "t", "x", "dprev", "xm").join(tri, period, "left").select(
        period, "t", "x", "dprev", "xm", F.sum("_num").over(w).alias("_num"), F.sum("_den").over(w).alias("_den"))
    al = al.where("_den > 0 AND xm IS NOT NULL").withColumn("alpha", clip(ratio("_num", "_den"), -1, 1))
    fit = isotonic(F.zip_with("x", "dprev", lambda a, b: a + F.col("alpha") * b))
    return al.select(period, "alpha", F.explode(F.arrays_zip(F.col("t").alias("tau"), fit.alias("qhat"))).alias("e")).select(period, "alpha", "e.tau", "e.qhat")


def _functional_forecast(now, m, lag, pairs, k: int):
    """Forecast of a law from its moment tensors, or None where they have too little rank.

    ``m`` sums (1, inner) x (1, all) over past laws, ``pairs`` and ``lag`` sum (1, inner) x (1, inner) of a law with itself and with the next
    one.  Components are eigenvectors of the centred inner moments; their dynamics are least squares on scores, which
    are linear in the laws; the forecast is the mean plus the scores' weighted combination of past deviations."""
    import numpy as np

    n, n_pairs, p = m[0, 0], pairs[0, 0], m.shape[0] - 1
    if n < k + 1 or n_pairs < k:
        return None
    mean = m[0, 1:] / n
    inner = m[1:, 0] / n
    cross = m[1:, 1:] - n * np.outer(inner, mean)  # inner x all
    at = np.arange(m.shape[1] - 1)[_inner_places(m.shape[1] - 1)]
    lam, vec = np.linalg.eigh(cross[:, at])
    lam, w = lam[::-1][:k], vec[:, ::-1][:, :k]
    if not lam[-1] > 1e-12 * max(lam[0], 1e-300):
        return None
    # scores of a law are w'(law - mean): an affine map of (1, inner)
    to = np.vstack([-(w.T @ inner), w])
    xx, xy = to.T @ pairs @ to, to.T @ lag @ to
    if np.linalg.matrix_rank(xx) < k:
        return None
    step = np.linalg.solve(xx, xy).T @ (to.T @ np.append(1.0, now[at]))
    return mean + (step / lam) @ (w.T @ cross)


def _inner_places(n: int):
    """Places of the 5 % levels among n = 99 levels of 1 %."""
    return slice(4, n, 5)


def fpca_war(q: DataFrame, *, period: str = "q", k: int = 2) -> DataFrame:
    """K-component functional autoregression at every origin with enough past laws.

    The sums of products that an origin needs are running sums over the calendar: one row per period and product, summed by
    product, so each product is a series of its own.  The eigen and least-squares solves of all origins run side by side in
    tasks, a row of moments each."""
    import numpy as np
    import pyarrow as pa

    laws = q.groupBy(period).agg(F.transform(F.array_sort(F.collect_list(F.struct("tau", "qv"))), lambda e: e["qv"]).alias("x"))
    laws = cut_lineage(laws.where(F.size("x") == 99).select(F.col(period).cast("long").alias("q"), "x"), "laws")
    inner = lambda c: F.expr(f"concat(array(1D), filter({c}, (e, i) -> i % 5 = 4))")
    one = laws.select("q", inner("x").alias("e"), F.concat(F.array(F.lit(1.0)), "x").alias("f"))
    last = laws.select((F.col("q") + 1).alias("q"), inner("x").alias("d"))
    both = one.join(last, "q", "left")

    def products(kind: int, left: str, right: str) -> Column:
        """(place, product) of an outer product; nulls where a side is missing."""
        return F.flatten(F.transform(left, lambda a, i: F.transform(right, lambda b, j: F.struct(F.lit(kind).alias("kind"), (i * F.size(right) + j).alias("place"), (a * b).alias("v")))))

    nothing = F.array().cast("array<struct<kind:int,place:int,v:double>>")
    # a pair of laws belongs to the period of the second one
    every = F.concat(products(0, "e", "f"), F.coalesce(products(1, "d", "e"), nothing), F.coalesce(products(2, "d", "d"), nothing))
    cells = both.select("q", F.explode(every).alias("c")).select("q", "c.kind", "c.place", "c.v")
    upto = Window.partitionBy("kind", "place").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    run = cells.select("q", "kind", "place", F.sum("v").over(upto).alias("v"))
    # a period without a preceding law adds no pair: its pair sums are those of the period before
    packed = run.groupBy("q").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == i, F.struct("place", "v")))), lambda e: e["v"]).alias(f"k{i}") for i in range(3)])
    hold = Window.orderBy("q").rowsBetween(Window.unboundedPreceding, 0)  # one row per calendar period
    filled = lambda c: F.last(F.when(F.size(c) > 0, F.col(c)), True).over(hold).alias(c)
    packed = packed.select("q", "k0", filled("k1"), filled("k2")).join(laws, "q")

    def solve(batches):
        for batch in batches:
            rows = []
            for o, m, lag, pairs, x in zip(*(c.to_pylist() for c in batch.columns)):
                if lag:
                    p = 20
                    got = _functional_forecast(np.array(x), np.array(m).reshape(p, -1), np.array(lag).reshape(p, p), np.array(pairs).reshape(p, p), k)
                    if got is not None:
                        rows.append((o, got.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["q", "raw"])

    raw = packed.select("q", "k0", "k1", "k2", "x").mapInArrow(solve, "q long, raw array<double>")
    fit = raw.select("q", F.posexplode(isotonic(F.col("raw"))).alias("i", "qhat"))
    return fit.select(F.col("q").cast(q.schema[period].dataType).alias(period), ((F.col("i") + 1) / 100.0).alias("tau"), "qhat")


def frechet_regression(q: DataFrame, x: DataFrame, *, period: str = "q", xcol: str = "x", min_pairs: int = 4) -> DataFrame:
    """Global Frechet regression of the next quantile function on one covariate, for every origin.

    Weights 1 + (x_s - xbar)(x_o - xbar) / var over pairs s + 1 <= origin turn into running sums
    of Q, xQ and the moments of x per level; the result is projected on monotone functions."""
    nxt = q.select((F.col(period) - 1).alias(period), "tau", F.col("qv").alias("_y"))
    j = nxt.join(x.select(period, F.col(xcol).alias("_x")), period)
    w = Window.partitionBy("tau").orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    s = j.select(
        (F.col(period) + 1).alias(period), "tau", F.count(F.lit(1)).over(w).alias("n"),
        F.avg("_x").over(w).alias("mx"), F.var_pop("_x").over(w).alias("vx"),
        F.avg("_y").over(w).alias("my"), F.avg(F.col("_x") * F.col("_y")).over(w).alias("mxy"))
    o = s.join(x.select(period, F.col(xcol).alias("_xo")), period).where((F.col("n") >= min_pairs) & (F.col("vx") > 0))
    est = F.col("my") + (F.col("mxy") - F.col("mx") * F.col("my")) * (F.col("_xo") - F.col("mx")) / F.col("vx")
    a = o.groupBy(period).agg(F.sort_array(F.collect_list(F.struct("tau", est.alias("x")))).alias("a"))
    return a.select(period, F.explode(F.arrays_zip(F.col("a")["tau"].alias("tau"), isotonic(F.col("a")["x"]).alias("qhat"))).alias("e")).select(period, "e.*")


def isotonic_projection(q: DataFrame, *, keys: list[str], value: str = "qv") -> DataFrame:
    """Monotone least-squares repair of each quantile vector (at most 99 levels)."""
    a = q.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tau", F.col(value).alias("x")))).alias("a"))
    return a.select(*keys, F.explode(F.arrays_zip(F.col("a")["tau"].alias("tau"), isotonic(F.col("a")["x"]).alias("fit"))).alias("e")).select(*keys, "e.*")


def ot_recalibrate(q: DataFrame, pits: DataFrame, *, keys: list[str], pit: str = "pit") -> DataFrame:
    """Q(G^-1(tau)) with G the law of past PIT values."""
    levels = U99
    g = exact_quantiles(pits, keys, pit, levels, "gi")
    a = q.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tau", "qv"))).alias("a"))
    a = a.select(*keys, F.col("a")["tau"].alias("_t"), F.col("a")["qv"].alias("_q"))
    return g.join(a, keys).select(*keys, "tau", interp(F.col("gi"), F.col("_t"), F.col("_q")).alias("qv"))


# ------------------------------------------------------------------ isotonic regression at scale


#: Blocks of one key that one task pools.
POOL_BLOCKS = 20_000


def isotonic_blocks(points: DataFrame, keys: list[str], pool_size: int = POOL_BLOCKS) -> DataFrame:
    """Isotonic regression per key of points (x, fit, weight), one per distinct x, as constant blocks (x_lo, x_hi, fit, weight).

    Pooling adjacent violators may be done in any order.  The blocks of a key are numbered along x and cut into stacks of
    ``pool_size``; each stack is pooled in its task, and the blocks that are left are numbered and cut anew, half a stack further
    each second time.  When neither cut pools anything, no two neighbours anywhere violate the order, because any two share a stack
    under one of the cuts.  A key that fits one stack needs one round, and no task ever holds more than a stack."""
    import pandas as pd

    from tidemark.operators.ranks import row_positions

    kt = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kt + ', ' if kt else ''}x_lo double, x_hi double, fit double, weight double"
    pool_adjacent = make_pool_adjacent()

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x_lo")
        out = pd.DataFrame(pool_adjacent(pdf["x_lo"], pdf["x_hi"], pdf["fit"], pdf["weight"]), columns=["x_lo", "x_hi", "fit", "weight"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    blocks = points.select(*keys, F.col("x").alias("x_lo"), F.col("x").alias("x_hi"), "fit", "weight")
    shift, still, before = 0, 0, None
    while True:
        placed = row_positions(blocks, keys, "x_lo", "x_hi", "_p")
        stacks = placed.groupBy(*keys, F.floor((F.col("_p") - 1 + shift) / pool_size).alias("_g"))
        most = placed.agg(F.max("_p")).first()[0] or 0
        blocks = cut_lineage(stacks.applyInPandas(pool, schema), "blocks")
        if most <= pool_size and shift == 0:
            return blocks
        after = blocks.count()
        still = still + 1 if after == before else 0
        if still == 2:
            return blocks
        before, shift = after, pool_size // 2 - shift


def fitted_points(points: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, x) with the fit of their block.

    A block is marked in every slice of x that it reaches into, so inside a (key, slice) the last mark at or before a point
    is its block: one running window, no range join and no list of blocks on a row."""
    from tidemark.operators.ranks import slice_bounds, slice_of

    cuts = slice_bounds(points, "x", 32)
    at = F.explode(F.sequence(slice_of(F.col("x_lo"), cuts), slice_of(F.col("x_hi"), cuts)))
    marks = blocks.select(*keys, at.alias("_s"), F.col("x_lo").alias("x"), F.lit(0).alias("_k"), "fit")
    rows = points.select(*keys, slice_of(F.col("x"), cuts).alias("_s"), "x", F.lit(1).alias("_k"), F.lit(None).cast("double").alias("fit"))
    run = Window.partitionBy(*keys, "_s").orderBy("x", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(rows).withColumn("fit", F.last("fit", True).over(run)).where("_k = 1").select(*keys, "x", "fit")


def isotonic_fit(df: DataFrame, *, keys: list[str], x: str, y: str, increasing: bool = True, pool_size: int = POOL_BLOCKS) -> DataFrame:
    """Isotonic regression per key as constant blocks (x_lo, x_hi, fit, weight), of rows averaged per distinct x."""
    sgn = 1.0 if increasing else -1.0
    base = df.groupBy(*keys, F.col(x).cast("double").alias("x")).agg((sgn * F.avg(y)).alias("fit"), F.count(F.lit(1)).cast("double").alias("weight"))
    return isotonic_blocks(cut_lineage(base, "points"), keys, pool_size).withColumn("fit", sgn * F.col("fit"))


def isotonic_distribution(df: DataFrame, *, x: str, y: str, thresholds: list[float], held: str | None = None) -> DataFrame:
    """Conditional CDF on a threshold grid: one antitonic fit of 1{y <= z} on x per threshold.

    With ``held`` the fit is repeated without each value of that column (leave one out).  Rows
    are first reduced to counts per (x, held), so the copies are of the reduced table."""
    zs = F.array(*[F.lit(float(t)) for t in thresholds])
    h = [held] if held else []
    red = df.groupBy(x, *h).agg(*[F.sum((F.col(y) <= z).cast("long")).alias(f"_c{i}") for i, z in enumerate(thresholds)], F.count(F.lit(1)).alias("_n"))
    long = red.select(x, *h, "_n", F.posexplode(F.array(*[F.col(f"_c{i}") for i in range(len(thresholds))])).alias("k", "_c"))
    if held:
        tot = long.groupBy(x, "k").agg(F.sum("_n").alias("_tn"), F.sum("_c").alias("_tc"))
        years = df.select(F.col(held).alias("_h")).distinct().agg(F.collect_set("_h")).scalar()  # the few held-out periods
        grid = tot.select(x, "k", "_tn", "_tc", F.explode(years).alias(held))
        long = grid.join(long, [x, "k", held], "left").select(
            x, "k", held, (F.col("_tn") - F.coalesce("_n", F.lit(0))).alias("_n"), (F.col("_tc") - F.coalesce("_c", F.lit(0))).alias("_c")).where("_n > 0")
    base = long.withColumn("z", F.element_at(zs, F.col("k") + 1)).withColumn("_y", F.col("_c") / F.col("_n"))
    keys = [*h, "z"]
    # weighted rows: one row per distinct x
    return _weighted_isotonic(base, keys, x, "_y", "_n").withColumnRenamed("fit", "cdf")


def _weighted_isotonic(base: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """Antitonic fit of already averaged points, evaluated at every x."""
    b = cut_lineage(base.select(*keys, F.col(x).cast("double").alias("x"), (-F.col(y)).alias("fit"), F.col(w).cast("double").alias("weight")), "points")
    out = fitted_points(b, isotonic_blocks(b, keys), keys)
    return out.withColumn("fit", -F.col("fit"))


# ------------------------------------------------------------------ line-series density


def density_raster(series: DataFrame, *, width: int, height: int, by: str = "series", px: str = "px", py: str = "py", gap_safe: bool = True, weight: str | None = None) -> DataFrame:
    """Rasterise each series' segments, set each pixel once per series, divide by the pixels the
    series has in that column, and sum over series.

    Segments explode into pixels inside the task; the distinct and both sums combine map-side.
    Without ``gap_safe`` a column that any series misses is NULL."""
    w = Window.partitionBy(by).orderBy(px)
    seg = series.select(by, F.col(px).alias("x0"), F.col(py).alias("y0"), F.lead(px).over(w).alias("x1"), F.lead(py).over(w).alias("y1"), *([weight] if weight else []))
    seg = seg.where("x1 IS NOT NULL")
    steep = F.abs(F.col("y1") - F.col("y0")) > F.abs(F.col("x1") - F.col("x0"))
    s = seg.withColumn("steep", steep).select(
        "*",
        F.when(steep, F.col("y0")).otherwise(F.col("x0")).alias("a0"), F.when(steep, F.col("x0")).otherwise(F.col("y0")).alias("b0"),
        F.when(steep, F.col("y1")).otherwise(F.col("x1")).alias("a1"), F.when(steep, F.col("x1")).otherwise(F.col("y1")).alias("b1"),
    )
    swap = F.col("a0") > F.col("a1")
    s = s.select(
        by, "steep", *([weight] if weight else []),
        F.when(swap, F.col("a1")).otherwise(F.col("a0")).alias("a0"), F.when(swap, F.col("b1")).otherwise(F.col("b0")).alias("b0"),
        F.when(swap, F.col("a0")).otherwise(F.col("a1")).alias("a1"), F.when(swap, F.col("b0")).otherwise(F.col("b1")).alias("b1"),
    ).withColumn("dx", F.col("a1") - F.col("a0")).withColumn("dy", F.abs(F.col("b1") - F.col("b0")))
    k = s.select("*", F.explode(F.sequence(F.lit(0), F.col("dx").cast("int"))).alias("k"))
    # after k columns an integer segment has moved ceil((2 k dy - dx) / (2 dx)) rows, never below zero
    move = F.when(F.col("dx") > 0, F.greatest(F.lit(0), F.ceil((2 * F.col("k") * F.col("dy") - F.col("dx")) / (2 * F.col("dx"))))).otherwise(0)
    b = F.col("b0") + F.when(F.col("b0") < F.col("b1"), 1).otherwise(-1) * move
    a = F.col("a0") + F.col("k")
    pix = k.select(by, *([weight] if weight else []), F.when(F.col("steep"), b).otherwise(a).cast("int").alias("px"), F.when(F.col("steep"), a).otherwise(b).cast("int").alias("py"))
    pix = pix.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)).distinct()
    cnt = pix.groupBy(by, "px").agg(F.count(F.lit(1)).alias("_n"))
    ww = F.col(weight) if weight else F.lit(1.0)
    out = pix.join(cnt, [by, "px"]).groupBy("px", "py").agg(F.sum(ww / F.col("_n")).alias("density"))
    if not gap_safe:
        live = seg.select(by).distinct().agg(F.count(F.lit(1))).scalar()
        full = cnt.groupBy("px").agg(F.count(F.lit(1)).alias("_c")).withColumn("_ok", F.col("_c") == live)
        out = out.join(full, "px").withColumn("density", F.when(F.col("_ok"), F.col("density"))).drop("_c", "_ok")
    return out


def density_branch_brush(raster: DataFrame, *, column: int, height: int, lo: float, hi: float, sigma: float = 4.0, gap: int = 8) -> DataFrame:
    """Smooth the last column's profile, find the main peak and the highest peak above it, and put the
    threshold at the valley between them.  Everything here has ``height`` rows."""
    spark = raster.sparkSession
    bins = spark.range(height).select(F.col("id").cast("int").alias("py"))
    prof = bins.join(raster.where(F.col("px") == column).select("py", "density"), "py", "left").fillna(0.0, ["density"])
    rad = int(4 * sigma + 0.5)
    # reflecting ends: each source bin also acts through its mirror images
    src = prof.select(F.explode(F.array(F.col("py"), -1 - F.col("py"), 2 * height - 1 - F.col("py"))).alias("p"), "density")
    norm = sum(math.exp(-0.5 * (k / sigma) ** 2) for k in range(-rad, rad + 1))
    sm = (
        src.select(F.explode(F.sequence(F.col("p") - rad, F.col("p") + rad)).alias("py"), "p", "density")
        .where(F.col("py").between(0, height - 1))
        .groupBy("py").agg((F.sum(F.col("density") * F.exp(-0.5 * ((F.col("py") - F.col("p")) / sigma) ** 2)) / norm).alias("v"))
    )
    w = Window.partitionBy(F.lit(0)).orderBy("py")
    top = sm.agg(F.max("v")).scalar()
    pk = sm.withColumn("_l", F.lag("v").over(w)).withColumn("_r", F.lead("v").over(w)).withColumn("main", sm.agg(F.min_by("py", F.struct(-F.col("v"), F.col("py")))).scalar())
    is_peak = (F.col("v") > F.col("_l")) & (F.col("v") >= F.col("_r")) & (F.col("v") > 0.02 * top)
    up = pk.where(is_peak & (F.col("py") > F.col("main") + gap)).agg(F.max_by("py", F.struct(F.col("v"), -F.col("py")))).scalar()
    between = pk.where((F.col("py") >= F.col("main")) & (F.col("py") <= up))
    return between.agg(F.max("main").alias("main_peak"), F.max("py").alias("upper_peak"), F.min_by("py", F.struct("v", "py")).alias("valley")).where("valley IS NOT NULL").withColumn(
        "threshold", F.lit(lo) + F.col("valley") / (height - 1) * (hi - lo))

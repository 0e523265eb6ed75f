"""Event series, storms, recurrence, and directed dependence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators.ranks import exact_quantiles


def binarize_quantile(df: DataFrame, *, by: list[str], value: str, level: float, upper: bool = True, out: str = "event") -> DataFrame:
    """1 above (below) the group's quantile, 0 otherwise, missing stays missing."""
    q = exact_quantiles(df, by, value, [level], "_q").drop("tau")
    j = df.join(q, by) if by else df.withColumn("_q", q.select("_q").scalar())
    hit = F.col(value) > F.col("_q") if upper else F.col(value) < F.col("_q")
    return j.withColumn(out, F.when(F.col(value).isNotNull(), hit.cast("int"))).drop("_q")


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Bin(n, p): the term at k in log space, then each term from the one before it."""
    lg = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    low = F.least(F.greatest(k, F.lit(0)), n).cast("int")
    first = lg(n) - lg(low) - lg(n - low) + low * F.log(p) + (n - low) * F.log1p(-p)
    odds = F.log(p) - F.log1p(-p)
    start = F.struct(first.cast("double").alias("t"), F.exp(first).cast("double").alias("s"))
    step = lambda a, i: a["t"] + F.log((n - i + 1).cast("double") / i) + odds
    rest = F.when(low < n, F.sequence(low + 1, n.cast("int"))).otherwise(F.array().cast("array<int>"))
    s = F.aggregate(rest, start, lambda a, i: F.struct(step(a, i).alias("t"), (a["s"] + F.exp(step(a, i))).alias("s")), lambda a: a["s"])
    return F.when(k <= 0, 1.0).when(k > n, 0.0).when(p >= 1, 1.0).when(p <= 0, 0.0).otherwise(s)


def event_coincidence(df: DataFrame, *, by: list[str], index: str, a: str, b: str, tol: int = 0, tau: int = 0) -> DataFrame:
    """Precursor and trigger rates of two binary calendar series and their Poisson-type tail p.

    A step counts only when both series are present.  The windows are range frames over the
    calendar index, so nothing is paired."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    w = Window.partitionBy(*by).orderBy(index) if by else Window.partitionBy(F.lit(0)).orderBy(index)
    x = x.withColumns({
        "_prec": F.coalesce(F.sum(b).over(w.rangeBetween(-tau - tol, -tau)), F.lit(0)),
        "_trig": F.coalesce(F.sum(a).over(w.rangeBetween(tau, tau + tol)), F.lit(0)),
    })
    n = lambda c: F.sum(c.cast("int"))
    g = x.groupBy(*by).agg(
        n((F.col(a) == 1) & (F.col("_prec") > 0)).alias("kp"), n((F.col(b) == 1) & (F.col("_trig") > 0)).alias("kt"),
        n(F.col(a) == 1).alias("n_a"), n(F.col(b) == 1).alias("n_b"), F.count(F.lit(1)).cast("int").alias("t"))
    q = 1 - (tol + 1) / (F.col("t") - tau)
    g = g.withColumns({"_pp": 1 - F.pow(q, F.col("n_b")), "_pt": 1 - F.pow(q, F.col("n_a"))})
    return g.select(
        *by, "n_a", "n_b", "t", ratio("kp", "n_a").alias("precursor_rate"), ratio("kt", "n_b").alias("trigger_rate"),
        binomial_tail(F.col("kp").cast("int"), F.col("n_a").cast("int"), F.col("_pp")).alias("p_precursor"),
        binomial_tail(F.col("kt").cast("int"), F.col("n_b").cast("int"), F.col("_pt")).alias("p_trigger"))


def rolling_coincidence(df: DataFrame, *, by: list[str], index: str, a: str, b: str, tol: int, width: int, step: int, first: int, last: int) -> DataFrame:
    """Precursor rate inside sliding windows: each event row is copied to the windows that hold it
    (width / step of them) and counted only with partners inside the same window."""
    ws = F.array(*[F.lit(s) for s in range(first, last - width + 2, step)])
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x = x.select(*by, index, a, b, F.explode(F.filter(ws, lambda s: F.col(index).between(s, s + width - 1))).alias("start"))
    w = Window.partitionBy(*by, "start").orderBy(index).rangeBetween(-tol, 0)
    x = x.withColumn("_h", F.sum(b).over(w))
    return x.groupBy(*by, "start").agg(F.sum(a).alias("n_a"), F.sum(b).alias("n_b"), ratio(F.sum(((F.col(a) == 1) & (F.col("_h") > 0)).cast("int")), F.sum(a)).alias("rate"))


def self_clustering(df: DataFrame, *, by: list[str], index: str, event: str) -> DataFrame:
    """P(event at t + 1 | event at t)."""
    nxt = F.max(event).over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(index).rangeBetween(1, 1))
    x = df.withColumn("_n", nxt).where((F.col(event) == 1) & F.col("_n").isNotNull())
    return x.groupBy(*by).agg(F.avg("_n").alias("p_next"), F.count(F.lit(1)).alias("n"))


def storm_segments(df: DataFrame, *, by: list[str], index: str, value: str, ratio_col: str, min_ratio: float, level: float = 0.9, half: int = 4, reach: int = 8) -> DataFrame:
    """Peaks above a ratio threshold, troughs on both sides, overlaps merged.

    The series is on the calendar; troughs are the first minimum in the frame before the peak and
    after it; islands of overlapping storms keep the earliest start, the highest peak, the latest end."""
    w = Window.partitionBy(*by).orderBy(index)
    q = exact_quantiles(df, by, ratio_col, [level], "_q").drop("tau")
    x = df.join(q, by)
    s = F.struct(F.col(value), F.col(index))
    x = x.withColumns({
        "_peak": (F.col(value) == F.max(value).over(w.rowsBetween(-half, half))) & (F.col(ratio_col) >= F.greatest(F.lit(min_ratio), F.col("_q"))),
        "_lo": F.min(s).over(w.rowsBetween(-reach, 0))[index],
        "_hi": F.min(s).over(w.rowsBetween(0, reach))[index],
    })
    p = x.where("_peak").where((F.col(index) - F.col("_lo") >= 2) & (F.col("_hi") - F.col(index) >= 2))
    ws = Window.partitionBy(*by).orderBy("_lo", index)
    prev = F.max("_hi").over(ws.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("_new", F.when(prev.isNull() | (F.col("_lo") > prev), 1).otherwise(0)).withColumn("storm", F.sum("_new").over(ws))
    return p.groupBy(*by, "storm").agg(F.min("_lo").alias("start"), F.min_by(index, F.struct((-F.col(value)).alias("a"), F.col(index).alias("b"))).alias("peak"), F.max("_hi").alias("end"), F.max(value).alias("peak_value"))


def hysteresis_index(df: DataFrame, *, storm: list[str], index: str, q: str, c: str, inc: float = 0.05) -> DataFrame:
    """Mean over levels of the rising minus the falling limb of c at equal normalised q, and the flushing index.

    Each storm is a short calendar segment; a level is read at the first crossing of each limb."""
    g = df.groupBy(*storm).agg(
        F.min(q).alias("_q0"), F.max(q).alias("_q1"), F.min(c).alias("_c0"), F.max(c).alias("_c1"),
        F.min_by(index, F.struct((-F.col(q)).alias("a"), F.col(index).alias("b"))).alias("_k"), F.count(F.when(F.col(c).isNull(), 1)).alias("_miss"))
    n = df.join(g, storm).where("_miss = 0 AND _q1 > _q0 AND _c1 > _c0")
    n = n.withColumns({"_qn": (F.col(q) - F.col("_q0")) / (F.col("_q1") - F.col("_q0")), "_cn": (F.col(c) - F.col("_c0")) / (F.col("_c1") - F.col("_c0"))})
    w = Window.partitionBy(*storm).orderBy(index)
    e = n.withColumns({"_q2": F.lead("_qn").over(w), "_c2": F.lead("_cn").over(w)}).where("_q2 IS NOT NULL AND _q2 <> _qn")
    k = int(round(1 / inc)) - 1
    e = e.withColumn("_l", F.explode(F.array(*[F.lit((i + 1) * inc) for i in range(k)])))
    e = e.where((F.col("_qn") - F.col("_l")) * (F.col("_q2") - F.col("_l")) <= 0)
    at = F.col("_cn") + (F.col("_c2") - F.col("_cn")) * (F.col("_l") - F.col("_qn")) / (F.col("_q2") - F.col("_qn"))
    e = e.withColumn("_rise", F.col(index) < F.col("_k")).groupBy(*storm, "_l").agg(F.min_by(F.when(F.col("_rise"), at), F.when(F.col("_rise"), F.col(index))).alias("_r"), F.min_by(F.when(~F.col("_rise"), at), F.when(~F.col("_rise"), F.col(index))).alias("_f"))
    hi = e.where("_r IS NOT NULL AND _f IS NOT NULL").groupBy(*storm).agg(F.avg(F.col("_r") - F.col("_f")).alias("hysteresis"), F.count(F.lit(1)).alias("n_levels"))
    fi = n.groupBy(*storm).agg((F.max(F.when(F.col(index) == F.col("_k"), F.col("_cn"))) - F.min_by("_cn", index)).alias("flushing"))
    return fi.join(hi, storm, "left")


# ------------------------------------------------------------------ recurrence


def recurrence_profile(df: DataFrame, *, by: list[str], index: str, a: str, b: str, lags: list[int]) -> DataFrame:
    """Share of equal symbols of a(t) and b(t + lag) for a short list of lags."""
    x = df.select(*by, index, a, F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")).withColumn("_t", F.col(index) + F.col("lag"))
    y = df.select(*by, F.col(index).alias("_t"), F.col(b).alias("_b"))
    return x.join(y, [*by, "_t"]).groupBy(*by, "lag").agg(F.avg((F.col(a) == F.col("_b")).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def recurrence_determinism(df: DataFrame, *, by: list[str], index: str, a: str, b: str, min_line: int = 2) -> DataFrame:
    """Recurrence rate and the share of recurrent points on diagonal lines of at least ``min_line``.

    One group is one calendar window of a fixed width (52 steps in practice), so its recurrence plot
    is bounded; points are matched by an equi join on the symbol."""
    x = df.select(*by, F.col(index).alias("_i"), F.col(a).alias("_s"))
    y = df.select(*by, F.col(index).alias("_j"), F.col(b).alias("_s"))
    p = x.join(y, [*by, "_s"]).withColumn("_d", F.col("_j") - F.col("_i"))
    w = Window.partitionBy(*by, "_d").orderBy("_i")
    p = p.withColumn("_run", F.col("_i") - F.row_number().over(w))
    lines = p.groupBy(*by, "_d", "_run").agg(F.count(F.lit(1)).alias("_len"))
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    g = lines.groupBy(*by).agg(F.sum("_len").alias("points"), F.sum(F.when(F.col("_len") >= min_line, F.col("_len")).otherwise(0)).alias("_det")).join(n, by)
    return g.select(*by, (F.col("points") / (F.col("_n") * F.col("_n"))).alias("recurrence_rate"), ratio("_det", "points").alias("determinism"))


def sliding_windows(df: DataFrame, *, index: str, width: int, step: int, first: int, last: int, out: str = "win") -> DataFrame:
    """Copy each row to the fixed windows that contain it."""
    ws = F.array(*[F.lit(s) for s in range(first, last - width + 2, step)])
    return df.withColumn(out, F.explode(F.filter(ws, lambda s: F.col(index).between(s, s + width - 1))))


# ------------------------------------------------------------------ state space


def delay_embedding(df: DataFrame, *, by: list[str], index: str, value: str, dim: int, out: str = "e") -> DataFrame:
    """Lag vectors (x_t, x_{t-1}, ..., x_{t-dim+1}), complete ones only."""
    w = Window.partitionBy(*by).orderBy(index)
    lags = [F.max(value).over(w.rangeBetween(-k, -k)) for k in range(dim)]
    x = df.withColumns({f"{out}{k}": c for k, c in enumerate(lags)})
    return x.dropna(subset=[f"{out}{k}" for k in range(dim)])


def cross_map_skill(df: DataFrame, *, by: list[str], index: str, source: str, target: str, dim: int, library: list[int], lag: int = 0, exclusion: int = 0) -> DataFrame:
    """Skill of recovering the target from the source's delay embedding, by library size.

    The library of size L is the first L embedded points.  The embedded points of one series (a
    calendar length) travel as one array; each point keeps only its dim + 1 nearest neighbours,
    found inside the row, so no table of point pairs is written."""
    e = delay_embedding(df, by=by, index=index, value=source, dim=dim)
    tgt = df.select(*by, (F.col(index) - lag).alias(index), F.col(target).alias("_y"))
    e = e.join(tgt, [*by, index]).where("_y IS NOT NULL")
    w = Window.partitionBy(*by).orderBy(index)
    e = e.withColumn("_n", F.row_number().over(w))
    ev = [f"e{k}" for k in range(dim)]
    lib = e.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_n", F.array(*ev).alias("v"), F.col("_y").alias("y")))).alias("_lib"))
    p = e.join(lib, by).withColumn("size", F.explode(F.array(*[F.lit(L) for L in library])))
    dist = lambda v: F.sqrt(sum((F.element_at(v, k + 1) - F.col(f"e{k}")) ** 2 for k in range(dim)))
    near = F.transform(
        F.filter("_lib", lambda z: (z["_n"] <= F.col("size")) & (F.abs(z["_n"] - F.col("_n")) > exclusion)),
        lambda z: F.struct(dist(z["v"]).alias("d"), z["_n"].alias("i"), z["y"].alias("y")))
    p = p.select(*by, index, "size", "_y", F.slice(F.array_sort(near), 1, dim + 1).alias("_nn")).where(F.size("_nn") == dim + 1)
    d1 = F.greatest(F.element_at("_nn", 1)["d"], F.lit(1e-12))
    p = p.withColumn("_d1", d1)
    num = F.aggregate("_nn", F.lit(0.0), lambda s, z: s + F.exp(-z["d"] / F.col("_d1")) * z["y"])
    den = F.aggregate("_nn", F.lit(0.0), lambda s, z: s + F.exp(-z["d"] / F.col("_d1")))
    return p.withColumn("_p", num / den).groupBy(*by, "size").agg(F.corr("_p", "_y").alias("skill"), F.count(F.lit(1)).alias("n"))


def lagged_moments(df: DataFrame, *, by: list[str], index: str, names: list[str]) -> DataFrame:
    """Moments of (x_t, x_{t+1}) per group for a VAR(1): one row of d x d numbers per group."""
    w = Window.partitionBy(*by).orderBy(index)
    x = df.withColumns({f"n_{c}": F.max(c).over(w.rangeBetween(1, 1)) for c in names}).dropna(subset=[*names, *[f"n_{c}" for c in names]])
    grid = lambda left, right: F.array(*[F.covar_pop(a, b) for a in left for b in right])
    ahead = [f"n_{c}" for c in names]
    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in names]).alias("m"), grid(names, names).alias("c"), grid(names, ahead).alias("x"), grid(ahead, ahead).alias("y")
    )


def information_flow(df: DataFrame, *, by: list[str], index: str, names: list[str], dt: float = 1.0) -> DataFrame:
    """Information flow T[i <- j] = a_ij C_ij / C_ii of a VAR(1), normalised.

    ``se`` and ``p`` take the inverse of the uncentred second moments, as the method is published; ``se_ols`` and ``p_ols`` those of
    least squares with an intercept.  A group is reduced to d x d moments, and each row of moments is solved where it is."""
    import numpy as np
    import pandas as pd

    from tidemark.functions.scalars import two_sided_p

    d = len(names)

    def solve(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                n = r["n"]
                c, x, y = (np.asarray(r[k], float).reshape(d, d) for k in ("c", "x", "y"))
                m = np.asarray(r["m"], float)
                beta = np.linalg.solve(c, x)  # next = beta' now
                a = (beta.T - np.eye(d)) / dt
                cs = c * n / (n - 1)
                share = cs / np.diag(cs)[:, None]
                t = a * share
                resid = (y - beta.T @ x) * n / (n - d - 1)
                z = np.abs(t).sum(axis=1) + np.abs(np.diag(np.abs(resid)) / dt / (2 * np.diag(cs)))
                spread = lambda inverse: np.sqrt(np.outer(np.diag(resid), np.diag(inverse))) * np.abs(share) / dt
                se, ols = spread(np.linalg.inv(c * n + n * np.outer(m, m))), spread(np.linalg.inv(c * n))
                for i in range(d):
                    for j in range(d):
                        out.append((*[r[k] for k in by], names[j], names[i], t[i, j], t[i, j] / z[i], se[i, j], ols[i, j], n))
            yield pd.DataFrame(out, columns=[*by, "source", "target", "flow", "flow_norm", "se", "se_ols", "n"])

    moments = lagged_moments(df, by=by, index=index, names=names)
    kt = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in by)
    # a group needs more pairs than parameters
    rows = moments.where(F.col("n") > d + 1).mapInPandas(solve, f"{kt}source string, target string, flow double, flow_norm double, se double, se_ols double, n long")
    return rows.withColumn("p", two_sided_p(F.col("flow") / F.col("se"))).withColumn("p_ols", two_sided_p(F.col("flow") / F.col("se_ols")))


def granger_f(df: DataFrame, *, by: list[str], index: str, x: str, y: str) -> DataFrame:
    """F test that x(t-1) adds to y(t-1) in predicting y(t), from one pass of moments; both models
    have an intercept."""
    w = Window.partitionBy(*by).orderBy(index)
    z = df.withColumns({"_y1": F.max(y).over(w.rangeBetween(-1, -1)), "_x1": F.max(x).over(w.rangeBetween(-1, -1))}).dropna(subset=[y, "_y1", "_x1"])
    cp = lambda a, b, n: F.covar_pop(a, b).alias(n)
    m = z.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), cp("_y1", "_y1", "a"), cp("_x1", "_x1", "b"), cp("_y1", "_x1", "c"), cp("_y1", y, "p"), cp("_x1", y, "q"), F.var_pop(y).alias("v"))
    det = F.col("a") * F.col("b") - F.col("c") ** 2
    rss0 = F.col("v") - F.col("p") ** 2 / F.col("a")
    rss1 = F.col("v") - (F.col("p") ** 2 * F.col("b") - 2 * F.col("p") * F.col("q") * F.col("c") + F.col("q") ** 2 * F.col("a")) / det
    return m.select(*by, "n", ((rss0 - rss1) / (rss1 / (F.col("n") - 3))).alias("f_stat"))

"""Walk-forward forecasts with every origin in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def combine_weighted(base: Column, other: Column, w: Column) -> Column:
    """base + w (other - base), exactly ``other`` at w = 1."""
    return F.when(w == 1, other).otherwise(base + w * (other - base))


def ols_predict(df: DataFrame, *, y: str, xs: list[str], train: str, out: str = "fit") -> DataFrame:
    """OLS with intercept on the training rows (one or two regressors), prediction for every row.

    Centred moments are one aggregation; the coefficients enter as a one-row scalar."""
    from tidemark.functions.linear import solve2
    from tidemark.functions.scalars import ratio

    t = df.where(F.col(train))
    m = t.agg(
        F.avg(y).alias("my"),
        *[F.avg(x).alias(f"m_{x}") for x in xs],
        *[F.covar_pop(x, y).alias(f"c_{x}") for x in xs],
        *[F.covar_pop(a, b).alias(f"g_{a}_{b}") for i, a in enumerate(xs) for b in xs[i:]],
    )
    if len(xs) == 1:
        beta = [ratio(f"c_{xs[0]}", f"g_{xs[0]}_{xs[0]}")]
    else:
        a, b = xs
        beta = solve2(F.col(f"g_{a}_{a}"), F.col(f"g_{a}_{b}"), F.col(f"g_{b}_{b}"), F.col(f"c_{a}"), F.col(f"c_{b}"), tol=0.0)
    coef = m.select(F.struct("my", *[f"m_{x}" for x in xs], *[c.alias(f"b_{x}") for c, x in zip(beta, xs)])).scalar()
    k = df.withColumn("_k", coef)
    fit = F.col("_k.my")
    for x in xs:
        fit = fit + F.col(f"_k.b_{x}") * (F.col(x) - F.col(f"_k.m_{x}"))
    return k.withColumn(out, fit).drop("_k")


# ------------------------------------------------------------------ pooled walk-forward


def design(df: DataFrame, *, value: str, size: str, k: int = 50, entity="entity", period="q") -> DataFrame:
    """Calendar-lag features, guarded log growths and the top-k flag at each origin."""
    from tidemark.functions.scalars import log_ratio
    from tidemark.operators.calendar import lag_at, topk_per_group

    x = df.withColumns({"y": F.col(value), **{f"y_lag{n}": lag_at(value, n, entity, period) for n in (1, 3, 4)}, "y_next": lag_at(value, -1, entity, period)})
    pos = (F.col("y") > 0) & (F.col("y_lag1") > 0) & (F.col("y_lag3") > 0) & (F.col("y_lag4") > 0)
    x = x.withColumns({
        "g_now": F.when(pos, log_ratio("y", "y_lag1")),
        "g_season": F.when(pos, log_ratio("y_lag3", "y_lag4")),
        "g_next": log_ratio("y_next", "y"),
    })
    top = topk_per_group(df.where(F.col(size).isNotNull()).select(entity, period, size), by=period, value=size, k=k, tie=entity)
    return x.join(top.select(entity, period, F.lit(True).alias("selected")), [entity, period], "left").fillna(False, ["selected"])


def pooled_ar_coefficients(data: DataFrame, *, period="q") -> DataFrame:
    """OLS of g_next on [1, g_now, g_season] over selected rows with origin s < t, for every t.

    One moment row per period is enough: the expanding fit is a running sum over the calendar,
    so no row is copied to later origins.  ``defined`` says whether the fit exists."""
    from tidemark.functions.linear import gram_columns, solve3

    tr = data.where("selected AND g_now IS NOT NULL AND g_season IS NOT NULL AND g_next IS NOT NULL")
    g = tr.groupBy(period).agg(*gram_columns({"c": F.lit(1.0), "a": F.col("g_now"), "b": F.col("g_season")}, F.col("g_next")))
    spine = data.select(period).distinct().join(g, period, "left")
    w = Window.partitionBy(F.lit(0)).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)  # one row per calendar period
    run = spine.select(period, *[F.sum(c).over(w).alias(c) for c in g.columns if c != period])
    m = [["g_c_c", "g_c_a", "g_c_b"], ["g_c_a", "g_a_a", "g_a_b"], ["g_c_b", "g_a_b", "g_b_b"]]
    beta = solve3([[F.col(x) for x in r] for r in m], [F.col("gy_c"), F.col("gy_a"), F.col("gy_b")])
    out = run.select(period, F.col("gn").alias("n_train"), *[b.alias(f"b{i}") for i, b in enumerate(beta)])
    return out.withColumn("defined", F.coalesce((F.col("n_train") >= 3) & F.col("b0").isNotNull(), F.lit(False)))


def forecast_cases(data: DataFrame, *, entity="entity", period="q", first: int | None = None) -> DataFrame:
    """One row per (entity, origin) with actual, naive, seasonal naive and pooled AR.

    Selected rows with a target and both histories; the pooled fit falls back to the naive
    value (flagged) where its growths are missing."""
    beta = pooled_ar_coefficients(data, period=period)
    c = data.where("selected AND y_next IS NOT NULL AND y IS NOT NULL AND y_lag3 IS NOT NULL")
    if first is not None:
        c = c.where(F.col(period) >= first)
    j = c.join(beta, period).where("defined")
    usable = F.col("g_now").isNotNull() & F.col("g_season").isNotNull()
    ar = F.col("y") * F.exp(F.col("b0") + F.col("b1") * F.col("g_now") + F.col("b2") * F.col("g_season"))
    return j.select(
        entity, F.col(period).alias("origin"), (F.col(period) + 1).alias("target"), F.col("y_next").alias("actual"),
        F.col("y").alias("naive"), F.col("y_lag3").alias("seasonal_naive"),
        F.when(usable, ar).otherwise(F.col("y")).alias("pooled_ar"), (~usable).alias("ar_fallback"),
    )


def origin_audit(data: DataFrame, *, period="q") -> DataFrame:
    """Selected, dropped and evaluated counts per origin, as columns and not as filters."""
    s = data.where("selected")
    t_ok, h_ok = F.col("y_next").isNotNull(), F.col("y").isNotNull() & F.col("y_lag3").isNotNull()
    n = lambda c: F.sum(c.cast("long"))
    return s.groupBy(F.col(period).alias("origin")).agg(
        F.count(F.lit(1)).alias("selected"), n(~t_ok).alias("dropped_target_missing"), n(t_ok & ~h_ok).alias("dropped_history"), n(t_ok & h_ok).alias("evaluated"))


METHODS = ["naive", "seasonal_naive", "pooled_ar"]


def melt_methods(cases: DataFrame, methods: list[str] = METHODS, ids: list[str] = ["entity", "origin", "target", "actual"]) -> DataFrame:
    return cases.select(*ids, *methods).unpivot(ids, methods, "method", "forecast")


def combo_weights(cases: DataFrame, *, grid: list[float], min_quarters: int = 8, default: float = 0.5) -> DataFrame:
    """Weight on the pooled forecast per origin: grid argmin of summed absolute error on cases with
    target <= origin, ties to the smallest weight, ``default`` below ``min_quarters`` target periods.

    Losses are summed per target period first; the expanding sum runs over the calendar."""
    errs = [F.sum(F.abs(combine_weighted(F.col("naive"), F.col("pooled_ar"), F.lit(float(w))) - F.col("actual"))).alias(f"l{i}") for i, w in enumerate(grid)]
    per = cases.groupBy("target").agg(*errs, F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(F.lit(0)).orderBy("target").rowsBetween(Window.unboundedPreceding, 0)
    r = per.select(F.col("target").alias("origin"), F.sum("n").over(run).alias("n_cases"), F.count(F.lit(1)).over(run).alias("n_quarters"), *[F.sum(f"l{i}").over(run).alias(f"l{i}") for i in range(len(grid))])
    best = F.array_min(F.array(*[F.struct(F.col(f"l{i}").alias("l"), F.lit(float(w)).alias("w")) for i, w in enumerate(grid)]))
    return r.select("origin", "n_cases", "n_quarters", F.when(F.col("n_quarters") < min_quarters, default).otherwise(best["w"]).alias("w"))


def combo_forecasts(cases: DataFrame, weights: DataFrame) -> DataFrame:
    j = cases.join(weights.select("origin", "w"), "origin")
    return j.withColumn("combo", combine_weighted(F.col("naive"), F.col("pooled_ar"), F.col("w")))


def multi_horizon(df: DataFrame, *, value: str, horizons: list[int], entity="entity", period="q") -> DataFrame:
    """Direct cases at several horizons: target value at period + h beside the value at the origin."""
    from tidemark.operators.calendar import lag_at

    x = df.withColumns({f"_h{h}": lag_at(value, -h, entity, period) for h in horizons} | {f"_s{h}": lag_at(value, 4 - h, entity, period) for h in horizons})
    e = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_h{h}").alias("actual"), F.col(f"_s{h}").alias("seasonal")) for h in horizons]))
    return x.select(entity, period, F.col(value).alias("naive"), e.alias("e")).select(entity, period, "naive", "e.*").where("actual IS NOT NULL AND seasonal IS NOT NULL")


def share_forecast_baselines(clr: DataFrame, *, value="clr", period="period", part="part") -> DataFrame:
    """One-step random walk, expanding mean and expanding AR(1) of each clr share."""
    from tidemark.functions.scalars import ratio

    w = Window.partitionBy(part).orderBy(period)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    x = clr.withColumn("_x", F.lag(value).over(w))
    run = lambda c: F.sum(F.when(F.col("_x").isNotNull(), c)).over(past)
    n, sx, sy = run(F.lit(1.0)), run(F.col("_x")), run(F.col(value))
    sxx, sxy = run(F.col("_x") * F.col("_x")), run(F.col("_x") * F.col(value))
    x = x.withColumns({"_n": n, "_sx": sx, "_sy": sy, "_sxx": sxx, "_sxy": sxy, "mean": F.avg(value).over(past)})
    b = ratio(F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy"), F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx"))
    ar = F.col("_sy") / F.col("_n") + b * (F.col("_x") - F.col("_sx") / F.col("_n"))
    return x.where("_n >= 4").select(period, part, F.col(value).alias("actual"), F.col("_x").alias("random_walk"), "mean", ar.alias("ar1"))


def trailing_best_member(scores: DataFrame, *, period: str, member: str, score: str, minimum: int = 12) -> DataFrame:
    """Member with the lowest mean score over strictly earlier periods, once ``minimum`` are scored."""
    w = Window.partitionBy(member).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    x = scores.withColumn("_m", F.when(F.count(score).over(w) >= minimum, F.avg(score).over(w)))
    return x.where("_m IS NOT NULL").groupBy(period).agg(F.min_by(member, F.struct(F.col("_m"), F.col(member))).alias("best"), F.min("_m").alias("past_score"))


# ------------------------------------------------------------------ per-entity distribution members


def past_error_quantiles(df: DataFrame, *, centre: str, error: str, levels: list[float], min_own: int = 8, scale: str | None = None, entity="entity", period="q") -> DataFrame:
    """Centre + quantiles of own past errors (through the origin), or of pooled scaled errors below ``min_own``.

    An entity's error series is bounded by the calendar; the pooled law uses exact distributed quantiles."""
    from tidemark.operators.ranks import exact_quantiles

    w = Window.partitionBy(entity).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    lev = F.array(*[F.lit(float(t)) for t in levels])
    x = df.withColumns({"n_own": F.count(error).over(w), "_own": F.percentile(error, lev).over(w)})
    if scale is None:
        q = F.when(F.col("n_own") >= min_own, F.transform("_own", lambda e: F.col(centre) + e))
        x = x.withColumn("_q", q)
    else:
        pool = exact_quantiles(df.where(F.col(scale) > 0).withColumn("_e", F.col(error) / F.col(scale)), [], "_e", levels)
        arr = pool.agg(F.transform(F.sort_array(F.collect_list(F.struct("tau", "qv"))), lambda e: e["qv"])).scalar()
        x = x.withColumn("_pool", arr)
        own = F.transform("_own", lambda e: F.col(centre) + e)
        pooled = F.transform("_pool", lambda e: F.col(centre) + F.col(scale) * e)
        x = x.withColumn("_q", F.when(F.col("n_own") >= min_own, own).when(F.col(scale) > 0, pooled))
    z = x.where(F.col("_q").isNotNull() & F.col(centre).isNotNull())
    return z.select(entity, period, "n_own", F.explode(F.arrays_zip(lev.alias("tau"), F.col("_q").alias("qv"))).alias("e")).select(entity, period, "n_own", "e.*")


def member_b0(df: DataFrame, *, value: str, levels: list[float], n: int = 8, entity="entity", period="q") -> DataFrame:
    """Quantiles of the last n values."""
    w = Window.partitionBy(entity).orderBy(period).rowsBetween(-(n - 1), 0)
    lev = F.array(*[F.lit(float(t)) for t in levels])
    x = df.where(F.col(value).isNotNull()).withColumns({"_c": F.count(value).over(w), "_q": F.percentile(value, lev).over(w)}).where(F.col("_c") == n)
    return x.select(entity, period, F.explode(F.arrays_zip(lev.alias("tau"), F.col("_q").alias("qv"))).alias("e")).select(entity, period, "e.*")


def member_centres(df: DataFrame, *, value: str, alpha: float = 0.3, entity="entity", period="q") -> DataFrame:
    """Centres for the next period and realised one-step errors of B1 (seasonal), B2 (random walk), B3 (smoothing)."""
    from tidemark.operators.calendar import exp_smoothing, lag_at

    x = exp_smoothing(df, value=value, alpha=alpha, out="_l", entity=entity, period=period)
    x = x.withColumns({
        "c1": lag_at(value, 3, entity, period), "e1": F.col(value) - lag_at(value, 4, entity, period),
        "c2": F.col(value), "e2": F.col(value) - lag_at(value, 1, entity, period),
        "c3": F.col("_l"), "e3": F.col(value) - lag_at("_l", 1, entity, period),
    })
    return x.drop("_l")


def member_b4(df: DataFrame, *, value: str, levels: list[float], min_pairs: int = 8, entity="entity", period="q") -> DataFrame:
    """Per entity and origin: OLS of next value on [1, value, 1{target in Q1}]; quantiles of in-sample errors.

    Coefficients come from running sums.  The residuals of an origin re-use the entity's earlier
    pairs, at most (periods^2)/2 rows per entity, bounded by the calendar."""
    from tidemark.functions.linear import solve3
    from tidemark.operators.calendar import lag_at

    x = df.select(entity, F.col(period).alias("t"), F.col(value).alias("y"), lag_at(value, 1, entity, period).alias("x"))
    x = x.withColumn("d", F.when(F.col("t") % 4 == 0, 1.0).otherwise(0.0))
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    w = Window.partitionBy(entity).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    s = lambda c: F.sum(F.when(ok, c)).over(w)
    one = F.lit(1.0)
    m = x.withColumns({
        "n": s(one), "sx": s(F.col("x")), "sd": s(F.col("d")), "sxx": s(F.col("x") ** 2), "sxd": s(F.col("x") * F.col("d")), "sy": s(F.col("y")),
        "sxy": s(F.col("x") * F.col("y")), "sdy": s(F.col("d") * F.col("y")),
        "pairs": F.collect_list(F.when(ok, F.struct("x", "y", "d"))).over(w),
    })
    g = [[F.col("n"), F.col("sx"), F.col("sd")], [F.col("sx"), F.col("sxx"), F.col("sxd")], [F.col("sd"), F.col("sxd"), F.col("sd")]]
    b = solve3(g, [F.col("sy"), F.col("sxy"), F.col("sdy")])
    c = m.where((F.col("n") >= min_pairs) & F.col("y").isNotNull()).select(entity, "t", "y", "pairs", *[v.alias(f"b{i}") for i, v in enumerate(b)]).where("b0 IS NOT NULL")
    nxt = F.when((F.col("t") + 1) % 4 == 0, 1.0).otherwise(0.0)
    e = c.select(entity, "t", (F.col("b0") + F.col("b1") * F.col("y") + F.col("b2") * nxt).alias("centre"), "b0", "b1", "b2", F.explode("pairs").alias("p"))
    err = F.col("p.y") - (F.col("b0") + F.col("b1") * F.col("p.x") + F.col("b2") * F.col("p.d"))
    lev = F.array(*[F.lit(float(t)) for t in levels])
    q = e.groupBy(entity, "t").agg(F.first("centre").alias("centre"), F.percentile(err, lev).alias("_q"))
    return q.select(entity, F.col("t").alias(period), F.explode(F.arrays_zip(lev.alias("tau"), F.transform("_q", lambda v: F.col("centre") + v).alias("qv"))).alias("e")).select(entity, period, "e.*")


# ------------------------------------------------------------------ moment-based estimators


def gram_matrix(df: DataFrame, xs: list[str], y: str | None = None, weight: str | None = None):
    """X'X, X'y and n as small driver arrays from one aggregation (p x p numbers, never rows)."""
    import numpy as np

    w = F.col(weight) if weight else F.lit(1.0)
    aggs = [F.sum(w * F.col(a) * F.col(b)).alias(f"x_{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j]
    if y:
        aggs += [F.sum(w * F.col(a) * F.col(y)).alias(f"y_{i}") for i, a in enumerate(xs)] + [F.sum(w * F.col(y) * F.col(y)).alias("yy")]
    r = df.agg(*aggs, F.count(F.lit(1)).alias("n")).first()
    p = len(xs)
    g = np.array([[r[f"x_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
    h = np.array([r[f"y_{i}"] for i in range(p)], float) if y else None
    return g, h, (float(r["yy"]) if y else None), int(r["n"])


def ridge_gcv(df: DataFrame, *, y: str, xs: list[str], lambdas: list[float], entity="entity"):
    """Ridge with entity effects removed, penalty chosen by generalised cross-validation.

    Within-entity centring and scaling are aggregates; the Gram is p x p; the eigen solve over
    the penalty grid is the driver step.  Returns (lambda, coefficients on the original scale)."""
    import numpy as np

    m = df.groupBy(entity).agg(*[F.avg(c).alias(f"_m_{c}") for c in [y, *xs]])
    c = df.join(m, entity).select(*[(F.col(k) - F.col(f"_m_{k}")).alias(k) for k in [y, *xs]])
    n_ent = m.count()
    g, h, yy, n = gram_matrix(c, xs, y)
    sd = np.sqrt(np.diag(g) / n)
    sd[sd == 0] = 1.0
    g, h = g / np.outer(sd, sd), h / sd
    lam, v = np.linalg.eigh(g)
    u = v.T @ h
    best = None
    for k in sorted(lambdas):
        b = v @ (u / (lam + k))
        rss = yy - 2 * b @ h + b @ g @ b
        df_k = (lam / (lam + k)).sum() + n_ent
        score = n * rss / (n - df_k) ** 2
        if best is None or score < best[0]:
            best = (score, k, b / sd)
    return best[1], dict(zip(xs, map(float, best[2])))


def panel_quantile_regression(df: DataFrame, *, y: str, xs: list[str], levels: list[float], iters: int = 25, eps: float = 1e-6) -> dict[float, list[float]]:
    """Linear quantile regression for all levels together by iteratively reweighted Gram matrices.

    Each pass is one aggregation that yields a p x p moment per level (the rows stay in Spark);
    the next pass carries the new coefficients as literals, so no lineage builds up."""
    import numpy as np

    names = ["_one", *xs]
    base = df.select(F.col(y).alias("_y"), F.lit(1.0).alias("_one"), *xs).where(" AND ".join(f"{c} IS NOT NULL" for c in ["_y", *xs]))
    base = cut_lineage(base, "irls")
    g, h, _, _ = gram_matrix(base, names, "_y")
    beta = {t: np.linalg.solve(g, h) for t in levels}
    p = len(names)
    for _ in range(iters):
        aggs = []
        for k, t in enumerate(levels):
            r = F.col("_y") - sum(F.lit(float(b)) * F.col(c) for b, c in zip(beta[t], names))
            w = F.when(r >= 0, t).otherwise(1 - t) / F.greatest(F.abs(r), F.lit(eps))
            aggs += [F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"x{k}_{i}_{j}") for i in range(p) for j in range(i, p)]
            aggs += [F.sum(w * F.col(names[i]) * F.col("_y")).alias(f"y{k}_{i}") for i in range(p)]
        row = base.agg(*aggs).first()
        move = 0.0
        for k, t in enumerate(levels):
            gm = np.array([[row[f"x{k}_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
            new = np.linalg.solve(gm, np.array([row[f"y{k}_{i}"] for i in range(p)]))
            move = max(move, float(np.abs(new - beta[t]).max()))
            beta[t] = new
        if move < 1e-8:
            break
    return {t: [float(v) for v in b] for t, b in beta.items()}


#: Columns of the dynamic panel equation: the value, its lag and three centred seasons.
PANEL = ("y", "l", "s1", "s2", "s3")
PANEL_FIT = "n long, rho double, a1 double, a2 double, a3 double, sigma2 double, omega2 double, phi0 double, phi1 double, shrinkage double, loglik double"


def _panel_windows(df: DataFrame, value: str, window: int, entity: str, period: str) -> DataFrame:
    """Per entity and origin with a complete window: sums of the equation's columns and of their products over it, the value
    before the window and the last one.  Running sums over the calendar, so every origin comes from one pass."""
    from tidemark.functions.periods import quarter_dummies
    from tidemark.operators.calendar import lag_at

    x = df.where(F.col(value).isNotNull()).select(entity, F.col(period).alias("q"), F.col(value).cast("double").alias("y"))
    x = x.withColumns({"l": lag_at("y", 1, entity, "q"), "y0": lag_at("y", window, entity, "q")}).select("*", *quarter_dummies("q"))
    use = F.col("l").isNotNull()
    span = Window.partitionBy(entity).orderBy("q").rangeBetween(-(window - 1), 0)
    over = lambda c: F.sum(F.when(use, c)).over(span)
    sums = {f"m_{v}": over(F.col(v)) / window for v in PANEL}
    sums |= {f"c_{i}_{j}": over(F.col(PANEL[i]) * F.col(PANEL[j])) for i in range(5) for j in range(i, 5)}
    x = x.select(entity, "q", "y", "y0", over(F.lit(1)).alias("_n"), *[c.alias(k) for k, c in sums.items()])
    return x.where((F.col("_n") == window) & F.col("y0").isNotNull()).drop("_n")


def _gls_fit(total, means, n: int, window: int):
    """Likelihood of the correlated-random-effects equation from its moments.

    ``total`` holds the products summed over all rows, ``means`` those of entity means with (1, first value) summed over
    entities.  Residual variance inside entities and variance of entity means are two clipped ratios given the slopes; given the
    variances the slopes are a weighted least squares fit.  Each step raises the likelihood."""
    import numpy as np

    level = means[:5, :5]
    within = total - window * level
    z, mz = means[5:, 5:], means[:5, 5:]
    between = level - mz @ np.linalg.solve(z, mz.T)

    def variances(k):
        w, e = float(k @ within @ k), float(k @ between @ k)
        noise, mean = w / (n * (window - 1)), e / n
        if mean < noise / window:  # no variance is left for the effects: pool both
            noise = (w + window * e) / (n * window)
            mean = noise / window
        value = n * (window - 1) / 2 * np.log(noise) + w / (2 * noise) + n / 2 * np.log(mean) + e / (2 * mean)
        return noise, mean, value

    best = None
    for first in (within, total):
        theta = np.linalg.lstsq(first[1:, 1:], first[1:, 0], rcond=None)[0]
        for _ in range(2000):
            noise, mean, value = variances(np.append(1.0, -theta))
            m = within / noise + between / mean
            new = np.linalg.solve(m[1:, 1:], m[1:, 0])
            moved = np.abs(new - theta).max()
            theta = new
            if moved < 1e-13:
                break
        k = np.append(1.0, -theta)
        noise, mean, value = variances(k)
        if best is None or value < best[0]:
            best = (value, theta, noise, mean)
    value, theta, noise, mean = best
    phi = np.linalg.solve(z, mz.T @ np.append(1.0, -theta))
    omega = max(mean - noise / window, 0.0)
    return (n, *map(float, theta), float(noise), float(omega), *map(float, phi), float((noise / window) / (omega + noise / window)), -float(value))


def eb_panel_moments(df: DataFrame, *, value: str, window: int = 12, entity="entity", period="q") -> tuple[DataFrame, DataFrame]:
    """Correlated-random-effects forecasts y_t = rho y_{t-1} + s_t'a + lambda_i + e at every origin.

    Returns (fits, forecasts).  A fit is one row per origin with at least three complete windows and enough rank; its moments are
    one row of sums over entities, and the solves of many origins run side by side on those rows.  A forecast is one
    row per origin and entity: the posterior mean of the effect, the slope on the last value and the next season."""
    import numpy as np
    import pyarrow as pa

    win = cut_lineage(_panel_windows(df, value, window, entity, period), "windows")
    means = [*[f"m_{v}" for v in PANEL], "one", "y0"]
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    squares = [(i, j) for i in range(7) for j in range(i, 7)]
    sums = [F.sum(f"c_{i}_{j}") for i, j in pairs] + [F.sum(F.col(means[i]) * F.col(means[j])) for i, j in squares]
    moments = win.withColumn("one", F.lit(1.0)).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("m"))

    def solve(batches):
        names = ["q", *[c.split()[0] for c in PANEL_FIT.split(", ")]]
        for batch in batches:
            rows = []
            for q, n, m in zip(*(c.to_pylist() for c in batch.columns)):
                total, mean = np.zeros((5, 5)), np.zeros((7, 7))
                for (i, j), v in zip(pairs, m):
                    total[i, j] = total[j, i] = v
                for (i, j), v in zip(squares, m[len(pairs) :]):
                    mean[i, j] = mean[j, i] = v
                try:
                    if n >= 3:
                        rows.append((q, *_gls_fit(total, mean, n, window)))
                except np.linalg.LinAlgError:
                    continue  # an origin without enough rank has no fit
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(cols)], names)

    fits = cut_lineage(moments.select(F.col("q").cast("long").alias("q"), "n", "m").mapInArrow(solve, "q long, " + PANEL_FIT), "panel-fits")
    lam = F.col("m_y") - F.col("rho") * F.col("m_l") - F.col("a1") * F.col("m_s1") - F.col("a2") * F.col("m_s2") - F.col("a3") * F.col("m_s3")
    season = sum((F.when((F.col("q") + 1) % 4 == i, 1.0).otherwise(0.0) - 0.25) * F.col(f"a{i + 1}") for i in range(3))
    prior = F.col("phi0") + F.col("phi1") * F.col("y0")
    fc = win.join(fits, "q")
    fc = fc.select(entity, F.col("q").cast(df.schema[period].dataType).alias(period), ((1 - F.col("shrinkage")) * lam + F.col("shrinkage") * prior + F.col("rho") * F.col("y") + season).alias("forecast"), "rho", "shrinkage")
    return fits.withColumnRenamed("q", period), fc


def eb_shrink_normal(df: DataFrame, *, x: str, s: str, group: str, min_group: int = 3) -> DataFrame:
    """Posterior mean, sd and local false sign rate under a normal prior centred at the group mean
    (small groups use the overall mean); the prior variance is a moment estimate."""
    from tidemark.functions.scalars import normal_cdf

    g = df.groupBy(group).agg(F.avg(x).alias("_gm"), F.count(F.lit(1)).alias("_gn"))
    allm = df.agg(F.avg(x)).scalar()
    c = df.join(g, group).withColumn("_m", F.when(F.col("_gn") >= min_group, F.col("_gm")).otherwise(allm))
    tau2 = c.agg(F.greatest(F.avg((F.col(x) - F.col("_m")) ** 2 - F.col(s) ** 2), F.lit(0.0))).scalar()
    c = c.withColumn("_t2", tau2)
    k = F.col("_t2") / (F.col("_t2") + F.col(s) ** 2)
    c = c.withColumns({"post_mean": F.col("_m") + k * (F.col(x) - F.col("_m")), "post_sd": F.sqrt(k) * F.col(s)})
    z = F.abs(F.try_divide(F.col("post_mean"), F.col("post_sd")))
    return c.withColumn("lfsr", F.coalesce(1 - normal_cdf(z), F.lit(1.0))).drop("_gm", "_gn", "_m", "_t2")


def eb_shrink_mixture(df: DataFrame, *, x: str, s: str, grid: list[float], iters: int = 30) -> tuple[list[float], DataFrame]:
    """Scale-mixture-of-normals prior on a grid of prior sds (0 gives point mass): EM for the weights.

    Every EM pass is one aggregation over the rows with the current weights as literals and one
    number per component returned."""
    import math

    from tidemark.functions.scalars import normal_cdf

    comp = [F.exp(-F.col(x) ** 2 / (2 * (F.col(s) ** 2 + t * t))) / F.sqrt(F.col(s) ** 2 + t * t) for t in grid]
    lik = cut_lineage(df.select("*", F.array(*comp).alias("_l")), "em")
    w = [1.0 / len(grid)] * len(grid)
    for _ in range(iters):
        num = [F.lit(w[k]) * F.col("_l")[k] for k in range(len(grid))]
        den = sum(num[1:], num[0])
        row = lik.agg(*[F.avg(n / den).alias(f"w{k}") for k, n in enumerate(num)]).first()
        new = [row[f"w{k}"] for k in range(len(grid))]
        moved = max(abs(a - b) for a, b in zip(w, new))
        w = new
        if moved < 1e-7:
            break
    num = [F.lit(w[k]) * F.col("_l")[k] for k in range(len(grid))]
    den = sum(num[1:], num[0])
    r = lik.select("*", F.array(*[n / den for n in num]).alias("_r"))
    mean = [F.col(x) * (t * t) / (F.col(s) ** 2 + t * t) for t in grid]
    sd = [F.sqrt((t * t) * F.col(s) ** 2 / (F.col(s) ** 2 + t * t)) for t in grid]
    post = sum((F.col("_r")[k] * mean[k] for k in range(len(grid))), F.lit(0.0))
    neg = sum((F.col("_r")[k] * (normal_cdf(-mean[k] / sd[k]) if t > 0 else F.lit(0.0)) for k, t in enumerate(grid)), F.lit(0.0))
    zero = sum((F.col("_r")[k] for k, t in enumerate(grid) if t == 0), F.lit(0.0))
    out = r.withColumns({"post_mean": post, "_neg": neg, "_zero": zero})
    return w, out.withColumn("lfsr", F.least(F.col("_neg") + F.col("_zero"), 1 - F.col("_neg"))).drop("_l", "_r", "_neg", "_zero")


def noise_sd_estimate(df: DataFrame, *, entity: str, group: str, gap: str, pseudo: float = 4.0, deflate: float = 1.0) -> DataFrame:
    """Per-entity sd of a gap series shrunk towards the group's median variance with pseudo-observations."""
    from tidemark.operators.ranks import exact_quantiles, group_medians

    g = df.groupBy(entity, group).agg(F.count(gap).alias("k"), F.var_samp(gap).alias("v")).withColumn("s2", F.col("v") / deflate)
    ok = g.where("k >= 3 AND s2 IS NOT NULL")
    pooled = group_medians(ok, [group], "s2", "_gm")
    allm = exact_quantiles(ok, [], "s2", [0.5], "_m").select("_m").scalar()
    j = g.join(pooled, group, "left").withColumn("_g", F.coalesce("_gm", allm))
    dof = F.greatest(F.col("k") - 1, F.lit(0))
    return j.select(entity, group, "k", F.sqrt((dof * F.coalesce("s2", F.lit(0.0)) + pseudo * F.col("_g")) / (dof + pseudo)).alias("sigma"))


def local_level_decompose(df: DataFrame, *, value: str, x: str, gains: list[float], by="part", period="period") -> DataFrame:
    """Split each series into market (regression), sticky (smoothed level) and transient parts.

    Every gain of a short grid is tried in the same pass; the gain with the smallest one-step
    squared error wins, ties to the smallest."""
    from tidemark.functions.scalars import ratio
    from tidemark.operators.calendar import exp_smoothing

    m = df.groupBy(by).agg(F.avg(value).alias("_my"), F.avg(x).alias("_mx"), ratio(F.covar_pop(x, value), F.var_pop(x)).alias("_b"))
    j = df.join(m, by).withColumn("market", F.col("_b") * (F.col(x) - F.col("_mx"))).withColumn("_z", F.col(value) - F.col("_my") - F.col("market"))
    each = j.select(by, period, "_z", "market", F.explode(F.array(*[F.lit(float(g)) for g in gains])).alias("gain"))
    parts = exp_smoothing(each, value="_z", alpha="gain", out="sticky", entity=[by, "gain"], period=period)
    parts = parts.withColumn("_e", F.col("_z") - F.lag("sticky").over(Window.partitionBy(by, "gain").orderBy(period)))
    best = parts.groupBy(by, "gain").agg(F.sum(F.col("_e") ** 2).alias("sse")).groupBy(by).agg(F.min_by("gain", F.struct("sse", "gain")).alias("gain"))
    return parts.join(best, [by, "gain"]).select(by, period, "gain", "market", "sticky", (F.col("_z") - F.col("sticky")).alias("transient"))


# ------------------------------------------------------------------ splits, change points, ceilings


def split_screen(df: DataFrame, *, y: str, xs: list[str]) -> DataFrame:
    """Association of the outcome with every candidate: t statistic, two-sided normal p, Bonferroni p."""
    from tidemark.functions.scalars import two_sided_p

    k = len(xs)
    long = df.select(F.col(y).alias("_y"), F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("v")) for x in xs])).alias("e")).select("_y", "e.*")
    s = long.groupBy("feature").agg(F.corr("_y", "v").alias("r"), F.count("v").alias("n"))
    stat = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") ** 2))
    s = s.withColumn("t", stat).withColumn("p", two_sided_p("t"))
    return s.withColumn("p_adj", F.least(F.lit(1.0), F.col("p") * k))


def best_threshold(df: DataFrame, *, y: str, x: str, min_bucket: int = 24) -> DataFrame:
    """Cut of x that leaves the smallest residual sum of squares, from distributed running sums."""
    from tidemark.operators.ranks import prefix_totals

    b = df.select(F.col(x).cast("double").alias("x"), F.lit(1).cast("long").alias("n"), F.col(y).cast("double").alias("s"))
    c = prefix_totals(b, [], "x", ["n", "s"])
    nl, sl = F.col("before_n") + F.col("n"), F.col("before_s") + F.col("s")
    nr, sr = F.col("total_n") - nl, F.col("total_s") - sl
    gain = sl * sl / nl + sr * sr / nr - F.col("total_s") ** 2 / F.col("total_n")
    ok = (nl >= min_bucket) & (nr >= min_bucket)
    return c.where(ok).agg(F.max_by(F.struct(F.col("x").alias("cut"), nl.alias("n_left"), gain.alias("gain")), F.struct(gain, -F.col("x"))).alias("b")).select("b.*")


def segment_coefficients(df: DataFrame, *, segment: str, y: str, x: str) -> DataFrame:
    """Slope, intercept and size per segment (the coefficient table of a model tree)."""
    return df.groupBy(segment).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def cusum_changepoint(series: DataFrame, *, value: str, index: str, by: list[str], min_size: int = 5) -> DataFrame:
    """Best single change in mean per series: position and standardised CUSUM statistic.

    Series are on the calendar, hence bounded; binary segmentation repeats this per segment id."""
    w = Window.partitionBy(*by).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    full = Window.partitionBy(*by)
    x = series.withColumns({"_i": F.count(value).over(w), "_s": F.sum(value).over(w), "_n": F.count(value).over(full), "_t": F.sum(value).over(full)})
    stat = F.abs(F.col("_s") - F.col("_i") * F.col("_t") / F.col("_n")) * F.sqrt(F.col("_n") / (F.col("_i") * (F.col("_n") - F.col("_i"))))
    ok = (F.col("_i") >= min_size) & (F.col("_n") - F.col("_i") >= min_size)
    return x.where(ok).withColumn("stat", stat).groupBy(*by).agg(F.max_by(index, F.struct("stat", -F.col("_i"))).alias("split_at"), F.max("stat").alias("stat"))


def binary_segmentation(series: DataFrame, *, value: str, index: str, by: list[str], threshold: float, depth: int = 3, min_size: int = 5) -> DataFrame:
    """Repeated CUSUM splits, one pass per depth; returns the segment id of every point."""
    x = series.withColumn("segment", F.lit("0"))
    for _ in range(depth):
        cp = cusum_changepoint(x, value=value, index=index, by=[*by, "segment"], min_size=min_size).where(F.col("stat") > threshold)
        x = x.join(cp.select(*by, "segment", "split_at"), [*by, "segment"], "left")
        side = F.when(F.col("split_at").isNull(), "").when(F.col(index) <= F.col("split_at"), "L").otherwise("R")
        x = x.withColumn("segment", F.concat("segment", side)).drop("split_at")
    return x


def nca_ceiling(df: DataFrame, *, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Step ceiling c(x) = max y over x' <= x, and its empty-zone effect size."""
    from tidemark.operators.calendar import running_max_step

    step = running_max_step(df, keys=[], x=x, y=y)
    lim = df.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))).scalar()
    # widths need the next distinct x; the steps are one row per distinct x, cut into runs of equal ceiling first
    runs = step.groupBy("ceiling").agg(F.min(x).alias("x_from"))
    w = Window.partitionBy(F.lit(0)).orderBy("x_from")
    z = runs.withColumn("_lim", lim).withColumn("width", F.coalesce(F.lead("x_from").over(w), F.col("_lim.x1")) - F.col("x_from"))
    zone = z.agg(F.sum((F.col("_lim.y1") - F.col("ceiling")) * F.col("width")).alias("zone"), F.first(F.col("_lim")).alias("l"))
    scope = (F.col("l.x1") - F.col("l.x0")) * (F.col("l.y1") - F.col("l.y0"))
    return step, zone.select("zone", scope.alias("scope"), F.when(scope > 0, F.col("zone") / scope).alias("effect"))


def nca_bottleneck(step: DataFrame, *, x: str, levels: list[float]) -> DataFrame:
    """Smallest x whose ceiling reaches each y level."""
    return step.select(F.explode(F.array(*[F.struct(F.lit(float(v)).alias("level"), F.when(F.col("ceiling") >= v, F.col(x)).alias("x")) for v in levels])).alias("e")).groupBy("e.level").agg(F.min("e.x").alias("required"))


def nca_limiting(df: DataFrame, conditions: list[str], *, y: str) -> DataFrame:
    """Condition with the lowest ceiling per row ('tie' when shared) and the headroom below it."""
    out = df
    for c in conditions:
        step, _ = nca_ceiling(df, x=c, y=y)
        out = out.join(step.select(c, F.col("ceiling").alias(f"_c_{c}")), c)
    low = F.least(*[F.col(f"_c_{c}") for c in conditions])
    hits = F.filter(F.array(*[F.when(F.col(f"_c_{c}") == low, c) for c in conditions]), lambda v: v.isNotNull())
    return out.withColumn("limit", F.when(F.size(hits) == 1, F.element_at(hits, 1)).otherwise("tie")).withColumn("headroom", low - F.col(y)).drop(*[f"_c_{c}" for c in conditions])


def kmeans_baseline(df: DataFrame, *, features: str, ks: list[int], seed: int = 7) -> DataFrame:
    """k-means for a short list of k, scored by silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    ev = ClusteringEvaluator(featuresCol=features)
    rows = [(k, float(ev.evaluate(KMeans(k=k, seed=seed, featuresCol=features).fit(df).transform(df)))) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")

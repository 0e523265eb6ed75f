"""Composition operators on a long table (period, part, amount).

Periods are calendar-bounded and the amounts are already summed per (period, part).
Statistics over periods are grouped by part and statistics over parts are grouped by
period, both with map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.linear import solve2, solve3
from tidemark.functions.scalars import ratio
from tidemark.operators.ranks import rank_average
from tidemark.session import cut_lineage

PD, PT = "period", "part"


def close_shares(df: DataFrame, *, period=PD, amount="amount", out="share") -> DataFrame:
    """Amounts -> shares per period; a non-positive amount fails the query."""
    t = df.groupBy(period).agg(F.sum(amount).alias("_t"))
    ok = F.when(F.col(amount) > 0, F.col(amount)).otherwise(F.raise_error(F.lit("shares need strictly positive amounts")).cast("double"))
    return df.join(t, period).withColumn(out, ok / F.col("_t")).drop("_t")


def half_min_zero_fill(df: DataFrame, *, amount="amount") -> DataFrame:
    """Zeros and NULLs become half the smallest positive amount of the table."""
    floor = df.agg(F.min(F.when(F.col(amount) > 0, F.col(amount))) / 2).scalar()
    return df.withColumn(amount, F.when(F.col(amount) > 0, F.col(amount)).otherwise(floor))


def clr(df: DataFrame, *, period=PD, amount="amount", out="clr") -> DataFrame:
    """ln x minus the period mean of ln x."""
    m = df.groupBy(period).agg(F.avg(F.log(amount)).alias("_m"))
    return df.join(m, period).withColumn(out, F.log(amount) - F.col("_m")).drop("_m")


def inv_clr(df: DataFrame, *, period=PD, value="clr", out="share") -> DataFrame:
    m = df.groupBy(period).agg(F.sum(F.exp(value)).alias("_s"))
    return df.join(m, period).withColumn(out, F.exp(value) / F.col("_s")).drop("_s")


def alr(df: DataFrame, *, reference: str, period=PD, part=PT, share="share", out="alr", tiny: float = 1e-4) -> DataFrame:
    """Log ratio to a reference part; zero shares become ``tiny`` and the period is renormalised."""
    z = df.withColumn("_x", F.when(F.col(share) == 0, tiny).otherwise(F.col(share)))
    t = z.groupBy(period).agg(F.sum("_x").alias("_t"), F.max(F.when(F.col(part) == reference, F.col("_x"))).alias("_r"))
    j = z.join(t, period).where(F.col(part) != reference)
    return j.withColumn(out, F.log(F.col("_x") / F.col("_t")) - F.log(F.col("_r") / F.col("_t"))).drop("_x", "_t", "_r")


def part_pair_moments(df: DataFrame, *, value: str, period=PD, part=PT) -> DataFrame:
    """Covariance and variances of every two parts over the periods: the D x D moment table.

    The rows of one period are at most one per part.  They are packed once per period, and
    every pair of the packed row is reduced map-side to running sums per (part, part): what
    is shuffled is the D x D table per task, never a pair per period."""
    packed = df.groupBy(period).agg(F.sort_array(F.collect_list(F.struct(F.col(part).alias("p"), F.col(value).alias("v")))).alias("_a"))
    one = packed.select("_a", F.explode("_a").alias("i"))
    pairs = one.select(F.col("i.p").alias("pi"), F.col("i.v").alias("vi"), F.explode(F.filter("_a", lambda x: x["p"] > F.col("i")["p"])).alias("j"))
    return pairs.groupBy("pi", F.col("j.p").alias("pj")).agg(
        F.covar_samp("vi", F.col("j.v")).alias("cov"),
        F.var_samp("vi").alias("var_i"),
        F.var_samp(F.col("j.v")).alias("var_j"),
        F.var_samp(F.col("vi") - F.col("j.v")).alias("vlr"),
        F.count(F.lit(1)).alias("n"),
    )


def log_ratio_association(df: DataFrame, *, value: str, period=PD, part=PT) -> DataFrame:
    """vlr, phi = vlr / var_i and rho = 2 cov / (var_i + var_j) for every two parts."""
    m = part_pair_moments(df, value=value, period=period, part=part)
    return m.select(
        "pi", "pj", "n", "vlr",
        ratio("vlr", "var_i").alias("phi"),
        ratio(2 * F.col("cov"), F.col("var_i") + F.col("var_j")).alias("rho"),
    )


def residual_on(df: DataFrame, covariates: DataFrame, *, value: str, xs: list[str], by=PT, period=PD, out="resid") -> DataFrame:
    """Residual of each part's series on an intercept and one or two period covariates.

    One pass builds the moments per part; the closed-form solve stays in the plan."""
    j = df.join(covariates.select(period, *xs), period)
    y = F.col(value)
    m = j.groupBy(by).agg(
        F.avg(y).alias("_my"),
        *[F.avg(x).alias(f"_m_{x}") for x in xs],
        *[F.covar_pop(x, value).alias(f"_c_{x}") for x in xs],
        *[F.covar_pop(a, b).alias(f"_g_{a}_{b}") for i, a in enumerate(xs) for b in xs[i:]],
    )
    if len(xs) == 1:
        beta = [ratio(F.col(f"_c_{xs[0]}"), F.col(f"_g_{xs[0]}_{xs[0]}"))]
    else:
        a, b = xs
        beta = solve2(F.col(f"_g_{a}_{a}"), F.col(f"_g_{a}_{b}"), F.col(f"_g_{b}_{b}"), F.col(f"_c_{a}"), F.col(f"_c_{b}"), tol=0.0)
    coef = m.select(by, "_my", *[f"_m_{x}" for x in xs], *[c.alias(f"_b_{x}") for c, x in zip(beta, xs)])
    k = j.join(coef, by)
    fit = F.col("_my")
    for x in xs:
        fit = fit + F.col(f"_b_{x}") * (F.col(x) - F.col(f"_m_{x}"))
    return k.select(*df.columns, (y - fit).alias(out))


def increments(df: DataFrame, *, value: str, by=PT, period=PD, out="inc") -> DataFrame:
    """First difference against the previous calendar period, first period dropped."""
    prev = F.max(value).over(Window.partitionBy(by).orderBy(period).rangeBetween(-1, -1))
    return df.withColumn(out, F.col(value) - prev).where(F.col(out).isNotNull())


def rank_clock(df: DataFrame, *, share="share", period=PD, part=PT) -> DataFrame:
    """Rank of each part by share (1 = largest, ties averaged) in its first and last period, and the share change."""
    r = rank_average(df.withColumn("_neg", -F.col(share)), [period], "_neg", "rank")
    return r.groupBy(part).agg(
        F.min_by("rank", period).alias("first_rank"),
        F.max_by("rank", period).alias("last_rank"),
        (F.max_by(share, period) - F.min_by(share, period)).alias("share_change"),
    )


def turnover(df: DataFrame, *, amount="amount", period=PD, part=PT) -> DataFrame:
    """Appearances, disappearances and total turnover between consecutive periods.

    Presence at t is matched with presence at t - 1 by an equi join."""
    here = df.where(F.col(amount) > 0).select(period, part).distinct()
    lo, hi = here.agg(F.min(period)).scalar(), here.agg(F.max(period)).scalar()
    now = here.select(part, F.col(period), F.lit(1).alias("_now"))
    was = here.select(part, (F.col(period) + 1).alias(period), F.lit(1).alias("_was"))
    j = now.join(was, [period, part], "full_outer").where((F.col(period) > lo) & (F.col(period) <= hi))
    g = j.groupBy(period).agg(
        F.count(F.lit(1)).alias("pool"),
        F.sum((F.col("_was").isNull()).cast("long")).alias("gained"),
        F.sum((F.col("_now").isNull()).cast("long")).alias("lost"),
    )
    return g.select(
        period,
        ratio(F.col("gained") + F.col("lost"), "pool").alias("total"),
        ratio("gained", "pool").alias("appearance"),
        ratio("lost", "pool").alias("disappearance"),
    )


def mean_rank_shift(df: DataFrame, *, share="share", period=PD, part=PT) -> DataFrame:
    """Mean absolute rank change of the parts present in two consecutive periods (ranked within the shared set,
    ties at their smallest rank)."""
    # read for both periods: the same share in each
    a = cut_lineage(df.where(F.col(share) > 0).select(part, period, F.col(share).alias("_a")), "shares")
    b = a.select(part, (F.col(period) + 1).alias(period), F.col("_a").alias("_b"))
    both = a.join(b, [period, part])
    r = rank_average(both, [period], "_a", "_ra", ties="min")
    r = rank_average(r, [period], "_b", "_rb", ties="min")
    return r.groupBy(period).agg(F.avg(F.abs(F.col("_ra") - F.col("_rb"))).alias("mrs"), F.count(F.lit(1)).alias("n_shared"))


def period_distances(df: DataFrame, *, value: str, period=PD, part=PT) -> DataFrame:
    """Euclidean distance of every two periods (their number is bounded by the calendar).

    Each part's series is packed in time order; partial sums of squared gaps per period pair
    are combined map-side."""
    packed = df.groupBy(part).agg(F.sort_array(F.collect_list(F.struct(F.col(period).alias("t"), F.col(value).alias("v")))).alias("_a"))
    one = packed.select("_a", F.explode("_a").alias("i"))
    two = one.select(F.col("i.t").alias("t1"), F.col("i.v").alias("v1"), F.explode(F.filter("_a", lambda x: x["t"] > F.col("i")["t"])).alias("j"))
    gap = F.col("v1") - F.col("j.v")
    return two.groupBy("t1", F.col("j.t").alias("t2")).agg(F.sqrt(F.sum(gap * gap)).alias("dist"))


def rate_change(df: DataFrame, *, value: str, period=PD, part=PT) -> DataFrame:
    """Slope and correlation of community distance on time lag."""
    d = period_distances(df, value=value, period=period, part=part).withColumn("lag", (F.col("t2") - F.col("t1")).cast("double"))
    return d.agg(F.regr_slope("dist", "lag").alias("slope"), F.regr_intercept("dist", "lag").alias("intercept"), F.count(F.lit(1)).alias("n"))


def variance_ratio(df: DataFrame, *, amount="amount", period=PD, part=PT, by: list[str] | None = None) -> DataFrame:
    """Variance of the total over the sum of part variances."""
    k = by or []
    per = df.groupBy(*k, part).agg(F.var_samp(amount).alias("_v"))
    tot = df.groupBy(*k, period).agg(F.sum(amount).alias("_t"))
    a = per.groupBy(*k).agg(F.sum("_v").alias("_sv"))
    b = tot.groupBy(*k).agg(F.var_samp("_t").alias("var_total"))
    j = a.join(b, k) if k else a.select("*", b.select("var_total").scalar().alias("var_total"))
    return j.select(*k, "var_total", F.col("_sv").alias("sum_var"), ratio("var_total", "_sv").alias("vr"))


def synchrony(df: DataFrame, *, amount="amount", period=PD, part=PT) -> DataFrame:
    """Loreau: var(total) / (sum of sd)^2.  Gross: mean correlation of each part with the rest."""
    tot = df.groupBy(period).agg(F.sum(amount).alias("_t"))
    j = df.join(tot, period).withColumn("_rest", F.col("_t") - F.col(amount))
    per = j.groupBy(part).agg(F.stddev_samp(amount).alias("_sd"), F.corr(amount, "_rest").alias("_r"))
    vt = tot.agg(F.var_samp("_t")).scalar()
    return per.agg((vt / (F.sum("_sd") * F.sum("_sd"))).alias("loreau"), F.avg("_r").alias("gross"), F.count(F.lit(1)).alias("n_parts"))


def detrend(df: DataFrame, *, value: str, by: list[str], period=PD, out="resid") -> DataFrame:
    """Residual of a linear trend per group."""
    t = F.col(period).cast("double")
    m = df.groupBy(*by).agg(F.avg(value).alias("_my"), F.avg(t).alias("_mt"), F.regr_slope(F.col(value), t).alias("_b"))
    return df.join(m, by).withColumn(out, F.col(value) - F.col("_my") - F.col("_b") * (t - F.col("_mt"))).drop("_my", "_mt", "_b")


def taylor_law(df: DataFrame, *, amount="amount", period=PD, part=PT, detrended: bool = True) -> DataFrame:
    """Log variance on log mean across parts; the residual flags parts that vary more than their size implies."""
    x = detrend(df, value=amount, by=[part], period=period) if detrended else df.withColumn("resid", F.col(amount))
    per = x.groupBy(part).agg(F.log(F.avg(amount)).alias("lm"), F.log(F.var_samp("resid")).alias("lv"))
    fit = per.agg(F.struct(F.regr_slope("lv", "lm").alias("z"), F.regr_intercept("lv", "lm").alias("a"))).scalar()
    return per.withColumn("_f", fit).select(
        part, F.col("_f.z").alias("z"), F.col("_f.a").alias("a"), (F.col("lv") - F.col("_f.a") - F.col("_f.z") * F.col("lm")).alias("taylor_resid")
    )


def portfolio_effect(df: DataFrame, *, amount="amount", period=PD, part=PT, by: list[str] | None = None) -> DataFrame:
    """Mean-variance and average-CV portfolio effects and the diversification ratio on detrended series."""
    k = by or []
    x = detrend(df, value=amount, by=[*k, part], period=period)
    per = x.groupBy(*k, part).agg(F.avg(amount).alias("m"), F.var_samp("resid").alias("v"))
    tot = detrend(df.groupBy(*k, period).agg(F.sum(amount).alias("_tot")), value="_tot", by=k or [F.lit(0).alias("_all")], period=period) if k else None
    if tot is None:
        t0 = df.groupBy(period).agg(F.sum(amount).alias("_tot")).withColumn("_all", F.lit(0))
        tot = detrend(t0, value="_tot", by=["_all"], period=period)
    kk = k or ["_all"]
    per = per if k else per.withColumn("_all", F.lit(0))
    a = per.groupBy(*kk).agg(
        F.regr_slope(F.log("v"), F.log("m")).alias("z"), F.regr_intercept(F.log("v"), F.log("m")).alias("a"),
        F.avg(F.sqrt("v") / F.col("m")).alias("mean_cv"), F.sum(F.sqrt("v")).alias("sum_sd"),
    )
    b = tot.groupBy(*kk).agg(F.avg("_tot").alias("mt"), F.stddev_samp("resid").alias("st"))
    j = a.join(b, kk)
    cv_t = F.col("st") / F.col("mt")
    out = j.select(
        *kk, "z",
        (F.sqrt(F.exp(F.col("a") + F.col("z") * F.log("mt"))) / F.col("mt") / cv_t).alias("pe_mv"),
        (F.col("mean_cv") / cv_t).alias("pe_cv"),
        (F.col("sum_sd") / F.col("st")).alias("diversification"),
    )
    return out if k else out.drop("_all")


def eppm(df: DataFrame, *, share="share", part=PT) -> DataFrame:
    """Positive part of the share minus the part's mean share."""
    m = df.groupBy(part).agg(F.avg(share).alias("_m"))
    return df.join(m, part).withColumn("eppm", F.greatest(F.lit(0.0), F.col(share) - F.col("_m"))).drop("_m")


def path_metrics(df: DataFrame, *, value: str, by: list[str] | None = None, period=PD, part=PT) -> DataFrame:
    """Length, net displacement, straightness and mean step cosine of a path in coordinate space."""
    k = by or []
    w = Window.partitionBy(*k, part).orderBy(period)
    x = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    x = x.withColumn("_e", F.lag("_d").over(w))
    step = x.groupBy(*k, period).agg(
        F.sqrt(F.sum(F.col("_d") * F.col("_d"))).alias("len"),
        F.sum(F.col("_d") * F.col("_e")).alias("dot"),
        F.sqrt(F.sum(F.col("_e") * F.col("_e"))).alias("plen"),
    )
    ends = df.groupBy(*k, part).agg((F.max_by(value, period) - F.min_by(value, period)).alias("_n"))
    a = step.groupBy(*k).agg(F.sum("len").alias("length"), F.avg(F.try_divide("dot", F.col("len") * F.col("plen"))).alias("step_cosine"))
    b = ends.groupBy(*k).agg(F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("net"))
    j = a.join(b, k) if k else a.select("*", b.select("net").scalar().alias("net"))
    return j.withColumn("straightness", ratio("net", "length"))


def directionality(df: DataFrame, *, value: str, period=PD, part=PT) -> DataFrame:
    """Length-weighted mean of 1 - turn / 180 over all ordered triples of periods.

    Periods are the calendar (tens), so triples are a join of two small distance tables;
    row data is reduced to the distances first."""
    d = period_distances(df, value=value, period=period, part=part)
    ij = d.select(F.col("t1").alias("i"), F.col("t2").alias("j"), F.col("dist").alias("a"))
    jk = d.select(F.col("t1").alias("j"), F.col("t2").alias("k"), F.col("dist").alias("b"))
    ik = d.select(F.col("t1").alias("i"), F.col("t2").alias("k"), F.col("dist").alias("c"))
    t = ij.join(jk, "j").join(ik, ["i", "k"])
    cosj = (F.col("a") * F.col("a") + F.col("b") * F.col("b") - F.col("c") * F.col("c")) / (2 * F.col("a") * F.col("b"))
    turn = 180 - F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosj))))
    w = F.col("a") + F.col("b")
    return t.agg((F.sum(w * (1 - turn / 180)) / F.sum(w)).alias("directionality"), F.count(F.lit(1)).alias("n_triples"))


def increment_split(df: DataFrame, market: DataFrame, *, value: str, x: str, period=PD, part=PT) -> DataFrame:
    """Split each part's path into market-driven and residual steps (regression through the origin), cumulated."""
    w = Window.partitionBy(part).orderBy(period)
    inc = df.withColumn("_dy", F.col(value) - F.lag(value).over(w)).withColumn("_y0", F.first(value).over(w))
    wm = Window.partitionBy(F.lit(0)).orderBy(period)
    m = market.select(period, (F.col(x) - F.lag(x).over(wm)).alias("_dx"))
    j = inc.join(m, period)
    b = j.groupBy(part).agg(ratio(F.sum(F.col("_dx") * F.col("_dy")), F.sum(F.when(F.col("_dy").isNotNull(), F.col("_dx") * F.col("_dx")))).alias("_b"))
    k = j.join(b, part)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    mk = F.coalesce(F.col("_b") * F.col("_dx"), F.lit(0.0))
    rs = F.coalesce(F.col("_dy") - F.col("_b") * F.col("_dx"), F.lit(0.0))
    return k.select(
        period, part,
        (F.col("_y0") + F.sum(mk).over(run)).alias("market_path"),
        (F.col("_y0") + F.sum(rs).over(run)).alias("residual_path"),
    )


def episode_points(df: DataFrame, onsets: dict[str, int], *, pre: int, post: int, value: str, period=PD, part=PT) -> DataFrame:
    """Rows of each episode window with their position 1..n."""
    ep = F.array(*[F.struct(F.lit(n).alias("e"), F.lit(t).alias("t")) for n, t in onsets.items()])
    hit = F.filter(ep, lambda s: F.col(period).between(s["t"] - pre, s["t"] + post))
    return df.select(F.explode(hit).alias("_e"), period, part, F.col(value).alias("v")).select(
        F.col("_e.e").alias("episode"), (F.col(period) - F.col("_e.t") + pre + 1).alias("pos"), part, "v"
    )


def episode_distance(points: DataFrame, *, part=PT) -> DataFrame:
    """Lock-step and symmetrised nearest-state distance of every two episodes, and each one's recovery ratio.

    Episodes are a handful of listed windows of tens of periods."""
    a = points.select(F.col("episode").alias("e1"), F.col("pos").alias("p1"), part, F.col("v").alias("va"))
    b = points.select(F.col("episode").alias("e2"), F.col("pos").alias("p2"), part, F.col("v").alias("vb"))
    g = F.col("va") - F.col("vb")
    st = a.join(b, part).where("e1 <> e2").groupBy("e1", "p1", "e2", "p2").agg(F.sum(g * g).alias("_s"))
    lock = st.where("p1 = p2").groupBy("e1", "e2").agg(F.sqrt(F.sum("_s")).alias("lockstep"))
    near = st.groupBy("e1", "p1", "e2").agg(F.sqrt(F.min("_s")).alias("_m")).groupBy("e1", "e2").agg(F.avg("_m").alias("_d"))
    back = near.select(F.col("e1").alias("e2"), F.col("e2").alias("e1"), F.col("_d").alias("_d2"))
    return near.join(back, ["e1", "e2"]).join(lock, ["e1", "e2"]).where("e1 < e2").select(
        "e1", "e2", "lockstep", ((F.col("_d") + F.col("_d2")) / 2).alias("path_distance")
    )


def episode_recovery(points: DataFrame, *, part=PT) -> DataFrame:
    """Distance from the first state: largest excursion, end distance, ratio."""
    s0 = points.where("pos = 1").select("episode", part, F.col("v").alias("_v0"))
    d = points.join(s0, ["episode", part]).groupBy("episode", "pos").agg(F.sqrt(F.sum((F.col("v") - F.col("_v0")) ** 2)).alias("d"))
    return d.groupBy("episode").agg(F.max("d").alias("max_exc"), F.max_by("d", "pos").alias("end_dist")).withColumn("ratio", ratio("end_dist", "max_exc"))


# ------------------------------------------------------------------ axes and transfer matrices


def ca_axes(df: DataFrame, *, period=PD, part=PT, amount="amount", axes: int = 2) -> tuple[DataFrame, DataFrame, list[float]]:
    """Correspondence analysis: row coordinates, column coordinates, inertia shares."""
    from tidemark.operators.seriation import correspondence_axes

    return correspondence_axes(df, period=period, part=part, amount=amount, axes=axes)


def seriate(rows: DataFrame, *, period=PD, axis="axis1") -> DataFrame:
    """Rank of the rows on the axis; its Spearman correlation with the calendar."""
    a = rank_average(rows.select(period, axis), [], axis, "pos")
    return rank_average(a, [], period, "t")


def simplex_rows(p):
    """Project every row of a matrix on the probability simplex."""
    import numpy as np

    u = -np.sort(-p, axis=1)
    css = np.cumsum(u, axis=1) - 1
    k = np.arange(1, p.shape[1] + 1)
    rho = (u - css / k > 0).sum(axis=1)
    theta = css[np.arange(len(p)), rho - 1] / rho
    return np.maximum(p - theta[:, None], 0)


def transfer_matrix_ls(df: DataFrame, *, period=PD, part=PT, share="share", regime: Column | None = None, iters: int = 20000) -> DataFrame:
    """Row-stochastic share-transfer matrix by constrained least squares, per regime.

    Spark reduces the panel to X'X and X'Y (parts x parts); the projected-gradient solve on
    those small matrices is the driver step."""
    import numpy as np

    spark = df.sparkSession
    g = regime if regime is not None else F.lit("all")
    packed = df.groupBy(period).agg(F.sort_array(F.collect_list(F.struct(F.col(part).alias("p"), F.col(share).alias("v")))).alias("x"))
    nxt = packed.select((F.col(period) - 1).alias(period), F.col("x").alias("y"))
    j = packed.join(nxt, period).withColumn("regime", g)
    base = j.select("regime", "x", "y", F.explode("x").alias("i"))
    xx = base.select("regime", F.col("i.p").alias("a"), F.col("i.v").alias("v"), F.explode("x").alias("j")).groupBy("regime", "a", F.col("j.p").alias("b")).agg(F.sum(F.col("v") * F.col("j.v")).alias("s"))
    xy = base.select("regime", F.col("i.p").alias("a"), F.col("i.v").alias("v"), F.explode("y").alias("j")).groupBy("regime", "a", F.col("j.p").alias("b")).agg(F.sum(F.col("v") * F.col("j.v")).alias("s"))
    moments = xx.withColumn("k", F.lit("xx")).unionByName(xy.withColumn("k", F.lit("xy"))).collect()
    parts = sorted({m["a"] for m in moments})
    at = {p: i for i, p in enumerate(parts)}
    out = []
    for reg in sorted({m["regime"] for m in moments}):
        mat = {k: np.zeros((len(parts), len(parts))) for k in ("xx", "xy")}
        for m in moments:
            if m["regime"] == reg:
                mat[m["k"]][at[m["a"]], at[m["b"]]] = m["s"]
        p, step = np.eye(len(parts)), 1 / np.linalg.eigvalsh(mat["xx"])[-1]
        for _ in range(iters):
            q = simplex_rows(p - step * (mat["xx"] @ p - mat["xy"]))
            if np.abs(q - p).max() < 1e-12:
                p = q
                break
            p = q
        out += [(reg, a, b, float(p[at[a], at[b]])) for a in parts for b in parts]
    return spark.createDataFrame(out, "regime string, source string, target string, p double")


def transfer_summary(matrix: DataFrame, mean_shares: DataFrame, *, part=PT, share="share") -> DataFrame:
    """Retention, half-life in periods and share-weighted migration."""
    keep = matrix.where("source = target").select("regime", F.col("source").alias(part), F.col("p").alias("retention"))
    j = keep.join(mean_shares.select(part, F.col(share).alias("_s")), part)
    return j.select(
        "regime", part, "retention",
        F.when(F.col("retention") < 1 - 1e-12, F.log(F.lit(0.5)) / F.log("retention")).alias("half_life"),
        (F.col("_s") * (1 - F.col("retention"))).alias("migration"),
    )

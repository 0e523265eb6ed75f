"""Scores, matched cases, and panel inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arrays import arr_sum, interp
from tidemark.functions.scalars import normal_cdf, normal_pdf, ratio, two_sided_p
from tidemark.operators.ranks import exact_quantiles, prefix_totals, rank_average
from tidemark.session import cut_lineage


def point_metrics(cases: DataFrame, *, by: list[str], actual="actual", forecast="forecast") -> DataFrame:
    """MAE, RMSE, MAPE (non-zero actuals) and MdAPE per group; the median is exact and distributed."""
    e = F.col(forecast) - F.col(actual)
    ape = F.when(F.col(actual) != 0, F.abs(e) / F.abs(F.col(actual)))
    x = cases.withColumns({"_e": e, "_ape": ape})
    a = x.groupBy(*by).agg(F.count("_e").alias("n"), F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") ** 2)).alias("rmse"), (100 * F.avg("_ape")).alias("mape"), F.count("_ape").alias("n_mape"))
    m = exact_quantiles(x, by, "_ape", [0.5], "_md").select(*by, (100 * F.col("_md")).alias("mdape"))
    return a.join(m, by, "left")


def with_overall(cases: DataFrame, year: Column, out: str = "scope") -> DataFrame:
    """Each case once for its year and once for the whole sample."""
    return cases.withColumn(out, F.explode(F.array(F.lit("all"), year.cast("string"))))


def pinball(q: Column, y: Column, tau: Column) -> Column:
    u = y - q
    return u * (tau - F.when(u < 0, 1.0).otherwise(0.0))


def quantile_crps(df: DataFrame, *, keys: list[str], y: str = "y", q: str = "qv", tau: str = "tau") -> DataFrame:
    """2 x mean pinball over the level grid; at most 99 rows per key."""
    return df.groupBy(*keys).agg((2 * F.avg(pinball(F.col(q), F.col(y), F.col(tau)))).alias("crps"), F.count(F.lit(1)).alias("n_levels"))


def coverage(df: DataFrame, *, keys: list[str], level: float, y: str = "y", q: str = "qv", tau: str = "tau") -> DataFrame:
    """Is y inside the central interval of the level grid."""
    lo, hi = round((1 - level) / 2, 4), round((1 + level) / 2, 4)
    at = lambda t: F.max(F.when(F.abs(F.col(tau) - t) < 1e-9, F.col(q)))
    g = df.groupBy(*keys).agg(F.first(y).alias("_y"), at(lo).alias("_lo"), at(hi).alias("_hi"))
    return g.select(*keys, ((F.col("_y") >= F.col("_lo")) & (F.col("_y") <= F.col("_hi"))).cast("int").alias("covered"))


def pit(obs: DataFrame, curves: DataFrame, *, keys: list[str], on: str, y: str = "y", q: str = "qv", tau: str = "tau") -> DataFrame:
    """Interpolated CDF value, 0 or 1 beyond the grid, the end level on an exact hit.

    ``curves`` has the level grid of each ``on``, a row a level; it is packed to a row a curve, so an observation meets one row
    and is never copied to its levels."""
    a = curves.groupBy(on).agg(F.sort_array(F.collect_list(F.struct(F.col(tau).alias("t"), F.col(q).alias("x")))).alias("_a"))
    a = a.withColumns({"_x": F.col("_a")["x"], "_t": F.col("_a")["t"]})
    keep = F.filter("_a", lambda e, i: (i == 0) | (F.element_at(F.col("_x"), F.greatest(i, F.lit(1))) < e["x"]))
    a = a.withColumn("_k", keep).select(on, F.col("_k")["x"].alias("_kx"), F.col("_k")["t"].alias("_kt"), *[F.element_at(c, k).alias(f"{c}{n}") for c in ("_x", "_t") for k, n in ((1, "lo"), (-1, "hi"))])
    p = (
        F.when(F.col(y) < F.col("_xlo"), 0.0).when(F.col(y) == F.col("_xlo"), F.col("_tlo"))
        .when(F.col(y) > F.col("_xhi"), 1.0).when(F.col(y) == F.col("_xhi"), F.col("_thi"))
        .otherwise(interp(F.col(y), F.col("_kx"), F.col("_kt")))
    )
    return obs.join(cut_lineage(a, "curves"), on).select(*keys, p.alias("pit"))


def energy_score(samples: DataFrame, *, keys: list[str], index: str, dims: list[str], ys: list[str]) -> DataFrame:
    """Mean |X - y| minus half the mean |X - X'| where X' is the next sample (the last pairs with the first)."""
    n = samples.groupBy(*keys).agg(F.max(index).alias("_n"))
    s = samples.join(n, keys)
    # sample i meets sample i - 1, sample 1 meets the last one
    nxt = s.select(*keys, F.when(F.col(index) == F.col("_n"), 1).otherwise(F.col(index) + 1).cast(samples.schema[index].dataType).alias(index), *[F.col(d).alias(f"_p_{d}") for d in dims])
    j = s.join(nxt, [*keys, index])
    d1 = F.sqrt(sum((F.col(d) - F.col(y)) ** 2 for d, y in zip(dims, ys)))
    d2 = F.sqrt(sum((F.col(d) - F.col(f"_p_{d}")) ** 2 for d in dims))
    return j.groupBy(*keys).agg((F.avg(d1) - 0.5 * F.avg(d2)).alias("energy"), F.count(F.lit(1)).alias("n_samples"))


def gaussian_crps(y: Column, mu: Column, sd: Column) -> Column:
    z = (y - mu) / sd
    return sd * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 0.5641895835477563)


def empirical_crps(sample: DataFrame, obs: DataFrame, *, keys: list[str], x: str, y: str) -> DataFrame:
    """Mean over observations of E|X - y| - E|X - X'| / 2 under the empirical law of a sample, per key.

    Sorted-sample identities replace the n x n pairs: both terms follow from running totals
    over the pooled distinct values."""
    zero = F.lit(0).cast("long")
    a = sample.groupBy(*keys, F.col(x).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    a = a.select(*keys, "_v", "_m", (F.col("_m") * F.col("_v")).alias("_mv"), zero.alias("_k"))
    b = obs.groupBy(*keys, F.col(y).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    b = b.select(*keys, "_v", zero.alias("_m"), F.lit(0.0).alias("_mv"), "_k")
    c = prefix_totals(a.unionByName(b), keys, "_v", ["_m", "_mv", "_k"])
    v, m = F.col("_v"), F.col("total__m")
    below_n, below_s = F.col("before__m"), F.col("before__mv")
    above_n = m - below_n - F.col("_m")
    above_s = F.col("total__mv") - below_s - F.col("_mv")
    e1 = v * below_n - below_s + above_s - v * above_n
    # the sum over ordered pairs |x_i - x_j| is twice the sum of n_v (v * below_n - below_s)
    g = c.groupBy(*keys).agg(
        F.sum(F.col("_k") * e1 / m).alias("_e1"), F.sum("_k").alias("n_obs"), F.max(m).alias("_tm"), F.sum(2 * F.col("_m") * (v * below_n - below_s)).alias("_pp"))
    return g.select(*keys, (F.col("_e1") / F.col("n_obs") - F.col("_pp") / (2 * F.col("_tm") * F.col("_tm"))).alias("crps"), "n_obs")


def auc(df: DataFrame, *, label: str, score: str, by: list[str] = []) -> DataFrame:
    """Rank AUC with ties at one half, from the counts per distinct score."""
    x = df.select(*by, F.col(score).cast("double").alias("_v"), (F.col(label) == 1).cast("long").alias("_p"), (F.col(label) == 0).cast("long").alias("_n"))
    c = prefix_totals(x, by, "_v", ["_p", "_n"])
    num = F.sum(F.col("_p") * (F.col("before__n") + 0.5 * F.col("_n")))
    return c.groupBy(*by).agg(F.try_divide(num, (F.max("total__p") * F.max("total__n")).cast("double")).alias("auc"), F.max("total__p").alias("n_pos"), F.max("total__n").alias("n_neg"))


def precision_recall_f1(pred: DataFrame, truth: DataFrame, *, item: str, pred_group: str, true_group: str) -> DataFrame:
    """Overlap of every predicted with every true group that shares an item; best match per true group."""
    p, t = pred.select(item, pred_group).distinct(), truth.select(item, true_group).distinct()
    np_ = p.groupBy(pred_group).agg(F.count(F.lit(1)).alias("_np"))
    nt = t.groupBy(true_group).agg(F.count(F.lit(1)).alias("_nt"))
    o = p.join(t, item).groupBy(pred_group, true_group).agg(F.count(F.lit(1)).alias("hits")).join(np_, pred_group).join(nt, true_group)
    o = o.select(pred_group, true_group, "hits", ratio("hits", "_np").alias("precision"), ratio("hits", "_nt").alias("recall"))
    o = o.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return o.groupBy(true_group).agg(F.max_by(F.struct(pred_group, "hits", "precision", "recall", "f1"), F.struct(F.col("f1"), F.col(pred_group))).alias("b")).select(true_group, "b.*")


def matched_cases(long: DataFrame, *, keys: list[str], method: str, value: str, methods: list[str], actual: str) -> tuple[DataFrame, DataFrame]:
    """Cases where every method and the actual are present, and counts of why the others were dropped."""
    w = long.groupBy(*keys).agg(F.max(actual).alias(actual), *[F.max(F.when(F.col(method) == m, F.col(value))).alias(m) for m in methods])
    miss = [F.col(m).isNull() for m in methods]
    anym = miss[0]
    for c in miss[1:]:
        anym = anym | c
    why = F.when(F.col(actual).isNull(), "no_actual").when(anym, "method_missing").otherwise("matched")
    return w.dropna(subset=[actual, *methods]), w.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def tolerance_match_rate(ref: DataFrame, other: DataFrame, *, run: str, pos: str, tol: int) -> DataFrame:
    """Share of reference positions with a hit within +-tol in each run: positions are spread over the
    tolerance band (a bounded number of copies) and matched by an equi semi-join."""
    band = other.select(run, F.explode(F.sequence(F.col(pos) - tol, F.col(pos) + tol)).alias(pos)).distinct()
    n = ref.select(pos).distinct()
    hit = n.join(band, pos).groupBy(run).agg(F.count(F.lit(1)).alias("n_hit"))
    total = n.agg(F.count(F.lit(1))).scalar()
    return other.select(run).distinct().join(hit, run, "left").select(run, F.coalesce("n_hit", F.lit(0)).alias("n_hit"), (F.coalesce("n_hit", F.lit(0)) / total).alias("rate"))


# ------------------------------------------------------------------ inference


def clustered_dm(df: DataFrame, *, by: list[str], d: str, cluster: str) -> DataFrame:
    """Mean loss difference with a CR1 cluster standard error: two grouped passes."""
    c = df.groupBy(*by, cluster).agg(F.sum(d).alias("_s"), F.count(d).alias("_n"))
    g = c.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("G"), ratio(F.sum("_s"), F.sum("_n")).alias("mean_diff"),
        F.sum(F.col("_s") ** 2).alias("_ss"), F.sum(F.col("_s") * F.col("_n")).alias("_sn"), F.sum(F.col("_n") ** 2).alias("_nn"))
    m = F.col("mean_diff")
    var = F.col("G") / (F.col("G") - 1) * (F.col("_ss") - 2 * m * F.col("_sn") + m * m * F.col("_nn")) / (F.col("n") * F.col("n"))
    se = F.when(F.col("G") >= 2, F.sqrt(F.greatest(var, F.lit(0.0))))
    out = g.withColumn("se", se)
    return out.select(*by, "n", "G", "mean_diff", "se", ratio(m, "se").alias("t_stat"), F.when(m < 0, "first").when(m > 0, "second").otherwise("tie").alias("favoured"))


def student_t_two_sided(t: float, df: int) -> float:
    """Two-sided p of one statistic (regularised incomplete beta by continued fraction): one-row driver step."""
    import math

    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def cf(a, b, x):
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1 / d if abs(d) > 1e-300 else 1e300
        h = d
        for m in range(1, 500):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + k * d
                d = 1 / d if abs(d) > 1e-300 else 1e300
                c = 1 + k / c
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x >= 1:
        return 1.0
    if x < (a + 1) / (a + b + 2):
        return front * cf(a, b, x) / a
    return 1 - front * cf(b, a, 1 - x) / b


def per_period_losses(cases: DataFrame, *, period: str, ref: str, alt: str) -> DataFrame:
    g = cases.groupBy(period).agg(F.avg(ref).alias("s_ref"), F.avg(alt).alias("s_alt"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("dbar", F.col("s_ref") - F.col("s_alt"))


def panel_dm_hac(per: DataFrame, *, period: str, d: str = "dbar", bandwidth: int | None = None) -> DataFrame:
    """Mean difference over periods with a Bartlett long-run variance (default bandwidth floor(sqrt(T))).

    One row per period of the calendar; autocovariances are a lag join of that short series."""
    w = Window.partitionBy(F.lit(0)).orderBy(period)
    mean = per.agg(F.avg(d)).scalar()
    n = per.agg(F.count(d)).scalar()
    x = per.select(F.row_number().over(w).alias("i"), (F.col(d) - mean).alias("u"), n.alias("T"))
    x = x.withColumn("M", F.lit(bandwidth) if bandwidth is not None else F.floor(F.sqrt("T")).cast("int"))
    lagged = x.select(F.col("i"), F.col("u"), "T", "M", F.explode(F.sequence(F.lit(0), F.col("M"))).alias("l"))
    other = x.select((F.col("i")).alias("j"), F.col("u").alias("v"))
    g = lagged.join(other, F.col("i") - F.col("l") == F.col("j")).groupBy("l", "T", "M").agg((F.sum(F.col("u") * F.col("v"))).alias("g"))
    k = F.when(F.col("l") == 0, 1.0).otherwise(2 * (1 - F.col("l") / (F.col("M") + 1)))
    s = g.groupBy("T", "M").agg(F.sum(k * F.col("g") / F.col("T")).alias("omega")).withColumn("mean", mean)
    se = F.sqrt(F.col("omega") / F.col("T"))
    return s.select("T", F.col("M").alias("bandwidth"), "mean", "omega", F.when(F.col("omega") > 0, se).alias("se"), F.when(F.col("omega") > 0, F.col("mean") / se).alias("stat"), F.sqrt((F.col("T") - 1) / F.col("T")).alias("small_sample"))


def periodogram_dm(per: DataFrame, *, period: str, d: str = "dbar", m: int | None = None) -> DataFrame:
    """The same mean with a Daniell-weighted periodogram variance over the first m frequencies."""
    w = Window.partitionBy(F.lit(0)).orderBy(period)
    mean = per.agg(F.avg(d)).scalar()
    n = per.agg(F.count(d)).scalar()
    x = per.select(F.row_number().over(w).alias("i"), (F.col(d) - mean).alias("u"), n.alias("T"))
    x = x.withColumn("m", F.lit(m) if m is not None else F.floor(F.pow("T", F.lit(1 / 3))).cast("int"))
    j = x.select("*", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("j"))
    ang = 2 * F.pi() * F.col("j") * F.col("i") / F.col("T")
    f = j.groupBy("j", "T", "m").agg(F.sum(F.col("u") * F.cos(ang)).alias("c"), F.sum(F.col("u") * F.sin(ang)).alias("s"))
    o = f.groupBy("T", "m").agg(F.avg((F.col("c") ** 2 + F.col("s") ** 2) / F.col("T")).alias("sigma2")).withColumn("mean", mean)
    return o.select("T", "m", "mean", "sigma2", (F.sqrt("T") * F.col("mean") / F.sqrt("sigma2")).alias("stat"), (2 * F.col("m")).alias("df"))


def relative_gain(per: DataFrame) -> DataFrame:
    return per.agg(ratio(F.sum("dbar"), F.sum("s_ref")).alias("gain"), F.count(F.lit(1)).alias("n_periods"), F.avg("s_ref").alias("mean_ref"))


def leave_one_out_gain(cases: DataFrame, *, period: str, unit: str, ref: str, alt: str) -> DataFrame:
    """Gain with each unit dropped: per-period totals minus the unit's own contribution.

    A dropped unit changes only the periods it is in; all other periods come from one total."""
    tot = cases.groupBy(period).agg(F.sum(ref).alias("_r"), F.sum(alt).alias("_a"), F.count(F.lit(1)).alias("_n"))
    own = cases.groupBy(unit, period).agg(F.sum(ref).alias("_or"), F.sum(alt).alias("_oa"), F.count(F.lit(1)).alias("_on"))
    j = own.join(tot, period)
    left = F.col("_n") - F.col("_on")
    new_d = F.when(left > 0, ((F.col("_r") - F.col("_or")) - (F.col("_a") - F.col("_oa"))) / left).otherwise(0.0)
    new_r = F.when(left > 0, (F.col("_r") - F.col("_or")) / left).otherwise(0.0)
    old_d, old_r = (F.col("_r") - F.col("_a")) / F.col("_n"), F.col("_r") / F.col("_n")
    base = tot.agg(F.struct(F.sum((F.col("_r") - F.col("_a")) / F.col("_n")).alias("d"), F.sum(F.col("_r") / F.col("_n")).alias("r"))).scalar()
    g = j.groupBy(unit).agg(F.sum(new_d - old_d).alias("_dd"), F.sum(new_r - old_r).alias("_dr")).withColumn("_b", base)
    return g.select(unit, ratio(F.col("_b.d") + F.col("_dd"), F.col("_b.r") + F.col("_dr")).alias("gain"))


def mean_shift_test(per: DataFrame, *, period: str, breaks: list[int], d: str = "dbar") -> DataFrame:
    """Shift of the mean at each listed break with a Bartlett HAC standard error.

    For a dummy regression the influence of period t on the shift is u_t (D_t / n1 - (1 - D_t) / n0),
    so its long-run variance needs one short series per break."""
    w = Window.partitionBy("brk").orderBy(period)
    x = per.select(period, F.col(d).alias("d"), F.explode(F.array(*[F.lit(b) for b in breaks])).alias("brk"))
    x = x.withColumn("aft", (F.col(period) >= F.col("brk")).cast("double"))
    full = Window.partitionBy("brk")
    x = x.withColumns({"n1": F.sum("aft").over(full), "T": F.count(F.lit(1)).over(full), "m1": F.avg(F.when(F.col("aft") == 1, F.col("d"))).over(full), "m0": F.avg(F.when(F.col("aft") == 0, F.col("d"))).over(full), "i": F.row_number().over(w)})
    x = x.withColumn("n0", F.col("T") - F.col("n1"))
    x = x.withColumn("f", F.when(F.col("aft") == 1, (F.col("d") - F.col("m1")) / F.col("n1")).otherwise(-(F.col("d") - F.col("m0")) / F.col("n0")))
    lag = x.select("brk", "i", "f", "T", "n0", "n1", "m0", "m1", F.explode(F.sequence(F.lit(0), F.floor(F.sqrt("T")).cast("int"))).alias("l"))
    o = x.select(F.col("brk").alias("brk2"), F.col("i").alias("j"), F.col("f").alias("v"))
    p = lag.join(o, (F.col("brk") == F.col("brk2")) & (F.col("i") - F.col("l") == F.col("j")))
    k = F.when(F.col("l") == 0, 1.0).otherwise(2 * (1 - F.col("l") / (F.floor(F.sqrt("T")) + 1)))
    g = p.groupBy("brk", "T", "n0", "n1", "m0", "m1").agg(F.sum(k * F.col("f") * F.col("v")).alias("v"))
    z = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt("v"))
    return g.select("brk", F.col("n0").cast("long").alias("n_before"), F.col("n1").cast("long").alias("n_after"), (F.col("m1") - F.col("m0")).alias("shift"), F.sqrt("v").alias("se"), z.alias("z"), two_sided_p(z).alias("p"))


def fluctuation_path(per: DataFrame, *, period: str, d: str = "dbar", m: int) -> DataFrame:
    """sqrt(m) x rolling mean over m periods, scaled by the full-sample long-run sd."""
    om = panel_dm_hac(per, period=period, d=d).select("omega").scalar()
    w = Window.partitionBy(F.lit(0)).orderBy(period).rowsBetween(-(m - 1), 0)
    x = per.withColumns({"_c": F.count(d).over(w), "_m": F.avg(d).over(w)}).where(F.col("_c") == m)
    return x.select(period, (F.sqrt(F.lit(float(m))) * F.col("_m") / F.sqrt(om)).alias("f"))


def holm(df: DataFrame, *, by: list[str] = [], p: str = "p", out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p; NULL stays NULL but counts in the family size.  A family is a short list of tests."""
    wk = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    x = df.withColumns({"_m": F.count(F.lit(1)).over(wk), "_r": F.row_number().over(wk.orderBy(F.col(p).asc_nulls_last()))})
    adj = F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p))
    x = x.withColumn("_a", adj)
    run = wk.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn(out, F.when(F.col(p).isNotNull(), F.max("_a").over(run))).drop("_m", "_r", "_a")


def bh_fdr(df: DataFrame, *, by: list[str] = [], p: str = "p", out: str = "q") -> DataFrame:
    """Step-up adjusted p: running minimum from the largest p."""
    wk = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    x = df.withColumns({"_n": F.count(p).over(wk), "_r": F.row_number().over(wk.orderBy(F.col(p).asc_nulls_last()))})
    x = x.withColumn("_a", F.col(p) * F.col("_n") / F.col("_r"))
    run = wk.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_a").over(run)))).drop("_n", "_r", "_a")


def correlation_lagged(df: DataFrame, *, by: list[str], time: str, a: str, b: str, lags: list[int], ranks: bool = False) -> DataFrame:
    """Correlation of a(t) with b(t - lag) for a short list of lags, by values or by ranks.

    Rows are copied once per lag and matched by an equi join on time."""
    la = F.explode(F.array(*[F.lit(k) for k in lags]))
    x = df.where(F.col(a).isNotNull()).select(*by, F.col(time).alias("_t"), F.col(a).alias("_a"), la.alias("lag"))
    y = df.where(F.col(b).isNotNull()).select(*by, F.col(time).alias("_u"), F.col(b).alias("_b"), la.alias("lag")).withColumn("_t", F.col("_u") + F.col("lag"))
    j = x.join(y, [*by, "_t", "lag"])
    if ranks:
        j = rank_average(j, [*by, "lag"], "_a", "_ra")
        j = rank_average(j, [*by, "lag"], "_b", "_rb")
        return j.groupBy(*by, "lag").agg(F.corr("_ra", "_rb").alias("r"), F.count(F.lit(1)).alias("n"))
    return j.groupBy(*by, "lag").agg(F.corr("_a", "_b").alias("r"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ populations, settings, rescoring


def ex_ante_set(df: DataFrame, *, value: str, threshold: float, epochs: list[int], window: int, entity="entity", period="q") -> DataFrame:
    """Entities above the threshold in every one of ``window`` periods up to each epoch.

    An entity qualifies at an epoch when its count in the trailing range frame is full."""
    ok = (F.abs(F.col(value)) >= threshold).cast("int")
    ep = F.array(*[F.lit(e) for e in epochs])
    hit = F.filter(ep, lambda e: F.col(period).between(e - window + 1, e))
    x = df.where(F.col(value).isNotNull()).select(entity, ok.alias("_ok"), F.explode(hit).alias("epoch"))
    return x.groupBy("epoch", entity).agg(F.count(F.lit(1)).alias("_n"), F.sum("_ok").alias("_s")).where((F.col("_n") == window) & (F.col("_s") == window)).select("epoch", entity)


def cs_population(df: DataFrame, *, value: str, size: str, min_size: float, min_prior: int = 8, entity="entity", period="q") -> DataFrame:
    """Eligible at an origin: size threshold and at least ``min_prior`` non-missing values through it."""
    w = Window.partitionBy(entity).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("n_prior", F.count(value).over(w)).where((F.col(size) >= min_size) & (F.col("n_prior") >= min_prior)).select(entity, period, "n_prior")


def rescore_frozen_scale(cases: DataFrame, scales: DataFrame, *, score: str, scale: str, entity="entity", origin="origin", out="rescored") -> DataFrame:
    """Scores restated to a scale frozen on an early window; entities without one keep the scale of
    their first scored origin."""
    first = cases.groupBy(entity).agg(F.min_by(scale, origin).alias("_first"))
    j = cases.join(scales.select(entity, F.col(scale).alias("_frozen")), entity, "left").join(first, entity)
    return j.withColumn("used_scale", F.coalesce("_frozen", "_first")).withColumn(out, F.col(score) * F.col(scale) / F.col("used_scale")).drop("_frozen", "_first")


def drop_and_rescore(cases: DataFrame, flags: DataFrame, *, entity="entity", period="target", spill: int = 1, quarters: list[int] = []) -> DataFrame:
    """Remove flagged (entity, period) targets and the next ``spill`` periods, and whole listed periods."""
    bad = flags.select(entity, F.explode(F.sequence(F.col(period), F.col(period) + spill).cast(T.ArrayType(cases.schema[period].dataType))).alias(period)).distinct()
    out = cases.join(bad, [entity, period], "left_anti")
    return out.where(~F.col(period).isin(*quarters)) if quarters else out


def select_settings(cases: DataFrame, *, members: list[str], epoch: str, coverage_min: float = 0.9) -> DataFrame:
    """Per epoch: members with enough coverage, their mean scores on matched cases, the best (lowest
    index on ties) and the trimmed set; an epoch with fewer than two usable members inherits."""
    cov = cases.groupBy(epoch).agg(*[F.avg(F.col(m).isNotNull().cast("double")).alias(f"_c_{m}") for m in members], F.count(F.lit(1)).alias("n_cases"))
    j = cases.join(cov, epoch)
    ok = F.lit(True)
    for m in members:
        ok = ok & ((F.col(f"_c_{m}") < coverage_min) | F.col(m).isNotNull())
    s = j.where(ok).groupBy(epoch).agg(F.max("n_cases").alias("n_cases"), F.count(F.lit(1)).alias("n_matched"), *[F.avg(F.when(F.col(f"_c_{m}") >= coverage_min, F.col(m))).alias(m) for m in members])
    arr = F.filter(F.array(*[F.struct(F.col(m).alias("score"), F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(members)]), lambda e: e["score"].isNotNull())
    s = s.withColumn("_a", F.array_sort(arr))
    usable = F.size("_a") >= 2
    best = F.element_at("_a", 1)
    kept = F.filter("_a", lambda e, i: (e["score"] <= 1.25 * best["score"]) | (i < 2))
    names = F.array_join(F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(e["i"].alias("i"), e["m"].alias("m")))), lambda e: e["m"]), ",")
    w = Window.partitionBy(F.lit(0)).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"_best": F.when(usable, best["m"]), "_trim": F.when(usable, names)})
    return s.select(epoch, "n_cases", "n_matched", F.last("_best", True).over(w).alias("b_star"), F.last("_trim", True).over(w).alias("trimmed"), (~usable).cast("int").alias("inherited"))


def noise_floor_gate(obs: DataFrame, *, kind: str, period: str, value: str, unit: str, levels: list[float], seed: int = 11) -> DataFrame:
    """Next-period W2 against split-half W2 inside a period: medians per kind and their ratio."""
    from tidemark.functions.hashing import draw_int
    from tidemark.operators.distribution import cs_quantile_function, w2sq_grid

    half = draw_int(seed, F.col(kind), F.col(period), F.col(unit)) % 2
    q = cs_quantile_function(obs, keys=[kind, period], value=value, levels=levels)
    nxt = q.withColumn(period, F.col(period) - 1)
    a = w2sq_grid(q, nxt, [kind, period], "w2").withColumn("_which", F.lit("next"))
    h = cs_quantile_function(obs.withColumn("_h", half), keys=[kind, period, "_h"], value=value, levels=levels)
    b = w2sq_grid(h.where("_h = 0"), h.where("_h = 1"), [kind, period], "w2").withColumn("_which", F.lit("split"))
    m = exact_quantiles(a.unionByName(b), [kind, "_which"], "w2", [0.5], "med")
    return m.groupBy(kind).agg(F.max(F.when(F.col("_which") == "next", F.col("med"))).alias("med_next"), F.max(F.when(F.col("_which") == "split", F.col("med"))).alias("med_split")).withColumn("ratio", ratio("med_next", "med_split"))


def secondary_metrics(df: DataFrame, *, entity="entity", period="target", y="y", scale="scale", q05="q05", q50="q50", q95="q95", q25="q25", q75="q75") -> DataFrame:
    """Scaled pinball at 5/50/95, MAE of the median and 50/90% coverage: equal weight per entity within
    a period, then per period."""
    p = lambda c, t: pinball(F.col(c), F.col(y), F.lit(t)) / F.col(scale)
    inside = lambda a, b: F.col(y).between(F.col(a), F.col(b)).cast("double")
    per = df.groupBy(period).agg(
        F.avg(p(q05, 0.05)).alias("pin05"), F.avg(p(q50, 0.5)).alias("pin50"), F.avg(p(q95, 0.95)).alias("pin95"),
        F.avg(F.abs(F.col(y) - F.col(q50)) / F.col(scale)).alias("mae"), F.avg(inside(q25, q75)).alias("cov50"), F.avg(inside(q05, q95)).alias("cov90"), F.count(F.lit(1)).alias("n"))
    return per.agg(*[F.avg(c).alias(c) for c in ("pin05", "pin50", "pin95", "mae", "cov50", "cov90")], F.sum("n").alias("n_cases"))

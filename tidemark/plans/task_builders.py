"""Prediction-task builders: label, cutoff, own (s_) and relational (r_) features per row.

Inputs are plain tables with the column names given in each docstring.  No feature uses a row
that is not public at the cutoff: yearly tables enter through an as-of join on their
availability date, monthly tables through the month strictly before the cutoff.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.periods import april_first_next_year, quarter_end
from tidemark.functions.scalars import clip, ratio
from tidemark.operators.aggregates import filtered_share, hhi, mode_by_value, share_of_total, weighted_mean
from tidemark.operators.calendar import cumcount_age, pct_change_k, rolling_stat
from tidemark.operators.joins import asof_join, asof_join_shifted, cross_join_grid, leave_one_out_peer, month_before_join, period_shift_join
from tidemark.session import cut_lineage


def june_avail(year):
    """Yearly branch tables: 30 June + 120 days."""
    return F.date_add(F.make_date(year, F.lit(6), F.lit(30)), 120)


def branch_features(branch: DataFrame) -> DataFrame:
    """branch(entity, branch, year, state, dep) -> entity x year footprint features."""
    b = branch.groupBy("entity", "year").agg(F.count(F.lit(1)).alias("nbr"), F.count_distinct("state").alias("nst"), F.sum("dep").alias("bdep"))
    b = pct_change_k(pct_change_k(b, value="nbr", period="year"), value="bdep", period="year")
    st = branch.groupBy("state", "year").agg(F.sum("dep").alias("sdep"))
    st = pct_change_k(st, value="sdep", entity="state", period="year").select("state", "year", F.col("sdep_g1").alias("st_g"))
    pre = branch.groupBy("entity", "state", "year").agg(F.sum("dep").alias("dep"))
    foot = pre.join(st, ["state", "year"]).groupBy("entity", "year").agg(weighted_mean("st_g", "dep").alias("foot_st_g"))
    return b.join(foot, ["entity", "year"], "left").withColumn("avail", june_avail(F.col("year")))


def task_deposit_decline(bank: DataFrame, branch: DataFrame, lending: DataFrame, complaints: DataFrame, macro: DataFrame) -> DataFrame:
    """bank(entity, q, dep, asset, holdco), branch(...), lending(entity, year, purpose, n),
    complaints(entity, month, n), macro(date, value).  Label: next quarter's deposits fall."""
    # each reduced input is written once; the features read them several times
    bank, branch, macro = cut_lineage(bank, "bank"), cut_lineage(branch, "branch"), cut_lineage(macro, "macro")
    w = Window.partitionBy("entity").orderBy("q")
    f = pct_change_k(bank, value="dep", ks=[1, 4]).withColumns({"s_dep_g": F.col("dep_g1"), "s_dep_g_l4": F.col("dep_g4")})
    f = f.withColumns({
        "s_dep_g_l1": F.lag("dep_g1", 1).over(w), "s_dep_g_l2": F.lag("dep_g1", 2).over(w),
        "label": F.when(F.lead("dep").over(w).isNotNull(), (F.lead("dep").over(w) < F.col("dep")).cast("double")),
        "cutoff": F.date_add(quarter_end("q"), 45), "s_log_asset": F.log1p("asset"), "s_qtr": F.pmod("q", F.lit(4)) + 1,
    })
    f = leave_one_out_peer(f, by=["q"], value="dep_g1", out="r_peer_dep_g")
    hc = bank.groupBy("holdco", "q").agg(F.count_distinct("entity").alias("r_hc_ncharters"))
    f = f.join(hc, ["holdco", "q"], "left")
    bf = branch_features(branch).select("entity", "avail", F.col("nbr").alias("r_sod_nbr"), F.col("nst").alias("r_sod_nst"), F.col("nbr_g1").alias("r_sod_nbr_g"), F.col("bdep_g1").alias("r_sod_bdep_g"), F.col("foot_st_g").alias("r_sod_foot_st_g"))
    sod = ["r_sod_nbr", "r_sod_nst", "r_sod_nbr_g", "r_sod_bdep_g", "r_sod_foot_st_g"]
    f = asof_join(f, bf, on="cutoff", right_on="avail", cols=sod, by=["entity"], bucket="year")
    ln = filtered_share(lending, by=["entity", "year"], value="n", cond=F.col("purpose").isin("R"), out="refi")
    ln = ln.select("entity", april_first_next_year("year").alias("avail"), F.col("total").alias("r_lend_n"), F.col("refi").alias("r_lend_refi_share"))
    f = asof_join(f, ln, on="cutoff", right_on="avail", cols=["r_lend_n", "r_lend_refi_share"], by=["entity"], bucket="year")
    cm = rolling_stat(complaints.groupBy("entity", "month").agg(F.sum("n").alias("n")), value="n", n=3, stat="sum", min_periods=1, out="r_cmp_3m", period="month")
    f = month_before_join(f, cm, cutoff="cutoff", month="month", keys=["entity"], cols=["r_cmp_3m"])
    f = cut_lineage(f, "features")
    cuts = f.select("cutoff").distinct()
    mc = asof_join_shifted(cuts, macro, on="cutoff", right_on="date", col="value", shift_days=91, out="r_macro_3m", bucket="month").withColumnRenamed("value", "r_macro")
    f = f.join(mc, "cutoff", "left").where("label IS NOT NULL")
    keep = [c for c in f.columns if c.startswith(("s_", "r_"))]
    return f.select(F.concat_ws("_", "entity", "q").alias("row_id"), "entity", "q", "cutoff", "label", *keep)


def task_branch_closure(branch: DataFrame) -> DataFrame:
    """branch(entity, branch, year, state, dep, lat, lon, holdco): closed next year, parent alive, no branch
    of the same parent at the same rounded place."""
    branch = cut_lineage(branch, "branch")
    place = lambda d: d.withColumn("k", F.concat_ws("_", F.round(F.col("lat") * 1000).cast("long"), F.round(F.col("lon") * 1000).cast("long")))
    br = place(branch)
    nxt = br.withColumn("year", F.col("year") - 1)
    alive = nxt.select("entity", "year").distinct()
    df = br.join(alive, ["entity", "year"], "left_semi")
    same = nxt.select("entity", "branch", "year", F.lit(1).alias("_same")).distinct()
    near = nxt.select("entity", "k", "year", F.lit(1).alias("_near")).distinct()
    df = df.join(same, ["entity", "branch", "year"], "left").join(near, ["entity", "k", "year"], "left")
    df = df.withColumn("label", (F.col("_same").isNull() & F.col("_near").isNull()).cast("double")).withColumn("cutoff", june_avail(F.col("year")))
    own = branch.withColumn("_e", F.concat_ws("_", "entity", "branch"))
    own = cumcount_age(pct_change_k(own, value="dep", ks=[1, 2], entity="_e", period="year"), out="s_age_obs", entity="_e", period="year")
    df = df.join(own.select("entity", "branch", "year", F.col("dep_g1").alias("s_dep_g1"), F.col("dep_g2").alias("s_dep_g2"), "s_age_obs"), ["entity", "branch", "year"], "left")
    bk = branch.groupBy("entity", "year").agg(F.count(F.lit(1)).alias("r_bank_nbr"), F.sum("dep").alias("r_bank_dep"))
    bk = pct_change_k(bk, value="r_bank_nbr", period="year")
    df = df.join(bk.withColumnRenamed("r_bank_nbr_g1", "r_bank_nbr_g"), ["entity", "year"], "left")
    prev = df.groupBy("entity", "year").agg(F.avg("label").alias("r_prev_closure_rate")).withColumn("year", F.col("year") + 1)
    df = df.join(prev, ["entity", "year"], "left")
    hc = branch.groupBy("holdco", "year").agg(F.count(F.lit(1)).alias("r_hc_nbr"), F.count_distinct("entity").alias("r_hc_ncert"))
    df = df.join(hc, ["holdco", "year"], "left").withColumn("r_dep_share", ratio("dep", "r_bank_dep"))
    cell = F.concat_ws("_", F.round(F.col("lat") / 5).cast("long"), F.round(F.col("lon") / 5).cast("long"))
    cn = branch.groupBy("year", cell.alias("cell")).agg(F.count(F.lit(1)).alias("_cn"))
    co = branch.groupBy("year", cell.alias("cell"), "entity").agg(F.count(F.lit(1)).alias("_on"))
    df = df.withColumn("cell", cell).join(cn, ["year", "cell"]).join(co, ["year", "cell", "entity"])
    df = df.withColumns({"r_cell_other_n": F.col("_cn") - F.col("_on"), "r_cell_own_n": F.col("_on") - 1, "s_log_dep": F.log1p(clip("dep", 0.0))})
    keep = [c for c in df.columns if c.startswith(("s_", "r_"))]
    return df.select(F.concat_ws("_", "entity", "branch", "year").alias("row_id"), "entity", "branch", "year", "cutoff", "label", *keep)


def task_spike(counts: DataFrame, *, min_volume: int = 60, floor: int = 20) -> DataFrame:
    """counts(company, month, product, n), month an index, of companies with ``min_volume`` in the trailing six
    months: next month at least twice the trailing median and at least ``floor``; own lags and ratios; product mix momentum and concentration."""
    counts = cut_lineage(counts, "counts")
    tot = counts.groupBy("company", "month").agg(F.sum("n").alias("n"))
    g = cross_join_grid(tot, entity="company", period="month", fill={"n": 0})
    w = Window.partitionBy("company").orderBy("month")
    for stat, k, mp, name in (("median", 6, 6, "med6"), ("sum", 6, 6, "vol6"), ("median", 6, 1, "_m6"), ("mean", 12, 1, "_a12"), ("max", 6, 1, "s_max6")):
        g = rolling_stat(g, value="n", n=k, stat=stat, min_periods=mp, out=name, entity="company", period="month")
    g = g.withColumns({f"s_lag{k}": F.lag("n", k).over(w) for k in (1, 2, 3, 6, 12)})
    g = g.withColumns({"s_lag0": F.col("n"), "nxt": F.lead("n").over(w), "s_ratio_med6": F.col("n") / F.greatest(F.col("_m6"), F.lit(1.0)), "s_ratio_mean12": F.col("n") / F.greatest(F.col("_a12"), F.lit(1.0))})
    f = g.where((F.col("vol6") >= min_volume) & F.col("nxt").isNotNull())
    f = f.withColumn("label", ((F.col("nxt") >= 2 * F.greatest(F.col("med6"), F.lit(1.0))) & (F.col("nxt") >= floor)).cast("double"))
    pm = counts.groupBy("company", "month", "product").agg(F.sum("n").alias("n"))
    mk = pct_change_k(counts.groupBy("product", "month").agg(F.sum("n").alias("mkt")), value="mkt", ks=[1, 3], entity="product", period="month")
    sh = share_of_total(pm, by=["company", "month"], value="n", out="w").join(mk, ["product", "month"])
    mix = sh.groupBy("company", "month").agg(F.sum(F.col("w") * F.col("mkt_g1")).alias("r_mix_mkt_g"), F.sum(F.col("w") * F.col("mkt_g3")).alias("r_mix_mkt_g3"))
    h = hhi(pm, by=["company", "month"], item="product", value="n", out="r_prod_hhi").withColumnRenamed("n_items", "r_nprod")
    top = mode_by_value(pm, by=["company", "month"], item="product", weight=F.sum("n"), out="r_top_product").drop("r_top_product_weight")
    allm = pct_change_k(tot.groupBy("month").agg(F.sum("n").alias("r_all_n")).withColumn("_k", F.lit(0)), value="r_all_n", entity="_k", period="month").drop("_k").withColumnRenamed("r_all_n_g1", "r_all_g")
    f = f.join(mix, ["company", "month"], "left").join(h, ["company", "month"], "left").join(top, ["company", "month"], "left").join(allm, "month", "left")
    keep = [c for c in f.columns if c.startswith(("s_", "r_"))]
    return f.select(F.concat_ws("_", "company", "month").alias("row_id"), "company", "month", "label", *keep)


def task_share_drop(lending: DataFrame, purposes: list[str], min_n: int = 50) -> DataFrame:
    """lending(lender, state, year, purpose, n, amount): next share below 75% of this share.

    Previous share and number of states come from the unfiltered table (the stated intent), not
    from the rows that pass the size filter."""
    lending = cut_lineage(lending, "lending")
    a = lending.groupBy("lender", "state", "year").agg(F.sum("n").alias("n"), F.sum("amount").alias("amt"))
    a = share_of_total(a, by=["state", "year"], value="n")
    x = period_shift_join(a, a, keys=["lender", "state"], period="year", k=1, cols={"share": "share_next"})
    x = period_shift_join(x, a, keys=["lender", "state"], period="year", k=-1, cols={"share": "s_share_prev", "n": "s_n_prev"})
    last = lending.agg(F.max("year")).scalar()
    x = x.where((F.col("year") < last) & (F.col("n") >= min_n))
    x = x.withColumns({"label": (F.coalesce("share_next", F.lit(0.0)) < 0.75 * F.col("share")).cast("double"), "cutoff": april_first_next_year("year"), "s_share": F.col("share"), "s_log_n": F.log1p("n"), "s_share_g": ratio("share", "s_share_prev") - 1, "s_avg_amt": ratio("amt", "n")})
    pp = lending.groupBy("lender", "state", "year").pivot("purpose", purposes).agg(F.sum("n")).fillna(0)
    tot = sum((F.col(p) for p in purposes[1:]), F.col(purposes[0]))
    pp = pp.select("lender", "state", "year", *[ratio(F.col(p), tot).alias(f"s_purp_{p.lower()}") for p in purposes])
    nat = a.groupBy("lender", "year").agg(F.count_distinct("state").alias("r_nstates"), F.sum("n").alias("_ln"))
    mk = pct_change_k(lending.groupBy("state", "year").agg(F.sum("n").alias("mkt")), value="mkt", entity="state", period="year").select("state", "year", F.col("mkt_g1").alias("r_mkt_g"))
    x = x.join(pp, ["lender", "state", "year"], "left").join(nat, ["lender", "year"], "left").join(mk, ["state", "year"], "left")
    x = x.withColumns({"r_state_share": ratio("n", "_ln"), "r_log_lender_n": F.log1p("_ln")})
    keep = [c for c in x.columns if c.startswith(("s_", "r_"))]
    return x.select(F.concat_ws("_", "lender", "state", "year").alias("row_id"), "lender", "state", "year", "cutoff", "label", *keep)


def task_growth_regression(hold: DataFrame, min_dep: float) -> DataFrame:
    """hold(holdco, state, year, dep): log growth to next year, clipped to [-1, 1]."""
    h = cut_lineage(hold.groupBy("holdco", "state", "year").agg(F.sum("dep").alias("dep")), "hold")
    x = period_shift_join(h, h, keys=["holdco", "state"], period="year", k=1, cols={"dep": "dep_next"}, how="inner")
    x = x.where((F.col("dep") >= min_dep) & (F.col("dep_next") > 0))
    for k in (1, 2):
        x = period_shift_join(x, h, keys=["holdco", "state"], period="year", k=-k, cols={"dep": f"dep_p{k}"})
    lg = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.log(F.col(a) / F.col(b)))
    x = x.withColumns({"label": clip(lg("dep_next", "dep"), -1, 1), "cutoff": june_avail(F.col("year")), "s_log_dep": F.log("dep"), "s_g1": clip(lg("dep", "dep_p1"), -3, 3), "s_g2": clip(lg("dep_p1", "dep_p2"), -3, 3)})
    hc = h.groupBy("holdco", "year").agg(F.sum("dep").alias("t"), F.count_distinct("state").alias("r_hc_nstates"))
    hc = period_shift_join(hc, hc, keys=["holdco"], period="year", k=-1, cols={"t": "tp"})
    x = x.join(hc.select("holdco", "year", "t", "r_hc_nstates", clip(lg("t", "tp"), -3, 3).alias("r_hc_g"), F.log("t").alias("r_hc_log_tot")), ["holdco", "year"], "left")
    st = h.groupBy("state", "year").agg(F.sum("dep").alias("sd"))
    st = period_shift_join(st, st, keys=["state"], period="year", k=-1, cols={"sd": "sp"})
    x = x.join(st.select("state", "year", lg("sd", "sp").alias("r_state_g")), ["state", "year"], "left").withColumn("r_state_share", ratio("dep", "t"))
    keep = [c for c in x.columns if c.startswith(("s_", "r_"))]
    return x.select(F.concat_ws("_", "holdco", "state", "year").alias("row_id"), "holdco", "state", "year", "cutoff", "label", *keep)


def prepare_panel(panel: DataFrame, *, guard: str, flow: str, listed: DataFrame, last_presample: int, keep: list[str], values: list[str]) -> DataFrame:
    """Reset guard -> listed duplicates out -> pre-sample mask, as one chain of transforms."""
    from tidemark.operators.calendar import ytd_reset_guard
    from tidemark.operators.panel import presample_mask

    return (
        ytd_reset_guard(panel, guard=guard, flows=[flow])
        .join(listed.select("entity", "q"), ["entity", "q"], "left_anti")
        .transform(lambda d: presample_mask(d, values=values, keep=keep, last=last_presample))
    )


def adjusted_target(df: DataFrame, *, value: str, parts: list[str], size: str, min_size: float, first: int, period: str = "q", out: str = "adjusted") -> DataFrame:
    """Flow minus its components for large entities from a given period on."""
    minus = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts), F.lit(0.0))
    return df.withColumn(out, F.when((F.col(size) >= min_size) & (F.col(period) >= first), F.col(value) - minus).otherwise(F.col(value)))


def industry_total_series(df: DataFrame, *, value: str, period: str = "q", min_count: int = 1) -> DataFrame:
    """Aggregate series as one entity on a complete calendar."""
    from tidemark.operators.aggregates import min_count_sum

    t = df.groupBy(period).agg(min_count_sum(value, min_count).alias(value)).withColumn("entity", F.lit("total"))
    return cross_join_grid(t.select("entity", period, value), entity="entity", period=period)


def sensitivity_sweep(cases: DataFrame, variants: dict[str, dict]) -> DataFrame:
    """One frame for all registered variants: each case is copied to the variants that admit it, and the
    gain is grouped by variant.

    A variant may bound the targets (first, last), drop listed targets, or keep one parity of entities."""
    hits = []
    for name, v in variants.items():
        ok = F.lit(True)
        if "first" in v:
            ok = ok & (F.col("target") >= v["first"])
        if "last" in v:
            ok = ok & (F.col("target") <= v["last"])
        if "drop" in v:
            ok = ok & ~F.col("target").isin(*v["drop"])
        if "min_ref" in v:
            ok = ok & (F.col("s_ref") >= v["min_ref"])
        hits.append(F.when(ok, F.lit(name)))
    x = cases.withColumn("variant", F.explode(F.filter(F.array(*hits), lambda n: n.isNotNull())))
    per = x.groupBy("variant", "target").agg(F.avg("s_ref").alias("r"), F.avg("s_alt").alias("a"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("variant").agg(ratio(F.sum(F.col("r") - F.col("a")), F.sum("r")).alias("gain"), F.count(F.lit(1)).alias("n_targets"), F.sum("n").alias("n_cases"))


def outlier_table(cases: DataFrame, names: DataFrame, *, key: str, n: int = 10) -> DataFrame:
    """Largest absolute percentage errors with names: only n rows are joined to the name table."""
    e = cases.where("actual <> 0").withColumn("ape", 100 * F.abs((F.col("forecast") - F.col("actual")) / F.col("actual")))
    top = e.orderBy(F.col("ape").desc(), F.col(key), F.col("target")).limit(n)
    return top.join(names, key, "left")

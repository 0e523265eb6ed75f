"""Section 2.10 queries: walk-forward forecasts of supplier revenue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.periods import quarter_index
from tidemark.operators import composition as K
from tidemark.operators import forecast as M
from tidemark.operators import partition as PT
from tidemark.operators.calendar import lag_at
from tidemark.plans.bindings import BM, CP, SP, SQ, brand_mix, customer_panel, segment_mix, supplier_panel, table
from tidemark.plans.composition import MK, SH, _market
from tidemark.plans.distribution import XS, cross_section
from tidemark.plans.registry import query
from tidemark.plans.relational import sql_cdf
from tidemark.session import cut_lineage

LG = "max(flow) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)"
DESIGN = f"""{SP}, d0 AS (SELECT entity, q, flow AS y, stock, {LG.format(k=1)} AS y1, {LG.format(k=3)} AS y3, {LG.format(k=4)} AS y4,
 max(flow) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS yn, row_number() OVER (PARTITION BY q ORDER BY stock DESC, entity) <= 50 AS sel FROM sp),
d AS (SELECT *, CASE WHEN least(y, y1, y3, y4) > 0 AND y1 IS NOT NULL AND y3 IS NOT NULL AND y4 IS NOT NULL THEN ln(y) - ln(y1) END AS gn, CASE WHEN least(y, y1, y3, y4) > 0 AND y1 IS NOT NULL AND y3 IS NOT NULL AND y4 IS NOT NULL THEN ln(y3) - ln(y4) END AS gs,
 CASE WHEN yn > 0 AND y > 0 THEN ln(yn) - ln(y) END AS gx FROM d0)"""
CASES = f"""{DESIGN}, m AS (SELECT o.q, count(*) AS n, avg(gn) AS ma, avg(gs) AS mb, avg(gx) AS my, var_pop(gn) AS vaa, var_pop(gs) AS vbb, covar_pop(gn, gs) AS vab, covar_pop(gn, gx) AS ca, covar_pop(gs, gx) AS cb
 FROM (SELECT DISTINCT q FROM d) o JOIN (SELECT * FROM d WHERE sel AND gn IS NOT NULL AND gs IS NOT NULL AND gx IS NOT NULL) t ON t.q < o.q GROUP BY o.q),
b AS (SELECT *, (ca * vbb - cb * vab) / (vaa * vbb - vab * vab) AS b1, (vaa * cb - vab * ca) / (vaa * vbb - vab * vab) AS b2 FROM m WHERE n >= 3 AND abs(vaa * vbb - vab * vab) > 0),
cases AS (SELECT entity, d.q AS origin, d.q + 1 AS target, yn AS actual, y AS naive, y3 AS seasonal_naive, CASE WHEN gn IS NOT NULL AND gs IS NOT NULL THEN y * exp(my + b1 * (gn - ma) + b2 * (gs - mb)) ELSE y END AS pooled_ar, (gn IS NULL OR gs IS NULL) AS fb
 FROM d JOIN b USING (q) WHERE sel AND yn IS NOT NULL AND y IS NOT NULL AND y3 IS NOT NULL)"""


def design(s, d):
    """The panel is written once: the design reads it for the lags and for the top-k."""
    return M.design(cut_lineage(supplier_panel(s, d), "panel"), value="flow", size="stock")


def cases(s, d):
    return M.forecast_cases(cut_lineage(design(s, d), "design"))


@query("naive", f"WITH {DESIGN} SELECT entity, q + 1 AS target, y AS naive, yn AS actual FROM d WHERE sel AND yn IS NOT NULL", "naive:4 actual:4")
def _(s, d):
    return design(s, d).where("selected AND y_next IS NOT NULL").select("entity", (F.col("q") + 1).alias("target"), F.col("y").alias("naive"), F.col("y_next").alias("actual"))


@query("seasonal_naive", f"WITH {DESIGN} SELECT entity, q + 1 AS target, y3 AS seasonal_naive, yn AS actual FROM d WHERE sel AND yn IS NOT NULL AND y3 IS NOT NULL", "seasonal_naive:4 actual:4")
def _(s, d):
    return design(s, d).where("selected AND y_next IS NOT NULL AND y_lag3 IS NOT NULL").select("entity", (F.col("q") + 1).alias("target"), F.col("y_lag3").alias("seasonal_naive"), F.col("y_next").alias("actual"))


@query("pooled_ar", f"WITH {CASES} SELECT origin, entity, pooled_ar, CAST(fb AS INT) AS ar_fallback FROM cases", "pooled_ar:3")
def _(s, d):
    return cases(s, d).select("origin", "entity", "pooled_ar", F.col("ar_fallback").cast("int"))


@query("walk_forward", f"WITH {CASES} SELECT entity, origin, target, method, actual, forecast FROM (SELECT entity, origin, target, actual, naive, seasonal_naive, pooled_ar FROM cases) UNPIVOT (forecast FOR method IN (naive, seasonal_naive, pooled_ar))", "actual:4 forecast:3")
def _(s, d):
    return M.melt_methods(cases(s, d))


@query("origin_audit", f"""WITH {DESIGN} SELECT q AS origin, count(*) AS selected, count(*) FILTER (yn IS NULL) AS dropped_target_missing, count(*) FILTER (yn IS NOT NULL AND y3 IS NULL) AS dropped_history, count(*) FILTER (yn IS NOT NULL AND y3 IS NOT NULL) AS evaluated FROM d WHERE sel GROUP BY q""")
def _(s, d):
    return M.origin_audit(design(s, d))


WGRID = [i / 20 for i in range(21)]
WEIGHTS = f"""{CASES}, ls AS (SELECT target, CAST(round(w, 2) AS DOUBLE) AS w, sum(abs(CASE WHEN w = 1 THEN pooled_ar ELSE naive + w * (pooled_ar - naive) END - actual)) AS l, count(*) AS n FROM cases, (SELECT i / 20e0 AS w FROM range(21) t(i)) GROUP BY ALL),
cu AS (SELECT target AS origin, w, sum(l) OVER k AS l, sum(n) OVER k AS n_cases, count(*) OVER k AS n_quarters FROM ls WINDOW k AS (PARTITION BY w ORDER BY target)),
wt AS (SELECT origin, max(n_cases)::BIGINT AS n_cases, max(n_quarters) AS n_quarters, CASE WHEN max(n_quarters) < 8 THEN 5e-1 ELSE arg_min(w, (l, w)) END AS w FROM cu GROUP BY origin)"""


@query("weight_grid_combo", f"WITH {WEIGHTS} SELECT c.entity, c.origin, wt.w, CASE WHEN w = 1 THEN pooled_ar ELSE naive + w * (pooled_ar - naive) END AS combo FROM cases c JOIN wt USING (origin)", "w:3 combo:3")
def _(s, d):
    c = cases(s, d)
    return M.combo_forecasts(c, M.combo_weights(c, grid=WGRID)).select("entity", "origin", "w", "combo")


@query("pseudo_oos_cases", f"WITH {WEIGHTS} SELECT * FROM wt", "w:3")
def _(s, d):
    return M.combo_weights(cases(s, d), grid=WGRID)


@query("multi_horizon", f"""WITH {SP}, h AS (SELECT unnest([1, 2, 3, 4]) AS h) SELECT a.entity, a.q, h.h, a.flow AS naive, b.flow AS actual, c.flow AS seasonal FROM sp a, h JOIN sp b ON b.entity = a.entity AND b.q = a.q + h.h JOIN sp c ON c.entity = a.entity AND c.q = a.q + h.h - 4""", "naive:4 actual:4 seasonal:4")
def _(s, d):
    return M.multi_horizon(supplier_panel(s, d), value="flow", horizons=[1, 2, 3, 4])


@query("share_forecast_baselines", f"""WITH {SH}, x AS (SELECT period, part, clr AS y, lag(clr) OVER w AS x FROM sh WINDOW w AS (PARTITION BY part ORDER BY period)),
r AS (SELECT *, avg(y) OVER k AS mean, count(x) OVER k AS n, regr_slope(y, x) OVER k AS b, regr_intercept(y, x) OVER k AS a FROM x WINDOW k AS (PARTITION BY part ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT period, part, y AS actual, x AS random_walk, mean, a + b * x AS ar1 FROM r WHERE n >= 4""", "actual:8 random_walk:8 mean:8 ar1:6")
def _(s, d):
    return M.share_forecast_baselines(K.clr(brand_mix(s, d)))


@query("climatology_seasonal", f"""WITH {XS}, qs AS (SELECT q, unnest([0.25, 0.5, 0.75])::DOUBLE AS tau, unnest(quantile_cont(r, [0.25, 0.5, 0.75])) AS qv FROM xs WHERE r IS NOT NULL GROUP BY q)
SELECT q, tau, CASE WHEN count(qv) OVER s >= 2 THEN avg(qv) OVER s ELSE avg(qv) OVER a END AS climatology FROM qs
WINDOW s AS (PARTITION BY tau, q % 4 ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY tau ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "tau:2 climatology:8")
def _(s, d):
    from tidemark.operators.distribution import cs_quantile_function

    q = cs_quantile_function(cross_section(s, d), keys=["q"], value="r", levels=[0.25, 0.5, 0.75])
    past = lambda *k: Window.partitionBy(*k).orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    same, any_ = past("tau", F.col("q") % 4), past("tau")
    return q.select("q", "tau", F.when(F.count("qv").over(same) >= 2, F.avg("qv").over(same)).otherwise(F.avg("qv").over(any_)).alias("climatology"))


@query("trailing_best_member", f"""WITH {CASES}, e AS (SELECT target, method, avg(abs(forecast - actual)) / 1e3 AS s FROM (SELECT entity, target, actual, naive, seasonal_naive, pooled_ar FROM cases) UNPIVOT (forecast FOR method IN (naive, seasonal_naive, pooled_ar)) GROUP BY ALL),
tm AS (SELECT target, method, CASE WHEN count(s) OVER w >= 12 THEN avg(s) OVER w END AS m FROM e WINDOW w AS (PARTITION BY method ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT target, arg_min(method, (m, method)) AS best, min(m) AS past_score FROM tm WHERE m IS NOT NULL GROUP BY target""", "past_score:6")
def _(s, d):
    e = M.melt_methods(cases(s, d)).groupBy("target", "method").agg((F.avg(F.abs(F.col("forecast") - F.col("actual"))) / 1e3).alias("s"))
    return M.trailing_best_member(e, period="target", member="method", score="s")


@query("asset_ratio", f"""WITH {CP} SELECT entity, q, 400 * flow / nullif(CASE WHEN p > 0 THEN p END, 0) AS ratio FROM (SELECT *, max(flow) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS p FROM cp)""", "ratio:5")
def _(s, d):
    from tidemark.functions.scalars import ratio

    p = lag_at("flow", 1)
    return customer_panel(s, d).select("entity", "q", ratio(400 * F.col("flow"), F.when(p > 0, p)).alias("ratio"))


LV = [0.05, 0.5, 0.95]


@query("empirical_error_quantiles", f"""WITH {XS}, z AS (SELECT entity, q, r, max(r) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS p FROM xs WHERE r IS NOT NULL),
e AS (SELECT *, r - p AS e, 1e0 + entity % 3 AS sc FROM z), pool AS (SELECT unnest([0.05, 0.5, 0.95])::DOUBLE AS tau, unnest(quantile_cont(e / sc, [0.05, 0.5, 0.95])) AS pq FROM e WHERE e IS NOT NULL),
o AS (SELECT entity, q, r, sc, count(e) OVER w AS n_own, quantile_cont(e, 0.05) OVER w AS a, quantile_cont(e, 0.5) OVER w AS b, quantile_cont(e, 0.95) OVER w AS c FROM e WINDOW w AS (PARTITION BY entity ORDER BY q))
SELECT entity, q, n_own, pool.tau, r + CASE WHEN n_own >= 8 THEN CASE WHEN pool.tau < 0.1 THEN a WHEN pool.tau < 0.6 THEN b ELSE c END ELSE sc * pq END AS qv FROM o, pool""", "tau:2 qv:7")
def _(s, d):
    x = cross_section(s, d)
    x = x.withColumn("e", F.col("r") - lag_at("r", 1)).withColumn("sc", 1.0 + F.col("entity") % 3)
    return M.past_error_quantiles(x, centre="r", error="e", levels=LV, scale="sc")


LV19 = [k / 20 for k in range(1, 20)]
NINETEEN = ", ".join(f"{v:.2f}" for v in LV19)


@query("members_b0_b3", f"""WITH {XS}, x AS (SELECT entity, q, r, row_number() OVER (PARTITION BY entity ORDER BY q) AS j FROM xs WHERE r IS NOT NULL),
sm AS (SELECT a.entity, a.q, sum(b.r * CASE WHEN b.j = 1 THEN pow(0.7e0, a.j - 1) ELSE 0.3e0 * pow(0.7e0, a.j - b.j) END) AS l FROM x a JOIN x b ON a.entity = b.entity AND b.j <= a.j GROUP BY ALL),
y AS (SELECT entity, q, r, l, max(r) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS r3, max(r) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING) AS r4, max(r) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS r1, max(l) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS l1 FROM x JOIN sm USING (entity, q)),
w AS (SELECT entity, q, r, r3, l, count(r) OVER w8 AS c0, quantile_cont(r, [{NINETEEN}]) OVER w8 AS b0, count(r - r4) OVER k AS n1, quantile_cont(r - r4, [{NINETEEN}]) OVER k AS e1, count(r - r1) OVER k AS n2, quantile_cont(r - r1, [{NINETEEN}]) OVER k AS e2, count(r - l1) OVER k AS n3, quantile_cont(r - l1, [{NINETEEN}]) OVER k AS e3 FROM y
 WINDOW k AS (PARTITION BY entity ORDER BY q), w8 AS (PARTITION BY entity ORDER BY q ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
l AS (SELECT unnest(range(1, 20)) AS i)
SELECT entity, q, 'B0' AS member, i / 20e0 AS tau, b0[i] AS qv FROM w, l WHERE c0 = 8 UNION ALL SELECT entity, q, 'B1', i / 20e0, r3 + e1[i] FROM w, l WHERE n1 >= 8 AND r3 IS NOT NULL
 UNION ALL SELECT entity, q, 'B2', i / 20e0, r + e2[i] FROM w, l WHERE n2 >= 8 UNION ALL SELECT entity, q, 'B3', i / 20e0, w.l + e3[i] FROM w, l WHERE n3 >= 8""", "tau:2 qv:7")
def _(s, d):
    x = cross_section(s, d)
    c = M.member_centres(x, value="r")
    out = M.member_b0(x, value="r", levels=LV19).select("entity", "q", F.lit("B0").alias("member"), "tau", "qv")
    for i in (1, 2, 3):
        q = M.past_error_quantiles(c, centre=f"c{i}", error=f"e{i}", levels=LV19)
        out = out.unionByName(q.select("entity", "q", F.lit(f"B{i}").alias("member"), "tau", "qv"))
    return out


@query("member_b4")
def _(s, d):
    return M.member_b4(cross_section(s, d), value="r", levels=LV)


@query("panel_quantile_regression")
def _(s, d):
    x = cross_section(s, d).withColumn("x1", lag_at("r", 1)).withColumn("q1", F.when(F.col("q") % 4 == 0, 1.0).otherwise(0.0))
    b = M.panel_quantile_regression(x, y="r", xs=["x1", "q1"], levels=[0.1, 0.5, 0.9])
    tau = F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), *[F.lit(v).alias(f"b{i}") for i, v in enumerate(c)]) for t, c in b.items()]))
    z = x.where("x1 IS NOT NULL").select("entity", "q", "x1", "q1", tau.alias("e"))
    return z.select("entity", "q", "e.tau", (F.col("e.b0") + F.col("e.b1") * F.col("x1") + F.col("e.b2") * F.col("q1")).alias("qv"))


@query("ridge_gcv")
def _(s, d):
    x = cross_section(s, d).withColumns({"x1": lag_at("r", 1), "x2": lag_at("r", 2), "x4": lag_at("r", 4)}).dropna()
    lam, b = M.ridge_gcv(x, y="r", xs=["x1", "x2", "x4"], lambdas=[0.01, 0.1, 1.0, 10.0, 100.0, 1000.0])
    fit = sum((F.lit(v) * F.col(k) for k, v in b.items()), F.lit(0.0))
    return x.select("entity", "q", fit.alias("score"), F.lit(lam).alias("penalty"))


@query("eb_panel_moments")
def _(s, d):
    return M.eb_panel_moments(cross_section(s, d), value="r")[1]


@query("eb_panel_fits")
def _(s, d):
    return M.eb_panel_moments(cross_section(s, d), value="r")[0]


@query("linear_baselines", f"""WITH {XS}, z AS (SELECT entity, q, r, max(r) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS p FROM xs WHERE r IS NOT NULL), a AS (SELECT regr_slope(r, p) AS s, regr_intercept(r, p) AS i FROM z), f AS (SELECT z.*, a.i + a.s * p AS fit FROM z, a),
sg AS (SELECT sqrt(sum((r - fit) * (r - fit)) / (count(fit) - 2)) AS sigma FROM f), tr AS (SELECT entity, regr_slope(r, q) AS trend FROM xs WHERE r IS NOT NULL GROUP BY entity)
SELECT entity, q, fit, fit + 1645e-3 * sigma AS upper, trend FROM f JOIN tr USING (entity), sg WHERE p IS NOT NULL""", "fit:7 upper:7 trend:8")
def _(s, d):
    x = cross_section(s, d).withColumn("p", lag_at("r", 1))
    f = M.ols_predict(x.where("p IS NOT NULL").withColumn("t", F.lit(True)), y="r", xs=["p"], train="t")
    sig = f.agg(F.sqrt(F.sum((F.col("r") - F.col("fit")) ** 2) / (F.count(F.lit(1)) - 2))).scalar()
    tr = x.groupBy("entity").agg(F.regr_slope("r", F.col("q").cast("double")).alias("trend"))
    return f.join(tr, "entity").select("entity", "q", "fit", (F.col("fit") + 1.645 * sig).alias("upper"), "trend")


@query("ridge_on_clr")
def _(s, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    parts = [r[0] for r in table(s, d, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # the fixed segment list
    wide = K.clr(segment_mix(s, d)).groupBy("period").pivot("part", parts).agg(F.max("clr"))
    v = VectorAssembler(inputCols=parts, outputCol="x").transform(wide).withColumn("y", F.col("period") / 4.0)
    m = LinearRegression(featuresCol="x", labelCol="y", regParam=0.1, elasticNetParam=0.0).fit(v)
    return m.transform(v).select("period", "y", F.col("prediction").alias("fit"))


def _effects(s, d):
    """Group = nation, x = mean order value per customer (in units of 100k), s = its standard error."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg(F.col("o_totalprice") / 1e5).alias("x"), (F.stddev_samp(F.col("o_totalprice") / 1e5) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return o.where("se > 0").join(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("grp")), "c_custkey")


EFF = """ef AS (SELECT c_custkey, c_nationkey AS grp, avg(o_totalprice / 1e5) AS x, stddev_samp(o_totalprice / 1e5) / sqrt(count(*)) AS se FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING stddev_samp(o_totalprice) > 0)"""


@query("eb_shrink_normal", f"""WITH {EFF}, c AS (SELECT *, CASE WHEN count(*) OVER g >= 3 THEN avg(x) OVER g ELSE avg(x) OVER () END AS m FROM ef WINDOW g AS (PARTITION BY grp)), t AS (SELECT greatest(avg((x - m) * (x - m) - se * se), 0e0) AS t2 FROM c),
p AS (SELECT c_custkey, m + t2 / (t2 + se * se) * (x - m) AS post_mean, sqrt(t2 / (t2 + se * se)) * se AS post_sd FROM c, t) SELECT c_custkey, post_mean, post_sd, coalesce(1 - {sql_cdf('z')}, 1e0) AS lfsr FROM (SELECT *, abs(post_mean / nullif(post_sd, 0)) AS z FROM p)""", "post_mean post_sd lfsr:7")
def _(s, d):
    return M.eb_shrink_normal(_effects(s, d), x="x", s="se", group="grp").select("c_custkey", "post_mean", "post_sd", "lfsr")


@query("eb_shrink_mixture")
def _(s, d):
    e = _effects(s, d)
    mu = e.agg(F.avg("x")).scalar()
    _, out = M.eb_shrink_mixture(e.withColumn("x", F.col("x") - mu), x="x", s="se", grid=[0.0, 0.05, 0.1, 0.2, 0.4, 0.8])
    return out.select("c_custkey", "post_mean", "lfsr")


@query("noise_sd_estimate", """WITH g0 AS (SELECT o_custkey AS e, c_nationkey AS grp, count(*) AS k, var_samp(o_totalprice / 1e5) AS s2 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), p AS (SELECT grp, median(s2) AS gm FROM g0 WHERE k >= 3 AND s2 IS NOT NULL GROUP BY grp), a AS (SELECT median(s2) AS m FROM g0 WHERE k >= 3)
SELECT e, g0.grp, k, sqrt((greatest(k - 1, 0) * coalesce(s2, 0) + 4 * coalesce(gm, m)) / (greatest(k - 1, 0) + 4)) AS sigma FROM g0 LEFT JOIN p USING (grp), a""", "sigma:7")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("e"), (F.col("o_totalprice") / 1e5).alias("gap"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("e"), F.col("c_nationkey").alias("grp"))
    return M.noise_sd_estimate(o.join(c, "e"), entity="e", group="grp", gap="gap")


@query("local_level_decompose", f"""WITH {SH}, {MK}, a AS (SELECT part, period, clr AS v, x1 AS x FROM sh JOIN mk USING (period)), m AS (SELECT part, avg(v) AS my, avg(x) AS mx, covar_pop(x, v) / var_pop(x) AS b FROM a GROUP BY part),
z AS (SELECT part, period, b * (x - mx) AS market, v - my - b * (x - mx) AS z, row_number() OVER (PARTITION BY part ORDER BY period) AS j FROM a JOIN m USING (part)), g AS (SELECT unnest([1e-1, 3e-1, 5e-1, 7e-1, 9e-1]) AS gain),
l AS (SELECT c.part, c.period, c.j, gain, c.market, c.z, sum(p.z * CASE WHEN p.j = 1 THEN pow(1 - gain, c.j - 1) ELSE gain * pow(1 - gain, c.j - p.j) END) AS sticky FROM z c JOIN z p ON p.part = c.part AND p.j <= c.j, g GROUP BY ALL),
e AS (SELECT *, z - lag(sticky) OVER (PARTITION BY part, gain ORDER BY j) AS e FROM l), s AS (SELECT part, gain, sum(e * e) AS sse FROM e GROUP BY ALL), b AS (SELECT part, arg_min(gain, (sse, gain)) AS gain FROM s GROUP BY part)
SELECT part, period, gain, market, sticky, z - sticky AS transient FROM l JOIN b USING (part, gain)""", "gain:3 market:7 sticky:7 transient:7")
def _(s, d):
    mix = brand_mix(s, d)
    x = K.clr(mix).join(_market(mix).select("period", "x1"), "period")
    return M.local_level_decompose(x, value="clr", x="x1", gains=[0.1, 0.3, 0.5, 0.7, 0.9])


@query("split_screen", """WITH l AS (SELECT o_totalprice / 1e5 AS y, c_acctbal AS a, year(o_orderdate)::DOUBLE AS b, month(o_orderdate)::DOUBLE AS c FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'acctbal' AS feature, corr(y, a) AS r, count(*) AS n FROM l UNION ALL SELECT 'year', corr(y, b), count(*) FROM l UNION ALL SELECT 'month', corr(y, c), count(*) FROM l""", "r:9")
def _(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("acctbal")), "o_custkey")
    o = o.select((F.col("o_totalprice") / 1e5).alias("y"), "acctbal", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return M.split_screen(o, y="y", xs=["acctbal", "year", "month"]).select("feature", "r", "n")


@query("split_screen_threshold", """WITH l AS (SELECT l_quantity AS x, l_extendedprice / 1e5 AS y FROM lineitem), c AS (SELECT x, sum(count(*)) OVER (ORDER BY x) AS nl, sum(sum(y)) OVER (ORDER BY x) AS sl FROM l GROUP BY x), t AS (SELECT count(*) AS n, sum(y) AS s FROM l),
g AS (SELECT x AS cut, nl::BIGINT AS n_left, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM c, t WHERE nl >= 24 AND n - nl >= 24) SELECT * FROM g ORDER BY gain DESC, cut LIMIT 1""", "cut:0 gain:6")
def _(s, d):
    l = table(s, d, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1e5).alias("y"))
    return M.best_threshold(l, y="y", x="l_quantity")


@query("split_screen_segments", "SELECT l_returnflag || l_linestatus AS seg, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, count(*) AS n FROM lineitem GROUP BY 1", "slope:4 intercept:3")
def _(s, d):
    l = table(s, d, "lineitem").withColumn("seg", F.concat("l_returnflag", "l_linestatus"))
    return M.segment_coefficients(l, segment="seg", y="l_extendedprice", x="l_quantity")


@query("cusum_changepoint", f"""WITH {SP}, x AS (SELECT entity, q, ln(flow) AS v FROM sp WHERE flow > 0), c AS (SELECT *, count(v) OVER w AS i, sum(v) OVER w AS s, count(v) OVER (PARTITION BY entity) AS n, sum(v) OVER (PARTITION BY entity) AS t FROM x WINDOW w AS (PARTITION BY entity ORDER BY q)),
k AS (SELECT *, abs(s - i * t / n) * sqrt(n / (i * (n - i))::DOUBLE) AS st FROM c WHERE i >= 5 AND n - i >= 5) SELECT entity, arg_max(q, (st, -i)) AS split_at, max(st) AS stat FROM k GROUP BY entity""", "stat:7")
def _(s, d):
    x = supplier_panel(s, d).where("flow > 0").select("entity", "q", F.log("flow").alias("v"))
    return M.cusum_changepoint(x, value="v", index="q", by=["entity"])


def _tree_sql(xs: list[str], depth: int, alpha: float, bucket: int) -> str:
    """The levels of the tree as plain SQL over ``l0`` (y, candidates): tests, the strongest candidate, its best cut, children."""
    from statistics import NormalDist

    crit = NormalDist().inv_cdf(1 - alpha / (2 * len(xs)))
    parts, rows = [], []
    for k in range(depth):
        tests = " UNION ALL ".join(f"SELECT node, '{x}' AS feature, count(*) AS n, avg(y) AS mean, CASE WHEN var_pop(y) > 0 AND var_pop({x}) > 0 THEN corr(y, {x}) END AS r FROM l{k} GROUP BY node" for x in xs)
        value = "CASE feature " + " ".join(f"WHEN '{x}' THEN {x}" for x in xs) + " END"
        parts.append(f"""b{k} AS (SELECT node, n, mean, feature FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, row_number() OVER (PARTITION BY node ORDER BY abs(r) DESC NULLS LAST) AS k FROM ({tests})) WHERE k = 1 AND abs(t) > {crit!r} AND n >= {2 * bucket}),
v{k} AS (SELECT node, v, count(*) AS n, sum(y) AS s FROM (SELECT l{k}.node, y, {value} AS v FROM l{k} JOIN b{k} USING (node)) GROUP BY ALL),
w{k} AS (SELECT node, v, sum(n) OVER a AS nl, sum(s) OVER a AS sl, sum(n) OVER (PARTITION BY node) AS n, sum(s) OVER (PARTITION BY node) AS s FROM v{k} WINDOW a AS (PARTITION BY node ORDER BY v)),
c{k} AS (SELECT node, arg_max(v, g) AS cut, max(g) AS gain FROM (SELECT node, v, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS g FROM w{k} WHERE nl >= {bucket} AND n - nl >= {bucket}) GROUP BY node),
l{k + 1} AS (SELECT y, {', '.join(xs)}, CASE WHEN cut IS NULL THEN node ELSE 2 * node + ({value} > cut)::INT END AS node FROM l{k} LEFT JOIN b{k} USING (node) LEFT JOIN c{k} USING (node))""")
        rows.append(f"SELECT node, n, mean, feature, cut, gain FROM b{k} JOIN c{k} USING (node)")
    rows.append(f"SELECT node, count(*), avg(y), NULL, NULL, NULL FROM l{depth} GROUP BY node")
    return ", ".join(parts) + " " + " UNION ALL ".join(rows)


TREE = ["stock", "lines", "quarter", "entity"]


@query("partition_tree", f"WITH {SP}, l0 AS (SELECT flow / 1e4 AS y, stock * 1e0 AS stock, n * 1e0 AS lines, q * 1e0 AS quarter, entity * 1e0 AS entity, 1 AS node FROM sp), {_tree_sql(TREE, 4, 0.001, 60)}", "mean:6 cut:6 gain:3")
def _(s, d):
    as_double = lambda c, name: F.col(c).cast("double").alias(name)
    x = supplier_panel(s, d).select((F.col("flow") / 1e4).alias("y"), as_double("stock", "stock"), as_double("n", "lines"), as_double("q", "quarter"), as_double("entity", "entity"))
    return PT.association_tree(x, y="y", xs=TREE, depth=4, alpha=0.001, min_bucket=60)[1].select("node", "n", "mean", "feature", "cut", "gain")


@query("sparse_changepoint")
def _(s, d):
    """The quarter in which few suppliers' log flows change together, with every supplier's loading."""
    x = supplier_panel(s, d).where("flow > 0").select("entity", "q", F.log("flow").alias("v"))
    got, loadings = PT.sparse_changepoint(x, series="entity", index="q", value="v")
    return loadings.withColumns({"split_at": F.lit(got["split_at"]).cast("long"), "stat": F.lit(got["stat"])})


def _segments_sql(depth: int, threshold: float) -> str:
    """Levels of splits over ``g0`` (entity, q, v, segment)."""
    parts = []
    for k in range(depth):
        parts.append(f"""c{k} AS (SELECT *, count(v) OVER w AS i, sum(v) OVER w AS s, count(v) OVER (PARTITION BY entity, segment) AS n, sum(v) OVER (PARTITION BY entity, segment) AS t FROM g{k} WINDOW w AS (PARTITION BY entity, segment ORDER BY q)),
k{k} AS (SELECT entity, segment, arg_max(q, (st, -i)) AS cut FROM (SELECT *, abs(s - i * t / n) * sqrt(n / (i * (n - i))::DOUBLE) AS st FROM c{k} WHERE i >= 5 AND n - i >= 5) GROUP BY ALL HAVING max(st) > {threshold}),
g{k + 1} AS (SELECT entity, q, v, segment || CASE WHEN cut IS NULL THEN '' WHEN q <= cut THEN 'L' ELSE 'R' END AS segment FROM g{k} LEFT JOIN k{k} USING (entity, segment))""")
    return ", ".join(parts)


@query("binary_segmentation", f"WITH {SP}, g0 AS (SELECT entity, q, ln(flow) AS v, '0' AS segment FROM sp WHERE flow > 0), {_segments_sql(2, 1.0)} SELECT entity, segment, count(*) AS n, min(q) AS from_q, max(q) AS to_q FROM g2 GROUP BY ALL")
def _(s, d):
    x = supplier_panel(s, d).where("flow > 0").select("entity", "q", F.log("flow").alias("v"))
    return M.binary_segmentation(x, value="v", index="q", by=["entity"], threshold=1.0, depth=2).groupBy("entity", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("q").alias("from_q"), F.max("q").alias("to_q"))


STEP = """st AS (SELECT l_quantity AS x, max(max(l_extendedprice)) OVER (ORDER BY l_quantity) AS c FROM lineitem GROUP BY 1), lm AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem)"""


@query("nca_ceiling", f"""WITH {STEP}, z AS (SELECT sum((y1 - c) * (coalesce(nx, x1) - x)) AS zone FROM (SELECT *, lead(x) OVER (ORDER BY x) AS nx FROM st), lm) SELECT zone, (x1 - x0) * (y1 - y0) AS scope, zone / ((x1 - x0) * (y1 - y0)) AS effect FROM z, lm""", "zone:2 scope:2 effect:8")
def _(s, d):
    return M.nca_ceiling(table(s, d, "lineitem"), x="l_quantity", y="l_extendedprice")[1]


@query("nca_bottleneck", f"WITH {STEP} SELECT v.level, min(CASE WHEN c >= v.level THEN x END) AS required FROM st, (SELECT unnest([2e4, 5e4, 8e4]) AS level) v GROUP BY ALL", "level:0 required:0")
def _(s, d):
    step, _ = M.nca_ceiling(table(s, d, "lineitem"), x="l_quantity", y="l_extendedprice")
    return M.nca_bottleneck(step, x="l_quantity", levels=[2e4, 5e4, 8e4])


@query("nca_limiting", """WITH a AS (SELECT l_quantity AS x, max(max(l_extendedprice)) OVER (ORDER BY l_quantity) AS c FROM lineitem GROUP BY 1), b AS (SELECT l_tax AS x, max(max(l_extendedprice)) OVER (ORDER BY l_tax) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a.c = b.c THEN 'tie' WHEN a.c < b.c THEN 'l_quantity' ELSE 'l_tax' END AS lim, least(a.c, b.c) - l_extendedprice AS headroom FROM lineitem JOIN a ON l_quantity = a.x JOIN b ON l_tax = b.x""", "headroom:3")
def _(s, d):
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_extendedprice")
    return M.nca_limiting(l, ["l_quantity", "l_tax"], y="l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", F.col("limit").alias("lim"), "headroom")


@query("kmeans_baseline")
def _(s, d):
    from pyspark.ml.functions import array_to_vector

    e = table(s, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return M.kmeans_baseline(e, features="v", ks=[2, 4, 8])


@query("profile_assign", f"""WITH {SP}, m AS (SELECT entity, (q % 4) AS k, avg(ln(flow)) AS v FROM sp GROUP BY ALL), b AS (SELECT entity, k, v - max(CASE WHEN k = 0 THEN v END) OVER (PARTITION BY entity) AS v FROM m),
pr(p, k, x) AS (VALUES ('up', 0, 0e0), ('up', 1, 1e0), ('up', 2, 2e0), ('up', 3, 3e0), ('down', 0, 0e0), ('down', 1, -1e0), ('down', 2, -2e0), ('down', 3, -3e0), ('hump', 0, 0e0), ('hump', 1, 1e0), ('hump', 2, 1e0), ('hump', 3, 0e0), ('dip', 0, 0e0), ('dip', 1, -1e0), ('dip', 2, -1e0), ('dip', 3, 0e0)),
c AS (SELECT entity, p, corr(v, x) AS r FROM b JOIN pr USING (k) GROUP BY ALL), t AS (SELECT *, r >= max(r) OVER (PARTITION BY entity) - 1e-9 AS w FROM c) SELECT p AS profile, sum(1e0 / n) AS assigned FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM t WHERE w) GROUP BY p""", "assigned:6")
def _(s, d):
    from tidemark.operators.similarity import profile_assign

    m = supplier_panel(s, d).groupBy("entity", (F.col("q") % 4).alias("k")).agg(F.avg(F.log("flow")).alias("v"))
    return profile_assign(m, PROFILES, entity="entity", index="k", value="v")


PROFILES = {"up": [0.0, 1.0, 2.0, 3.0], "down": [0.0, -1.0, -2.0, -3.0], "hump": [0.0, 1.0, 1.0, 0.0], "dip": [0.0, -1.0, -1.0, 0.0]}


@query("profile_significance", f"""WITH {SP}, m AS (SELECT entity, (q % 4) AS k, avg(ln(flow)) AS v FROM sp GROUP BY ALL), f AS (SELECT * FROM m WHERE entity IN (SELECT entity FROM m GROUP BY entity HAVING count(v) = 4)),
pm AS (SELECT a.i * 64 + b.i * 16 + c.i * 4 + d.i AS pid, [a.i, b.i, c.i, d.i] AS o FROM range(4) a(i), range(4) b(i), range(4) c(i), range(4) d(i) WHERE len(list_distinct([a.i, b.i, c.i, d.i])) = 4),
x AS (SELECT entity, pid, t.k, v FROM pm, range(4) t(k) JOIN f ON f.k = pm.o[t.k + 1]),
pr(p, k, x) AS (VALUES ('up', 0, 0e0), ('up', 1, 1e0), ('up', 2, 2e0), ('up', 3, 3e0), ('down', 0, 0e0), ('down', 1, -1e0), ('down', 2, -2e0), ('down', 3, -3e0), ('hump', 0, 0e0), ('hump', 1, 1e0), ('hump', 2, 1e0), ('hump', 3, 0e0), ('dip', 0, 0e0), ('dip', 1, -1e0), ('dip', 2, -1e0), ('dip', 3, 0e0)),
c AS (SELECT entity, pid, p, corr(v, pr.x) AS r FROM x JOIN pr USING (k) GROUP BY ALL), t AS (SELECT *, r >= max(r) OVER (PARTITION BY entity, pid) - 1e-9 AS w FROM c),
w AS (SELECT entity, pid, p, 1e0 / count(*) OVER (PARTITION BY entity, pid) AS w FROM t WHERE w),
g AS (SELECT p AS profile, coalesce(sum(w) FILTER (pid = 27), 0) AS assigned, sum(w) / 24 AS expected, (SELECT count(DISTINCT entity) FROM f) AS n FROM w GROUP BY p)
SELECT profile, assigned, expected, CASE WHEN ceil(assigned - 1e-9) <= 0 THEN 1e0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(expected / n) + (n - i) * ln(1 - expected / n)))
 FROM (SELECT unnest(range((SELECT max(n) + 1 FROM g))) AS i) WHERE i >= ceil(assigned - 1e-9) AND i <= n) END AS p_upper FROM g""", "assigned:6 expected:6 p_upper:6")
def _(s, d):
    from tidemark.operators.similarity import profile_significance

    m = supplier_panel(s, d).groupBy("entity", (F.col("q") % 4).alias("k")).agg(F.avg(F.log("flow")).alias("v"))
    return profile_significance(m, PROFILES, entity="entity", index="k", value="v")

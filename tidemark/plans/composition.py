"""Section 2.8 queries: brand and segment composition by ship quarter."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.periods import quarter_index
from tidemark.operators import composition as K
from tidemark.operators import seriation as SE
from tidemark.operators.calendar import standardise
from tidemark.plans.bindings import BM, SM, SP, SQ, brand_mix, segment_mix, supplier_panel, table
from tidemark.plans.registry import query

SH = f"""{BM}, sh AS (SELECT period, part, amount, amount / sum(amount) OVER (PARTITION BY period) AS share,
 ln(amount) - avg(ln(amount)) OVER (PARTITION BY period) AS clr FROM bm)"""
SSH = f"""{SM}, sh AS (SELECT period, part, amount, amount / sum(amount) OVER (PARTITION BY period) AS share,
 ln(amount) - avg(ln(amount)) OVER (PARTITION BY period) AS clr FROM sm)"""
MK = """mk AS (SELECT period, avg(CASE WHEN part < 'Brand#3' THEN ln(amount) END) AS x1, stddev_samp(ln(amount)) AS x2 FROM bm GROUP BY period)"""


def _market(mix):
    return mix.groupBy("period").agg(F.avg(F.when(F.col("part") < "Brand#3", F.log("amount"))).alias("x1"), F.stddev_samp(F.log("amount")).alias("x2"))


def _clr(s, d):
    return K.clr(K.close_shares(brand_mix(s, d)))


def _seg(s, d):
    return K.clr(K.close_shares(segment_mix(s, d)))


@query("close_shares", f"WITH {SH} SELECT period, part, share FROM sh", "share:9")
def _(s, d):
    return K.close_shares(brand_mix(s, d)).drop("amount")


@query("clr", f"WITH {SH} SELECT period, part, clr FROM sh", "clr:9")
def _(s, d):
    return K.clr(brand_mix(s, d)).drop("amount")


@query("inv_clr", f"WITH {SH} SELECT period, part, share FROM sh", "share:9")
def _(s, d):
    return K.inv_clr(K.clr(brand_mix(s, d)).drop("amount")).drop("clr")


@query("alr", f"WITH {SH}, z AS (SELECT period, part, CASE WHEN share < 3e-2 THEN 1e-4 ELSE share END AS x FROM sh) SELECT a.period, a.part, ln(a.x) - ln(b.x) AS alr FROM z a JOIN z b ON a.period = b.period AND b.part = 'Brand#1' WHERE a.part <> 'Brand#1'", "alr:9")
def _(s, d):
    sh = K.close_shares(brand_mix(s, d)).withColumn("share", F.when(F.col("share") < 0.03, 0.0).otherwise(F.col("share")))
    return K.alr(sh, reference="Brand#1").select("period", "part", "alr")


@query("half_min_zero_fill", f"WITH {BM}, z AS (SELECT period, part, CASE WHEN (period + length(part)) % 5 = 0 THEN 0e0 ELSE amount END AS amount FROM bm) SELECT period, part, CASE WHEN amount > 0 THEN amount ELSE (SELECT min(amount) / 2 FROM z WHERE amount > 0) END AS amount FROM z", "amount:5")
def _(s, d):
    z = brand_mix(s, d).withColumn("amount", F.when((F.col("period") + F.length("part")) % 5 == 0, 0.0).otherwise(F.col("amount")))
    return K.half_min_zero_fill(z)


PAIR = """SELECT a.part AS pi, b.part AS pj, count(*) AS n, {m} FROM {t} a JOIN {t} b ON a.period = b.period AND a.part < b.part GROUP BY ALL"""


def _pairs(t, v, out="vlr phi rho"):
    full = {
        "vlr": f"var_samp(a.{v} - b.{v}) AS vlr",
        "phi": f"var_samp(a.{v} - b.{v}) / var_samp(a.{v}) AS phi",
        "rho": f"2 * covar_samp(a.{v}, b.{v}) / (var_samp(a.{v}) + var_samp(b.{v})) AS rho",
    }
    return PAIR.format(t=t, m=", ".join(full[o] for o in out.split()))


@query("vlr", f"WITH {SH}, l AS (SELECT period, part, ln(amount) AS y FROM sh) {_pairs('l', 'y', 'vlr')}", "vlr:8")
def _(s, d):
    return K.log_ratio_association(brand_mix(s, d).withColumn("y", F.log("amount")), value="y").select("pi", "pj", "n", "vlr")


@query("phi", f"WITH {SH}, l AS (SELECT period, part, ln(amount) AS y FROM sh) {_pairs('l', 'y', 'phi')}", "phi:8")
def _(s, d):
    return K.log_ratio_association(brand_mix(s, d).withColumn("y", F.log("amount")), value="y").select("pi", "pj", "n", "phi")


@query("rho", f"WITH {SH} {_pairs('sh', 'clr', 'rho')}", "rho:8")
def _(s, d):
    return K.log_ratio_association(_clr(s, d), value="clr").select("pi", "pj", "n", "rho")


RES2 = """{n}m AS (SELECT part, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, var_pop(x1) AS g11, var_pop(x2) AS g22, covar_pop(x1, x2) AS g12 FROM {j} GROUP BY part),
{n} AS (SELECT j.period, j.part, y - my - (c1 * g22 - c2 * g12) / (g11 * g22 - g12 * g12) * (x1 - m1) - (g11 * c2 - g12 * c1) / (g11 * g22 - g12 * g12) * (x2 - m2) AS r FROM {j} j JOIN {n}m USING (part))"""


@query("partial_rho_level", f"WITH {SH}, {MK}, j AS (SELECT sh.period, part, clr AS y, x1, x2 FROM sh JOIN mk USING (period)), {RES2.format(n='rs', j='j')} {_pairs('rs', 'r', 'rho')}", "rho:8")
def _(s, d):
    mix = brand_mix(s, d)
    r = K.residual_on(K.clr(mix), _market(mix), value="clr", xs=["x1", "x2"])
    return K.log_ratio_association(r, value="resid").select("pi", "pj", "n", "rho")


@query("partial_rho_increment", f"""WITH {SH}, {MK}, i AS (SELECT period, part, clr - lag(clr) OVER (PARTITION BY part ORDER BY period) AS y FROM sh), mi AS (SELECT period, x1 - lag(x1) OVER (ORDER BY period) AS x1, x2 - lag(x2) OVER (ORDER BY period) AS x2 FROM mk),
j AS (SELECT i.period, part, y, x1, x2 FROM i JOIN mi USING (period) WHERE y IS NOT NULL), {RES2.format(n='rs', j='j')} {_pairs('rs', 'r', 'rho')}""", "rho:8")
def _(s, d):
    mix = brand_mix(s, d)
    inc = K.increments(K.clr(mix), value="clr").select("period", "part", "inc")
    w = Window.partitionBy(F.lit(0)).orderBy("period")  # one row per calendar quarter
    mk = _market(mix).select("period", *[(F.col(x) - F.lag(x).over(w)).alias(x) for x in ("x1", "x2")])
    r = K.residual_on(inc, mk, value="inc", xs=["x1", "x2"])
    return K.log_ratio_association(r, value="resid").select("pi", "pj", "n", "rho")


@query("rank_clock", f"""WITH {SH}, r AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY share DESC) AS r FROM sh)
SELECT part, CAST(arg_min(r, period) AS DOUBLE) AS first_rank, CAST(arg_max(r, period) AS DOUBLE) AS last_rank, arg_max(share, period) - arg_min(share, period) AS share_change FROM r GROUP BY part""", "first_rank:1 last_rank:1 share_change:9")
def _(s, d):
    return K.rank_clock(K.close_shares(brand_mix(s, d)))


TURN = """pres AS (SELECT DISTINCT l_suppkey AS part, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS period FROM lineitem WHERE l_quantity >= 49)"""


def _presence(s, d):
    from tidemark.functions.periods import month_index

    l = table(s, d, "lineitem").where("l_quantity >= 49")
    return l.groupBy(F.col("l_suppkey").alias("part"), month_index("l_shipdate").alias("period")).agg(F.sum("l_quantity").alias("amount"))


@query("turnover", f"""WITH {TURN}, j AS (SELECT coalesce(a.period, b.period + 1) AS period, a.part AS now_p, b.part AS was_p FROM pres a FULL JOIN pres b ON a.part = b.part AND a.period = b.period + 1)
SELECT period, avg((was_p IS NULL OR now_p IS NULL)::INT) AS total, avg((was_p IS NULL)::INT) AS appearance, avg((now_p IS NULL)::INT) AS disappearance FROM j
WHERE period > (SELECT min(period) FROM pres) AND period <= (SELECT max(period) FROM pres) GROUP BY period""", "total appearance disappearance")
def _(s, d):
    return K.turnover(_presence(s, d))


@query("mean_rank_shift", f"""WITH {SH}, j AS (SELECT a.period, a.part, rank() OVER (PARTITION BY a.period ORDER BY a.share) AS ra, rank() OVER (PARTITION BY a.period ORDER BY b.share) AS rb FROM sh a JOIN sh b ON a.part = b.part AND a.period = b.period + 1)
SELECT period, avg(abs(CAST(ra AS DOUBLE) - rb)) AS mrs, count(*) AS n_shared FROM j GROUP BY period""", "mrs")
def _(s, d):
    return K.mean_rank_shift(K.close_shares(brand_mix(s, d)))


DIST = "dd AS (SELECT a.period AS t1, b.period AS t2, sqrt(sum((a.{v} - b.{v}) * (a.{v} - b.{v}))) AS dist FROM sh a JOIN sh b ON a.part = b.part AND a.period < b.period GROUP BY ALL)"


@query("rate_change", f"WITH {SH}, {DIST.format(v='share')} SELECT regr_slope(dist, t2 - t1) AS slope, regr_intercept(dist, t2 - t1) AS intercept, count(*) AS n FROM dd", "slope:9 intercept:9")
def _(s, d):
    return K.rate_change(K.close_shares(brand_mix(s, d)), value="share")


@query("variance_ratio", f"WITH {BM}, v AS (SELECT sum(v) AS sum_var FROM (SELECT var_samp(amount / 1e6) AS v FROM bm GROUP BY part)), t AS (SELECT var_samp(t) AS var_total FROM (SELECT sum(amount / 1e6) AS t FROM bm GROUP BY period)) SELECT var_total, sum_var, var_total / sum_var AS vr FROM v, t", "var_total:7 sum_var:7 vr:7")
def _(s, d):
    return K.variance_ratio(brand_mix(s, d).withColumn("amount", F.col("amount") / 1e6))


@query("synchrony", f"""WITH {BM}, j AS (SELECT part, amount, sum(amount) OVER (PARTITION BY period) - amount AS rest FROM bm), p AS (SELECT stddev_samp(amount) AS sd, corr(amount, rest) AS r FROM j GROUP BY part)
SELECT (SELECT var_samp(t) FROM (SELECT sum(amount) AS t FROM bm GROUP BY period)) / (sum(sd) * sum(sd)) AS loreau, avg(r) AS gross, count(*) AS n_parts FROM p""", "loreau gross")
def _(s, d):
    return K.synchrony(brand_mix(s, d))


DET = "tr AS (SELECT *, amount - avg(amount) OVER w - regr_slope(amount, period) OVER w * (period - avg(period) OVER w) AS resid FROM bm WINDOW w AS (PARTITION BY part))"


@query("taylor_law", f"""WITH {BM}, {DET}, p AS (SELECT part, ln(avg(amount)) AS lm, ln(var_samp(resid)) AS lv FROM tr GROUP BY part), f AS (SELECT regr_slope(lv, lm) AS z, regr_intercept(lv, lm) AS a FROM p)
SELECT part, z, a, lv - a - z * lm AS taylor_resid FROM p, f""", "z a:5 taylor_resid")
def _(s, d):
    return K.taylor_law(brand_mix(s, d))


@query("portfolio_effect", f"""WITH {BM}, {DET}, p AS (SELECT part, avg(amount) AS m, var_samp(resid) AS v FROM tr GROUP BY part),
t AS (SELECT period, sum(amount) AS tot FROM bm GROUP BY period), td AS (SELECT tot, tot - avg(tot) OVER () - regr_slope(tot, period) OVER () * (period - avg(period) OVER ()) AS r FROM t),
a AS (SELECT regr_slope(ln(v), ln(m)) AS z, regr_intercept(ln(v), ln(m)) AS a, avg(sqrt(v) / m) AS cv, sum(sqrt(v)) AS ss FROM p), b AS (SELECT avg(tot) AS mt, stddev_samp(r) AS st FROM td)
SELECT z, sqrt(exp(a + z * ln(mt))) / mt / (st / mt) AS pe_mv, cv / (st / mt) AS pe_cv, ss / st AS diversification FROM a, b""", "z pe_mv pe_cv diversification")
def _(s, d):
    return K.portfolio_effect(brand_mix(s, d))


@query("eppm", f"WITH {SH} SELECT period, part, greatest(0e0, share - avg(share) OVER (PARTITION BY part)) AS eppm FROM sh", "eppm:9")
def _(s, d):
    return K.eppm(K.close_shares(brand_mix(s, d))).select("period", "part", "eppm")


@query("path_metrics", f"""WITH {SH}, x AS (SELECT *, clr - lag(clr) OVER w AS dd FROM sh WINDOW w AS (PARTITION BY part ORDER BY period)), y AS (SELECT *, lag(dd) OVER (PARTITION BY part ORDER BY period) AS e FROM x),
s AS (SELECT period, sqrt(sum(dd * dd)) AS len, sum(dd * e) AS dot, sqrt(sum(e * e)) AS plen FROM y GROUP BY period), n AS (SELECT sqrt(sum(v * v)) AS net FROM (SELECT arg_max(clr, period) - arg_min(clr, period) AS v FROM sh GROUP BY part))
SELECT sum(len) AS length, avg(dot / nullif(len * plen, 0)) AS step_cosine, net, net / sum(len) AS straightness FROM s, n GROUP BY net""", "length step_cosine net straightness")
def _(s, d):
    return K.path_metrics(_clr(s, d), value="clr")


@query("directionality", f"""WITH {SH}, {DIST.format(v='clr')}, t AS (SELECT x.dist AS a, y.dist AS b, z.dist AS c FROM dd x JOIN dd y ON x.t2 = y.t1 JOIN dd z ON z.t1 = x.t1 AND z.t2 = y.t2)
SELECT sum((a + b) * (1 - (180 - degrees(acos(greatest(-1e0, least(1e0, (a * a + b * b - c * c) / (2 * a * b)))))) / 180)) / sum(a + b) AS directionality, count(*) AS n_triples FROM t""", "directionality:8")
def _(s, d):
    return K.directionality(_clr(s, d), value="clr")


@query("increment_split", f"""WITH {SH}, {MK}, i AS (SELECT period, part, clr, clr - lag(clr) OVER w AS dy, first_value(clr) OVER w AS y0 FROM sh WINDOW w AS (PARTITION BY part ORDER BY period)), mi AS (SELECT period, x1 - lag(x1) OVER (ORDER BY period) AS dx FROM mk),
j AS (SELECT * FROM i JOIN mi USING (period)), b AS (SELECT part, sum(dx * dy) / sum(CASE WHEN dy IS NOT NULL THEN dx * dx END) AS b FROM j GROUP BY part)
SELECT period, part, y0 + sum(coalesce(b * dx, 0)) OVER w AS market_path, y0 + sum(coalesce(dy - b * dx, 0)) OVER w AS residual_path FROM j JOIN b USING (part) WINDOW w AS (PARTITION BY part ORDER BY period)""", "market_path:8 residual_path:8")
def _(s, d):
    mix = brand_mix(s, d)
    return K.increment_split(K.clr(mix), _market(mix), value="clr", x="x1")


ONSETS = {"a": 7984, "b": 7991, "c": 7999}
EPI = f"""{SH}, ep AS (SELECT * FROM (VALUES ('a', 7984), ('b', 7991), ('c', 7999)) v(episode, t)), pt AS (SELECT episode, period - t + 3 AS pos, part, clr AS v FROM sh JOIN ep ON period BETWEEN t - 2 AND t + 3)"""


@query("episode_distance", f"""WITH {EPI}, st AS (SELECT a.episode AS e1, a.pos AS p1, b.episode AS e2, b.pos AS p2, sum((a.v - b.v) * (a.v - b.v)) AS s FROM pt a JOIN pt b ON a.part = b.part AND a.episode <> b.episode GROUP BY ALL),
lk AS (SELECT e1, e2, sqrt(sum(s)) AS lockstep FROM st WHERE p1 = p2 GROUP BY ALL), nr AS (SELECT e1, e2, avg(m) AS d FROM (SELECT e1, p1, e2, sqrt(min(s)) AS m FROM st GROUP BY ALL) GROUP BY ALL)
SELECT a.e1, a.e2, lockstep, (a.d + b.d) / 2 AS path_distance FROM nr a JOIN nr b ON a.e1 = b.e2 AND a.e2 = b.e1 JOIN lk ON lk.e1 = a.e1 AND lk.e2 = a.e2 WHERE a.e1 < a.e2""", "lockstep path_distance")
def _(s, d):
    return K.episode_distance(K.episode_points(_clr(s, d), ONSETS, pre=2, post=3, value="clr"))


@query("episode_recovery", f"""WITH {EPI}, z AS (SELECT a.episode, a.pos, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS dd FROM pt a JOIN pt b ON a.episode = b.episode AND a.part = b.part AND b.pos = 1 GROUP BY ALL)
SELECT episode, max(dd) AS max_exc, arg_max(dd, pos) AS end_dist, arg_max(dd, pos) / max(dd) AS ratio FROM z GROUP BY episode""", "max_exc end_dist ratio")
def _(s, d):
    return K.episode_recovery(K.episode_points(_clr(s, d), ONSETS, pre=2, post=3, value="clr"))


@query("ca_axes")
def _(s, d):
    rows, cols, share = K.ca_axes(brand_mix(s, d))
    r = rows.select(F.lit("row").alias("side"), F.col("period").cast("string").alias("label"), "axis1", "axis2")
    c = cols.select(F.lit("column").alias("side"), F.col("part").alias("label"), "axis1", "axis2")
    return r.unionByName(c).withColumn("inertia1", F.lit(share[0])).withColumn("inertia2", F.lit(share[1]))


@query("seriate")
def _(s, d):
    rows, _, _ = K.ca_axes(brand_mix(s, d))
    return K.seriate(rows).agg(F.corr("pos", "t").alias("spearman_with_calendar"), F.count(F.lit(1)).alias("n"))


@query("seriate_significance")
def _(s, d):
    """Lines by quarter and brand: modes of the seriated table against 1,000 tables with its margins."""
    parts = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("part"))
    lines = table(s, d, "lineitem").groupBy("l_partkey", quarter_index("l_shipdate").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return SE.seriation_significance(lines.join(parts, "l_partkey"), period="period", part="part", count="n")


@query("mix_clock")
def _(s, d):
    """Quarter of each mix from the mixes before it, beside the naive date."""
    return SE.mix_clock(brand_mix(s, d), period="period", part="part", amount="amount").select("period", "fit", F.col("last").cast("double").alias("last"))


@query("mix_clock_errors")
def _(s, d):
    """Mean absolute error of the walked-forward dates, in years, and of the naive ones."""
    p = SE.mix_clock(brand_mix(s, d), period="period", part="part", amount="amount")
    err = lambda c: F.avg(F.abs(F.col(c) - F.col("period")) / 4.0)
    return p.agg(err("fit").alias("mae"), err("last").alias("mae_naive"), F.count(F.lit(1)).alias("n_test"))


@query("transfer_matrix_ls")
def _(s, d):
    sh = K.close_shares(segment_mix(s, d))
    return K.transfer_matrix_ls(sh, regime=F.when(F.col("period") < 7993, "early").otherwise("late"))


@query("transfer_summary")
def _(s, d):
    sh = K.close_shares(segment_mix(s, d))
    return K.transfer_summary(K.transfer_matrix_ls(sh), sh.groupBy("part").agg(F.avg("share").alias("share")))

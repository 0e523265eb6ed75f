"""Section 2.9 queries: the quarterly cross-section of supplier revenue per unit of lagged volume."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.periods import week_ending
from tidemark.operators import distribution as D
from tidemark.operators.calendar import lag_at
from tidemark.plans.bindings import SP, SQ, line_units, supplier_panel, table
from tidemark.plans.registry import query
from tidemark.plans.relational import BAND, WEEKLY, sql_cdf, sql_ppf

L99 = "[" + ", ".join(f"{t:.2f}" for t in D.U99) + "]"
XS = f"""{SP}, xs AS (SELECT entity, q, flow / max(stock) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) / 1e3 AS r FROM sp)"""
QF = f"""{XS}, qf AS (SELECT q, CAST(unnest({L99}) AS DOUBLE) AS tau, unnest(quantile_cont(r, {L99})) AS qv FROM xs WHERE r IS NOT NULL GROUP BY q)"""
QF19 = f"{QF}, q19 AS (SELECT * FROM qf WHERE CAST(round(tau * 100) AS INT) % 5 = 0)"


def cross_section(s, d):
    return supplier_panel(s, d).select("entity", "q", (F.col("flow") / lag_at("stock", 1) / 1e3).alias("r")).where("r IS NOT NULL")


def quantile_functions(s, d):
    return D.cs_quantile_function(cross_section(s, d), keys=["q"], value="r")


@query("cs_quantile_function", f"WITH {QF} SELECT * FROM qf", "tau:2 qv:8")
def _(s, d):
    return quantile_functions(s, d)


@query("w2sq_grid", f"""WITH {QF} SELECT a.q, avg((a.qv - b.qv) * (a.qv - b.qv)) AS w2sq, avg((a.qv - b.qv) * (a.qv - b.qv)) FILTER (CAST(round(a.tau * 100) AS INT) % 5 = 0) AS w2sq_trimmed FROM qf a JOIN qf b ON b.q = a.q + 1 AND a.tau = b.tau GROUP BY a.q""", "w2sq:8 w2sq_trimmed:8")
def _(s, d):
    q = quantile_functions(s, d)
    nxt = q.withColumn("q", F.col("q") - 1)
    full = D.w2sq_grid(q, nxt, ["q"]).drop("n_levels")
    trim = D.w2sq_grid(D.inner_levels(q), D.inner_levels(nxt), ["q"], "w2sq_trimmed").drop("n_levels")
    return full.join(trim, "q")


def weekly_mix(s, d):
    """Monthly six-band weights per return flag (exact counts of units)."""
    l = table(s, d, "lineitem")
    agg = l.groupBy(F.col("l_returnflag").alias("kind"), (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("m"), F.expr(BAND).alias("band")).agg(F.sum("l_quantity").alias("w"))
    bands = ["01", "02", "03", "04", "05", "06"]
    arr = F.array(*[F.coalesce(F.sum(F.when(F.col("band") == b, F.col("w"))), F.lit(0.0)) for b in bands])
    return agg.groupBy("kind", "m").agg(arr.alias("p"))


XPOS = (0.693147, 1.906155, 2.649159, 3.378225, 4.047429, 5.021171)
MIX = f"""bd AS (SELECT * FROM (VALUES ('01', {XPOS[0]}e0, 1), ('02', {XPOS[1]}e0, 2), ('03', {XPOS[2]}e0, 3), ('04', {XPOS[3]}e0, 4), ('05', {XPOS[4]}e0, 5), ('06', {XPOS[5]}e0, 6)) v(band, x, i)),
w0 AS (SELECT l_returnflag AS kind, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS m, {BAND} AS band, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
km AS (SELECT DISTINCT kind, m FROM w0),
p AS (SELECT km.kind, km.m, bd.i, bd.x, coalesce(w0.w, 0e0) AS w FROM km CROSS JOIN bd LEFT JOIN w0 USING (kind, m, band)),
c AS (SELECT kind, m, i, x, CASE WHEN i = 6 THEN 1e0 ELSE sum(w) OVER k / sum(w) OVER (PARTITION BY kind, m) END AS c FROM p WINDOW k AS (PARTITION BY kind, m ORDER BY i)),
brk AS (SELECT DISTINCT a.kind, a.m, a.c FROM (SELECT kind, m, c FROM c UNION ALL SELECT kind, m - 1, c FROM c) a JOIN km k0 ON k0.kind = a.kind AND k0.m = a.m JOIN km k1 ON k1.kind = a.kind AND k1.m = a.m + 1 WHERE a.c > 0),
seg AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY kind, m ORDER BY c), 0e0) AS lo FROM brk),
st AS (SELECT s.kind, s.m, s.c - s.lo AS w, (SELECT min(x) FROM c WHERE c.kind = s.kind AND c.m = s.m AND c.c >= (s.lo + s.c) / 2) AS a, (SELECT min(x) FROM c WHERE c.kind = s.kind AND c.m = s.m + 1 AND c.c >= (s.lo + s.c) / 2) AS b FROM seg s)"""


def _consecutive(s, d):
    a = weekly_mix(s, d)
    b = a.select("kind", (F.col("m") - 1).alias("m"), F.col("p").alias("pn"))
    return a.join(b, ["kind", "m"])


def _xpos():
    return F.array(*[F.lit(v) for v in XPOS])


@query("w2sq_discrete", f"WITH {MIX} SELECT kind, m, sum(w * (a - b) * (a - b)) AS w2sq FROM st GROUP BY ALL", "w2sq:9")
def _(s, d):
    return D.w2sq_discrete(_consecutive(s, d), "p", "pn", _xpos()).select("kind", "m", "w2sq")


@query("w2_decompose", f"""WITH {MIX}, mm AS (SELECT kind, m, sum(w * a) AS m1, sum(w * b) AS m2, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab FROM st GROUP BY ALL),
v AS (SELECT *, greatest(aa - m1 * m1, 0e0) AS v1, greatest(bb - m2 * m2, 0e0) AS v2 FROM mm)
SELECT kind, m, (m1 - m2) * (m1 - m2) AS loc, (sqrt(v1) - sqrt(v2)) * (sqrt(v1) - sqrt(v2)) AS scale, v1 + v2 - 2 * (ab - m1 * m2) - (sqrt(v1) - sqrt(v2)) * (sqrt(v1) - sqrt(v2)) AS shape FROM v""", "loc:9 scale:9 shape:9")
def _(s, d):
    return D.w2_decompose(_consecutive(s, d), "p", "pn", _xpos()).select("kind", "m", "loc", "scale", "shape")


RAST_A = "SELECT CAST(month(l_shipdate) AS INT) AS px, CAST(l_quantity AS INT) AS py, sum(CASE WHEN l_returnflag = 'A' THEN 1e0 ELSE 0e0 END) AS a, sum(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END) AS b FROM lineitem GROUP BY ALL"


@query("w1_cdf_distance", f"""WITH r AS ({RAST_A}), t AS (SELECT *, a / sum(a) OVER (PARTITION BY px) AS pa, b / sum(b) OVER (PARTITION BY px) AS pb FROM r),
g AS (SELECT px, pa, pb, abs(sum(pa - pb) OVER (PARTITION BY px ORDER BY py)) AS g FROM t), p AS (SELECT px, sum(g) * 2e-1 AS w1, sum(abs(pa - pb)) / 2 AS tv FROM g GROUP BY px)
SELECT avg(w1) AS w1, avg(tv) AS tv, count(*) AS n_columns FROM p""", "w1:9 tv:9")
def _(s, d):
    l = table(s, d, "lineitem").groupBy(F.month("l_shipdate").alias("px"), F.col("l_quantity").cast("int").alias("py")).agg(
        F.sum(F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("b"))
    return D.w1_cdf_distance(l, column="px", row="py", a="a", b="b", step=0.2)


@query("barycenter", f"WITH {QF} SELECT q // 4 AS y, tau, avg(qv) AS qv, sum(qv * q) / sum(q) AS qw FROM qf GROUP BY ALL", "tau:2 qv:8 qw:8")
def _(s, d):
    q = quantile_functions(s, d).withColumn("y", F.floor(F.col("q") / 4))
    return D.barycenter(q, keys=["y"]).join(D.barycenter(q, keys=["y"], weight="q").withColumnRenamed("qv", "qw"), ["y", "tau"])


@query("widen", f"WITH {QF} SELECT a.q, a.tau, s.s, m.qv + s.s * (a.qv - m.qv) AS qv FROM qf a JOIN qf m ON a.q = m.q AND m.tau = 0.5, (SELECT unnest([0.75e0, 1e0, 1.25e0]) AS s) s", "tau:2 s:2 qv:8")
def _(s, d):
    return D.widen(quantile_functions(s, d), keys=["q"], factors=[0.75, 1.0, 1.25])


GRID = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0]


@query("select_widening", f"""WITH {QF}, mid AS (SELECT q, qv AS m FROM qf WHERE tau = 0.5), c AS (SELECT q - 1 AS q, r AS y FROM xs WHERE r IS NOT NULL), sg AS (SELECT unnest([0.5e0, 0.75e0, 1e0, 1.25e0, 1.5e0, 2e0]) AS s),
l AS (SELECT c.q // 4 AS y, sg.s, 2 * avg((c.y - (m + s * (qv - m))) * (tau - CASE WHEN c.y - (m + s * (qv - m)) < 0 THEN 1 ELSE 0 END)) / 2 AS score FROM c JOIN qf USING (q) JOIN mid USING (q), sg GROUP BY ALL)
SELECT y, arg_min(s, (score, s)) AS s, min(score) AS score FROM l GROUP BY y""", "s:2 score:7")
def _(s, d):
    cases = cross_section(s, d).select((F.col("q") - 1).alias("q"), F.col("r").alias("y0"), F.lit(2.0).alias("scale"), F.floor((F.col("q") - 1) / 4).alias("y"))
    return D.select_widening(quantile_functions(s, d), cases, keys=["q"], factors=GRID, by=["y"], y="y0")


def _members(s, d):
    q = quantile_functions(s, d)
    a = q.withColumn("member", F.lit("now"))
    b = q.withColumn("q", F.col("q") + 4).withColumn("member", F.lit("year_ago"))
    both = a.select("q").distinct().join(b.select("q").distinct(), "q")
    return a.unionByName(b).join(both, "q", "left_semi")


@query("linear_pool_quantiles")
def _(s, d):
    return D.linear_pool_quantiles(_members(s, d), keys=["q"], member="member", levels=D.U19)


@query("trim_members", """WITH t0 AS (SELECT o_orderpriority AS g, o_orderstatus AS m, stddev_samp(o_totalprice / 1e5) AS sd FROM orders GROUP BY ALL), t AS (SELECT g, m, sd * CASE m WHEN 'F' THEN 1e0 WHEN 'O' THEN 1.2e0 ELSE 2e0 END AS score FROM t0)
SELECT g, m, score FROM t QUALIFY score <= 1.25 * min(score) OVER (PARTITION BY g) OR row_number() OVER (PARTITION BY g ORDER BY score, m) <= 2""", "score:8")
def _(s, d):
    t = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("m")).agg(F.stddev_samp(F.col("o_totalprice") / 1e5).alias("sd"))
    return D.trim_members(t.select("g", "m", (F.col("sd") * F.when(F.col("m") == "F", 1.0).when(F.col("m") == "O", 1.2).otherwise(2.0)).alias("score")), by=["g"], member="m", score="score")


WAR = f"""{QF}, ob AS (SELECT o.q AS o, f.tau, avg(f.qv) AS qbar FROM (SELECT DISTINCT q FROM qf) o JOIN qf f ON f.q <= o.q GROUP BY ALL),
pr AS (SELECT ob.o, a.tau, a.q, a.qv - qbar AS v0, b.qv - qbar AS v1 FROM ob JOIN qf a ON a.tau = ob.tau JOIN qf b ON b.tau = a.tau AND b.q = a.q + 1 AND b.q <= ob.o),
be AS (SELECT o, sum(v0 * v1) / sum(v0 * v0) AS beta_raw, count(DISTINCT q) AS n_pairs FROM pr WHERE CAST(round(tau * 100) AS INT) % 5 = 0 GROUP BY o)"""


@query("war_forecast", f"""WITH {WAR} SELECT ob.o AS q, ob.tau, n_pairs, beta_raw, least(greatest(beta_raw, 0e0), 1e0) AS beta, qbar, (1 - least(greatest(beta_raw, 0e0), 1e0)) * qbar + least(greatest(beta_raw, 0e0), 1e0) * f.qv AS qhat
FROM ob JOIN be USING (o) JOIN qf f ON f.q = ob.o AND f.tau = ob.tau""", "tau:2 beta_raw:6 beta:6 qbar:8 qhat:7")
def _(s, d):
    return D.war_forecast(quantile_functions(s, d)).where("n_pairs IS NOT NULL")


@query("rank_map", f"""WITH {WAR}, qh AS (SELECT ob.o AS q, ob.tau, (1 - least(greatest(beta_raw, 0e0), 1e0)) * qbar + least(greatest(beta_raw, 0e0), 1e0) * f.qv AS qhat FROM ob JOIN be USING (o) JOIN qf f ON f.q = ob.o AND f.tau = ob.tau),
rk AS (SELECT entity, q, (rank() OVER w + (count(*) OVER (PARTITION BY q, r) - 1) / 2e0 - 5e-1) / count(*) OVER (PARTITION BY q) AS p FROM xs WHERE r IS NOT NULL WINDOW w AS (PARTITION BY q ORDER BY r)),
z AS (SELECT entity, q, {sql_ppf('p')} AS z FROM rk), zp AS (SELECT a.z AS z0, b.z AS z1, b.q AS q FROM z a JOIN z b ON a.entity = b.entity AND b.q = a.q + 1),
ro AS (SELECT o.q, least(greatest(corr(z0, z1), 0e0), 99e-2) AS rho FROM (SELECT DISTINCT q FROM zp) o JOIN zp ON zp.q <= o.q GROUP BY o.q),
u AS (SELECT z.entity, z.q, t.tau, rho, {{cdf}} AS u FROM (SELECT z.entity, z.q, t.tau, rho, rho * z.z + sqrt(1 - rho * rho) * {sql_ppf('t.tau')} AS x FROM z JOIN ro USING (q), (SELECT unnest([5e-2, 5e-1, 95e-2]) AS tau) t) z, (SELECT 1) t0(one)),
g AS (SELECT u.*, floor(u * 100) AS k FROM u)
SELECT g.entity, g.q, g.tau, g.rho, CASE WHEN u <= 1e-2 THEN (SELECT qhat FROM qh WHERE qh.q = g.q AND round(qh.tau * 100) = 1) WHEN u >= 99e-2 THEN (SELECT qhat FROM qh WHERE qh.q = g.q AND round(qh.tau * 100) = 99) ELSE a.qhat + (b.qhat - a.qhat) * (u * 100 - k) END AS qv
FROM g LEFT JOIN qh a ON a.q = g.q AND round(a.tau * 100) = g.k LEFT JOIN qh b ON b.q = g.q AND round(b.tau * 100) = g.k + 1 WHERE EXISTS (SELECT 1 FROM qh WHERE qh.q = g.q)""".replace("{cdf}", sql_cdf("z.x")).replace("z.entity, z.q, t.tau, rho, (CASE", "z.entity, z.q, z.tau, rho, (CASE"), "tau:2 rho:6 qv:6")
def _(s, d):
    qh = D.war_forecast(quantile_functions(s, d)).where("n_pairs IS NOT NULL").select("q", "tau", "qhat")
    return D.rank_map(cross_section(s, d), qh, value="r", levels=[0.05, 0.5, 0.95])


@query("ar_map_forecast")
def _(s, d):
    return D.ar_map_forecast(quantile_functions(s, d))


@query("fpca_war")
def _(s, d):
    return D.fpca_war(quantile_functions(s, d))


ISO = """g AS (SELECT a.{k}, a.i AS lo, b.i AS hi, (SELECT avg(c.x) FROM v c WHERE c.{k} = a.{k} AND c.i BETWEEN a.i AND b.i) AS m FROM v a JOIN v b ON a.{k} = b.{k} AND a.i <= b.i),
f AS (SELECT v.{k}, v.i, v.tau, max(mn) AS fit FROM v JOIN (SELECT v.{k}, v.i, g.lo, min(g.m) AS mn FROM v JOIN g ON g.{k} = v.{k} AND g.lo <= v.i AND g.hi >= v.i GROUP BY ALL) w ON w.{k} = v.{k} AND w.i = v.i GROUP BY ALL)"""


@query("frechet_regression", f"""WITH {QF19}, x AS (SELECT q, avg(r) AS x FROM xs WHERE r IS NOT NULL GROUP BY q), pr AS (SELECT b.q AS q, b.tau, x.x, b.qv AS y FROM q19 b JOIN x ON x.q = b.q - 1),
m AS (SELECT o.q, p.tau, count(*) AS n, avg(p.x) AS mx, var_pop(p.x) AS vx, avg(p.y) AS my, avg(p.x * p.y) AS mxy FROM (SELECT DISTINCT q FROM pr) o JOIN pr p ON p.q <= o.q GROUP BY ALL),
v AS (SELECT m.q, CAST(round(tau * 20) AS INT) AS i, tau, my + (mxy - mx * my) * (x.x - mx) / vx AS x FROM m JOIN x USING (q) WHERE n >= 4 AND vx > 0), {ISO.format(k='q')}
SELECT q, tau, fit AS qhat FROM f""", "tau:2 qhat:6")
def _(s, d):
    xs = cross_section(s, d)
    return D.frechet_regression(D.inner_levels(quantile_functions(s, d)), xs.groupBy("q").agg(F.avg("r").alias("x")))


@query("isotonic_projection", f"""WITH {QF19}, v AS (SELECT q, CAST(round(tau * 20) AS INT) AS i, tau, qv + CASE WHEN CAST(round(tau * 20) AS INT) % 3 = 0 THEN 5e-1 ELSE -3e-1 END AS x FROM q19), {ISO.format(k='q')} SELECT q, tau, fit FROM f""", "tau:2 fit:7")
def _(s, d):
    q = D.inner_levels(quantile_functions(s, d))
    q = q.withColumn("qv", F.col("qv") + F.when(F.round(F.col("tau") * 20) % 3 == 0, 0.5).otherwise(-0.3))
    return D.isotonic_projection(q, keys=["q"])


@query("ot_recalibrate", f"""WITH {QF}, pt AS (SELECT q, (rank() OVER (PARTITION BY q ORDER BY r) - 5e-1) / count(*) OVER (PARTITION BY q) AS p FROM xs WHERE r IS NOT NULL), sq AS (SELECT q, p * p AS pit FROM pt),
g AS (SELECT q, CAST(unnest({L99}) AS DOUBLE) AS tau, unnest(quantile_cont(pit, {L99})) AS gi FROM sq GROUP BY q), h AS (SELECT *, floor(gi * 100) AS k FROM g)
SELECT h.q, h.tau, CASE WHEN gi <= 1e-2 THEN (SELECT qv FROM qf WHERE qf.q = h.q AND round(qf.tau * 100) = 1) WHEN gi >= 99e-2 THEN (SELECT qv FROM qf WHERE qf.q = h.q AND round(qf.tau * 100) = 99) ELSE a.qv + (b.qv - a.qv) * (gi * 100 - k) END AS qv
FROM h LEFT JOIN qf a ON a.q = h.q AND round(a.tau * 100) = h.k LEFT JOIN qf b ON b.q = h.q AND round(b.tau * 100) = h.k + 1""", "tau:2 qv:6")
def _(s, d):
    from tidemark.operators.ranks import rank_average

    p = rank_average(cross_section(s, d), ["q"], "r", "rk", "p")
    return D.ot_recalibrate(quantile_functions(s, d), p.withColumn("pit", F.col("p") * F.col("p")), keys=["q"])


TH = [20000.0, 40000.0, 60000.0, 80000.0]


@query("isotonic_distribution", """WITH b AS (SELECT l_quantity AS tau, CAST(l_quantity AS INT) AS i, z, avg((l_extendedprice <= z)::INT) AS y, count(*) AS w FROM lineitem, (SELECT unnest([2e4, 4e4, 6e4, 8e4]) AS z) GROUP BY ALL),
c AS (SELECT *, sum(y * w) OVER k AS sy, sum(w) OVER k AS sw FROM b WINDOW k AS (PARTITION BY z ORDER BY i)), g AS (SELECT a.z, a.i AS lo, d.i AS hi, (d.sy - a.sy + a.y * a.w) / (d.sw - a.sw + a.w) AS m FROM c a JOIN c d ON a.z = d.z AND a.i <= d.i),
n AS (SELECT b.z, b.i, g.lo, max(g.m) AS mx FROM b JOIN g ON g.z = b.z AND g.lo <= b.i AND g.hi >= b.i GROUP BY ALL)
SELECT z, CAST(i AS DOUBLE) AS x, min(mx) AS cdf FROM n GROUP BY ALL""", "z:0 x:0 cdf:8")
def _(s, d):
    return D.isotonic_distribution(table(s, d, "lineitem"), x="l_quantity", y="l_extendedprice", thresholds=TH)


@query("isotonic_distribution_skill", """WITH l AS (SELECT year(l_shipdate) AS yr, CAST(l_quantity AS INT) AS i, z, (l_extendedprice <= z)::INT AS y FROM lineitem, (SELECT unnest([2e4, 4e4, 6e4, 8e4]) AS z)),
b AS (SELECT h.yr AS held, i, z, avg(y) AS y, count(*) AS w FROM l JOIN (SELECT DISTINCT yr FROM l) h ON l.yr <> h.yr GROUP BY ALL),
c AS (SELECT *, sum(y * w) OVER k AS sy, sum(w) OVER k AS sw FROM b WINDOW k AS (PARTITION BY held, z ORDER BY i)), g AS (SELECT a.held, a.z, a.i AS lo, d.i AS hi, (d.sy - a.sy + a.y * a.w) / (d.sw - a.sw + a.w) AS m FROM c a JOIN c d ON a.held = d.held AND a.z = d.z AND a.i <= d.i),
n AS (SELECT b.held, b.z, b.i, g.lo, max(g.m) AS mx FROM b JOIN g ON g.held = b.held AND g.z = b.z AND g.lo <= b.i AND g.hi >= b.i GROUP BY ALL), f AS (SELECT held, z, i, min(mx) AS cdf FROM n GROUP BY ALL),
cl AS (SELECT held, z, sum(y * w) / sum(w) AS base FROM b GROUP BY ALL)
SELECT l.yr AS held, avg((f.cdf - l.y) * (f.cdf - l.y)) AS brier_idr, avg((cl.base - l.y) * (cl.base - l.y)) AS brier_clim FROM l JOIN f ON f.held = l.yr AND f.z = l.z AND f.i = l.i JOIN cl ON cl.held = l.yr AND cl.z = l.z GROUP BY l.yr""", "brier_idr:7 brier_clim:7")
def _(s, d):
    l = table(s, d, "lineitem").select(F.year("l_shipdate").alias("held"), "l_quantity", "l_extendedprice")
    fit = D.isotonic_distribution(l, x="l_quantity", y="l_extendedprice", thresholds=TH, held="held")
    # reduced outcomes: per (year, quantity, threshold) the count and the hits
    red = l.groupBy("held", F.col("l_quantity").alias("x")).agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("l_extendedprice") <= z).cast("double")).alias(f"h{i}") for i, z in enumerate(TH)])
    long = red.select("held", "x", "n", F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.col(f"h{i}").alias("h")) for i, z in enumerate(TH)])).alias("e")).select("held", "x", "n", "e.z", "e.h")
    tot = long.groupBy("z").agg(F.sum("n").alias("tn"), F.sum("h").alias("th"))
    per = long.groupBy("held", "z").agg(F.sum("n").alias("yn"), F.sum("h").alias("yh"))
    base = per.join(tot, "z").select("held", "z", ((F.col("th") - F.col("yh")) / (F.col("tn") - F.col("yn"))).alias("base"))
    j = long.join(fit, ["held", "x", "z"]).join(base, ["held", "z"])
    # sum over rows of (p - y)^2 = n p^2 - 2 p h + h
    sq = lambda p: F.sum(F.col("n") * p * p - 2 * p * F.col("h") + F.col("h")) / F.sum("n")
    return j.groupBy("held").agg(sq(F.col("cdf")).alias("brier_idr"), sq(F.col("base")).alias("brier_clim"))


PIXSQL = f"""{SP}, mx AS (SELECT min(q) AS q0, max(flow) AS top FROM sp), pts AS (SELECT entity AS series, CAST((q - q0) * 3 AS INT) AS px, CAST(least(greatest(floor(flow / top * 40), 0), 40) AS INT) AS py FROM sp, mx),
sg AS (SELECT series, px AS x0, py AS y0, lead(px) OVER w AS x1, lead(py) OVER w AS y1 FROM pts WINDOW w AS (PARTITION BY series ORDER BY px)), s1 AS (SELECT *, abs(y1 - y0) > abs(x1 - x0) AS st FROM sg WHERE x1 IS NOT NULL),
s2 AS (SELECT series, st, CASE WHEN st THEN y0 ELSE x0 END AS a0, CASE WHEN st THEN x0 ELSE y0 END AS b0, CASE WHEN st THEN y1 ELSE x1 END AS a1, CASE WHEN st THEN x1 ELSE y1 END AS b1 FROM s1),
s3 AS (SELECT series, st, least(a0, a1) AS a0, greatest(a0, a1) AS a1, CASE WHEN a0 > a1 THEN b1 ELSE b0 END AS b0, CASE WHEN a0 > a1 THEN b0 ELSE b1 END AS b1 FROM s2),
s4 AS (SELECT *, a1 - a0 AS dx, abs(b1 - b0) AS dy, unnest(generate_series(0, a1 - a0)) AS k FROM s3),
s5 AS (SELECT series, st, a0 + k AS a, b0 + CASE WHEN b0 < b1 THEN 1 ELSE -1 END * CASE WHEN dx > 0 THEN greatest(0, CAST(ceil((2 * k * dy - dx) / (2e0 * dx)) AS INT)) ELSE 0 END AS b FROM s4),
px AS (SELECT DISTINCT series, CAST(CASE WHEN st THEN b ELSE a END AS INT) AS px, CAST(CASE WHEN st THEN a ELSE b END AS INT) AS py FROM s5), ok AS (SELECT * FROM px WHERE px BETWEEN 0 AND 81 AND py BETWEEN 0 AND 39)"""


def _series_pixels(s, d):
    p = supplier_panel(s, d)
    q0, top = p.agg(F.min("q")).scalar(), p.agg(F.max("flow")).scalar()
    return p.select(F.col("entity").alias("series"), ((F.col("q") - q0) * 3).alias("px"), F.least(F.greatest(F.floor(F.col("flow") / top * 40), F.lit(0)), F.lit(40)).cast("int").alias("py"))


@query("density_raster", f"WITH {PIXSQL} SELECT px, py, sum(1e0 / n) AS density FROM (SELECT *, count(*) OVER (PARTITION BY series, px) AS n FROM ok) GROUP BY ALL", "density:8")
def _(s, d):
    return D.density_raster(_series_pixels(s, d), width=82, height=40)


@query("density_branch_brush")
def _(s, d):
    """Two bands of suppliers, one lifted, so that the profile has an upper branch."""
    p = _series_pixels(s, d).withColumn("py", F.when(F.col("series") % 4 == 0, F.col("py")).otherwise(F.floor(F.col("py") / 3).cast("int")))
    r = D.density_raster(p, width=82, height=40)
    return D.density_branch_brush(r, column=75, height=40, lo=0.0, hi=1.0, sigma=2.0, gap=4)

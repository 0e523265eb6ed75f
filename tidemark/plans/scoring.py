"""Section 2.11 queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.hashing import sql_draw_int
from tidemark.operators import distribution as D
from tidemark.operators import forecast as M
from tidemark.operators import scoring as S
from tidemark.operators.calendar import lag_at
from tidemark.plans.bindings import DE, SP, SQ, customer_panel, daily_events, supplier_panel, table
from tidemark.plans.distribution import QF, XS, cross_section, quantile_functions
from tidemark.plans.forecast import CASES, LV, cases
from tidemark.plans.registry import query
from tidemark.plans.relational import sql_cdf
from tidemark.session import cut_lineage

LONG = f"{CASES}, lg AS (SELECT entity, origin, target, method, actual, forecast FROM (SELECT entity, origin, target, actual, naive, seasonal_naive, pooled_ar FROM cases) UNPIVOT (forecast FOR method IN (naive, seasonal_naive, pooled_ar)))"


@query("point_metrics", f"""WITH {LONG}, sc AS (SELECT 'all' AS scope, * FROM lg UNION ALL SELECT CAST(target // 4 AS VARCHAR), * FROM lg), e AS (SELECT scope, method, forecast - actual AS e, CASE WHEN actual <> 0 THEN abs(forecast - actual) / abs(actual) END AS ape FROM sc)
SELECT scope, method, count(e) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 100 * avg(ape) AS mape, count(ape) AS n_mape, 100 * median(ape) AS mdape FROM e GROUP BY ALL""", "mae:2 rmse:2 mape:6 mdape:6")
def _(s, d):
    long = M.melt_methods(cut_lineage(cases(s, d), "cases"))
    return S.point_metrics(S.with_overall(long, F.floor(F.col("target") / 4)), by=["scope", "method"])


@query("matched_cases", f"""WITH {LONG}, k AS (SELECT *, forecast AS f FROM lg WHERE NOT (method = 'pooled_ar' AND entity % 7 = 0)), w AS (SELECT entity, target, max(CASE WHEN entity % 11 <> 0 THEN actual END) AS actual, max(f) FILTER (method = 'naive') AS a, max(f) FILTER (method = 'seasonal_naive') AS b, max(f) FILTER (method = 'pooled_ar') AS c FROM k GROUP BY ALL)
SELECT CASE WHEN actual IS NULL THEN 'no_actual' WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'method_missing' ELSE 'matched' END AS reason, count(*) AS n FROM w GROUP BY 1""")
def _(s, d):
    long = M.melt_methods(cases(s, d)).where("NOT (method = 'pooled_ar' AND entity % 7 = 0)").withColumn("actual", F.when(F.col("entity") % 11 != 0, F.col("actual")))
    return S.matched_cases(long, keys=["entity", "target"], method="method", value="forecast", methods=M.METHODS, actual="actual")[1]


FQ = f"""{QF}, y AS (SELECT entity, q, r AS y FROM xs WHERE r IS NOT NULL), j AS (SELECT y.entity, y.q, y.y, f.tau, f.qv FROM y JOIN qf f ON f.q = y.q - 1)"""


def scored(s, d):
    """Each supplier's ratio against the previous quarter's cross-section quantiles."""
    y = cross_section(s, d).select("entity", "q", F.col("r").alias("y"))
    return y.join(quantile_functions(s, d).withColumn("q", F.col("q") + 1), "q")


@query("pinball", f"WITH {FQ} SELECT q, tau, avg((y - qv) * (tau - (y < qv)::INT)) AS loss FROM j GROUP BY ALL", "tau:2 loss:8")
def _(s, d):
    return scored(s, d).groupBy("q", "tau").agg(F.avg(S.pinball(F.col("qv"), F.col("y"), F.col("tau"))).alias("loss"))


@query("quantile_crps", f"WITH {FQ} SELECT entity, q, 2 * avg((y - qv) * (tau - (y < qv)::INT)) AS crps, count(*) AS n_levels FROM j GROUP BY ALL", "crps:8")
def _(s, d):
    return S.quantile_crps(scored(s, d), keys=["entity", "q"])


@query("coverage", f"WITH {FQ} SELECT entity, q, CAST(max(y) >= max(qv) FILTER (round(tau * 100) = 5) AND max(y) <= max(qv) FILTER (round(tau * 100) = 95) AS INT) AS covered FROM j GROUP BY ALL")
def _(s, d):
    return S.coverage(scored(s, d), keys=["entity", "q"], level=0.9)


@query("pit", f"""WITH {FQ}, e AS (SELECT entity, q, y, max(CASE WHEN qv <= y THEN tau END) AS t0, arg_max(qv, qv) FILTER (qv <= y) AS x0, min(CASE WHEN qv > y THEN tau END) AS t1, min(qv) FILTER (qv > y) AS x1, min(qv) AS lo, max(qv) AS hi FROM j GROUP BY ALL)
SELECT entity, q, CASE WHEN y < lo THEN 0e0 WHEN y = lo THEN 1e-2 WHEN y > hi THEN 1e0 WHEN y = hi THEN 99e-2 ELSE t0 + (t1 - t0) * (y - x0) / (x1 - x0) END AS pit FROM e""", "pit:7")
def _(s, d):
    y = cross_section(s, d).select("entity", "q", F.col("r").alias("y"))
    return S.pit(y, quantile_functions(s, d).withColumn("q", F.col("q") + 1), keys=["entity", "q"], on="q")


@query("energy_score", f"""WITH e AS (SELECT event_type AS k, value / 100 AS a, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS b, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT e.k, avg(sqrt((e.a - 5e-1) * (e.a - 5e-1) + (e.b - 5e-1) * (e.b - 5e-1))) - 5e-1 * avg(sqrt((e.a - p.a) * (e.a - p.a) + (e.b - p.b) * (e.b - p.b))) AS energy, count(*) AS n_samples FROM e JOIN e p ON p.k = e.k AND p.i = CASE WHEN e.i = 1 THEN e.n ELSE e.i - 1 END GROUP BY e.k""", "energy:8")
def _(s, d):
    from tidemark.operators.ranks import row_positions

    e = table(s, d, "events").select(F.col("event_type").alias("k"), "event_id", (F.col("value") / 100).alias("a"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("b"))
    e = row_positions(e, ["k"], "event_id", "event_id", "i").withColumns({"ya": F.lit(0.5), "yb": F.lit(0.5)})
    return S.energy_score(e, keys=["k"], index="i", dims=["a", "b"], ys=["ya", "yb"])


@query("gaussian_crps", f"""WITH z AS (SELECT o_orderkey, o_totalprice / 1e5 AS y, (o_totalprice / 1e5 - 25e-1) / 12e-1 AS z FROM orders) SELECT o_orderkey, 12e-1 * (z * (2 * {sql_cdf('z')} - 1) + 2 * exp(-z * z / 2) * 0.3989422804014327e0 - 0.5641895835477563e0) AS crps FROM z""", "crps:8")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", S.gaussian_crps(F.col("o_totalprice") / 1e5, F.lit(2.5), F.lit(1.2)).alias("crps"))


@query("empirical_crps", f"""WITH {SP}, t AS (SELECT entity % 5 AS k, stock AS x FROM sp WHERE q < 8000), o AS (SELECT entity % 5 AS k, stock AS y FROM sp WHERE q >= 8000),
a AS (SELECT o.k, avg(abs(x - y)) AS e1 FROM o JOIN t USING (k) GROUP BY o.k), b AS (SELECT p.k, avg(abs(p.x - r.x)) AS e2 FROM t p JOIN t r USING (k) GROUP BY p.k) SELECT k, e1 - e2 / 2 AS crps, (SELECT count(*) FROM o WHERE o.k = a.k) AS n_obs FROM a JOIN b USING (k)""", "crps:8")
def _(s, d):
    p = supplier_panel(s, d).withColumn("k", F.col("entity") % 5)
    return S.empirical_crps(p.where("q < 8000"), p.where("q >= 8000"), keys=["k"], x="stock", y="stock")


@query("auc", """WITH t AS (SELECT d.lang, l.quality AS y, d.n_chars AS x FROM documents d JOIN labels l USING (doc_id)), p AS (SELECT a.lang, avg(CASE WHEN a.x > b.x THEN 1e0 WHEN a.x = b.x THEN 5e-1 ELSE 0e0 END) AS auc FROM t a JOIN t b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY a.lang)
SELECT t.lang, max(p.auc) AS auc, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM t LEFT JOIN p ON p.lang = t.lang GROUP BY t.lang""", "auc:7")
def _(s, d):
    t = table(s, d, "documents").select("doc_id", "lang", "n_chars").join(table(s, d, "labels"), "doc_id")
    return S.auc(t, label="quality", score="n_chars", by=["lang"])


@query("precision_recall_f1", """WITH p AS (SELECT doc_id, lang AS g FROM documents), t AS (SELECT doc_id, source AS h FROM documents), o AS (SELECT g, h, count(*) AS hits FROM p JOIN t USING (doc_id) GROUP BY ALL), x AS (SELECT o.*, hits / (SELECT count(*) FROM p WHERE p.g = o.g) AS pr, hits / (SELECT count(*) FROM t WHERE t.h = o.h) AS rc FROM o)
SELECT h, g, hits, pr AS precision, rc AS recall, 2 * pr * rc / (pr + rc) AS f1 FROM x QUALIFY row_number() OVER (PARTITION BY h ORDER BY 2 * pr * rc / (pr + rc) DESC, g DESC) = 1""", "precision:7 recall:7 f1:7")
def _(s, d):
    t = table(s, d, "documents")
    return S.precision_recall_f1(t.select("doc_id", F.col("lang").alias("g")), t.select("doc_id", F.col("source").alias("h")), item="doc_id", pred_group="g", true_group="h")


@query("tolerance_match_rate", """WITH r AS (SELECT DISTINCT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS pos FROM events WHERE event_type = 'purchase' AND value > 100), o AS (SELECT event_type AS run, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS pos FROM events WHERE event_type <> 'purchase' AND value > 60)
SELECT runs.run, count(*) FILTER (EXISTS (SELECT 1 FROM o WHERE o.run = runs.run AND o.pos BETWEEN r.pos - 2 AND r.pos + 2)) AS n_hit, count(*) FILTER (EXISTS (SELECT 1 FROM o WHERE o.run = runs.run AND o.pos BETWEEN r.pos - 2 AND r.pos + 2)) / count(*) AS rate FROM r, (SELECT DISTINCT run FROM o) runs GROUP BY 1""", "rate:7")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("run"), F.floor(F.unix_timestamp("ts") / 3600).alias("pos"), "value")
    return S.tolerance_match_rate(e.where("run = 'purchase' AND value > 100"), e.where("run <> 'purchase' AND value > 60"), run="run", pos="pos", tol=2)


DIFF = f"{CASES}, dd AS (SELECT entity, origin, target, abs(naive - actual) / 1e4 AS s_ref, abs(pooled_ar - actual) / 1e4 AS s_alt FROM cases), pq AS (SELECT target, avg(s_ref) AS s_ref, avg(s_alt) AS s_alt, count(*) AS n, avg(s_ref) - avg(s_alt) AS dbar FROM dd GROUP BY target)"


def losses(s, d):
    return cut_lineage(cases(s, d), "cases").select("entity", "origin", "target", (F.abs(F.col("naive") - F.col("actual")) / 1e4).alias("s_ref"), (F.abs(F.col("pooled_ar") - F.col("actual")) / 1e4).alias("s_alt"))


def per_target(s, d):
    """One row per target period, written once because the tests read it several times."""
    return cut_lineage(S.per_period_losses(losses(s, d), period="target", ref="s_ref", alt="s_alt"), "periods")


@query("clustered_dm", f"""WITH {DIFF}, x AS (SELECT 'all' AS scope, target, s_ref - s_alt AS d FROM dd UNION ALL SELECT CAST(target // 4 AS VARCHAR), target, s_ref - s_alt FROM dd), mm AS (SELECT scope, avg(d) AS md, count(*) AS n, count(DISTINCT target) AS g FROM x GROUP BY scope),
c AS (SELECT x.scope, x.target, sum(d - md) AS s FROM x JOIN mm USING (scope) GROUP BY ALL), v AS (SELECT scope, sqrt(mm.g / (mm.g - 1) * sum(s * s) / (mm.n * mm.n)) AS se FROM c JOIN mm USING (scope) WHERE mm.g >= 2 GROUP BY scope, mm.g, mm.n)
SELECT scope, n, g AS "G", md AS mean_diff, se, md / nullif(se, 0) AS t_stat, CASE WHEN md < 0 THEN 'first' WHEN md > 0 THEN 'second' ELSE 'tie' END AS favoured FROM mm LEFT JOIN v USING (scope)""", "mean_diff:7 se:7 t_stat:5")
def _(s, d):
    x = losses(s, d).withColumn("d", F.col("s_ref") - F.col("s_alt"))
    return S.clustered_dm(S.with_overall(x, F.floor(F.col("target") / 4)), by=["scope"], d="d", cluster="target")


@query("panel_dm_hac", f"""WITH {DIFF}, x AS (SELECT row_number() OVER (ORDER BY target) AS i, dbar - avg(dbar) OVER () AS u, count(*) OVER () AS t, avg(dbar) OVER () AS mean FROM pq), g AS (SELECT b.i - a.i AS l, sum(a.u * b.u) / max(a.t) AS g FROM x a JOIN x b ON b.i >= a.i AND b.i - a.i <= floor(sqrt(a.t)) GROUP BY 1),
o AS (SELECT sum(CASE WHEN l = 0 THEN g ELSE 2 * (1 - l / (floor(sqrt((SELECT max(t) FROM x))) + 1)) * g END) AS omega FROM g), s AS (SELECT max(t) AS t, max(mean) AS mean FROM x)
SELECT t AS "T", CAST(floor(sqrt(t)) AS INT) AS bandwidth, mean, omega, sqrt(omega / t) AS se, mean / sqrt(omega / t) AS stat, sqrt((t - 1) / t) AS small_sample FROM o, s""", "mean:7 omega:6 se:6 stat:6 small_sample:7")
def _(s, d):
    return S.panel_dm_hac(per_target(s, d), period="target")


@query("periodogram_dm", f"""WITH {DIFF}, x AS (SELECT row_number() OVER (ORDER BY target) AS i, dbar - avg(dbar) OVER () AS u, count(*) OVER () AS t, avg(dbar) OVER () AS mean FROM pq), f AS (SELECT j, sum(u * cos(2 * pi() * j * i / t)) AS c, sum(u * sin(2 * pi() * j * i / t)) AS s, max(t) AS t, max(mean) AS mean FROM x, range(1, 3) r(j) WHERE j <= floor(pow(t, 1 / 3e0)) GROUP BY j)
SELECT t AS "T", count(*)::INT AS m, mean, avg((c * c + s * s) / t) AS sigma2, sqrt(t) * mean / sqrt(avg((c * c + s * s) / t)) AS stat, 2 * count(*)::INT AS df FROM f GROUP BY t, mean""", "mean:7 sigma2:6 stat:6")
def _(s, d):
    return S.periodogram_dm(per_target(s, d), period="target")


@query("relative_gain", f"WITH {DIFF} SELECT sum(dbar) / sum(s_ref) AS gain, count(*) AS n_periods, avg(s_ref) AS mean_ref FROM pq", "gain:7 mean_ref:6")
def _(s, d):
    return S.relative_gain(per_target(s, d))


@query("leave_one_out_gain", f"""WITH {DIFF}, o AS (SELECT u.entity, d.target, avg(d.s_ref) AS r, avg(d.s_ref) - avg(d.s_alt) AS db FROM (SELECT DISTINCT entity FROM dd) u JOIN dd d ON d.entity <> u.entity GROUP BY ALL) SELECT entity, sum(db) / sum(r) AS gain FROM o GROUP BY entity""", "gain:7")
def _(s, d):
    return S.leave_one_out_gain(losses(s, d), period="target", unit="entity", ref="s_ref", alt="s_alt")


@query("leave_one_year_out_gain", f"""WITH {DIFF} SELECT y.y, sum(dbar) / sum(s_ref) AS gain FROM pq JOIN (SELECT DISTINCT target // 4 AS y FROM pq) y ON pq.target // 4 <> y.y GROUP BY 1""", "gain:7")
def _(s, d):
    p = per_target(s, d).withColumn("y", F.floor(F.col("target") / 4))
    t = p.agg(F.struct(F.sum("dbar").alias("d"), F.sum("s_ref").alias("r"))).scalar()
    return p.groupBy("y").agg(F.sum("dbar").alias("dd"), F.sum("s_ref").alias("rr")).withColumn("t", t).select("y", ((F.col("t.d") - F.col("dd")) / (F.col("t.r") - F.col("rr"))).alias("gain"))


@query("mean_shift_test", f"""WITH {DIFF}, x AS (SELECT b.b AS brk, row_number() OVER (PARTITION BY b.b ORDER BY target) AS i, dbar AS d, (target >= b.b) AS z FROM pq, (SELECT unnest([7990, 7996]) AS b) b), mb AS (SELECT brk, avg(d) FILTER (z) AS m1, avg(d) FILTER (NOT z) AS m0, count(*) FILTER (z) AS n1, count(*) FILTER (NOT z) AS n0, count(*) AS t FROM x GROUP BY brk),
f AS (SELECT x.brk, i, CASE WHEN z THEN (d - m1) / n1 ELSE -(d - m0) / n0 END AS f, t FROM x JOIN mb USING (brk)), v AS (SELECT a.brk, sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (b.i - a.i) / (floor(sqrt(a.t)) + 1)) END * a.f * b.f) AS v FROM f a JOIN f b ON a.brk = b.brk AND b.i >= a.i AND b.i - a.i <= floor(sqrt(a.t)) GROUP BY a.brk),
r AS (SELECT brk, n0 AS n_before, n1 AS n_after, m1 - m0 AS shift, sqrt(v) AS se, (m1 - m0) / sqrt(v) AS z FROM mb JOIN v USING (brk)) SELECT *, 2 * (1 - {sql_cdf('abs(z)')}) AS p FROM r""", "shift:6 se:6 z:6 p:6")
def _(s, d):
    return S.mean_shift_test(per_target(s, d), period="target", breaks=[7990, 7996])


@query("fluctuation_path", f"""WITH {DIFF}, x AS (SELECT target, dbar, row_number() OVER (ORDER BY target) AS i, dbar - avg(dbar) OVER () AS u, count(*) OVER () AS t FROM pq), o AS (SELECT sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (b.i - a.i) / (floor(sqrt(a.t)) + 1)) END * a.u * b.u / a.t) AS om FROM x a JOIN x b ON b.i >= a.i AND b.i - a.i <= floor(sqrt(a.t)))
SELECT target, f FROM (SELECT target, sqrt(6e0) * avg(dbar) OVER w / sqrt(om) AS f, count(*) OVER w AS c FROM x, o WINDOW w AS (ORDER BY target ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) WHERE c = 6""", "f:6")
def _(s, d):
    return S.fluctuation_path(per_target(s, d), period="target", m=6)


PV = """pv AS (SELECT o_custkey % 40 AS g, o_orderpriority AS fam, CASE WHEN o_custkey % 40 <> 13 THEN (CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) % 99991 AS DOUBLE) + 1) / 1e5 END AS p FROM orders GROUP BY o_custkey % 40, o_orderpriority)"""


def _pvals(s, d):
    o = table(s, d, "orders").groupBy((F.col("o_custkey") % 40).alias("g"), F.col("o_orderpriority").alias("fam")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("c"))
    return o.select("g", "fam", F.when(F.col("g") != 13, ((F.col("c") % 99991).cast("double") + 1) / 1e5).alias("p"))


@query("holm", f"""WITH {PV}, r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p NULLS LAST) AS r, count(*) OVER (PARTITION BY fam) AS m FROM pv) SELECT g, fam, p, CASE WHEN p IS NOT NULL THEN max(least(1e0, (m - r + 1) * p)) OVER (PARTITION BY fam ORDER BY r) END AS p_holm FROM r""", "p:7 p_holm:7")
def _(s, d):
    return S.holm(_pvals(s, d), by=["fam"])


@query("bh_fdr", f"""WITH {PV}, r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p NULLS LAST) AS r, count(p) OVER (PARTITION BY fam) AS n FROM pv) SELECT g, fam, p, CASE WHEN p IS NOT NULL THEN least(1e0, min(p * n / r) OVER (PARTITION BY fam ORDER BY r DESC)) END AS q FROM r""", "p:7 q:7")
def _(s, d):
    return S.bh_fdr(_pvals(s, d), by=["fam"])


@query("normal_t_pvalue", f"WITH z AS (SELECT o_orderkey, o_totalprice / 1e5 - 25e-1 AS z FROM orders) SELECT o_orderkey, 2 * (1 - {sql_cdf('abs(z)')}) AS p FROM z", "p:8")
def _(s, d):
    from tidemark.functions.scalars import two_sided_p

    return table(s, d, "orders").select("o_orderkey", two_sided_p(F.col("o_totalprice") / 1e5 - 2.5).alias("p"))


@query("correlation_lagged", f"""WITH {DE}, a AS (SELECT date, value FROM de WHERE series = 'click'), b AS (SELECT series, date, value FROM de WHERE series <> 'click'), l AS (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS lag)
SELECT b.series, l.lag, corr(a.value, b.value) AS r, count(*) AS n FROM a, l JOIN b ON a.date = b.date + l.lag GROUP BY ALL""", "r:7")
def _(s, d):
    e = daily_events(s, d)
    a = e.where("series = 'click'").select("date", F.col("value").alias("a"))
    j = e.where("series <> 'click'").join(a, "date").withColumn("t", F.datediff("date", F.lit("2024-01-01").cast("date")))
    return S.correlation_lagged(j, by=["series"], time="t", a="a", b="value", lags=[-3, -2, -1, 0, 1, 2, 3])


@query("correlation_lagged_ranks", f"""WITH {SP}, l AS (SELECT unnest([0, 1, 4]) AS lag), j AS (SELECT a.entity, l.lag, a.flow AS a, b.stock AS b FROM sp a, l JOIN sp b ON a.entity = b.entity AND a.q = b.q + l.lag),
r AS (SELECT entity, lag, rank() OVER (PARTITION BY entity, lag ORDER BY a) + (count(*) OVER (PARTITION BY entity, lag, a) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY entity, lag ORDER BY b) + (count(*) OVER (PARTITION BY entity, lag, b) - 1) / 2e0 AS rb FROM j) SELECT entity, lag, corr(ra, rb) AS r, count(*) AS n FROM r GROUP BY ALL""", "r:7")
def _(s, d):
    return S.correlation_lagged(supplier_panel(s, d), by=["entity"], time="q", a="flow", b="stock", lags=[0, 1, 4], ranks=True)


@query("ex_ante_set",
       f"""WITH {SP}, e AS (SELECT unnest([7987, 7991, 7995, 7999, 8003]) AS epoch) SELECT e.epoch, entity FROM sp, e WHERE q BETWEEN epoch - 3 AND epoch GROUP BY ALL HAVING count(*) = 4 AND count(*) FILTER (flow >= 6e5) = 4""")
def _(s, d):
    return S.ex_ante_set(supplier_panel(s, d), value="flow", threshold=6e5, epochs=[7987, 7991, 7995, 7999, 8003], window=4)


@query("cs_population", f"WITH {SP} SELECT entity, q, n_prior FROM (SELECT *, count(flow) OVER (PARTITION BY entity ORDER BY q) AS n_prior FROM sp) WHERE stock >= 400 AND n_prior >= 8")
def _(s, d):
    return S.cs_population(supplier_panel(s, d), value="flow", size="stock", min_size=400.0)


@query("rescore_frozen_scale", f"""WITH {DIFF}, sc AS (SELECT *, 1 + (entity % 7) + origin % 3 AS scale FROM dd), fr AS (SELECT entity, 1 + avg(stock) / 1e3 AS scale FROM sp WHERE q < 7986 AND entity % 5 <> 0 GROUP BY entity), fi AS (SELECT entity, arg_min(scale, origin) AS first FROM sc GROUP BY entity)
SELECT sc.entity, origin, coalesce(fr.scale, first) AS used_scale, s_ref * sc.scale / coalesce(fr.scale, first) AS rescored FROM sc LEFT JOIN fr USING (entity) JOIN fi USING (entity)""", "used_scale:7 rescored:7")
def _(s, d):
    c = losses(s, d).withColumn("scale", (1 + F.col("entity") % 7 + F.col("origin") % 3).cast("double"))
    fr = supplier_panel(s, d).where("q < 7986 AND entity % 5 <> 0").groupBy("entity").agg((1 + F.avg("stock") / 1e3).alias("scale"))
    return S.rescore_frozen_scale(c, fr, score="s_ref", scale="scale").select("entity", "origin", "used_scale", "rescored")


@query("drop_and_rescore", f"""WITH {DIFF}, fl AS (SELECT entity, q FROM (SELECT entity, q, stock / lag(stock) OVER (PARTITION BY entity ORDER BY q) - 1 AS g FROM sp) WHERE abs(g) > 5e-1)
SELECT target, avg(s_ref) AS s_ref, count(*) AS n FROM dd WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.entity = dd.entity AND dd.target IN (fl.q, fl.q + 1)) AND target NOT IN (7992) GROUP BY target""", "s_ref:6")
def _(s, d):
    from tidemark.operators.quality import merger_flags

    fl = merger_flags(supplier_panel(s, d), asset="stock", thr=0.5).where("merger_flag").select("entity", F.col("q").alias("target"))
    return S.drop_and_rescore(losses(s, d), fl, quarters=[7992]).groupBy("target").agg(F.avg("s_ref").alias("s_ref"), F.count(F.lit(1)).alias("n"))


@query("select_settings", f"""WITH {CASES}, w AS (SELECT target // 4 AS epoch, abs(naive - actual) / 1e4 AS a, abs(seasonal_naive - actual) / 1e4 AS b, CASE WHEN target // 4 > 1998 OR entity % 2 = 0 THEN abs(pooled_ar - actual) / 1e4 END AS c FROM cases),
cv AS (SELECT epoch, avg((c IS NOT NULL)::INT) >= 9e-1 AS okc, count(*) AS n_cases FROM w GROUP BY epoch), s AS (SELECT epoch, max(n_cases) AS n_cases, count(*) AS n_matched, avg(a) AS a, avg(b) AS b, CASE WHEN bool_and(okc) THEN avg(c) END AS c FROM w JOIN cv USING (epoch) WHERE NOT okc OR c IS NOT NULL GROUP BY epoch),
l AS (SELECT epoch, m, sc, i FROM (SELECT epoch, unnest(['a', 'b', 'c']) AS m, unnest([a, b, c]) AS sc, unnest([0, 1, 2]) AS i FROM s) WHERE sc IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY sc, i) AS r, min(sc) OVER (PARTITION BY epoch) AS best FROM l)
SELECT s.epoch, n_cases, n_matched, arg_min(m, r) AS b_star, string_agg(m, ',' ORDER BY i) FILTER (sc <= 1.25 * best OR r <= 2) AS trimmed, 0 AS inherited FROM k JOIN s USING (epoch) GROUP BY s.epoch, n_cases, n_matched""")
def _(s, d):
    c = cases(s, d).withColumn("epoch", F.floor(F.col("target") / 4))
    e = lambda m: F.abs(F.col(m) - F.col("actual")) / 1e4
    w = c.select("epoch", e("naive").alias("a"), e("seasonal_naive").alias("b"), F.when((F.col("epoch") > 1998) | (F.col("entity") % 2 == 0), e("pooled_ar")).alias("c"))
    return S.select_settings(w, members=["a", "b", "c"], epoch="epoch")


L3 = "[0.1, 0.25, 0.5, 0.75, 0.9]"


@query("noise_floor_gate", f"""WITH o AS (SELECT l_returnflag AS kind, {SQ.format(d='l_shipdate')} AS period, l_extendedprice / 1e4 AS v, {sql_draw_int(11, 'l_returnflag', SQ.format(d='l_shipdate'), 'l_partkey')} % 2 AS h FROM lineitem),
q AS (SELECT kind, period, unnest({L3}) AS tau, unnest(quantile_cont(v, {L3})) AS qv FROM o GROUP BY kind, period), hq AS (SELECT kind, period, h, unnest({L3}) AS tau, unnest(quantile_cont(v, {L3})) AS qv FROM o GROUP BY kind, period, h),
a AS (SELECT q.kind, q.period, avg((q.qv - n.qv) * (q.qv - n.qv)) AS w FROM q JOIN q n ON n.kind = q.kind AND n.tau = q.tau AND n.period = q.period + 1 GROUP BY ALL), b AS (SELECT x.kind, x.period, avg((x.qv - y.qv) * (x.qv - y.qv)) AS w FROM hq x JOIN hq y ON x.kind = y.kind AND x.period = y.period AND x.tau = y.tau AND x.h = 0 AND y.h = 1 GROUP BY ALL)
SELECT kind, (SELECT median(w) FROM a WHERE a.kind = k.kind) AS med_next, (SELECT median(w) FROM b WHERE b.kind = k.kind) AS med_split, (SELECT median(w) FROM a WHERE a.kind = k.kind) / (SELECT median(w) FROM b WHERE b.kind = k.kind) AS ratio FROM (SELECT DISTINCT kind FROM o) k""", "med_next:7 med_split:7 ratio:5")
def _(s, d):
    from tidemark.functions.periods import quarter_index

    o = table(s, d, "lineitem").select(F.col("l_returnflag").alias("kind"), quarter_index("l_shipdate").alias("period"), (F.col("l_extendedprice") / 1e4).alias("v"), "l_partkey")
    return S.noise_floor_gate(o, kind="kind", period="period", value="v", unit="l_partkey", levels=[0.1, 0.25, 0.5, 0.75, 0.9])


@query("secondary_metrics", f"""WITH {QF}, p AS (SELECT q + 1 AS q, max(qv) FILTER (round(tau * 100) = 5) AS a, max(qv) FILTER (round(tau * 100) = 25) AS b, max(qv) FILTER (round(tau * 100) = 50) AS c, max(qv) FILTER (round(tau * 100) = 75) AS d, max(qv) FILTER (round(tau * 100) = 95) AS e FROM qf GROUP BY q), j AS (SELECT xs.q, r AS y, 1e0 + entity % 3 AS s, a, b, c, d, e FROM xs JOIN p USING (q) WHERE r IS NOT NULL),
g AS (SELECT q, avg((y - a) * (5e-2 - (y < a)::INT) / s) AS pin05, avg((y - c) * (5e-1 - (y < c)::INT) / s) AS pin50, avg((y - e) * (95e-2 - (y < e)::INT) / s) AS pin95, avg(abs(y - c) / s) AS mae, avg((y BETWEEN b AND d)::INT) AS cov50, avg((y BETWEEN a AND e)::INT) AS cov90, count(*) AS n FROM j GROUP BY q)
SELECT avg(pin05) AS pin05, avg(pin50) AS pin50, avg(pin95) AS pin95, avg(mae) AS mae, avg(cov50) AS cov50, avg(cov90) AS cov90, sum(n)::BIGINT AS n_cases FROM g""", "pin05:7 pin50:7 pin95:7 mae:7 cov50:7 cov90:7")
def _(s, d):
    q = quantile_functions(s, d)
    at = lambda t: F.max(F.when(F.round(F.col("tau") * 100) == t, F.col("qv")))
    p = q.groupBy((F.col("q") + 1).alias("q")).agg(at(5).alias("q05"), at(25).alias("q25"), at(50).alias("q50"), at(75).alias("q75"), at(95).alias("q95"))
    j = cross_section(s, d).join(p, "q").select("entity", F.col("q").alias("target"), F.col("r").alias("y"), (1.0 + F.col("entity") % 3).alias("scale"), "q05", "q25", "q50", "q75", "q95")
    return S.secondary_metrics(j)

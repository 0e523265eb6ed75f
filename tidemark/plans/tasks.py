"""Section 2.15 queries: end-to-end task tables on the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.periods import quarter_index
from tidemark.operators import distribution as D
from tidemark.operators import quality as Q
from tidemark.plans import task_builders as TB
from tidemark.plans.bindings import CENTS, CY, SP, SQ, customer_ytd, line_units, supplier_panel, table
from tidemark.plans.distribution import MIX, _consecutive, _xpos
from tidemark.plans.forecast import cases
from tidemark.plans.registry import query
from tidemark.plans.scoring import DIFF, losses
from tidemark.session import scratch_path

BR = f"""br AS (SELECT l_suppkey AS entity, l_partkey % 15 AS branch, CAST(year(l_shipdate) AS BIGINT) AS year, (l_partkey % 15) % 4 AS state, l_suppkey % 20 AS holdco, CAST(sum({CENTS}) AS DOUBLE) / 1e4 AS dep,
 20 + (l_suppkey * 7 % 40) * 5e-1 + (l_partkey % 15) AS lat, 60 + (l_suppkey * 3 % 50) * 25e-2 + (l_partkey % 15) * 5e-1 AS lon FROM lineitem GROUP BY ALL HAVING count(*) >= 5)"""


def branches(s, d):
    l = table(s, d, "lineitem")
    k = F.col("l_partkey") % 15
    g = l.groupBy(F.col("l_suppkey").alias("entity"), k.alias("branch"), F.year("l_shipdate").alias("year")).agg((F.sum(line_units()).cast("double") / 10000.0).alias("dep"), F.count(F.lit(1)).alias("_n")).where("_n >= 5").drop("_n")
    return g.withColumns({"state": F.col("branch") % 4, "holdco": F.col("entity") % 20, "lat": 20 + (F.col("entity") * 7 % 40) * 0.5 + F.col("branch"), "lon": 60 + (F.col("entity") * 3 % 50) * 0.25 + F.col("branch") * 0.5})


LN = "ln_ AS (SELECT l_suppkey AS entity, l_partkey % 8 AS state, CAST(year(l_shipdate) AS BIGINT) AS year, l_returnflag AS purpose, count(*) AS n, sum(l_quantity) AS amount FROM lineitem GROUP BY ALL)"


def lending(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), (F.col("l_partkey") % 8).alias("state"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("purpose")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("amount"))


def complaints(s, d):
    return table(s, d, "orders").groupBy((F.col("o_custkey") % 100).alias("entity"), F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def macro(s, d):
    o = table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("c"))
    return o.select("date", (F.col("c").cast("double") / 1e8 / F.col("n")).alias("value"))


@query("task_deposit_decline", f"""WITH {SP}, {BR}, {LN}, bk AS (SELECT entity, q, flow AS dep, stock AS asset, entity % 20 AS holdco, last_day(make_date(q // 4, (q % 4 + 1) * 3, 1)) + 45 AS cutoff FROM sp),
g AS (SELECT *, dep / lag(dep) OVER w - 1 AS g1, dep / lag(dep, 4) OVER w - 1 AS g4, lead(dep) OVER w AS nx FROM bk WINDOW w AS (PARTITION BY entity ORDER BY q)),
g2 AS (SELECT *, lag(g1) OVER w AS gl1, lag(g1, 2) OVER w AS gl2, (sum(g1) OVER p - coalesce(g1, 0)) / nullif(count(g1) OVER p - (g1 IS NOT NULL)::INT, 0) AS peer FROM g WINDOW w AS (PARTITION BY entity ORDER BY q), p AS (PARTITION BY q)),
hc AS (SELECT holdco, q, count(DISTINCT entity) AS nch FROM bk GROUP BY ALL),
b1 AS (SELECT entity, year, count(*) AS nbr, count(DISTINCT state) AS nst, sum(dep) AS bdep FROM br GROUP BY ALL), b2 AS (SELECT *, nbr / lag(nbr) OVER w - 1 AS nbr_g, bdep / lag(bdep) OVER w - 1 AS bdep_g FROM b1 WINDOW w AS (PARTITION BY entity ORDER BY year)),
st AS (SELECT state, year, sum(dep) / lag(sum(dep)) OVER (PARTITION BY state ORDER BY year) - 1 AS st_g FROM br GROUP BY state, year), ft AS (SELECT entity, year, sum(dep * st_g) / sum(dep) FILTER (st_g IS NOT NULL) AS foot FROM br JOIN st USING (state, year) GROUP BY ALL),
sod AS (SELECT b2.*, foot, make_date(year, 6, 30) + 120 AS avail FROM b2 LEFT JOIN ft USING (entity, year)), le AS (SELECT entity, make_date(year + 1, 4, 1) AS avail, sum(n) AS tn, coalesce(sum(n) FILTER (purpose = 'R'), 0) / sum(n) AS refi FROM ln_ GROUP BY entity, year),
cm0 AS (SELECT o_custkey % 100 AS entity, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY ALL), cm AS (SELECT entity, month, sum(n) OVER (PARTITION BY entity ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3 FROM cm0),
mc AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e8 / count(*) AS value FROM orders GROUP BY 1)
SELECT g2.entity || '_' || g2.q AS row_id, g2.entity, g2.q, CAST(g2.cutoff AS VARCHAR) AS cutoff, CASE WHEN nx < dep THEN 1e0 ELSE 0e0 END AS label, g1 AS s_dep_g, g4 AS s_dep_g_l4, gl1 AS s_dep_g_l1, gl2 AS s_dep_g_l2, ln(1 + asset) AS s_log_asset, g2.q % 4 + 1 AS s_qtr, peer AS r_peer_dep_g, nch AS r_hc_ncharters,
 sod.nbr AS r_sod_nbr, sod.nst AS r_sod_nst, sod.nbr_g AS r_sod_nbr_g, sod.bdep_g AS r_sod_bdep_g, sod.foot AS r_sod_foot_st_g, le.tn::BIGINT AS r_lend_n, le.refi AS r_lend_refi_share, cm.c3::BIGINT AS r_cmp_3m, m1.value AS r_macro, m1.value - m2.value AS r_macro_3m
FROM g2 JOIN hc USING (holdco, q) ASOF LEFT JOIN sod ON sod.entity = g2.entity AND g2.cutoff >= sod.avail ASOF LEFT JOIN le ON le.entity = g2.entity AND g2.cutoff >= le.avail LEFT JOIN cm ON cm.entity = g2.entity AND cm.month = date_trunc('month', g2.cutoff) - INTERVAL 1 MONTH
 ASOF LEFT JOIN mc m1 ON g2.cutoff >= m1.date ASOF LEFT JOIN (SELECT date + 91 AS date, value FROM mc) m2 ON g2.cutoff >= m2.date WHERE nx IS NOT NULL""",
       "label:0 s_dep_g s_dep_g_l4 s_dep_g_l1 s_dep_g_l2 s_log_asset r_peer_dep_g r_sod_nbr_g r_sod_bdep_g r_sod_foot_st_g r_lend_refi_share r_macro r_macro_3m")
def _(s, d):
    return deposit_task(s, d).withColumn("cutoff", F.col("cutoff").cast("string"))


def deposit_task(s, d):
    bank = supplier_panel(s, d).select("entity", "q", F.col("flow").alias("dep"), F.col("stock").alias("asset"), (F.col("entity") % 20).alias("holdco"))
    return TB.task_deposit_decline(bank, branches(s, d), lending(s, d), complaints(s, d), macro(s, d))


@query("task_branch_closure", f"""WITH {BR}, b AS (SELECT *, CAST(round(lat * 1000) AS BIGINT) || '_' || CAST(round(lon * 1000) AS BIGINT) AS k, CAST(round(lat / 5) AS BIGINT) || '_' || CAST(round(lon / 5) AS BIGINT) AS cell FROM br),
x AS (SELECT b.*, CASE WHEN EXISTS (SELECT 1 FROM b n WHERE n.entity = b.entity AND n.branch = b.branch AND n.year = b.year + 1) OR EXISTS (SELECT 1 FROM b n WHERE n.entity = b.entity AND n.k = b.k AND n.year = b.year + 1) THEN 0e0 ELSE 1e0 END AS label FROM b WHERE EXISTS (SELECT 1 FROM b n WHERE n.entity = b.entity AND n.year = b.year + 1)),
o AS (SELECT entity, branch, year, dep / lag(dep) OVER w - 1 AS g1, dep / lag(dep, 2) OVER w - 1 AS g2, row_number() OVER w - 1 AS age FROM br WINDOW w AS (PARTITION BY entity, branch ORDER BY year)), bk AS (SELECT entity, year, count(*) AS nbr, sum(dep) AS bdep, count(*) / lag(count(*)) OVER (PARTITION BY entity ORDER BY year) - 1 AS nbr_g FROM br GROUP BY entity, year),
pv AS (SELECT entity, year + 1 AS year, avg(label) AS pr FROM x GROUP BY ALL), hc AS (SELECT holdco, year, count(*) AS n, count(DISTINCT entity) AS nc FROM br GROUP BY ALL), cn AS (SELECT year, cell, count(*) AS n FROM b GROUP BY ALL), co AS (SELECT year, cell, entity, count(*) AS n FROM b GROUP BY ALL)
SELECT x.entity || '_' || x.branch || '_' || x.year AS row_id, x.entity, x.branch, x.year, CAST(make_date(x.year, 6, 30) + 120 AS VARCHAR) AS cutoff, label, g1 AS s_dep_g1, g2 AS s_dep_g2, age AS s_age_obs, bk.nbr AS r_bank_nbr, bk.bdep AS r_bank_dep, bk.nbr_g AS r_bank_nbr_g, pr AS r_prev_closure_rate, hc.n AS r_hc_nbr, hc.nc AS r_hc_ncert, x.dep / bk.bdep AS r_dep_share, cn.n - co.n AS r_cell_other_n, co.n - 1 AS r_cell_own_n, ln(1 + x.dep) AS s_log_dep
FROM x JOIN o USING (entity, branch, year) JOIN bk USING (entity, year) LEFT JOIN pv USING (entity, year) JOIN hc USING (holdco, year) JOIN cn USING (year, cell) JOIN co USING (year, cell, entity)""",
       "label:0 s_dep_g1 s_dep_g2 r_bank_dep:4 r_bank_nbr_g r_prev_closure_rate r_dep_share s_log_dep")
def _(s, d):
    return TB.task_branch_closure(branches(s, d)).withColumn("cutoff", F.col("cutoff").cast("string"))


SPK = "ct AS (SELECT o_custkey % 50 AS company, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS month, o_orderpriority AS product, count(*) AS n FROM orders WHERE o_orderdate < (SELECT date_trunc('month', CAST(max(o_orderdate) AS DATE) + 1) FROM orders) GROUP BY ALL)"


@query("task_spike", f"""WITH {SPK}, tt AS (SELECT company, month, sum(n)::BIGINT AS n FROM ct GROUP BY ALL), ms AS (SELECT unnest(generate_series((SELECT min(month) FROM tt), (SELECT max(month) FROM tt))) AS month), g AS (SELECT c.company, ms.month, coalesce(tt.n, 0) AS n FROM (SELECT DISTINCT company FROM tt) c CROSS JOIN ms LEFT JOIN tt USING (company, month)),
r AS (SELECT *, CASE WHEN count(n) OVER w6 >= 6 THEN median(n) OVER w6 END AS med6, CASE WHEN count(n) OVER w6 >= 6 THEN sum(n) OVER w6 END AS vol6, median(n) OVER w6 AS m6, avg(n) OVER w12 AS a12, max(n) OVER w6 AS mx6, lag(n, 1) OVER w AS l1, lag(n, 2) OVER w AS l2, lag(n, 3) OVER w AS l3, lag(n, 6) OVER w AS l6, lag(n, 12) OVER w AS l12, lead(n) OVER w AS nx FROM g
 WINDOW w AS (PARTITION BY company ORDER BY month), w6 AS (PARTITION BY company ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), w12 AS (PARTITION BY company ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
mk AS (SELECT product, month, sum(n) / lag(sum(n)) OVER w - 1 AS g1, sum(n) / lag(sum(n), 3) OVER w - 1 AS g3 FROM ct GROUP BY product, month WINDOW w AS (PARTITION BY product ORDER BY month)),
sh AS (SELECT company, month, product, n, n / sum(n) OVER (PARTITION BY company, month) AS w FROM ct), mx AS (SELECT company, month, sum(w * g1) AS a, sum(w * g3) AS b, sum(w * w) AS h, count(*) AS np, arg_min(product, (-n, product)) AS top FROM sh JOIN mk USING (product, month) GROUP BY ALL), am AS (SELECT month, sum(n)::BIGINT AS n, sum(n) / lag(sum(n)) OVER (ORDER BY month) - 1 AS g FROM tt GROUP BY month)
SELECT r.company || '_' || r.month AS row_id, r.company, r.month, CASE WHEN nx >= 2 * greatest(med6, 1) AND nx >= 3 THEN 1e0 ELSE 0e0 END AS label, mx6 AS s_max6, l1 AS s_lag1, l2 AS s_lag2, l3 AS s_lag3, l6 AS s_lag6, l12 AS s_lag12, r.n AS s_lag0, r.n / greatest(m6, 1) AS s_ratio_med6, r.n / greatest(a12, 1) AS s_ratio_mean12,
 mx.a AS r_mix_mkt_g, mx.b AS r_mix_mkt_g3, mx.h AS r_prod_hhi, mx.np AS r_nprod, mx.top AS r_top_product, am.n AS r_all_n, am.g AS r_all_g FROM r LEFT JOIN mx USING (company, month) LEFT JOIN am USING (month) WHERE vol6 >= 8 AND nx IS NOT NULL""",
       "label:0 s_ratio_med6 s_ratio_mean12 r_mix_mkt_g r_mix_mkt_g3 r_prod_hhi r_all_g")
def _(s, d):
    o = table(s, d, "orders")
    # a last month that is not over is left out
    wall = o.agg(F.date_trunc("month", F.date_add(F.max("o_orderdate"), 1))).scalar()
    ct = o.where(F.col("o_orderdate") < wall).groupBy((F.col("o_custkey") % 50).alias("company"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month"), F.col("o_orderpriority").alias("product")).agg(F.count(F.lit(1)).alias("n"))
    return TB.task_spike(ct, min_volume=8, floor=3)  # fifty companies over few orders


@query("task_share_drop", f"""WITH {LN}, a AS (SELECT entity AS lender, state, year, sum(n)::BIGINT AS n, sum(amount) AS amt FROM ln_ GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY state, year) AS share, sum(n) OVER (PARTITION BY lender, year) AS ltot, count(*) OVER (PARTITION BY lender, year) AS nst FROM a),
pp AS (SELECT entity AS lender, state, year, coalesce(sum(n) FILTER (purpose = 'A'), 0) / sum(n) AS pa, coalesce(sum(n) FILTER (purpose = 'N'), 0) / sum(n) AS pn, coalesce(sum(n) FILTER (purpose = 'R'), 0) / sum(n) AS pr FROM ln_ GROUP BY ALL), mk AS (SELECT state, year, sum(n) / lag(sum(n)) OVER (PARTITION BY state ORDER BY year) - 1 AS g FROM ln_ GROUP BY state, year)
SELECT s.lender || '_' || s.state || '_' || s.year AS row_id, s.lender, s.state, s.year, CAST(make_date(s.year + 1, 4, 1) AS VARCHAR) AS cutoff, CASE WHEN coalesce(x.share, 0) < 75e-2 * s.share THEN 1e0 ELSE 0e0 END AS label, p.share AS s_share_prev, p.n AS s_n_prev, s.share AS s_share, ln(1 + s.n) AS s_log_n, s.share / p.share - 1 AS s_share_g, s.amt / s.n AS s_avg_amt, pa AS s_purp_a, pn AS s_purp_n, pr AS s_purp_r,
 s.nst AS r_nstates, mk.g AS r_mkt_g, s.n / s.ltot AS r_state_share, ln(1 + s.ltot) AS r_log_lender_n FROM s LEFT JOIN s x ON x.lender = s.lender AND x.state = s.state AND x.year = s.year + 1 LEFT JOIN s p ON p.lender = s.lender AND p.state = s.state AND p.year = s.year - 1 JOIN pp ON pp.lender = s.lender AND pp.state = s.state AND pp.year = s.year JOIN mk ON mk.state = s.state AND mk.year = s.year
WHERE s.year < (SELECT max(year) FROM ln_) AND s.n >= 5""", "label:0 s_share_prev:8 s_share:8 s_log_n s_share_g s_avg_amt s_purp_a s_purp_n s_purp_r r_mkt_g r_state_share r_log_lender_n")
def _(s, d):
    return TB.task_share_drop(lending(s, d).withColumnRenamed("entity", "lender"), ["A", "N", "R"], min_n=5).withColumn("cutoff", F.col("cutoff").cast("string"))


HLD = f"hd AS (SELECT l_suppkey % 50 AS holdco, l_partkey % 8 AS state, CAST(year(l_shipdate) AS BIGINT) AS year, CAST(sum({CENTS}) AS DOUBLE) / 1e4 AS dep FROM lineitem GROUP BY ALL)"


@query("task_growth_regression", f"""WITH {HLD}, hc AS (SELECT holdco, year, sum(dep) AS t, count(*) AS ns FROM hd GROUP BY ALL), st AS (SELECT state, year, sum(dep) AS sd FROM hd GROUP BY ALL)
SELECT h.holdco || '_' || h.state || '_' || h.year AS row_id, h.holdco, h.state, h.year, CAST(make_date(h.year, 6, 30) + 120 AS VARCHAR) AS cutoff, greatest(-1, least(1, ln(n.dep / h.dep))) AS label, ln(h.dep) AS s_log_dep, CASE WHEN p.dep IS NOT NULL THEN greatest(-3, least(3, ln(h.dep / p.dep))) END AS s_g1, CASE WHEN p.dep IS NOT NULL AND p2.dep IS NOT NULL THEN greatest(-3, least(3, ln(p.dep / p2.dep))) END AS s_g2,
 hc.ns AS r_hc_nstates, CASE WHEN hp.t IS NOT NULL THEN greatest(-3, least(3, ln(hc.t / hp.t))) END AS r_hc_g, ln(hc.t) AS r_hc_log_tot, CASE WHEN sp.sd IS NOT NULL THEN ln(st.sd / sp.sd) END AS r_state_g, h.dep / hc.t AS r_state_share
FROM hd h JOIN hd n ON n.holdco = h.holdco AND n.state = h.state AND n.year = h.year + 1 LEFT JOIN hd p ON p.holdco = h.holdco AND p.state = h.state AND p.year = h.year - 1 LEFT JOIN hd p2 ON p2.holdco = h.holdco AND p2.state = h.state AND p2.year = h.year - 2 JOIN hc ON hc.holdco = h.holdco AND hc.year = h.year LEFT JOIN hc hp ON hp.holdco = h.holdco AND hp.year = h.year - 1
 JOIN st ON st.state = h.state AND st.year = h.year LEFT JOIN st sp ON sp.state = h.state AND sp.year = h.year - 1 WHERE h.dep >= 1e4 AND n.dep > 0""", "label:7 s_log_dep:7 s_g1:7 s_g2:7 r_hc_g:7 r_hc_log_tot:7 r_state_g:7 r_state_share:7")
def _(s, d):
    h = table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("holdco"), (F.col("l_partkey") % 8).alias("state"), F.year("l_shipdate").alias("year")).agg((F.sum(line_units()).cast("double") / 10000.0).alias("dep"))
    return TB.task_growth_regression(h, 1e4).withColumn("cutoff", F.col("cutoff").cast("string"))


@query("build_relational_db", f"""WITH {SP}, {BR}, {LN} SELECT 'bank_quarter' AS table_name, count(*) AS n_rows, count(DISTINCT (entity, q)) AS n_keys FROM sp UNION ALL SELECT 'branch_year', count(*), count(DISTINCT (entity, branch, year)) FROM br UNION ALL SELECT 'lending', count(*), count(DISTINCT (entity, state, year, purpose)) FROM ln_""")
def _(s, d):
    """Write every table once, read it back, and take its inventory."""
    from tidemark.sources.writers import table_inventory

    root = scratch_path(s, "db")
    tabs = {"bank_quarter": (supplier_panel(s, d), ["entity", "q"]), "branch_year": (branches(s, d), ["entity", "branch", "year"]), "lending": (lending(s, d), ["entity", "state", "year", "purpose"])}
    out = {}
    for name, (df, keys) in tabs.items():
        df.write.parquet(f"{root}/{name}")
        out[name] = (s.read.schema(df.schema).parquet(f"{root}/{name}"), keys, None)
    return table_inventory(out).select("table_name", "n_rows", "n_keys")


@query("panel_build", f"""WITH {CY}, l AS (SELECT *, max(ytd) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev FROM cy), f AS (SELECT entity, q, ytd, CASE WHEN q % 4 = 0 THEN ytd ELSE ytd - prev END AS flow_q FROM l)
SELECT entity, q, 'ytd' AS item, ytd AS value FROM f UNION ALL SELECT entity, q, 'flow_q', flow_q FROM f""", "value:2")
def _(s, d):
    """YTD text -> key check -> quarterly flow -> wide and long tables -> the long table."""
    from tidemark.operators.calendar import decumulate
    from tidemark.sources.writers import write_parquet_long_wide

    p = Q.assert_unique_key(customer_ytd(s, d).select("entity", "q", "ytd"), ["entity", "q"])
    root = scratch_path(s, "build")
    write_parquet_long_wide(decumulate(p), root, ids=["entity", "q"], values=["ytd", "flow_q"])
    return s.read.parquet(f"{root}/wide").select("entity", "q", "ytd", "flow_q").unpivot(["entity", "q"], ["ytd", "flow_q"], "item", "value")


def _zipped_filings(s, d):
    """The year-to-date panel as one ZIP per quarter with two members, each with a header and a description line."""
    from tidemark.functions.periods import quarter_end
    from tidemark.plans.sources import HEADER
    from tidemark.sources.archives import write_zips
    from tidemark.sources.readers import MISSING

    p = customer_ytd(s, d)
    ytd = F.when(F.col("n") > 1, F.col("ytd").cast("decimal(20,2)").cast("string")).otherwise(F.lit(MISSING))
    line = F.concat_ws("^", F.col("entity").cast("string"), F.date_format(quarter_end("q"), "yyyyMMdd"), ytd, F.col("n").cast("string"), F.lit('café "x"'))
    rows = p.select(F.concat(F.lit("q="), F.col("q").cast("string")).alias("archive"), F.concat(F.lit("part"), (F.col("entity") % 2).cast("string"), F.lit(".txt")).alias("member"), line.alias("line"))
    root = scratch_path(s, "filings")
    done = write_zips(rows, root, archive="archive", member="member", header=["^".join(HEADER), "id text^date^amount^count^free"])
    return root, done


FZ = f"""{CY}, z AS (SELECT entity, q, CASE WHEN n > 1 THEN ytd END AS ytd FROM cy), fl AS (SELECT entity, q, ytd, max(ytd) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev FROM z),
fq AS (SELECT entity, q, ytd, CASE WHEN q % 4 = 0 THEN ytd ELSE ytd - prev END AS flow_q FROM fl)"""


def _filed_panel(s, d):
    from tidemark.operators.calendar import decumulate
    from tidemark.plans.sources import HEADER
    from tidemark.sources import readers as RD

    root, _ = _zipped_filings(s, d)
    raw = RD.read_caret_zip(s, root, items=["ytd"], ids=["entity", "report_date", "file_q"], entity="entity", header=HEADER)
    raw = RD.check_file_period(raw.withColumn("q", quarter_index(F.to_date("report_date", "yyyyMMdd"))), file_period="file_q", row_period="q")
    return decumulate(Q.assert_unique_key(raw.select("entity", F.col("q").cast("long").alias("q"), "ytd"), ["entity", "q"]))


@query("panel_from_archives", f"WITH {FZ} SELECT entity, q, ytd, flow_q FROM fq", "ytd:2 flow_q:2")
def _(s, d):
    """Archives of filings, written from the orders, read back member by member, checked and decumulated."""
    return _filed_panel(s, d).select("entity", "q", "ytd", "flow_q")


@query("panel_coverage", f"""WITH {FZ} SELECT q, count(*) AS n_records, count(ytd) AS n_ytd, count(flow_q) AS n_flow, count(*) FILTER (flow_q < 0) AS n_negative, count(*) FILTER (ytd IS NOT NULL AND flow_q IS NULL) AS n_missing_prior,
(SELECT min(v) FROM (SELECT ytd AS v FROM fq b WHERE b.q = a.q AND ytd IS NOT NULL ORDER BY ytd DESC LIMIT 50)) AS top50_cutoff FROM fq a GROUP BY q""", "top50_cutoff:2")
def _(s, d):
    """Coverage of every filed quarter: records, values, flows, negative flows, flows without a prior, the fiftieth largest value."""
    from tidemark.operators.calendar import topk_per_group
    from tidemark.session import cut_lineage

    p = cut_lineage(_filed_panel(s, d), "panel")
    cut = topk_per_group(p.where("ytd IS NOT NULL"), by="q", value="ytd", k=50).groupBy("q").agg(F.min("ytd").alias("top50_cutoff"))
    yes = lambda c: F.count(F.when(c, 1))
    g = p.groupBy("q").agg(F.count(F.lit(1)).alias("n_records"), F.count("ytd").alias("n_ytd"), F.count("flow_q").alias("n_flow"), yes(F.col("flow_q") < 0).alias("n_negative"), yes(F.col("ytd").isNotNull() & F.col("flow_q").isNull()).alias("n_missing_prior"))
    return g.join(cut, "q", "left")


@query("panel_vintage", f"WITH {CY} SELECT 'q=' || q || '.zip' AS file, count(DISTINCT entity % 2) AS n_members, count(*) AS n_lines FROM cy GROUP BY q")
def _(s, d):
    """What was filed: members and lines of every archive."""
    return _zipped_filings(s, d)[1]


@query("prepare_panel", f"""WITH {SP}, l AS (SELECT *, max(stock) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS p FROM sp), r AS (SELECT entity, q, stock, CASE WHEN NOT coalesce(q % 4 > 0 AND stock < p, FALSE) THEN flow END AS flow FROM l)
SELECT entity, q, CASE WHEN q > 7983 THEN flow END AS flow, CASE WHEN q >= 7983 THEN stock END AS stock FROM r WHERE NOT (entity % 9 = 4 AND q = 7990)""", "flow:4 stock:0")
def _(s, d):
    p = supplier_panel(s, d)
    return TB.prepare_panel(p, guard="stock", flow="flow", listed=p.where("entity % 9 = 4 AND q = 7990"), last_presample=7983, keep=["stock"], values=["flow", "stock"]).select("entity", "q", "flow", "stock")


@query("industry_total_series", f"WITH {SP} SELECT 'total' AS entity, q, sum(flow) AS flow FROM sp GROUP BY q", "flow:4")
def _(s, d):
    return TB.industry_total_series(supplier_panel(s, d), value="flow")


@query("adjusted_target", f"WITH {SP} SELECT entity, q, CASE WHEN stock >= 600 AND q >= 7990 THEN flow - n - stock ELSE flow END AS adjusted FROM sp", "adjusted:4")
def _(s, d):
    return TB.adjusted_target(supplier_panel(s, d), value="flow", parts=["n", "stock"], size="stock", min_size=600.0, first=7990).select("entity", "q", "adjusted")


@query("sensitivity_sweep", f"""WITH {DIFF}, v AS (SELECT 'all' AS variant, * FROM dd UNION ALL SELECT 'late', * FROM dd WHERE target >= 7996 UNION ALL SELECT 'early', * FROM dd WHERE target <= 7995 UNION ALL SELECT 'no_shock', * FROM dd WHERE target NOT IN (7992, 8000) UNION ALL SELECT 'large', * FROM dd WHERE s_ref >= 5),
p AS (SELECT variant, target, avg(s_ref) AS r, avg(s_alt) AS a, count(*) AS n FROM v GROUP BY ALL) SELECT variant, sum(r - a) / sum(r) AS gain, count(*) AS n_targets, sum(n)::BIGINT AS n_cases FROM p GROUP BY variant""", "gain:7")
def _(s, d):
    return TB.sensitivity_sweep(losses(s, d), {"all": {}, "late": {"first": 7996}, "early": {"last": 7995}, "no_shock": {"drop": [7992, 8000]}, "large": {"min_ref": 5.0}})


@query("outlier_table", f"""WITH {DIFF} SELECT entity, target, 100 * abs((naive - actual) / actual) AS ape, s_name FROM cases JOIN supplier ON s_suppkey = entity ORDER BY 3 DESC, entity, target LIMIT 10""", "ape:6")
def _(s, d):
    c = cases(s, d).withColumn("forecast", F.col("naive"))
    return TB.outlier_table(c, table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"), "s_name"), key="entity").select("entity", "target", "ape", "s_name")


@query("ledger_score", f"WITH {MIX} SELECT kind, m + 1 AS target, sum(w * (a - b) * (a - b)) AS w2 FROM st GROUP BY ALL", "w2:9")
def _(s, d):
    """Persistence forecasts in a ledger joined to their outcomes and scored."""
    from tidemark.plans.distribution import weekly_mix

    mix = weekly_mix(s, d)
    fc = mix.select("kind", (F.col("m") + 1).alias("target"), F.col("p").alias("forecast"))
    out = mix.select("kind", F.col("m").alias("target"), F.col("p").alias("outcome"))
    return D.w2sq_discrete(fc.join(out, ["kind", "target"]), "forecast", "outcome", _xpos(), "w2").select("kind", "target", "w2")


RUNGS = [("boosted_relational", "boosted_own"), ("linear_relational", "linear_own")]


@query("gbt_baseline_ladder")
def _(s, d):
    """Deposit decline: area under the curve of six rungs with joint intervals, and paired differences of all to own features."""
    from tidemark.operators import ladder as L
    from tidemark.session import cut_lineage

    t = cut_lineage(deposit_task(s, d), "task").withColumn("split", F.when(F.col("q") < 7998, "train").otherwise("val"))
    preds = L.ladder_predictions(t, kind="clf", entity="entity", naive=-F.coalesce("s_dep_g", F.lit(0.0)), iters=5)
    return L.ladder_scores(preds, kind="clf", pairs=RUNGS)


@query("growth_baseline_ladder")
def _(s, d):
    """Growth of holdings by state: mean absolute error of seven rungs with joint intervals, and paired differences."""
    from tidemark.operators import ladder as L
    from tidemark.session import cut_lineage

    h = table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("holdco"), (F.col("l_partkey") % 8).alias("state"), F.year("l_shipdate").alias("year")).agg((F.sum(line_units()).cast("double") / 10000.0).alias("dep"))
    t = cut_lineage(TB.task_growth_regression(h, 1e4), "task")
    years = [r[0] for r in t.select("year").distinct().orderBy("year").collect()]
    t = t.withColumn("split", F.when(F.col("year") < years[-2], "train").otherwise("val"))
    last = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("s_g1", F.lit(0.0))))
    preds = L.ladder_predictions(t, kind="reg", entity="holdco", naive=F.lit(0.0), last=last, iters=5)
    return L.ladder_scores(preds, kind="reg", pairs=RUNGS)


@query("ladder_naive_scores", f"""WITH {SP}, g AS (SELECT entity, q, flow / nullif(lag(flow) OVER w, 0) - 1 AS g, lead(flow) OVER w < flow AS y FROM sp WINDOW w AS (PARTITION BY entity ORDER BY q)), v AS (SELECT q, -coalesce(g, 0) AS s, y FROM g WHERE y IS NOT NULL AND q >= 7998)
SELECT 'naive' AS model, (SELECT sum(CASE WHEN p.s > n.s THEN 1e0 WHEN p.s = n.s THEN 5e-1 ELSE 0e0 END) / count(*) FROM v p JOIN v n ON p.y AND NOT n.y) AS value""", "value:8")
def _(s, d):
    """The naive rung alone, from stored predictions."""
    from tidemark.operators import ladder as L
    from tidemark.session import cut_lineage

    t = cut_lineage(deposit_task(s, d), "task").where("q >= 7998")
    preds = t.select("row_id", F.col("entity").cast("string").alias("entity"), F.lit("naive").alias("model"), "label", (-F.coalesce("s_dep_g", F.lit(0.0))).alias("score"))
    return L.auc_replicates(cut_lineage(preds, "predictions"), reps=1).select("model", "value")


@query("register_forecaster", f"""WITH {SP}, h AS (SELECT entity, q, flow, avg(flow) OVER (PARTITION BY entity ORDER BY q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS f FROM sp) SELECT entity, q AS origin, f AS forecast FROM h""", "forecast:3")
def _(s, d):
    """A user-supplied model over every (entity, origin) history: grouped map on calendar-bounded groups."""
    from tidemark.operators.callbacks import register_forecaster
    from tidemark.session import cut_lineage

    def last_four(history):
        return float(history["value"].tail(4).mean())

    p = cut_lineage(supplier_panel(s, d).select("entity", "q", "flow"), "panel")
    r = p.agg(F.min("q").alias("lo"), F.max("q").alias("hi")).first()
    every = register_forecaster(p, last_four, origins=list(range(r.lo, r.hi + 1)), value="flow")
    return every.join(p.select("entity", F.col("q").alias("origin")), ["entity", "origin"], "left_semi")

"""Section 2.5 and 2.6 queries: windows, sorts and set operations on the stand-in panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.periods import week_ending
from tidemark.operators import calendar as C
from tidemark.operators import ranks as R
from tidemark.plans.bindings import (
    BM, CP, CY, DE, SP, brand_mix, customer_panel, customer_ytd, daily_events, supplier_panel, table,
)
from tidemark.plans.registry import query

LAG = "max({v}) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)"


@query("decumulate", f"""
WITH {CY}, l AS (SELECT *, {LAG.format(v='ytd', k=1)} AS prev FROM cy)
SELECT entity, q, ytd, CASE WHEN q % 4 = 0 THEN ytd ELSE ytd - prev END AS flow_q,
       CAST(q % 4 <> 0 AND prev IS NULL AS INT) AS missing_prior FROM l""", "ytd:2 flow_q:2")
def _(s, d):
    return C.decumulate(customer_ytd(s, d)).select("entity", "q", "ytd", "flow_q", F.col("missing_prior").cast("int"))


@query("entrant_rule", f"""
WITH {CY}, l AS (SELECT *, {LAG.format(v='ytd', k=1)} AS prev, min(q) OVER (PARTITION BY entity) AS q0 FROM cy)
SELECT entity, q, CASE WHEN q % 4 = 0 OR q = q0 THEN ytd ELSE ytd - prev END AS flow_b FROM l""", "flow_b:2")
def _(s, d):
    return C.entrant_rule(C.decumulate(customer_ytd(s, d))).select("entity", "q", "flow_b")


@query("ytd_reset_guard", f"""
WITH {SP}, l AS (SELECT *, {LAG.format(v='stock', k=1)} AS prev FROM sp),
f AS (SELECT *, coalesce(q % 4 > 0 AND stock < prev, FALSE) AS r FROM l)
SELECT entity, q, CAST(r AS INT) AS ytd_reset_flag, CASE WHEN NOT r THEN flow END AS flow FROM f""", "flow:4")
def _(s, d):
    return C.ytd_reset_guard(supplier_panel(s, d), guard="stock", flows=["flow"]).select(
        "entity", "q", F.col("ytd_reset_flag").cast("int"), "flow")


@query("discontinuity_flags", f"""
WITH {SP}, l AS (SELECT entity, q, flow - {LAG.format(v='flow', k=1)} AS d FROM sp),
w AS (SELECT *, count(*) OVER y AS seen, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) OVER y AS pos FROM l
      WINDOW y AS (PARTITION BY entity, q // 4 ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT entity, q, CAST(coalesce(d < 0, FALSE) AS INT) AS negative_flow,
       CAST(coalesce(d < 0, FALSE) AND seen > 0 AND coalesce(pos, 0) = seen AS INT) AS sign_break FROM w""")
def _(s, d):
    p = supplier_panel(s, d)
    p = p.withColumn("change", F.col("flow") - C.lag_at("flow", 1))
    return C.discontinuity_flags(p, flow="change").select(
        "entity", "q", F.col("negative_flow").cast("int"), F.col("sign_break").cast("int"))


@query("calendar_lag", f"""
WITH {CP} SELECT entity, q, flow, {LAG.format(v='flow', k=1)} AS flow_lag1, {LAG.format(v='flow', k=4)} AS flow_lag4,
  max(flow) OVER (PARTITION BY entity ORDER BY q RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS flow_lead1
FROM cp""", "flow:2 flow_lag1:2 flow_lag4:2 flow_lead1:2")
def _(s, d):
    return C.calendar_lag(customer_panel(s, d), value="flow", lags=[1, 4, -1]).drop("n")


@query("row_lag_lead", f"""
WITH {SP} SELECT entity, q, lag(flow) OVER w AS flow_prev, lead(flow) OVER w AS flow_next
FROM sp WINDOW w AS (PARTITION BY entity ORDER BY q)""", "flow_prev:4 flow_next:4")
def _(s, d):
    return C.row_lag_lead(supplier_panel(s, d), value="flow").select("entity", "q", "flow_prev", "flow_next")


@query("pct_change_k", f"""
WITH {SP} SELECT entity, q, flow / lag(flow) OVER w - 1 AS flow_g1, flow / lag(flow, 4) OVER w - 1 AS flow_g4
FROM sp WINDOW w AS (PARTITION BY entity ORDER BY q)""", "flow_g1 flow_g4")
def _(s, d):
    return C.pct_change_k(supplier_panel(s, d), value="flow", ks=[1, 4]).select("entity", "q", "flow_g1", "flow_g4")


@query("log_growth", f"""
WITH {CP}, l AS (SELECT *, {LAG.format(v='flow', k=1)} AS p FROM cp)
SELECT entity, q, CASE WHEN flow > 0 AND p > 0 THEN ln(flow) - ln(p) END AS g FROM l""", "g")
def _(s, d):
    return C.log_growth(customer_panel(s, d), value="flow").select("entity", "q", "g")


@query("rolling_stat", f"""
WITH {CP} SELECT entity, q,
  CASE WHEN count(flow) OVER w3 >= 1 THEN sum(flow) OVER w3 END AS flow_sum3,
  CASE WHEN count(flow) OVER w6 >= 6 THEN median(flow) OVER w6 END AS flow_median6,
  CASE WHEN count(flow) OVER w12 >= 1 THEN avg(flow) OVER w12 END AS flow_mean12,
  CASE WHEN count(flow) OVER w6 >= 1 THEN max(flow) OVER w6 END AS flow_max6
FROM cp WINDOW w3 AS (PARTITION BY entity ORDER BY q ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  w6 AS (PARTITION BY entity ORDER BY q ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
  w12 AS (PARTITION BY entity ORDER BY q ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
       "flow_sum3:2 flow_median6:4 flow_mean12:5 flow_max6:2")
def _(s, d):
    p = customer_panel(s, d)
    p = C.rolling_stat(p, value="flow", n=3, stat="sum", min_periods=1)
    p = C.rolling_stat(p, value="flow", n=6, stat="median")
    p = C.rolling_stat(p, value="flow", n=12, stat="mean", min_periods=1)
    return C.rolling_stat(p, value="flow", n=6, stat="max", min_periods=1).drop("flow", "n")


@query("trailing_median_ratio", f"""
WITH {SP} SELECT entity, q, flow / nullif(CASE WHEN count(flow) OVER w >= 8 THEN median(flow) OVER w END, 0) AS ratio
FROM sp WINDOW w AS (PARTITION BY entity ORDER BY q ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""", "ratio")
def _(s, d):
    return C.trailing_median_ratio(supplier_panel(s, d), value="flow", n=12, min_periods=8).select("entity", "q", "ratio")


@query("local_maximum", f"""
WITH {SP} SELECT entity, q, CAST(flow = max(flow) OVER (PARTITION BY entity ORDER BY q
  ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS INT) AS is_peak FROM sp""")
def _(s, d):
    return C.local_maximum(supplier_panel(s, d), value="flow").select("entity", "q", F.col("is_peak").cast("int"))


@query("cumcount_age", f"""
WITH {CP} SELECT entity, q, row_number() OVER (PARTITION BY entity ORDER BY q) - 1 AS age FROM cp""")
def _(s, d):
    return C.cumcount_age(customer_panel(s, d)).select("entity", "q", "age")


@query("topk_per_group", f"""
WITH {CP}, r AS (SELECT entity, q, flow, row_number() OVER (PARTITION BY q ORDER BY flow DESC, entity) AS rank FROM cp)
SELECT * FROM r WHERE rank <= 50""", "flow:2")
def _(s, d):
    return C.topk_per_group(customer_panel(s, d), by="q", value="flow", k=50).drop("n")


@query("nlargest", f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""", "o_totalprice:2")
def _(s, d):
    return C.nlargest(table(s, d, "orders").select("o_orderkey", "o_totalprice"), value="o_totalprice", n=25, tie="o_orderkey")


@query("rank_average", """
SELECT l_orderkey, l_linenumber, l_returnflag, avg(r) OVER (PARTITION BY l_returnflag, l_quantity) AS rank,
  (avg(r) OVER (PARTITION BY l_returnflag, l_quantity) - 0.5e0) / count(*) OVER (PARTITION BY l_returnflag) AS pct
FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r FROM lineitem)""", "rank:1 pct")
def _(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return R.rank_average(df, ["l_returnflag"], "l_quantity", "rank", "pct").drop("l_quantity")


@query("quintile_symbols", """
SELECT o_orderkey, o_orderpriority, ntile(5) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS symbol
FROM orders""")
def _(s, d):
    df = table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return R.quintile_symbols(df, ["o_orderpriority"], "o_totalprice", "o_orderkey").drop("o_totalprice")


@query("standardise", f"""
WITH {CP} SELECT entity, q, (flow - avg(flow) OVER w) / nullif(stddev_samp(flow) OVER w, 0) AS z,
  (n - avg(n) OVER w) / nullif(stddev_pop(n) OVER w, 0) AS zp FROM cp WINDOW w AS (PARTITION BY q)""", "z zp")
def _(s, d):
    p = C.standardise(customer_panel(s, d), by=["q"], value="flow")
    return C.standardise(p, by=["q"], value="n", ddof=0, out="zp").select("entity", "q", "z", "zp")


@query("exp_smoothing", f"""
WITH {CP}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY q) AS j FROM cp)
SELECT a.entity, a.q, sum(ln(b.flow) * CASE WHEN b.j = 1 THEN pow(0.7e0, a.j - 1) ELSE 0.3e0 * pow(0.7e0, a.j - b.j) END) AS level
FROM o a JOIN o b ON a.entity = b.entity AND b.j <= a.j GROUP BY ALL""", "level:8")
def _(s, d):
    return C.exp_smoothing(customer_panel(s, d).withColumn("lf", F.log("flow")), value="lf").select("entity", "q", "level")


@query("running_max_step", """
SELECT l_quantity, max(max(l_extendedprice)) OVER (ORDER BY l_quantity) AS ceiling FROM lineitem GROUP BY l_quantity""", "ceiling:2")
def _(s, d):
    return C.running_max_step(table(s, d, "lineitem"), keys=[], x="l_quantity", y="l_extendedprice")


@query("expanding_mean", f"""
WITH {DE} SELECT series, CAST(date AS VARCHAR) AS date, avg(value) OVER (PARTITION BY series ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS climatology FROM de""", "climatology")
def _(s, d):
    return C.expanding_mean(daily_events(s, d), value="value", by=["series"], order="date").select(
        "series", F.col("date").cast("string"), "climatology")


@query("gap_interpolate", f"""
WITH {CP}, qs AS (SELECT unnest(generate_series((SELECT min(q) FROM cp), (SELECT max(q) FROM cp))) AS q),
g AS (SELECT e.entity, qs.q, cp.flow FROM (SELECT DISTINCT entity FROM cp) e, qs LEFT JOIN cp ON cp.entity = e.entity AND cp.q = qs.q),
b AS (SELECT *, last_value(flow IGNORE NULLS) OVER p AS lv, first_value(flow IGNORE NULLS) OVER n AS rv,
  last_value(CASE WHEN flow IS NOT NULL THEN q END IGNORE NULLS) OVER p AS li,
  first_value(CASE WHEN flow IS NOT NULL THEN q END IGNORE NULLS) OVER n AS ri FROM g
  WINDOW p AS (PARTITION BY entity ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         n AS (PARTITION BY entity ORDER BY q ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT entity, q, coalesce(flow, CASE WHEN q - li = 1 THEN lv + (rv - lv) / (ri - li) END) AS flow FROM b""", "flow:5")
def _(s, d):
    from tidemark.operators.joins import cross_join_grid

    p = customer_panel(s, d).select("entity", "q", "flow")
    return C.gap_interpolate(cross_join_grid(p, entity="entity", period="q"), value="flow")


@query("calendar_mask_interpolate", f"""
WITH {DE}, m AS (SELECT *, CASE WHEN isodow(date) < 6 THEN value END AS v,
  row_number() OVER (PARTITION BY series ORDER BY date) AS i FROM de),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS lv, first_value(v IGNORE NULLS) OVER n AS rv,
  last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS li,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ri FROM m
  WINDOW p AS (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         n AS (PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, CAST(date AS VARCHAR) AS date, coalesce(v, lv + (rv - lv) * (i - li) / nullif(ri - li, 0)) AS filled FROM b""", "filled")
def _(s, d):
    e = daily_events(s, d).withColumn("weekend", F.weekday("date") >= 5)
    return C.calendar_mask_interpolate(e, value="value", mask="weekend", out="filled", entity="series", period="date").select(
        "series", F.col("date").cast("string"), "filled")


@query("forward_fill_limit", f"""
WITH {CP}, qs AS (SELECT unnest(generate_series((SELECT min(q) FROM cp), (SELECT max(q) FROM cp))) AS q),
g AS (SELECT e.entity, qs.q, cp.flow FROM (SELECT DISTINCT entity FROM cp) e, qs LEFT JOIN cp ON cp.entity = e.entity AND cp.q = qs.q)
SELECT entity, q, last_value(flow IGNORE NULLS) OVER (PARTITION BY entity ORDER BY q ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS flow FROM g""", "flow:2")
def _(s, d):
    from tidemark.operators.joins import cross_join_grid

    p = customer_panel(s, d).select("entity", "q", "flow")
    return C.forward_fill_limit(cross_join_grid(p, entity="entity", period="q"), value="flow")


@query("cyclic_shift", f"""
WITH {SP}, i AS (SELECT entity, q, flow, q - min(q) OVER () AS i, max(q) OVER () - min(q) OVER () + 1 AS n FROM sp)
SELECT a.entity, a.q, b.flow AS shifted FROM i a JOIN i b ON a.entity = b.entity AND a.i = (b.i + 5) % b.n""", "shifted:4")
def _(s, d):
    p = supplier_panel(s, d)
    span = p.agg(F.min("q").alias("lo"), F.max("q").alias("hi")).first()
    p = p.withColumn("i", F.col("q") - span["lo"])
    return C.cyclic_shift(p, by=["entity"], index="i", value="flow", shift=5, n=span["hi"] - span["lo"] + 1).select("entity", "q", "shifted")


@query("multi_key_sort", """
SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS pos FROM orders""")
def _(s, d):
    w = Window.partitionBy("o_custkey", "_s").orderBy(F.col("o_orderpriority"), F.col("o_totalprice").desc(), F.col("o_orderkey"))
    o = table(s, d, "orders")
    # the leading sort key has few values: position = rows in earlier classes + position inside the class
    o = o.withColumn("_s", F.col("o_orderpriority"))
    cls = o.groupBy("o_custkey", "_s").agg(F.count(F.lit(1)).alias("_n"))
    off = cls.select("o_custkey", "_s", F.coalesce(F.sum("_n").over(
        Window.partitionBy("o_custkey").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return o.join(off, ["o_custkey", "_s"]).select("o_orderkey", "o_orderpriority", (F.col("_o") + F.row_number().over(w)).alias("pos"))


@query("union_all", """
SELECT 'order' AS kind, o_custkey AS k, o_totalprice AS v FROM orders
UNION ALL SELECT 'line', l_suppkey, l_extendedprice FROM lineitem""", "v:2")
def _(s, d):
    a = table(s, d, "orders").select(F.lit("order").alias("kind"), F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = table(s, d, "lineitem").select(F.col("l_extendedprice").alias("v"), F.col("l_suppkey").alias("k"), F.lit("line").alias("kind"))
    return a.unionByName(b)


@query("set_intersection", """
SELECT c_custkey AS k FROM customer INTERSECT SELECT l_suppkey FROM lineitem""")
def _(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("k")).intersect(table(s, d, "lineitem").select("l_suppkey"))


@query("set_difference", """
SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1999-01-01'""")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    return c.join(table(s, d, "orders").where("o_orderdate >= DATE'1999-01-01'").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("argmin_tie_low", f"""
WITH {CP} SELECT entity, min(q) AS q, min(flow) AS flow FROM (
  SELECT *, rank() OVER (PARTITION BY entity ORDER BY flow) AS r FROM cp) WHERE r = 1 GROUP BY entity""", "flow:2")
def _(s, d):
    from tidemark.operators.aggregates import argmin_tie_low

    return argmin_tie_low(customer_panel(s, d), keys=["entity"], loss="flow", order="q")


@query("ewma_mix", f"""
WITH {BM}, sh AS (SELECT period, part, amount / sum(amount) OVER (PARTITION BY period) AS share FROM bm),
o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY period) AS j FROM sh)
SELECT a.period, a.part, sum(b.share * CASE WHEN b.j = 1 THEN pow(0.8e0, a.j - 1) ELSE 0.2e0 * pow(0.8e0, a.j - b.j) END) AS ewma,
  CASE WHEN a.j >= 4 THEN sum(CASE WHEN b.j > a.j - 4 THEN b.share END) / 4 END AS ma4
FROM o a JOIN o b ON a.part = b.part AND b.j <= a.j GROUP BY a.period, a.part, a.j""", "ewma:9 ma4:9")
def _(s, d):
    from tidemark.operators.composition import close_shares

    sh = close_shares(brand_mix(s, d)).drop("amount")
    sh = C.exp_smoothing(sh, value="share", alpha=0.2, out="ewma", entity="part", period="period")
    w = Window.partitionBy("part").orderBy("period").rowsBetween(-3, 0)
    return sh.select("period", "part", "ewma", F.when(F.count("share").over(w) == 4, F.avg("share").over(w)).alias("ma4"))

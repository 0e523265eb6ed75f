"""Section 2.2, 2.3, 2.4, 2.7 and 2.12 queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import holidays as H
from tidemark.functions import periods as P
from tidemark.functions import scalars as S
from tidemark.functions import text as X
from tidemark.functions.arrays import interp
from tidemark.functions.hashing import hash_key
from tidemark.operators import aggregates as A
from tidemark.operators import joins as J
from tidemark.operators import quality as Q
from tidemark.operators import ranks as R
from tidemark.operators.calendar import decumulate, lag_at, running_ytd
from tidemark.plans.bindings import (
    BM, CP, CY, DE, SM, SP, SQ, brand_mix, customer_panel, customer_ytd, daily_events, line_units, segment_mix, supplier_panel, table,
)
from tidemark.plans.registry import query
from tidemark.plans.windows import LAG

# ---------------------------------------------------------------- 2.2


@query("cast_strict", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(s, d):
    # an ANSI cast: text that is not a number fails the query
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("cast_coercing", """SELECT doc_id, TRY_CAST(substr(text, 1, 1) AS INTEGER) AS lead_digit, TRY_CAST(lang AS DOUBLE) IS NULL AS is_text FROM documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.substring("text", 1, 1).try_cast("int").alias("lead_digit"), F.col("lang").try_cast("double").isNull().alias("is_text"))


ITEMS = {"A100": "flow", "A200": "stock", "A300": "n"}


@query("rename_project", f"WITH {SP} SELECT entity, q, flow AS a100_total, stock AS a200_total, CAST(n AS DOUBLE) AS a300_total FROM sp", "a100_total:4 a200_total:0 a300_total:0")
def _(s, d):
    p = supplier_panel(s, d)
    return p.select("entity", "q", *[F.col(v).cast("double").alias(f"{k.lower()}_total") for k, v in ITEMS.items()])


@query("drop_incomplete", f"WITH {CP}, l AS (SELECT entity, q, flow, {LAG.format(v='flow', k=1)} AS f1, {LAG.format(v='flow', k=4)} AS f4 FROM cp) SELECT * FROM l WHERE f1 IS NOT NULL AND f4 IS NOT NULL", "flow:2 f1:2 f4:2")
def _(s, d):
    p = customer_panel(s, d).select("entity", "q", "flow", lag_at("flow", 1).alias("f1"), lag_at("flow", 4).alias("f4"))
    return p.dropna(subset=["f1", "f4"])


@query("truncate_at_origin", f"WITH {CP} SELECT entity, count(*) AS n, max(q) AS last_q FROM cp WHERE q <= 7995 GROUP BY entity")
def _(s, d):
    # the period bound is turned into a date bound, which reaches the scan
    o = table(s, d, "orders").where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp"))
    p = o.groupBy(F.col("o_custkey").alias("entity"), P.quarter_index("o_orderdate").alias("q")).agg(F.count(F.lit(1)).alias("_n"))
    return p.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max("q").alias("last_q"))


@query("presample_mask", f"""WITH {SP} SELECT entity, q, CASE WHEN q > 7985 THEN flow END AS flow,
  CASE WHEN q >= 7985 THEN stock END AS stock FROM sp""", "flow:4 stock:0")
def _(s, d):
    from tidemark.operators.panel import presample_mask

    return presample_mask(supplier_panel(s, d), values=["flow", "stock"], keep=["stock"], last=7985).select("entity", "q", "flow", "stock")


@query("train_restriction", f"""WITH {SP}, x AS (SELECT *, lag(stock) OVER (PARTITION BY entity ORDER BY q) AS d FROM sp)
SELECT o.origin, count(*) AS n_rows, sum(flow / d) AS ratio_sum FROM x, (VALUES (7990), (7998), (8004)) o(origin)
WHERE d > 0 AND q <= origin AND q >= CASE WHEN origin < 7996 THEN 7980 ELSE 7984 END AND q NOT IN (7988, 7989) GROUP BY o.origin""", "ratio_sum:3")
def _(s, d):
    from tidemark.operators.panel import train_restriction

    p = supplier_panel(s, d).withColumn("d", lag_at("stock", 1))
    t = train_restriction(p, origins=[7990, 7998, 8004], first={7990: 7980, 7998: 7984, 8004: 7984}, exclude=[7988, 7989], denominator="d")
    return t.groupBy("origin").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("flow") / F.col("d")).alias("ratio_sum"))


@query("exclude_listed_rows", f"""WITH {CP} SELECT entity, q, flow FROM cp WHERE (entity, q) NOT IN (SELECT (entity, q) FROM cp WHERE n >= 3)""", "flow:2")
def _(s, d):
    p = customer_panel(s, d)
    listed = p.where("n >= 3").select("entity", "q")
    return p.join(listed, ["entity", "q"], "left_anti").select("entity", "q", "flow")


SPLITS = [("train", "1995-01-01", "1998-12-31"), ("val", "1999-01-01", "1999-12-31"), ("test", "2000-01-01", "2000-12-31"), ("holdout", "2001-01-01", "2001-06-30")]


@query("split_by_cutoff", """SELECT o_orderkey, CASE WHEN d BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train'
 WHEN d BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'val' WHEN d BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' THEN 'test'
 WHEN d BETWEEN DATE '2001-01-01' AND DATE '2001-06-30' THEN 'holdout' END AS split FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("cut"))
    return J.split_by_cutoff(o, cutoff="cut", ranges=SPLITS).select("o_orderkey", "split")


BAND = "CASE WHEN l_quantity <= 4 THEN '01' WHEN l_quantity <= 9 THEN '02' WHEN l_quantity <= 20 THEN '03' WHEN l_quantity <= 30 THEN '04' WHEN l_quantity <= 40 THEN '05' ELSE '06' END"


@query("bucket_map", f"SELECT {BAND} AS band, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s, d):
    return table(s, d, "lineitem").groupBy(F.expr(BAND).alias("band"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("weekday_filter", "SELECT isodow(l_shipdate) - 1 AS weekday, count(*) AS n FROM lineitem WHERE isodow(l_shipdate) < 6 GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").where(F.weekday("l_shipdate") < 5).groupBy(F.weekday("l_shipdate").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


@query("winsor_clip", f"WITH {SP}, g AS (SELECT entity, q, flow / lag(flow) OVER (PARTITION BY entity ORDER BY q) - 1 AS g FROM sp) SELECT entity, q, CASE WHEN g IS NOT NULL THEN least(greatest(g, -0.25e0), 0.25e0) END AS g FROM g", "g")
def _(s, d):
    g = S.ratio(F.col("flow"), F.lag("flow").over(Window.partitionBy("entity").orderBy("q"))) - 1
    return supplier_panel(s, d).select("entity", "q", S.clip(g, -0.25, 0.25).alias("g"))


@query("quantile_outlier_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_extendedprice) < (SELECT quantile_cont(abs(l_extendedprice), 0.999) FROM lineitem) AND abs(l_quantity) < (SELECT quantile_cont(abs(l_quantity), 0.999) FROM lineitem)")
def _(s, d):
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return A.quantile_outlier_filter(l, values=["l_extendedprice", "l_quantity"], level=0.999).select("l_orderkey", "l_linenumber")


@query("trim_top_quantile", "SELECT o_orderkey FROM orders WHERE o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.98) FROM orders)")
def _(s, d):
    return A.trim_top_quantile(table(s, d, "orders").select("o_orderkey", "o_totalprice"), values=["o_totalprice"]).select("o_orderkey")


# ---------------------------------------------------------------- 2.3


@query("inner_join", f"""SELECT n_name, c_mktsegment, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""", "total:2")
def _(s, d):
    per = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("_c"))
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return per.join(c, "c_custkey").join(n, "c_nationkey").groupBy("n_name", "c_mktsegment").agg(F.sum("_n").alias("n"), (F.sum("_c").cast("double") / 100.0).alias("total"))


@query("left_join", """SELECT c_custkey, count(o_orderkey) AS n_orders, max(CAST(o_orderdate AS DATE))::VARCHAR AS last_order FROM customer
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def _(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.max(F.to_date("o_orderdate")).cast("string").alias("last_order"))
    return table(s, d, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna(0, ["n_orders"])


@query("left_join_flag", f"""WITH {CP}, p AS (SELECT entity, q + 4 AS q, flow AS f FROM cp)
SELECT entity, q, coalesce(f, flow) AS forecast, CAST(f IS NULL AS INT) AS fallback FROM cp LEFT JOIN p USING (entity, q)""", "forecast:2")
def _(s, d):
    p = customer_panel(s, d)
    lagged = p.select("entity", (F.col("q") + 4).alias("q"), F.col("flow").alias("forecast"))
    return J.left_join_flag(p, lagged, ["entity", "q"], "forecast", F.col("flow")).select("entity", "q", "forecast", F.col("fallback").cast("int"))


@query("validated_join", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.validated_join(table(s, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "c_mktsegment")


@query("asof_join", """
WITH r AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) + INTERVAL 45 DAY AS avail, o_orderkey, o_totalprice FROM orders),
r1 AS (SELECT k, avail, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS price FROM r GROUP BY k, avail),
l AS (SELECT c_custkey AS k, m.cut FROM customer, (SELECT last_day(CAST(x AS DATE)) AS cut FROM generate_series(TIMESTAMP '1995-03-01', TIMESTAMP '2001-09-01', INTERVAL 3 MONTH) g(x)) m)
SELECT l.k, CAST(l.cut AS VARCHAR) AS cut, r1.o_orderkey AS src, r1.price FROM l ASOF LEFT JOIN r1 ON l.k = r1.k AND l.cut >= r1.avail""", "price:2")
def _(s, d):
    cuts = F.transform(F.sequence(F.lit("1995-03-01").cast("date"), F.lit("2001-09-01").cast("date"), F.expr("interval 3 months")), lambda x: F.last_day(x))
    left = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.explode(cuts).alias("cut"))
    right = table(s, d, "orders").select(F.col("o_custkey").alias("k"), P.publication_avail("o_orderdate", 45).alias("avail"), F.col("o_orderkey").alias("src"), F.col("o_totalprice").alias("price"))
    return J.asof_join(left, right, on="cut", right_on="avail", cols=["src", "price"], by=["k"], bucket="year", order_tie="src").withColumn("cut", F.col("cut").cast("string"))


@query("asof_join_global", f"""
WITH {DE}, r AS (SELECT date, value FROM de WHERE series = 'click'), l AS (SELECT event_id, CAST(ts AS DATE) - INTERVAL 1 DAY AS cut FROM events)
SELECT event_id, value FROM l ASOF LEFT JOIN r ON CAST(l.cut AS DATE) >= r.date""", "value")
def _(s, d):
    left = table(s, d, "events").select("event_id", F.date_sub(F.to_date("ts"), 1).alias("cut"))
    right = daily_events(s, d).where("series = 'click'").select("date", "value")
    return J.asof_join(left, right, on="cut", right_on="date", cols=["value"], bucket="week").select("event_id", "value")


@query("asof_join_shifted", f"""
WITH {SP}, t AS (SELECT q, sum(stock) AS v FROM sp GROUP BY q), r AS (SELECT last_day(make_date(q // 4, (q % 4 + 1) * 3, 1)) AS dt, v FROM t),
l AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS cut FROM orders)
SELECT CAST(l.cut AS VARCHAR) AS cut, a.v, a.v - b.v AS change FROM l ASOF LEFT JOIN r a ON l.cut >= a.dt
ASOF LEFT JOIN (SELECT dt + 91 AS dt, v FROM r) b ON l.cut >= b.dt""", "v:0 change:0")
def _(s, d):
    r = supplier_panel(s, d).groupBy("q").agg(F.sum("stock").alias("v")).select(P.quarter_end("q").alias("dt"), "v")
    left = table(s, d, "orders").select(F.to_date("o_orderdate").alias("cut")).distinct()
    return J.asof_join_shifted(left, r, on="cut", right_on="dt", col="v", shift_days=91, out="change", bucket="year").select(F.col("cut").cast("string"), "v", "change")


@query("period_shift_join", f"WITH {CP} SELECT a.entity, a.q, b.flow AS next_flow, c.flow AS prev_year FROM cp a LEFT JOIN cp b ON a.entity = b.entity AND b.q = a.q + 1 LEFT JOIN cp c ON a.entity = c.entity AND c.q = a.q - 4", "next_flow:2 prev_year:2")
def _(s, d):
    p = customer_panel(s, d)
    x = J.period_shift_join(p, p, keys=["entity"], period="q", k=1, cols={"flow": "next_flow"})
    return J.period_shift_join(x, p, keys=["entity"], period="q", k=-4, cols={"flow": "prev_year"}).select("entity", "q", "next_flow", "prev_year")


@query("semi_join", f"WITH {CP} SELECT entity, q FROM cp a WHERE EXISTS (SELECT 1 FROM cp b WHERE b.entity = a.entity AND b.q = a.q + 1)")
def _(s, d):
    p = customer_panel(s, d).select("entity", "q")
    return p.join(p.select("entity", (F.col("q") - 1).alias("q")), ["entity", "q"], "left_semi")


@query("anti_join", f"WITH {CP} SELECT entity, q FROM cp a WHERE NOT EXISTS (SELECT 1 FROM cp b WHERE b.entity = a.entity AND b.q = a.q + 1)")
def _(s, d):
    p = customer_panel(s, d).select("entity", "q")
    return p.join(p.select("entity", (F.col("q") - 1).alias("q")), ["entity", "q"], "left_anti")


@query("key_resolution_join", """
WITH x AS (SELECT p_brand AS k, p_partkey AS target, p_type AS level FROM part),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY list_position(['PROMO', 'ECONOMY', 'STANDARD'], level) NULLS FIRST, target) AS r FROM x WHERE level IN ('PROMO', 'ECONOMY', 'STANDARD')) WHERE r = 1)
SELECT p_partkey, p_brand AS k, b.target, b.level FROM part LEFT JOIN b ON p_brand = b.k""")
def _(s, d):
    p = table(s, d, "part")
    cw = p.where(F.col("p_type").isin("PROMO", "ECONOMY", "STANDARD")).select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("target"), F.col("p_type").alias("level"))
    return J.key_resolution_join(p.select("p_partkey", F.col("p_brand").alias("k")), cw, key="k", level="level", preference=["PROMO", "ECONOMY", "STANDARD"], target="target", tie="target")


def _vintages(s, d):
    """Two vintages of the daily series: the second lost some days, gained others, and revised a few."""
    e = daily_events(s, d).select("series", "date", F.col("total").alias("value"))
    day = F.dayofmonth("date")
    return e.where(day <= 25), e.where(day >= 4).withColumn("value", F.when(day % 7 == 0, F.col("value") + 1).when(day % 11 == 0, None).otherwise(F.col("value")))


VINT = f"""{DE}, v1 AS (SELECT series, date, total AS value FROM de WHERE day(date) <= 25),
v2 AS (SELECT series, date, CASE WHEN day(date) % 7 = 0 THEN total + 1 WHEN day(date) % 11 = 0 THEN NULL ELSE total END AS value FROM de WHERE day(date) >= 4)"""


@query("outer_composition_join", f"""WITH {VINT} SELECT series, CAST(date AS VARCHAR) AS date, a.value AS value_prev, b.value AS value_cur,
 CAST(a.series IS NOT NULL AS INT) AS in_prev, CAST(b.series IS NOT NULL AS INT) AS in_cur FROM v1 a FULL JOIN v2 b USING (series, date)""", "value_prev:2 value_cur:2")
def _(s, d):
    a, b = _vintages(s, d)
    return J.outer_composition_join(a, b, ["series", "date"], "value").select("series", F.col("date").cast("string"), "value_prev", "value_cur", F.col("in_prev").cast("int"), F.col("in_cur").cast("int"))


@query("range_join_month_before", """
WITH m AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderkey, m.n AS n_prev FROM orders LEFT JOIN m ON m.k = o_custkey AND m.m = date_trunc('month', o_orderdate) - INTERVAL 1 MONTH""")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("cut"))
    m = o.groupBy("k", F.trunc("cut", "month").alias("m")).agg(F.count(F.lit(1)).alias("n_prev"))
    return J.month_before_join(o, m, cutoff="cut", month="m", keys=["k"], cols=["n_prev"]).select("o_orderkey", "n_prev")


@query("interval_join_events", """
WITH a AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM events WHERE event_type = 'purchase'),
b AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM events WHERE event_type = 'view')
SELECT a.user_id, a.h, CAST(count(b.h) AS BIGINT) AS n_hits FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.h BETWEEN a.h - 2 - 24 AND a.h - 2 GROUP BY ALL""")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_type", F.floor(F.unix_timestamp("ts") / 3600).alias("h"))
    a = e.where("event_type = 'purchase'").select("user_id", "h").distinct()
    b = e.where("event_type = 'view'").select("user_id", "h")
    return J.interval_join_events(a, b, time="h", tol=24, tau=2, keys=["user_id"])


@query("cross_join_grid", f"""WITH {CP}, qs AS (SELECT unnest(generate_series((SELECT min(q) FROM cp), (SELECT max(q) FROM cp))) AS q)
SELECT e.entity, qs.q, coalesce(cp.n, 0) AS n FROM (SELECT DISTINCT entity FROM cp) e, qs LEFT JOIN cp ON cp.entity = e.entity AND cp.q = qs.q""")
def _(s, d):
    return J.cross_join_grid(customer_panel(s, d).select("entity", "q", "n"), entity="entity", period="q", fill={"n": 0})


@query("leave_one_out_peer", f"WITH {SP} SELECT entity, q, (sum(flow) OVER w - flow) / (count(flow) OVER w - 1) AS peer FROM sp WINDOW w AS (PARTITION BY q)", "peer:2")
def _(s, d):
    return J.leave_one_out_peer(supplier_panel(s, d), by=["q"], value="flow").select("entity", "q", "peer")


# ---------------------------------------------------------------- 2.4


@query("group_agg", """SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS n_cust, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / 1e2 AS total,
 avg(o_totalprice) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders GROUP BY 1""", "total:2 mean:6 lo:2 hi:2")
def _(s, d):
    o = table(s, d, "orders")
    k = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_cust"),
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100.0).alias("total"),
        F.avg("o_totalprice").alias("mean"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"),
        F.min_by("o_orderkey", k).alias("first_key"), F.max_by("o_orderkey", k).alias("last_key"))


@query("filtered_agg", """SELECT l_suppkey, sum(l_quantity) AS total, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS part,
 coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) / sum(l_quantity) AS share FROM lineitem GROUP BY 1""", "total:0 part:0 share")
def _(s, d):
    return A.filtered_share(table(s, d, "lineitem"), by=["l_suppkey"], value="l_quantity", cond=F.col("l_returnflag") == "R")


@query("min_count_sum", f"WITH {CP}, l AS (SELECT *, {LAG.format(v='flow', k=1)} AS p FROM cp) SELECT q, CASE WHEN count(p) >= 100 THEN count(p) END AS n, CASE WHEN count(p) >= 150 THEN sum(p) END AS total FROM l GROUP BY q", "total:2")
def _(s, d):
    p = customer_panel(s, d).withColumn("p", lag_at("flow", 1))
    return p.groupBy("q").agg(F.when(F.count("p") >= 100, F.count("p")).alias("n"), A.min_count_sum("p", 150).alias("total"))


@query("latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1", "o_totalprice:2")
def _(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return A.latest_per_key(o, keys=["o_custkey"], time="o_orderdate", tie="o_orderkey").drop("o_orderdate")


@query("first_per_key", "SELECT l_partkey, arg_min(l_suppkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_suppkey FROM lineitem GROUP BY 1")
def _(s, d):
    l = table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return A.first_per_key(l, keys=["l_partkey"], order=["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_suppkey")


@query("mode_by_value", """WITH t AS (SELECT o_custkey, o_orderpriority, count(*) AS w FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority AS top, w AS top_weight FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, o_orderpriority) = 1""")
def _(s, d):
    return A.mode_by_value(table(s, d, "orders"), by=["o_custkey"], item="o_orderpriority", weight=F.count(F.lit(1)))


@query("weighted_mean", f"""WITH {SP}, g AS (SELECT *, flow / lag(flow) OVER (PARTITION BY entity ORDER BY q) - 1 AS g FROM sp)
SELECT q, sum(flow * g) / sum(flow) FILTER (g IS NOT NULL) AS wmean FROM g GROUP BY q""", "wmean")
def _(s, d):
    g = S.ratio(F.col("flow"), F.lag("flow").over(Window.partitionBy("entity").orderBy("q"))) - 1
    return supplier_panel(s, d).withColumn("g", g).groupBy("q").agg(A.weighted_mean("g", "flow").alias("wmean"))


@query("hhi", f"WITH {BM}, s AS (SELECT period, amount / sum(amount) OVER (PARTITION BY period) AS sh FROM bm) SELECT period, sum(sh * sh) AS hhi, count(*) AS n_items FROM s GROUP BY period", "hhi:8")
def _(s, d):
    return A.hhi(brand_mix(s, d), by=["period"], item="part", value="amount")


@query("share_of_total", f"WITH {SM} SELECT period, part, amount / sum(amount) OVER (PARTITION BY period) AS share FROM sm", "share:8")
def _(s, d):
    return A.share_of_total(segment_mix(s, d), by=["period"], value="amount").drop("amount")


@query("pivot_table", f"""SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS n,
 sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r FROM lineitem GROUP BY 1""", "a:0 n:0 r:0")
def _(s, d):
    p = table(s, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).fillna(0.0)
    return p.select("l_suppkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("unpivot", f"WITH {SP} SELECT entity, q, item, value FROM (SELECT entity, q, flow, stock, CAST(n AS DOUBLE) AS n FROM sp) UNPIVOT (value FOR item IN (flow, stock, n))", "value:4")
def _(s, d):
    from tidemark.sources.writers import to_long

    return to_long(supplier_panel(s, d), ids=["entity", "q"], values=["flow", "stock", "n"])


@query("resample_calendar", f"""WITH {DE}, w AS (SELECT *, date + CAST((12 - isodow(date)) % 7 AS INT) AS fri FROM de)
SELECT series, CAST(fri AS VARCHAR) AS label, avg(value) AS value, count(value) AS n_obs FROM w GROUP BY ALL""", "value")
def _(s, d):
    e = daily_events(s, d)
    return A.resample_calendar(e, label=P.week_ending("date"), by=["series"], time="date", value="value").withColumn("label", F.col("label").cast("string"))


@query("resample_last", f"""WITH {DE} SELECT series, CAST(date + CAST((10 - isodow(date)) % 7 AS INT) AS VARCHAR) AS label, arg_max(total, date) AS value, count(total) AS n_obs FROM de GROUP BY ALL""", "value:2")
def _(s, d):
    e = daily_events(s, d)
    return A.resample_calendar(e, label=P.week_ending("date", "Wed"), by=["series"], time="date", value="total", how="last").withColumn("label", F.col("label").cast("string"))


def _daily_orders(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100.0).alias("value"))


DO = """dord AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS value FROM orders GROUP BY ALL)"""


@query("quarter_volatility", f"""WITH {DO}, c AS (SELECT *, ln(value) - ln(lag(value) OVER (PARTITION BY series ORDER BY date)) AS ch FROM dord)
SELECT series, {SQ.format(d='date')} AS label, avg(value) AS level, stddev_samp(ch) AS vol, count(ch) AS n_changes FROM c GROUP BY ALL""", "level:3 vol:8")
def _(s, d):
    return A.quarter_volatility(_daily_orders(s, d), label=P.quarter_index("date"), by=["series"], time="date", value="value")


@query("quarter_volatility_asof", f"""WITH {DO}, c AS (SELECT *, ln(value) - ln(lag(value) OVER (PARTITION BY series ORDER BY date)) AS ch, {SQ.format(d='date')} AS q FROM dord)
SELECT series, q AS label, avg(value) AS level, stddev_samp(ch) AS vol, count(ch) AS n_changes FROM c WHERE date + 30 <= last_day(make_date(q // 4, (q % 4 + 1) * 3, 1)) GROUP BY ALL""", "level:3 vol:8")
def _(s, d):
    e = _daily_orders(s, d).withColumn("avail", P.publication_avail("date", 30))
    return A.quarter_volatility(e, label=P.quarter_index("date"), by=["series"], time="date", value="value", avail="avail", asof=P.quarter_end(P.quarter_index("date")))


def _weekly_args():
    return dict(kind="kind", date="date", bucket="band", amount="units", count="n", buckets=["01", "02", "03", "04", "05", "06"], week=P.week_ending("date"))


def _weekly_obs(s, d):
    l = table(s, d, "lineitem").where(F.weekday("l_shipdate") < 5)
    return l.groupBy(F.col("l_returnflag").alias("kind"), F.to_date("l_shipdate").alias("date"), F.expr(BAND).alias("band")).agg(F.sum(line_units()).alias("units"), F.count(F.lit(1)).alias("n"))


WEEKLY = f"""obs AS (SELECT l_returnflag AS kind, CAST(l_shipdate AS DATE) AS date, {BAND} AS band, {{cents}} AS u FROM lineitem WHERE isodow(l_shipdate) < 6),
wk AS (SELECT *, date + CAST((12 - isodow(date)) % 7 AS INT) AS week FROM obs),
days AS (SELECT kind, week, count(DISTINCT date) AS valid_days, count(*) AS n, sum(u)::DOUBLE AS tot FROM wk GROUP BY ALL),
spine AS (SELECT k.kind, CAST(w.x AS DATE) AS week, b.band FROM (SELECT DISTINCT kind FROM wk) k,
  (SELECT unnest(generate_series((SELECT min(week) FROM wk)::TIMESTAMP, (SELECT max(week) FROM wk)::TIMESTAMP, INTERVAL 7 DAY)) AS x) w, (SELECT unnest(['01','02','03','04','05','06']) AS band) b),
cells AS (SELECT kind, week, band, sum(u)::DOUBLE AS u, count(*) AS n FROM wk GROUP BY ALL)""".replace("{cents}", "CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))")


@query("weekly_bucket_mix", f"""WITH {WEEKLY}
SELECT s.kind, CAST(s.week AS VARCHAR) AS week, CAST(s.band AS INT) AS band, coalesce(d.valid_days, 0) AS valid_days, coalesce(c.n, 0) AS n,
 CAST(coalesce(d.valid_days >= 3 AND d.n >= 40 AND d.tot > 0, FALSE) AS INT) AS usable,
 CASE WHEN d.valid_days >= 3 AND d.n >= 40 AND d.tot > 0 THEN coalesce(c.u, 0) / d.tot END AS share
FROM spine s LEFT JOIN days d USING (kind, week) LEFT JOIN cells c USING (kind, week, band) WHERE s.week <= (SELECT max(date) FROM wk)""", "share:8")
def _(s, d):
    w = A.weekly_bucket_mix(_weekly_obs(s, d), min_count=40, **_weekly_args())
    z = w.select("kind", F.col("week").cast("string"), "valid_days", "N", F.col("usable").cast("int").alias("usable"), F.coalesce("mix", F.transform("D", lambda _: F.lit(None).cast("double"))).alias("mix"))
    z = z.select("*", F.posexplode("mix").alias("pos", "share"))
    return z.select("kind", "week", (F.col("pos") + 1).alias("band"), "valid_days", F.element_at("N", F.col("pos") + 1).alias("n"), "usable", "share")


@query("partial_week_mix", f"""WITH {WEEKLY}, p AS (SELECT * FROM wk WHERE date BETWEEN DATE '1998-06-15' AND DATE '1998-06-17'),
t AS (SELECT kind, sum(u)::DOUBLE AS tot, count(DISTINCT date) AS valid_days FROM p GROUP BY kind)
SELECT t.kind, '1998-06-19' AS week, CAST(b.band AS INT) AS band, t.valid_days, 0 AS usable, 1 AS provisional, coalesce(sum(p.u), 0)::DOUBLE / t.tot AS share
FROM t CROSS JOIN (SELECT unnest(['01','02','03','04','05','06']) AS band) b LEFT JOIN p ON p.kind = t.kind AND p.band = b.band GROUP BY t.kind, b.band, t.valid_days, t.tot""", "share:8")
def _(s, d):
    w = A.partial_week_mix(_weekly_obs(s, d), asof="1998-06-17", min_count=40, **_weekly_args())
    z = w.select("kind", F.col("week").cast("string"), "valid_days", F.col("usable").cast("int").alias("usable"), F.col("provisional").cast("int").alias("provisional"), F.posexplode("mix").alias("pos", "share"))
    return z.withColumn("band", F.col("pos") + 1).drop("pos")


@query("weekly_total", f"WITH {WEEKLY} SELECT CAST(week AS VARCHAR) AS week, sum(u)::DOUBLE / 1e4 AS total FROM wk WHERE kind = 'N' GROUP BY week", "total:4")
def _(s, d):
    l = table(s, d, "lineitem").where((F.col("l_returnflag") == "N") & (F.weekday("l_shipdate") < 5))
    return l.groupBy(P.week_ending("l_shipdate").cast("string").alias("week")).agg((F.sum(line_units()).cast("double") / 10000.0).alias("total"))


@query("year_columns", f"""WITH y AS (SELECT o_custkey AS entity, year(o_orderdate) AS y, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ALL)
SELECT entity, max(n) FILTER (y = 1996) AS n_1996, max(n) FILTER (y = 2000) AS n_2000, max(top) FILTER (y = 1996) AS top_1996, max(top) FILTER (y = 2000) AS top_2000,
 max(n) FILTER (y = 2000) - max(n) FILTER (y = 1996) AS n_change, max(top) FILTER (y = 2000) - max(top) FILTER (y = 1996) AS top_change FROM y WHERE y IN (1996, 2000) GROUP BY entity""", "top_1996:2 top_2000:2 top_change:3")
def _(s, d):
    y = table(s, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    return A.year_columns(y, key="entity", year="y", measures=["n", "top"], first=1996, second=2000)


@query("coverage_report", f"""WITH {CY}, l AS (SELECT *, {LAG.format(v='ytd', k=1)} AS prev FROM cy), f AS (SELECT *, CASE WHEN q % 4 = 0 THEN ytd ELSE ytd - prev END AS flow_q, (q % 4 <> 0 AND prev IS NULL) AS missing_prior,
 row_number() OVER (PARTITION BY q ORDER BY ytd DESC, entity) AS r FROM l)
SELECT q, count(*) AS rows, count(ytd) AS n_ytd, count(flow_q) AS n_flow_q, CAST(sum(missing_prior::INT) AS BIGINT) AS n_missing_prior, min(ytd) FILTER (r <= 50) AS topk_cutoff FROM f GROUP BY q""", "topk_cutoff:2")
def _(s, d):
    p = decumulate(customer_ytd(s, d))
    return A.coverage_report(p, by="q", columns=["ytd", "flow_q"], flags=["missing_prior"], rank_value="ytd")


@query("distinct_count", "SELECT c_mktsegment, count(DISTINCT o_custkey) AS n_active FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    act = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(s, d, "customer").select("c_custkey", "c_mktsegment").join(act, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_active"))


LEVELS = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


@query("exact_quantiles",
       "SELECT l_returnflag, unnest([5e-2, 1e-1, 25e-2, 5e-1, 75e-2, 9e-1, 95e-2]) AS tau, unnest(quantile_cont(l_extendedprice, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95])) AS qv FROM lineitem GROUP BY l_returnflag", "tau:2 qv:5")
def _(s, d):
    return R.exact_quantiles(table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", LEVELS)


@query("mad_scale", f"""WITH {SP}, w AS (SELECT o.q AS origin, sp.entity, sp.flow FROM (SELECT DISTINCT q FROM (SELECT unnest(generate_series((SELECT min(q) FROM sp), (SELECT max(q) FROM sp))) AS q)) o JOIN sp ON sp.q BETWEEN o.q - 15 AND o.q),
m AS (SELECT origin, entity, median(flow) AS m, count(*) AS n_obs FROM w GROUP BY ALL),
r0 AS (SELECT origin, entity, n_obs, median(abs(flow - m)) AS dev FROM w JOIN m USING (origin, entity) GROUP BY ALL), r AS (SELECT origin, entity, n_obs, CASE WHEN n_obs >= 12 THEN 1.4826e0 * dev END AS raw FROM r0),
f AS (SELECT origin, quantile_cont(raw, 0.1) AS f FROM r GROUP BY origin)
SELECT origin, entity, n_obs, raw, CASE WHEN raw IS NOT NULL THEN greatest(raw, f) END AS scale FROM r JOIN f USING (origin)""", "raw:4 scale:4")
def _(s, d):
    w = A.trailing_origins(supplier_panel(s, d), index="q", span=16)
    return A.mad_scale(w, keys=["origin", "entity"], value="flow", floor_by=["origin"])


@query("histogram_bins", "SELECT o_orderpriority, least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n FROM (SELECT o_orderpriority, percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS p FROM orders) GROUP BY ALL")
def _(s, d):
    r = R.rank_average(table(s, d, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", "r")
    n = r.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n0"))
    ties = r.groupBy("o_orderpriority", "r").agg(F.count(F.lit(1)).alias("t"))
    x = ties.join(n, "o_orderpriority").withColumn("p", (F.col("r") - (F.col("t") + 1) / 2.0) / (F.col("n0") - 1))
    return A.histogram_bins(x, value="p", by=["o_orderpriority"], weight="t")


@query("crosstab_share", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS share FROM lineitem GROUP BY 1, 2", "share")
def _(s, d):
    return A.crosstab_share(table(s, d, "lineitem"), row="l_returnflag", col="l_linestatus")


@query("gram_aggregate", f"""WITH {CP}, l AS (SELECT entity, q, flow, {LAG.format(v='flow', k=1)} AS p FROM cp), x AS (SELECT q, ln(flow) AS y, ln(p) AS x FROM l WHERE p > 0 AND flow > 0)
SELECT q, sum(1e0) AS g_c_c, sum(x) AS g_c_x, sum(x * x) AS g_x_x, sum(y) AS gy_c, sum(x * y) AS gy_x, sum(y * y) AS gyy, count(*) AS gn FROM x GROUP BY q""", "g_c_c:0 g_c_x:5 g_x_x:5 gy_c:5 gy_x:5 gyy:5")
def _(s, d):
    from tidemark.functions.linear import gram_columns

    p = customer_panel(s, d).withColumn("p", lag_at("flow", 1)).where("p > 0 AND flow > 0")
    return p.groupBy("q").agg(*gram_columns({"c": F.lit(1.0), "x": F.log("p")}, F.log("flow")))


@query("rollup_levels", "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS k, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY ROLLUP (1, 2)", "mean:6")
def _(s, d):
    o = table(s, d, "orders").select(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("k"), "o_totalprice")
    return o.rollup("y", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"))


# ---------------------------------------------------------------- 2.7


@query("period_index", f"SELECT DISTINCT {SQ.format(d='o_orderdate')} AS q, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label, CAST(last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS VARCHAR) AS q_end, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m FROM orders")
def _(s, d):
    q = P.quarter_index("o_orderdate")
    return table(s, d, "orders").select(q.alias("q"), P.quarter_label(q).alias("label"), P.quarter_end(q).cast("string").alias("q_end"), P.month_index("o_orderdate").alias("m")).distinct()


@query("last_q4_on_or_before", f"SELECT DISTINCT {SQ.format(d='o_orderdate')} AS q, CASE WHEN quarter(o_orderdate) = 4 THEN year(o_orderdate) * 4 + 3 ELSE year(o_orderdate) * 4 - 1 END AS epoch FROM orders")
def _(s, d):
    q = P.quarter_index("o_orderdate")
    return table(s, d, "orders").select(q.alias("q"), P.last_q4_on_or_before(q).alias("epoch")).distinct()


@query("quarter_dummies", f"SELECT o_orderkey, (quarter(o_orderdate) = 1)::INT - 25e-2 AS s1, (quarter(o_orderdate) = 2)::INT - 25e-2 AS s2, (quarter(o_orderdate) = 3)::INT - 25e-2 AS s3 FROM orders", "s1:2 s2:2 s3:2")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", *P.quarter_dummies(P.quarter_index("o_orderdate")))


FIX = "(month({x}) * 100 + day({x}) IN (101, 704, 1111, 1225) OR (month({x}) * 100 + day({x}) = 619 AND year({x}) >= 2021))"
HOL = "(isodow({x}) < 6 AND (" + FIX + " OR (isodow({x}) = 1 AND " + FIX.replace("{x}", "({x} - 1)") + """)
 OR (isodow({x}) = 1 AND month({x}) IN (1, 2) AND day({x}) BETWEEN 15 AND 21) OR (isodow({x}) = 1 AND month({x}) = 5 AND day({x}) >= 25)
 OR (isodow({x}) = 1 AND month({x}) = 9 AND day({x}) <= 7) OR (isodow({x}) = 1 AND month({x}) = 10 AND day({x}) BETWEEN 8 AND 14)
 OR (isodow({x}) = 4 AND month({x}) = 11 AND day({x}) BETWEEN 22 AND 28){sat}))"""
SAT = " OR (isodow({x}) = 5 AND " + FIX.replace("{x}", "({x} + 1)") + ")"


def _hol(x: str, sat: bool = False) -> str:
    return HOL.replace("{sat}", SAT if sat else "").replace("{x}", x)


BDAYS = f"""cal AS (SELECT CAST(x AS DATE) AS dt FROM generate_series(TIMESTAMP '1994-12-25', TIMESTAMP '2002-06-30', INTERVAL 1 DAY) g(x)),
bd AS (SELECT dt FROM cal WHERE isodow(dt) < 6 AND NOT {_hol('dt')}), bds AS (SELECT dt FROM cal WHERE isodow(dt) < 6 AND NOT {_hol('dt', True)})"""


@query("fed_holiday_calendar", f"SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST({_hol('CAST(o_orderdate AS DATE)')} AS INT) AS holiday, count(*) AS n FROM orders GROUP BY ALL")
def _(s, d):
    day = F.to_date("o_orderdate")
    o = table(s, d, "orders").groupBy(day.alias("dt")).agg(F.count(F.lit(1)).alias("n"))
    return o.select(F.col("dt").cast("string").alias("day"), H.is_holiday("dt").cast("int").alias("holiday"), "n")


@query("business_day_roll", f"""WITH {BDAYS}, p AS (SELECT DISTINCT {SQ.format(d='o_orderdate')} AS q FROM orders), e AS (SELECT q, last_day(make_date(q // 4, (q % 4 + 1) * 3, 1)) + CASE WHEN q % 4 = 3 THEN 45 ELSE 40 END AS x FROM p)
SELECT q, CAST(min(dt) AS VARCHAR) AS due, CAST(min(dt) + 7 AS VARCHAR) AS avail FROM e JOIN bds ON dt >= x GROUP BY q""")
def _(s, d):
    q = table(s, d, "orders").select(P.quarter_index("o_orderdate").alias("q")).distinct()
    return q.select("q", H.filing_due_date("q").cast("string").alias("due"), H.filing_availability("q").cast("string").alias("avail"))


@query("release_timestamp", f"""WITH {BDAYS}, e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), nb AS (SELECT d, min(dt) AS b FROM e JOIN bd ON dt > d GROUP BY d)
SELECT CAST(d AS VARCHAR) AS day, strftime(b + CASE WHEN b BETWEEN (SELECT min(x) FROM (SELECT CAST(g AS DATE) AS x FROM generate_series(make_date(year(b), 4, 1)::TIMESTAMP, make_date(year(b), 4, 7)::TIMESTAMP, INTERVAL 1 DAY) t(g)) WHERE isodow(x) = 7)
 AND (SELECT max(x) - 1 FROM (SELECT CAST(g AS DATE) AS x FROM generate_series(make_date(year(b), 10, 25)::TIMESTAMP, make_date(year(b), 10, 31)::TIMESTAMP, INTERVAL 1 DAY) t(g)) WHERE isodow(x) = 7) THEN INTERVAL 17 HOUR ELSE INTERVAL 18 HOUR END, '%Y-%m-%d %H:%M') AS released_utc FROM nb""")
def _(s, d):
    day = table(s, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return day.select(F.col("d").cast("string").alias("day"), F.date_format(H.release_timestamp("d"), "yyyy-MM-dd HH:mm").alias("released_utc"))


@query("week_label", """SELECT o_orderkey, CAST(d + CAST((12 - isodow(d)) % 7 AS INT) AS VARCHAR) AS w_fri, CAST(d + CAST((10 - isodow(d)) % 7 AS INT) AS VARCHAR) AS w_wed FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", P.week_ending("o_orderdate").cast("string").alias("w_fri"), P.week_ending("o_orderdate", "Wed").cast("string").alias("w_wed"))


@query("publication_avail", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 45 AS VARCHAR) AS a45, CAST(CAST(o_orderdate AS DATE) + 120 AS VARCHAR) AS a120, CAST(make_date(year(o_orderdate) + 1, 4, 1) AS VARCHAR) AS april FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", P.publication_avail("o_orderdate", 45).cast("string").alias("a45"), P.publication_avail("o_orderdate", 120).cast("string").alias("a120"), P.april_first_next_year(F.year("o_orderdate")).cast("string").alias("april"))


@query("name_normalise", r"""WITH n AS (SELECT c_custkey, 'The ' || c_name || CASE c_custkey % 4 WHEN 0 THEN ' & Co., Inc.' WHEN 1 THEN ' National Bank, N.A.' WHEN 2 THEN ' National Association Holdings' ELSE ' Financial Services Group' END AS name FROM customer),
x AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(name), '&', ' AND ', 'g'), '[^A-Z0-9 ]', ' ', 'g'),
 '\b(NATIONAL ASSOCIATION|N A|NA|INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LLC|LTD|THE|AND|HOLDING|HOLDINGS|GROUP|FSB|USA|FINANCIAL|SERVICES)\b', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM n)
SELECT c_custkey, norm, CASE WHEN length(norm) >= 4 THEN norm END AS name_key FROM x""")
def _(s, d):
    tail = F.expr("element_at(array(' & Co., Inc.', ' National Bank, N.A.', ' National Association Holdings', ' Financial Services Group'), CAST(c_custkey % 4 + 1 AS INT))")
    name = F.concat(F.lit("The "), "c_name", tail)
    return table(s, d, "customer").select("c_custkey", X.name_normalise(name).alias("norm"), X.name_key(name).alias("name_key"))


@query("geo_key", """SELECT c_custkey, format('{:.3f}', round(30 + (c_custkey % 1999) / 100e0, 3)) || '_' || format('{:.3f}', round(-70 - (c_custkey % 777) / 50e0, 3)) AS k3,
 CAST(round((30 + (c_custkey % 1999) / 100e0) / 5e-2) AS BIGINT) || '_' || CAST(round((-70 - (c_custkey % 777) / 50e0) / 5e-2) AS BIGINT) AS cell FROM customer""")
def _(s, d):
    lat = 30 + (F.col("c_custkey") % 1999) / F.lit(100.0)
    lon = -70 - (F.col("c_custkey") % 777) / F.lit(50.0)
    return table(s, d, "customer").select("c_custkey", F.concat_ws("_", F.format_number(F.round(lat, 3), 3), F.format_number(F.round(lon, 3), 3)).alias("k3"), X.grid_cell(lat, lon).alias("cell"))


@query("log_transforms", "SELECT o_orderkey, ln(o_totalprice) AS l, ln(1 + o_totalprice) AS l1, exp(1e-6 * o_totalprice) - 1 AS e1, ln(o_totalprice / 5e5) - ln(1 - o_totalprice / 5e5) AS lg, 1 / (1 + exp(-(o_totalprice / 1e5))) AS ex FROM orders", "l l1 e1 lg ex")
def _(s, d):
    x = F.col("o_totalprice")
    return table(s, d, "orders").select("o_orderkey", F.log(x).alias("l"), F.log1p(x).alias("l1"), F.expm1(x * 1e-6).alias("e1"), S.logit(x / 5e5).alias("lg"), S.expit(x / 1e5).alias("ex"))


@query("regex_extract_code", r"""SELECT c_custkey, regexp_replace(c_name, '#.*$', '') AS stem, CAST(nullif(regexp_extract(c_name, '#0*([0-9]+)$', 1), '') AS BIGINT) AS code FROM customer""")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", F.regexp_replace("c_name", "#.*$", "").alias("stem"), X.regex_extract_code("c_name", "#0*([0-9]+)$").cast("long").alias("code"))


@query("sentence_filter", r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS a FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(a, lambda x: NOT regexp_matches(x, '(the|[0-9])')), ' ')) AS kept, len(a) AS n_sentences FROM p""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(X.sentence_filter("text", "(the|[0-9])")).alias("kept"), F.size(F.split("text", r"(?<=[.!?])\s+")).alias("n_sentences"))


@query("keyword_flag", "SELECT doc_id, CAST(regexp_matches(text, '(?i)licen[cs]e|copyright') AS INT) AS flag FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.keyword_flag("text", "(?i)licen[cs]e|copyright").cast("int").alias("flag"))


def sql_horner(coefs, x):
    out = repr(coefs[0]) if "e" in repr(coefs[0]) else repr(coefs[0]) + "e0"
    for c in coefs[1:]:
        k = repr(c) if "e" in repr(c) else repr(c) + "e0"
        out = f"({out} * {x} + ({k}))"
    return out


def sql_cdf(x: str) -> str:
    z = f"abs({x})"
    near = f"exp(-{z} * {z} / 2) * {sql_horner(S.HART_NUM, z)} / {sql_horner(S.HART_DEN, z)}"
    far = f"exp(-{z} * {z} / 2) / (({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 65e-2))))) * 2.506628274631e0)"
    tail = f"(CASE WHEN {z} > 37 THEN 0e0 WHEN {z} < 7.07106781186547e0 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def sql_ppf(p: str) -> str:
    q, tl, tu = f"({p} - 5e-1)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    r = f"({q} * {q})"
    return f"""(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < 2425e-5 THEN {sql_horner(S.PPF_C, tl)} / {sql_horner(S.PPF_D, tl)}
 WHEN {p} > 1 - 2425e-5 THEN -({sql_horner(S.PPF_C, tu)}) / {sql_horner(S.PPF_D, tu)} ELSE {q} * {sql_horner(S.PPF_A, r)} / {sql_horner(S.PPF_B, r)} END)"""


@query("normal_cdf_ppf", f"SELECT o_orderkey, {sql_cdf('x')} AS cdf, {sql_ppf('p')} AS ppf FROM (SELECT o_orderkey, o_totalprice / 5e4 - 5 AS x, o_totalprice / 500001e0 AS p FROM orders)", "cdf:9 ppf:8")
def _(s, d):
    x = F.col("o_totalprice")
    return table(s, d, "orders").select("o_orderkey", S.normal_cdf(x / 5e4 - 5).alias("cdf"), S.normal_ppf(x / 500001.0).alias("ppf"))


@query("array_interp", """SELECT o_orderkey, CASE WHEN x <= 0 THEN 10e0 WHEN x <= 1e5 THEN 10 + (20 - 10) * (x - 0) / 1e5 WHEN x <= 3e5 THEN 20 + (15 - 20) * (x - 1e5) / 2e5 WHEN x < 4e5 THEN 15 + (40 - 15) * (x - 3e5) / 1e5 ELSE 40 END AS y
FROM (SELECT o_orderkey, o_totalprice AS x FROM orders)""", "y:8")
def _(s, d):
    xs = F.array(*[F.lit(v) for v in (0.0, 1e5, 3e5, 4e5)])
    ys = F.array(*[F.lit(v) for v in (10.0, 20.0, 15.0, 40.0)])
    return table(s, d, "orders").select("o_orderkey", interp(F.col("o_totalprice"), xs, ys).alias("y"))


@query("hash_key", """SELECT o_orderkey, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders""")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", hash_key(F.col("o_orderkey"), F.col("o_orderstatus")).alias("h"))


@query("combine_weighted", f"""WITH {CP}, l AS (SELECT entity, q, {LAG.format(v='flow', k=1)} AS a, {LAG.format(v='flow', k=4)} AS b, CAST(q % 5 AS DOUBLE) / 4 AS w FROM cp)
SELECT entity, q, CASE WHEN w = 1 THEN b ELSE a + w * (b - a) END AS f FROM l""", "f:5")
def _(s, d):
    from tidemark.operators.forecast import combine_weighted

    p = customer_panel(s, d).select("entity", "q", lag_at("flow", 1).alias("a"), lag_at("flow", 4).alias("b"), ((F.col("q") % 5).cast("double") / 4).alias("w"))
    return p.select("entity", "q", combine_weighted(F.col("a"), F.col("b"), F.col("w")).alias("f"))


# ---------------------------------------------------------------- 2.12


@query("assert_unique_key", "SELECT o_orderkey, o_custkey FROM orders")
def _(s, d):
    return Q.assert_unique_key(table(s, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query("accounting_identity", """WITH p AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) * (100 + CAST(round(l_tax * 100) AS BIGINT)))::DOUBLE / 1e6 AS parts FROM lineitem GROUP BY 1)
SELECT year(o_orderdate) AS y, count(parts) AS n_checked, max(abs(o_totalprice - parts)) AS max_abs_gap, avg((abs(o_totalprice - parts) <= 1e0)::INT::DOUBLE) AS share_within FROM orders LEFT JOIN p ON l_orderkey = o_orderkey GROUP BY 1""", "max_abs_gap:3 share_within")
def _(s, d):
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    line = cents("l_extendedprice") * (100 - cents("l_discount")) * (100 + cents("l_tax"))
    parts = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum(line).cast("double") / 1e6).alias("parts"))
    o = table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), "o_totalprice").join(parts, "o_orderkey", "left")
    return Q.accounting_identity(o, total="o_totalprice", parts=F.col("parts"), by=["y"], tol=1.0)


@query("completeness_check", "SELECT o_custkey, year(o_orderdate) AS y, count(DISTINCT o_orderpriority) AS n_items, CAST(count(DISTINCT o_orderpriority) = 5 AS INT) AS complete FROM orders GROUP BY ALL")
def _(s, d):
    o = table(s, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderpriority")
    return Q.completeness_check(o, by=["o_custkey", "y"], item="o_orderpriority", expected=5).withColumn("complete", F.col("complete").cast("int"))


@query("known_gap_check", f"""WITH {CP}, qs AS (SELECT unnest(generate_series((SELECT min(q) FROM cp), (SELECT max(q) FROM cp))) AS q)
SELECT e.entity, qs.q, CAST(qs.q % 4 = 3 AS INT) AS known FROM (SELECT DISTINCT entity FROM cp) e, qs WHERE NOT EXISTS (SELECT 1 FROM cp WHERE cp.entity = e.entity AND cp.q = qs.q)""")
def _(s, d):
    p = customer_panel(s, d).select("entity", "q")
    exp = J.cross_join_grid(p, entity="entity", period="q")
    listed = exp.where(F.col("q") % 4 == 3)
    return Q.known_gap_check(exp, p, ["entity", "q"], listed).withColumn("known", F.col("known").cast("int"))


@query("cross_source_check", f"""WITH {VINT} SELECT series, CAST(date AS VARCHAR) AS date, CASE WHEN b.series IS NULL THEN 'only_a' WHEN a.series IS NULL THEN 'only_b' WHEN abs(a.value - b.value) <= 5e-1 THEN 'equal' ELSE 'different' END AS status FROM v1 a FULL JOIN v2 b USING (series, date)""")
def _(s, d):
    a, b = _vintages(s, d)
    return Q.cross_source_check(a, b, ["series", "date"], "value", 0.5).select("series", F.col("date").cast("string"), "status")


@query("multiset_check", """WITH a AS (SELECT l_suppkey AS k, l_quantity AS v, 1 AS s FROM lineitem), b AS (SELECT l_suppkey, CASE WHEN l_suppkey % 3 = 0 AND l_quantity = 7 THEN 8 ELSE l_quantity END, -1 FROM lineitem),
u AS (SELECT k, v, sum(s) AS dd FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) SELECT k, CAST(sum(abs(dd)) = 0 AS INT) AS same, CAST(sum(abs(dd)) AS BIGINT) AS n_unmatched FROM u GROUP BY k""")
def _(s, d):
    a = table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("v"))
    b = a.withColumn("v", F.when((F.col("k") % 3 == 0) & (F.col("v") == 7), 8.0).otherwise(F.col("v")))
    return Q.multiset_check(a, b, ["k"], "v").withColumn("same", F.col("same").cast("int"))


@query("vintage_diff", f"""WITH {VINT} SELECT series, CAST(date AS VARCHAR) AS date, b.value - a.value AS delta, CASE WHEN a.series IS NULL THEN 'added' WHEN b.series IS NULL THEN 'removed'
 WHEN a.value IS NULL AND b.value IS NOT NULL THEN 'filled' WHEN a.value IS NOT NULL AND b.value IS NULL THEN 'blanked' WHEN a.value IS DISTINCT FROM b.value THEN 'changed' ELSE 'same' END AS kind FROM v1 a FULL JOIN v2 b USING (series, date)""", "delta:2")
def _(s, d):
    a, b = _vintages(s, d)
    return Q.vintage_diff(a, b, ["series", "date"], "value").select("series", F.col("date").cast("string"), "delta", "kind")


@query("join_coverage", """
SELECT 'documents' AS source, 'labels' AS target, coalesce(sum(m), 0)::BIGINT AS rows_matched, count(*) AS rows_total, coalesce(sum(n_chars * m), 0)::BIGINT AS weight_matched, sum(n_chars)::BIGINT AS weight_total,
 sum(m) / count(*) AS row_share, sum(n_chars * m) / sum(n_chars) AS weight_share FROM (SELECT n_chars, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS m FROM documents d LEFT JOIN labels l USING (doc_id))
UNION ALL SELECT 'orders', 'customer', sum(m)::BIGINT, count(*), sum(o_shippriority * m)::BIGINT, sum(o_shippriority)::BIGINT, sum(m) / count(*), sum(o_shippriority * m) / sum(o_shippriority)
FROM (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS o_shippriority, CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS m FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY') ON o_custkey = c_custkey)""", "row_share weight_share")
def _(s, d):
    a = Q.join_coverage(table(s, d, "documents"), table(s, d, "labels"), on=["doc_id"], weight="n_chars", source="documents", target="labels")
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("w"))
    c = table(s, d, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("k"))
    b = Q.join_coverage(o, c, on=["k"], weight="w", source="orders", target="customer")
    fix = lambda x: x.withColumns({c: F.col(c).cast("long") for c in ("rows_matched", "rows_total", "weight_matched", "weight_total")})
    return fix(a).unionByName(fix(b))


@query("rebuild_parity", f"""WITH {CP}, y AS (SELECT entity, q, flow, sum(flow) OVER (PARTITION BY entity, q // 4 ORDER BY q) AS ytd FROM cp),
r AS (SELECT a.entity, a.q, CASE WHEN a.q % 4 = 0 THEN a.ytd ELSE a.ytd - b.ytd END AS f FROM y a LEFT JOIN y b ON b.entity = a.entity AND b.q = a.q - 1)
SELECT count(f) AS n_matched, count(*) - count(f) AS n_unmatched, max(abs(flow - f)) AS max_abs_diff FROM cp LEFT JOIN r USING (entity, q)""", "max_abs_diff:3")
def _(s, d):
    stored = customer_panel(s, d)
    rebuilt = decumulate(running_ytd(stored, value="flow", out="ytd")).where("flow_q IS NOT NULL")
    return Q.rebuild_parity(stored, rebuilt.select("entity", "q", F.col("flow_q").alias("flow")), ["entity", "q"], "flow")


@query("merger_flags", f"""WITH {SP}, l AS (SELECT *, {LAG.format(v='stock', k=1)} AS p FROM sp), f AS (SELECT entity, q, coalesce(abs(stock / nullif(p, 0) - 1) > 15e-2, FALSE) AS j, (entity % 10 = 3 AND q = 7996) AS e FROM l)
SELECT entity, q, CAST(j AS INT) AS jump, CAST(e AS INT) AS listed, CAST(j OR e AS INT) AS merger_flag FROM f""")
def _(s, d):
    p = supplier_panel(s, d)
    ev = p.where("entity % 10 = 3 AND q = 7996").select("entity", "q")
    m = Q.merger_flags(p, asset="stock", events=ev)
    return m.select("entity", "q", *[F.col(c).cast("int").alias(c) for c in ("jump", "listed", "merger_flag")])


@query("max_gap_days", """WITH x AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), g AS (SELECT *, d - lag(d) OVER (PARTITION BY k ORDER BY d) AS g FROM x)
SELECT k, max(g) AS max_gap, count(*) AS n_days FROM g GROUP BY k""")
def _(s, d):
    return Q.max_gap_days(table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d")), by=["k"], date="d")


LEDGER = f"""{CP}, o AS (SELECT entity, q, n, row_number() OVER (PARTITION BY entity ORDER BY q) AS i FROM cp),
c AS (SELECT entity, q, n, i, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || entity || '|' || q || '|' || n) AS hash FROM o WHERE i = 1
 UNION ALL SELECT o.entity, o.q, o.n, o.i, c.hash, sha256(c.hash || '|' || o.entity || '|' || o.q || '|' || o.n) FROM c JOIN o ON o.entity = c.entity AND o.i = c.i + 1),
t AS (SELECT entity, q, CASE WHEN entity % 50 = 0 THEN n + 1 ELSE n END AS n, hash, CASE WHEN entity % 70 = 0 THEN NULL ELSE prev_hash END AS prev_hash FROM c)"""


@query("ledger_chain_verify", f"""WITH RECURSIVE {LEDGER} SELECT entity, q, CAST(coalesce(hash = sha256(prev_hash || '|' || entity || '|' || q || '|' || n), FALSE) AS INT) AS hash_ok,
 CAST(prev_hash IS NOT DISTINCT FROM coalesce(lag(hash) OVER (PARTITION BY entity ORDER BY q), repeat('0', 64)) AS INT) AS link_ok, CAST(q + n <= 8004 AS INT) AS time_ok, 1 AS key_ok FROM t""")
def _(s, d):
    p = Q.chain_ledger(customer_panel(s, d).select("entity", "q", "n"), by=["entity"], order="q", fields=["entity", "q", "n"])
    # tampered on purpose: some contents and some links
    t = p.withColumn("n", F.when(F.col("entity") % 50 == 0, F.col("n") + 1).otherwise(F.col("n"))).withColumn("prev_hash", F.when(F.col("entity") % 70 == 0, None).otherwise(F.col("prev_hash")))
    t = t.withColumn("made", F.col("q") + F.col("n")).withColumn("due", F.lit(8004))
    v = Q.ledger_chain_verify(t, by=["entity"], order="q", fields=["entity", "q", "n"], made="made", due="due", key=["entity", "q"])
    return v.select("entity", "q", *[F.col(c).cast("int").alias(c) for c in ("hash_ok", "link_ok", "time_ok", "key_ok")])

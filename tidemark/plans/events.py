"""Section 2.13 and 2.14 queries: resampling, events, dependence, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.hashing import sql_draw_int
from tidemark.functions.periods import quarter_index
from tidemark.operators import composition as K
from tidemark.operators import events as E
from tidemark.operators import pairs as PR
from tidemark.operators import resampling as RS
from tidemark.operators import similarity as SM_
from tidemark.operators import textjoin as TJ
from tidemark.operators.calendar import lag_at, standardise
from tidemark.operators.joins import cross_join_grid
from tidemark.operators.ranks import quintile_symbols
from tidemark.plans.bindings import BM, DE, SP, SQ, brand_mix, daily_events, supplier_panel, table
from tidemark.plans.composition import SH
from tidemark.plans.distribution import XS, cross_section
from tidemark.plans.registry import query
from tidemark.plans.scoring import DIFF, losses
from tidemark.session import cut_lineage, spread

DR = sql_draw_int

# ---------------------------------------------------------------- 2.13


@query("within_block_permutation", f"""WITH {XS}, b AS (SELECT q, entity, r FROM xs WHERE r IS NOT NULL), x AS (SELECT b.*, rep FROM b, range(3) t(rep)),
g AS (SELECT rep, q, r, row_number() OVER (PARTITION BY rep, q ORDER BY {DR(5, 'rep', 'entity')}, CAST(entity AS VARCHAR)) AS pos FROM x), t AS (SELECT rep, q, entity, row_number() OVER (PARTITION BY rep, q ORDER BY {DR(6, 'rep', 'entity')}, CAST(entity AS VARCHAR)) AS pos FROM x)
SELECT t.rep, t.q, t.entity, g.r AS permuted FROM t JOIN g USING (rep, q, pos)""", "permuted:7")
def _(s, d):
    return RS.within_block_permutation(cross_section(s, d), block=["q"], ids=["entity"], value="r", seed=5, reps=3).drop("r")


@query("pooled_permutation", f"""WITH x AS (SELECT o_orderkey, o_totalprice AS v, rep FROM orders, range(2) t(rep)), g AS (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY {DR(9, 'rep', 'o_orderkey')}, CAST(o_orderkey AS VARCHAR)) AS pos FROM x),
t AS (SELECT rep, o_orderkey, row_number() OVER (PARTITION BY rep ORDER BY {DR(10, 'rep', 'o_orderkey')}, CAST(o_orderkey AS VARCHAR)) AS pos FROM x) SELECT t.rep, o_orderkey, v AS permuted FROM t JOIN g USING (rep, pos)""", "permuted:2")
def _(s, d):
    return RS.pooled_permutation(table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v")), ids=["o_orderkey"], value="v", seed=9, reps=2).drop("v")


@query("permutation_correlation", f"""WITH {XS}, b AS (SELECT xs.q, xs.entity, r, stock AS x FROM xs JOIN sp USING (entity, q) WHERE r IS NOT NULL), y AS (SELECT b.*, rep FROM b, range(19) t(rep)),
g AS (SELECT rep, q, r, row_number() OVER (PARTITION BY rep, q ORDER BY {DR(5, 'rep', 'entity')}, CAST(entity AS VARCHAR)) AS pos FROM y), t AS (SELECT rep, q, x, row_number() OVER (PARTITION BY rep, q ORDER BY {DR(6, 'rep', 'entity')}, CAST(entity AS VARCHAR)) AS pos FROM y),
n AS (SELECT rep, corr(t.x, g.r) AS r FROM t JOIN g USING (rep, q, pos) GROUP BY rep), o AS (SELECT corr(x, r) AS o FROM b) SELECT max(o) AS observed, avg(r) AS null_mean, (1 + count(*) FILTER (abs(r) >= abs(o) - 1e-12)) / (1 + count(r)) AS p FROM n, o""", "observed:7 null_mean:7 p:7")
def _(s, d):
    x = supplier_panel(s, d).select("entity", "q", "stock", (F.col("flow") / lag_at("stock", 1) / 1e3).alias("r")).where("r IS NOT NULL")
    return RS.permutation_correlation(x, block=["q"], ids=["entity"], x="stock", y="r", seed=5, reps=19)


def span(df, index: str = "q") -> tuple[int, int]:
    """First period and number of periods of a table: two numbers."""
    r = df.agg(F.min(index).alias("lo"), F.max(index).alias("hi")).first()
    return r.lo, r.hi - r.lo + 1


@query("cyclic_shift_null", f"""WITH {SP}, i AS (SELECT entity, q - (SELECT min(q) FROM sp) AS i, ln(flow) AS u, ln(stock) AS v FROM sp), m AS (SELECT entity, covar_samp(u, v) AS c, var_samp(u) + var_samp(v) AS dn, avg(u) AS mu, avg(v) AS mv, count(*) AS n FROM i GROUP BY entity),
x AS (SELECT a.entity, s.s, sum(a.u * b.v) AS x, count(*) AS n FROM i a, (SELECT unnest(range(4, (SELECT max(q) - min(q) + 1 FROM sp) - 3)) AS s) s JOIN i b ON a.entity = b.entity AND a.i = (b.i + s.s) % (SELECT max(q) - min(q) + 1 FROM sp) GROUP BY ALL), j AS (SELECT x.entity, 2 * (x.x - x.n * mu * mv) / (x.n - 1) / dn AS nl, 2 * c / dn AS o FROM x JOIN m USING (entity))
SELECT entity, max(o) AS observed, (1 + count(*) FILTER (abs(nl) >= abs(o) - 1e-12)) / (1 + count(*)) AS p, count(*) AS n_shifts FROM j GROUP BY entity""", "observed:7 p:7")
def _(s, d):
    p = supplier_panel(s, d)
    first, n = span(p)
    x = p.select("entity", (F.col("q") - first).alias("i"), F.log("flow").alias("u"), F.log("stock").alias("v"))
    return RS.cyclic_shift_null(x, by=["entity"], index="i", n=n, u="u", v="v")


@query("cluster_bootstrap", f"""WITH {DIFF}, u AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT entity FROM dd)), sm AS (SELECT entity, sum(s_ref - s_alt) AS nu, sum(s_ref) AS de FROM dd GROUP BY entity),
sl AS (SELECT rep, {DR(21, 'rep', 'k')} % (SELECT max(n) FROM u) AS i FROM range(40) a(rep), (SELECT unnest(range((SELECT max(n) FROM u))) AS k) b), st AS (SELECT rep, sum(nu) / sum(de) AS st FROM sl JOIN u USING (i) JOIN sm USING (entity) GROUP BY rep)
SELECT quantile_cont(st, 0.025) AS lower, quantile_cont(st, 0.5) AS median, quantile_cont(st, 0.975) AS upper FROM st""", "lower:7 median:7 upper:7")
def _(s, d):
    x = losses(s, d).groupBy("entity").agg(F.sum(F.col("s_ref") - F.col("s_alt")).alias("nu"), F.sum("s_ref").alias("de"))
    n = x.count()
    return RS.cluster_bootstrap(x, unit="entity", num="nu", den="de", n_units=n, seed=21, reps=40)


@query("row_bootstrap", f"""WITH {XS}, x AS (SELECT q, entity, r, row_number() OVER (PARTITION BY q ORDER BY {DR(31, 'entity')}, CAST(entity AS VARCHAR)) AS p, count(*) OVER (PARTITION BY q) AS n FROM xs WHERE r IS NOT NULL),
b AS (SELECT rep, q, {DR(32, 'rep', 'q', 'p')} % n + 1 AS p FROM x, range(3) t(rep)) SELECT rep, q, avg(r) AS mean_r, count(*) AS n, count(DISTINCT entity) AS n_distinct FROM b JOIN x USING (q, p) GROUP BY ALL""", "mean_r:8")
def _(s, d):
    b = RS.row_bootstrap(cross_section(s, d), block=["q"], ids=["entity"], seed=31, reps=3)
    return b.groupBy("rep", "q").agg(F.avg("r").alias("mean_r"), F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("n_distinct"))


@query("block_bootstrap", f"""WITH {SP}, t AS (SELECT q - (SELECT min(q) FROM sp) AS pos, sum(stock) AS v FROM sp GROUP BY q), b AS (SELECT rep, b, {DR(41, 'rep', 'b')} % ((SELECT max(q) - min(q) + 1 FROM sp) - 3) AS s FROM range(20) a(rep), (SELECT unnest(range(CAST(ceil((SELECT max(q) - min(q) + 1 FROM sp) / 4e0) AS BIGINT))) AS b) c), e AS (SELECT rep, b * 4 + o AS slot, s + o AS pos FROM b, range(4) d(o))
SELECT rep, avg(v) AS mean_v, count(*) AS n FROM e JOIN t USING (pos) WHERE slot < (SELECT max(q) - min(q) + 1 FROM sp) GROUP BY rep""", "mean_v:5")
def _(s, d):
    p = supplier_panel(s, d)
    first, n = span(p)
    t = p.groupBy((F.col("q") - first).alias("pos")).agg(F.sum("stock").alias("v"))
    return RS.block_bootstrap(t, n=n, length=4, seed=41, reps=20).groupBy("rep").agg(F.avg("v").alias("mean_v"), F.count(F.lit(1)).alias("n"))


@query("geometric_block_bootstrap", f"""WITH {SP}, t AS (SELECT q - (SELECT min(q) FROM sp) AS pos, sum(stock) AS v FROM sp GROUP BY q), z AS (SELECT rep, i, i = 0 OR {DR(43, 'rep', 'i')} / 4294967296e0 < 1e0 / 6 AS nw, {DR(44, 'rep', 'i')} % (SELECT max(q) - min(q) + 1 FROM sp) AS f FROM range(20) a(rep), (SELECT unnest(range((SELECT max(q) - min(q) + 1 FROM sp))) AS i) b),
w AS (SELECT rep, i, last_value(CASE WHEN nw THEN i END IGNORE NULLS) OVER k AS a, last_value(CASE WHEN nw THEN f END IGNORE NULLS) OVER k AS f FROM z WINDOW k AS (PARTITION BY rep ORDER BY i)) SELECT rep, avg(v) AS mean_v, count(*) AS n FROM w JOIN t ON t.pos = (w.f + w.i - w.a) % (SELECT max(q) - min(q) + 1 FROM sp) GROUP BY rep""", "mean_v:5")
def _(s, d):
    p = supplier_panel(s, d)
    first, n = span(p)
    t = p.groupBy((F.col("q") - first).alias("pos")).agg(F.sum("stock").alias("v"))
    return RS.geometric_block_bootstrap(t, n=n, mean_length=6, seed=43, reps=20).groupBy("rep").agg(F.avg("v").alias("mean_v"), F.count(F.lit(1)).alias("n"))


@query("sign_flip_null", f"""WITH {SH}, x AS (SELECT period, part, clr - lag(clr) OVER w AS dd, first_value(clr) OVER w AS v0 FROM sh WINDOW w AS (PARTITION BY part ORDER BY period)), r AS (SELECT x.*, rep, CASE WHEN {DR(51, 'rep', 'period')} % 2 = 0 THEN 1e0 ELSE -1e0 END AS sg FROM x, range(5) t(rep))
SELECT rep, period, part, v0 + sum(coalesce(dd * sg, 0)) OVER (PARTITION BY rep, part ORDER BY period) AS flipped FROM r""", "flipped:8")
def _(s, d):
    return RS.sign_flip_null(K.clr(brand_mix(s, d)), value="clr", seed=51, reps=5)


@query("split_half", f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY {DR(61, '0', 'l_orderkey', 'l_linenumber')}, l_orderkey || '|' || l_linenumber) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(r > n // 2 AS INT) AS half FROM p""")
def _(s, d):
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return RS.split_half(l, block=["l_suppkey"], ids=["l_orderkey", "l_linenumber"], seed=61).drop("l_suppkey")


@query("day_split", "SELECT isodow(l_shipdate) AS dow, (isodow(l_shipdate) - 1) % 2 AS half, count(*) AS n FROM lineitem WHERE isodow(l_shipdate) < 6 GROUP BY ALL")
def _(s, d):
    l = table(s, d, "lineitem").where(F.weekday("l_shipdate") < 5)
    return l.groupBy((F.weekday("l_shipdate") + 1).alias("dow"), RS.day_split(F.col("l_shipdate")).alias("half")).agg(F.count(F.lit(1)).alias("n"))


VARS = ["flow", "stock", "n", "disc"]
YR = """yr AS (SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS BIGINT) AS y, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS flow, sum(l_quantity) AS stock, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS disc FROM lineitem GROUP BY ALL)"""
RKM = f"""{YR}, rk AS (SELECT y, entity, {', '.join(f"rank() OVER (PARTITION BY y ORDER BY {v}) + (count(*) OVER (PARTITION BY y, {v}) - 1) / 2e0 AS {v}" for v in VARS)} FROM yr),
mt AS ({' UNION ALL '.join(f"SELECT y, '{a}' AS i, '{b}' AS j, " + (f"corr({a}, {b})" if a != b else "1e0") + " AS c FROM rk GROUP BY y" for a in VARS for b in VARS)}),
dc AS (SELECT y, i, j, c - avg(c) OVER (PARTITION BY y, i) - avg(c) OVER (PARTITION BY y, j) + avg(c) OVER (PARTITION BY y) AS c FROM mt)"""
RVT = f"""{RKM}, pr AS (SELECT a.y AS b1, b.y AS b2, sum(a.c * b.c) AS s FROM dc a JOIN dc b USING (i, j) GROUP BY ALL), rv AS (SELECT p.b1, p.b2, p.s / sqrt(x.s * z.s) AS rv FROM pr p JOIN pr x ON x.b1 = p.b1 AND x.b2 = p.b1 JOIN pr z ON z.b1 = p.b2 AND z.b2 = p.b2 WHERE p.b1 < p.b2)"""


def yearly(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("y")).agg(
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100.0).alias("flow"), F.sum("l_quantity").alias("stock"),
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double").alias("disc"))


def _matrix(s, d):
    return SM_.rank_correlation_matrix(yearly(s, d), block="y", entity="entity", values=VARS)


@query("rank_correlation_matrix", f"WITH {RKM} SELECT * FROM mt", "c:8")
def _(s, d):
    return _matrix(s, d)


@query("rv_coefficient", f"WITH {RVT} SELECT * FROM rv", "rv:7")
def _(s, d):
    return SM_.rv_coefficient(SM_.double_center(_matrix(s, d), block="y"), block="y")


@query("statis_compromise")
def _(s, d):
    return SM_.statis_compromise(_matrix(s, d), block="y")[0]


@query("statis_movement")
def _(s, d):
    return SM_.statis_compromise(_matrix(s, d), block="y")[2]


@query("exact_relabel", f"""WITH {RVT}, pa AS (SELECT b1 - 1995 AS i, b2 - 1995 AS j, rv FROM rv), mk AS (SELECT m FROM range(128) t(m) WHERE bit_count(m::INTEGER) = 3), ds AS (SELECT m, avg(rv) FILTER ((m >> i) & 1 = (m >> j) & 1) - avg(rv) FILTER ((m >> i) & 1 <> (m >> j) & 1) AS st FROM mk, pa GROUP BY m), o AS (SELECT st AS o FROM ds WHERE m = 112)
SELECT max(o) AS observed, avg((st >= o - 1e-12)::INT) AS p, count(*) AS n_assignments, count(*) FILTER (st > o + 1e-12) AS n_better FROM ds, o""", "observed:7 p:7")
def _(s, d):
    rv = SM_.rv_coefficient(SM_.double_center(_matrix(s, d), block="y"), block="y")
    pairs = rv.select((F.col("b1") - 1995).alias("i"), (F.col("b2") - 1995).alias("j"), F.col("rv").alias("v"))
    return RS.exact_relabel(pairs, k=7, m=3, observed=0b1110000)


@query("kfold_cv", f"SELECT {DR(71, 'o_orderkey')} % 5 AS fold, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS total FROM orders GROUP BY 1", "total:2")
def _(s, d):
    o = table(s, d, "orders")
    return o.groupBy(RS.kfold(["o_orderkey"], 5, 71).alias("fold")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100.0).alias("total"))


@query("leave_one_year_out", f"""WITH {YR}, x AS (SELECT y, stock / 1e3 AS x, flow / 1e6 AS v FROM yr) SELECT h.y, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept, count(*) AS n_train FROM x JOIN (SELECT DISTINCT y FROM x) h ON x.y <> h.y GROUP BY h.y""", "slope:6 intercept:6")
def _(s, d):
    x = yearly(s, d).select("y", (F.col("stock") / 1e3).alias("x"), (F.col("flow") / 1e6).alias("v"))
    return RS.leave_one_out_fits(x, held="y", x="x", y="v")


@query("random_set_null", f"""WITH {YR}, u AS (SELECT entity, stddev_samp(flow) / avg(flow) AS cv FROM yr GROUP BY entity), o AS (SELECT avg(cv) AS o, count(*) AS k FROM u WHERE entity % 10 = 3), r AS (SELECT rep, entity, cv, row_number() OVER (PARTITION BY rep ORDER BY {DR(81, 'rep', 'entity')}, CAST(entity AS VARCHAR)) AS p FROM u, range(50) t(rep)),
m AS (SELECT rep, avg(cv) AS st FROM r, o WHERE p <= 10 GROUP BY rep) SELECT max(o) AS observed, avg(st) AS null_mean, (1 + count(*) FILTER (st >= o - 1e-12)) / (1 + count(*)) AS p FROM m, o""", "observed:7 null_mean:7 p:7")
def _(s, d):
    u = yearly(s, d).groupBy("entity").agg((F.stddev_samp("flow") / F.avg("flow")).alias("cv"))
    obs = u.where("entity % 10 = 3").agg(F.avg("cv")).scalar()
    return RS.random_set_null(u, unit="entity", value="cv", size=10, observed=obs, seed=81, reps=50)


@query("placebo_rank_permutation", f"""WITH {XS}, b AS (SELECT q, entity, r FROM xs WHERE r IS NOT NULL), x AS (SELECT b.*, rep FROM b, range(5) t(rep)), g AS (SELECT rep, q, r, row_number() OVER (PARTITION BY rep, q ORDER BY {DR(91, 'rep', 'entity')}, CAST(entity AS VARCHAR)) AS pos FROM x), t AS (SELECT rep, q, entity, row_number() OVER (PARTITION BY rep, q ORDER BY {DR(92, 'rep', 'entity')}, CAST(entity AS VARCHAR)) AS pos FROM x),
p AS (SELECT t.rep, t.q, t.entity, g.r AS pr FROM t JOIN g USING (rep, q, pos)), e AS (SELECT p.rep, avg(abs(n.r - p.pr)) AS placebo, avg(abs(n.r - c.r)) AS real FROM p JOIN b c ON c.q = p.q AND c.entity = p.entity JOIN b n ON n.q = p.q + 1 AND n.entity = p.entity GROUP BY p.rep) SELECT rep, placebo, real, 1 - placebo / real AS gain FROM e""", "placebo:7 real:7 gain:6")
def _(s, d):
    b = cross_section(s, d)
    p = RS.within_block_permutation(b, block=["q"], ids=["entity"], value="r", seed=91, reps=5)
    n = b.select("entity", (F.col("q") - 1).alias("q"), F.col("r").alias("rn"))
    return p.join(n, ["entity", "q"]).groupBy("rep").agg(F.avg(F.abs(F.col("rn") - F.col("permuted"))).alias("placebo"), F.avg(F.abs(F.col("rn") - F.col("r"))).alias("real")).withColumn("gain", 1 - F.col("placebo") / F.col("real"))


# ---------------------------------------------------------------- 2.14

HR = """hr0 AS (SELECT event_type AS series, CAST(floor(epoch(ts) / 3600) AS BIGINT) - 473352 AS h, count(*) AS n FROM events GROUP BY ALL), hs AS (SELECT unnest(generate_series((SELECT min(h) FROM hr0), (SELECT max(h) FROM hr0))) AS h),
hr AS (SELECT s.series, hs.h, coalesce(n, 0) AS n FROM (SELECT DISTINCT series FROM hr0) s CROSS JOIN hs LEFT JOIN hr0 USING (series, h)), qt AS (SELECT series, quantile_cont(n, 0.8) AS t FROM hr GROUP BY series), ev AS (SELECT series, h, CAST(n > t AS INT) AS e FROM hr JOIN qt USING (series)),
ab AS (SELECT a.h, a.e AS a, b.e AS b FROM ev a JOIN ev b ON a.h = b.h AND a.series = 'purchase' AND b.series = 'view')"""


def hourly(s, d):
    e = table(s, d, "events").groupBy(F.col("event_type").alias("series"), (F.floor(F.unix_timestamp("ts") / 3600) - 473352).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return cross_join_grid(e, entity="series", period="h", fill={"n": 0})


def binary(s, d):
    return E.binarize_quantile(hourly(s, d), by=["series"], value="n", level=0.8)


def two(s, d):
    e = binary(s, d)
    return e.groupBy("h").agg(F.max(F.when(F.col("series") == "purchase", F.col("event"))).alias("a"), F.max(F.when(F.col("series") == "view", F.col("event"))).alias("b"))


@query("binarize_quantile", f"WITH {HR} SELECT series, h, e AS event FROM ev")
def _(s, d):
    return binary(s, d).select("series", "h", "event")


@query("event_coincidence", f"""WITH {HR}, w AS (SELECT *, sum(b) OVER (ORDER BY h RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p, sum(a) OVER (ORDER BY h RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS t FROM ab)
SELECT count(*) FILTER (a = 1) AS n_a, count(*) FILTER (b = 1) AS n_b, count(*) AS t, count(*) FILTER (a = 1 AND p > 0) / count(*) FILTER (a = 1) AS precursor_rate, count(*) FILTER (b = 1 AND t > 0) / count(*) FILTER (b = 1) AS trigger_rate FROM w""", "precursor_rate:7 trigger_rate:7")
def _(s, d):
    return E.event_coincidence(two(s, d), by=[], index="h", a="a", b="b", tol=2, tau=1).drop("p_precursor", "p_trigger")


@query("event_coincidence_pvalue", f"""WITH {HR}, w AS (SELECT *, sum(b) OVER (ORDER BY h RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p FROM ab), g AS (SELECT count(*) FILTER (a = 1 AND p > 0) AS k, count(*) FILTER (a = 1) AS n, 1 - pow(1 - 3e0 / (count(*) - 1), count(*) FILTER (b = 1)) AS pp FROM w)
SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(pp) + (n - i) * ln(1 - pp))) AS p_precursor FROM g, (SELECT unnest(range((SELECT max(n) + 1 FROM g))) AS i) r WHERE i >= k""", "p_precursor:7")
def _(s, d):
    return E.event_coincidence(two(s, d), by=[], index="h", a="a", b="b", tol=2, tau=1).select("p_precursor")


@query("rolling_coincidence", f"""WITH {HR}, st AS (SELECT unnest(generate_series(0, (SELECT max(h) FROM ab) - 103, 24)) AS s), x AS (SELECT st.s AS start, h, a, b FROM ab JOIN st ON h BETWEEN s AND s + 103), w AS (SELECT *, sum(b) OVER (PARTITION BY start ORDER BY h RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS p FROM x)
SELECT start, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, count(*) FILTER (a = 1 AND p > 0) / sum(a) AS rate FROM w GROUP BY start""", "rate:7")
def _(s, d):
    ab = two(s, d)
    return E.rolling_coincidence(ab, by=[], index="h", a="a", b="b", tol=1, width=104, step=24, first=0, last=ab.agg(F.max("h")).first()[0])


@query("event_lag_scan", f"""WITH {HR}, l AS (SELECT unnest([0, 1, 2, 3, 6, 12, 24]) AS tau), w AS (SELECT tau, count(*) FILTER (x.a = 1 AND EXISTS (SELECT 1 FROM ab y WHERE y.b = 1 AND y.h BETWEEN x.h - tau - 1 AND x.h - tau)) AS k, count(*) FILTER (x.a = 1) AS n FROM ab x, l GROUP BY tau) SELECT tau, k / n AS precursor_rate FROM w""", "precursor_rate:7")
def _(s, d):
    t = two(s, d)
    out = None
    for tau in (0, 1, 2, 3, 6, 12, 24):
        r = E.event_coincidence(t, by=[], index="h", a="a", b="b", tol=1, tau=tau).select(F.lit(tau).alias("tau"), "precursor_rate")
        out = r if out is None else out.unionByName(r)
    return out


@query("self_clustering", f"WITH {HR}, x AS (SELECT series, e, lead(e) OVER (PARTITION BY series ORDER BY h) AS n FROM ev) SELECT series, avg(n) AS p_next, count(*) AS n FROM x WHERE e = 1 AND n IS NOT NULL GROUP BY series", "p_next:7")
def _(s, d):
    return E.self_clustering(binary(s, d), by=["series"], index="h", event="event")


STORMS = f"""{HR}, rt AS (SELECT series, h, n, n / nullif(CASE WHEN count(n) OVER w >= 20 THEN median(n) OVER w END, 0) AS r FROM hr WINDOW w AS (PARTITION BY series ORDER BY h ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)),
q9 AS (SELECT series, quantile_cont(r, 0.9) AS t FROM rt WHERE r IS NOT NULL GROUP BY series), pk AS (SELECT rt.*, t, n = max(n) OVER (PARTITION BY series ORDER BY h ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS lm, (min((n, h)) OVER (PARTITION BY series ORDER BY h ROWS BETWEEN 8 PRECEDING AND CURRENT ROW))[2] AS lo, (min((n, h)) OVER (PARTITION BY series ORDER BY h ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING))[2] AS hi FROM rt JOIN q9 USING (series)),
p AS (SELECT * FROM pk WHERE lm AND r >= greatest(1.5, t) AND h - lo >= 2 AND hi - h >= 2), g AS (SELECT *, max(hi) OVER (PARTITION BY series ORDER BY lo, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph FROM p), i AS (SELECT *, sum(CASE WHEN ph IS NULL OR lo > ph THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY lo, h) AS storm FROM g),
st AS (SELECT series, storm::BIGINT AS storm, min(lo) AS start, arg_min(h, (-n, h)) AS peak, max(hi) AS "end", max(n) AS peak_value FROM i GROUP BY ALL)"""


@query("storm_segments", f"WITH {STORMS} SELECT * FROM st")
def _(s, d):
    return storms(s, d)


def storms(s, d):
    from tidemark.operators.calendar import trailing_median_ratio

    x = trailing_median_ratio(hourly(s, d), value="n", entity="series", period="h")
    return E.storm_segments(x, by=["series"], index="h", value="n", ratio_col="ratio", min_ratio=1.5)


@query("hysteresis_index", f"""WITH {STORMS}, sn AS (SELECT series, storm, unnest(generate_series(start, "end")) AS h FROM st), oc AS (SELECT CASE series WHEN 'error' THEN 'click' WHEN 'purchase' THEN 'error' WHEN 'signup' THEN 'purchase' WHEN 'view' THEN 'signup' ELSE 'view' END AS series, h, n AS c FROM hr),
d AS (SELECT series, storm, h, n AS q, c FROM sn JOIN hr USING (series, h) JOIN oc USING (series, h)), ex AS (SELECT series, storm, min(q) AS q0, max(q) AS q1, min(c) AS c0, max(c) AS c1, arg_min(h, (-q, h)) AS k, count(*) FILTER (c IS NULL) AS miss FROM d GROUP BY ALL),
x AS (SELECT series, storm, h, k, (q - q0) / (q1 - q0) AS qn, (c - c0) / (c1 - c0) AS cn FROM d JOIN ex USING (series, storm) WHERE miss = 0 AND q1 > q0 AND c1 > c0), sg AS (SELECT *, lead(qn) OVER w AS q2, lead(cn) OVER w AS c2 FROM x WINDOW w AS (PARTITION BY series, storm ORDER BY h)),
cr AS (SELECT series, storm, l, h < k AS rise, h, cn + (c2 - cn) * (l - qn) / (q2 - qn) AS va FROM sg, (SELECT (v + 1) * 5e-2 AS l FROM range(19) t(v)) WHERE q2 IS NOT NULL AND q2 <> qn AND (qn - l) * (q2 - l) <= 0),
lm AS (SELECT series, storm, l, arg_min(va, h) FILTER (rise) AS r, arg_min(va, h) FILTER (NOT rise) AS f FROM cr GROUP BY ALL), hi AS (SELECT series, storm, avg(r - f) AS hysteresis, count(*) AS n_levels FROM lm WHERE r IS NOT NULL AND f IS NOT NULL GROUP BY ALL),
fi AS (SELECT series, storm, max(CASE WHEN h = k THEN cn END) - arg_min(cn, h) AS flushing FROM x GROUP BY ALL) SELECT series, storm, flushing, hysteresis, n_levels FROM fi LEFT JOIN hi USING (series, storm)""", "flushing:6 hysteresis:6")
def _(s, d):
    """Storms of each series against the count of the next series in the alphabet."""
    st = storms(s, d)
    h = hourly(s, d)
    nxt = {"click": "error", "error": "purchase", "purchase": "signup", "signup": "view", "view": "click"}
    m = F.create_map(*[F.lit(v) for kv in nxt.items() for v in (kv[1], kv[0])])
    other = h.select(m[F.col("series")].alias("series"), "h", F.col("n").alias("c"))
    j = h.join(other, ["series", "h"])
    span = st.select("series", "storm", F.explode(F.sequence("start", "end")).alias("h"))
    return E.hysteresis_index(j.join(span, ["series", "h"]), storm=["series", "storm"], index="h", q="n", c="c")


SY = f"""{DE}, sy AS (SELECT series, date - DATE '2024-01-01' AS t, ntile(5) OVER (PARTITION BY series ORDER BY value, date - DATE '2024-01-01') AS sym FROM de)"""


def symbols(s, d):
    e = daily_events(s, d).withColumn("t", F.datediff("date", F.lit("2024-01-01").cast("date")))
    return quintile_symbols(e, ["series"], "value", "t", out="sym").select("series", "t", "sym")


def symbol_pairs(s, d):
    x = symbols(s, d)
    a = x.where("series = 'click'").select("t", F.col("sym").alias("a"))
    return x.where("series <> 'click'").select("series", "t", F.col("sym").alias("b")).join(a, "t")


@query("recurrence_profile", f"WITH {SY}, l AS (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS lag) SELECT b.series, l.lag, avg((a.sym = b.sym)::INT) AS rate, count(*) AS n FROM sy a, l JOIN sy b ON b.t = a.t + l.lag WHERE a.series = 'click' AND b.series <> 'click' GROUP BY ALL", "rate:7")
def _(s, d):
    return E.recurrence_profile(symbol_pairs(s, d), by=["series"], index="t", a="a", b="b", lags=[-3, -2, -1, 0, 1, 2, 3])


@query("recurrence_determinism", f"""WITH {SY}, wn AS (SELECT unnest(generate_series(0, (SELECT max(t) FROM sy) - 20, 7)) AS win), x AS (SELECT b.series, win, a.t AS t, a.sym AS a, b.sym AS b FROM sy a JOIN sy b USING (t) JOIN wn ON t BETWEEN win AND win + 20 WHERE a.series = 'click' AND b.series <> 'click'), p AS (SELECT i.series, i.win, i.t AS i, j.t AS j, j.t - i.t AS d FROM x i JOIN x j ON i.series = j.series AND i.win = j.win AND i.a = j.b),
r AS (SELECT *, i - row_number() OVER (PARTITION BY series, win, d ORDER BY i) AS g FROM p), ln AS (SELECT series, win, d, g, count(*) AS len FROM r GROUP BY ALL), n AS (SELECT series, win, count(*) AS n FROM x GROUP BY ALL)
SELECT series, win, sum(len) / (max(n) * max(n)) AS recurrence_rate, sum(CASE WHEN len >= 2 THEN len ELSE 0 END) / sum(len) AS determinism FROM ln JOIN n USING (series, win) GROUP BY ALL""", "recurrence_rate:7 determinism:7")
def _(s, d):
    x = symbol_pairs(s, d)
    w = E.sliding_windows(x, index="t", width=21, step=7, first=0, last=x.agg(F.max("t")).first()[0])
    return E.recurrence_determinism(w, by=["series", "win"], index="t", a="a", b="b")


WK = """wk0 AS (SELECT o_orderpriority AS series, CAST(floor(epoch(o_orderdate) / 604800) AS BIGINT) - 1304 AS t, ln(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e2) AS v FROM orders GROUP BY ALL), wk AS (SELECT * FROM wk0)"""


def weekly(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), (F.floor(F.unix_timestamp("o_orderdate") / 604800) - 1304).alias("t")).agg(F.log(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100.0).alias("v"))


@query("delay_embedding", f"WITH {WK} SELECT a.series, a.t, a.v AS e0, b.v AS e1, c.v AS e2 FROM wk a JOIN wk b ON a.series = b.series AND b.t = a.t - 1 JOIN wk c ON a.series = c.series AND c.t = a.t - 2", "e0:7 e1:7 e2:7")
def _(s, d):
    return E.delay_embedding(weekly(s, d), by=["series"], index="t", value="v", dim=3).select("series", "t", "e0", "e1", "e2")


def pair_weekly(s, d):
    w = weekly(s, d)
    return w.join(w.where("series = '1-URGENT'").select("t", F.col("v").alias("y")), "t").where("series <> '1-URGENT'")


@query("cross_map_skill", f"""WITH {WK}, e AS (SELECT a.series, a.t, a.v AS e0, b.v AS e1, y.v AS y, row_number() OVER (PARTITION BY a.series ORDER BY a.t) AS n FROM wk a JOIN wk b ON a.series = b.series AND b.t = a.t - 1 JOIN wk y ON y.series = '1-URGENT' AND y.t = a.t JOIN wk y1 ON y1.series = '1-URGENT' AND y1.t = a.t - 1 WHERE a.series <> '1-URGENT'),
l AS (SELECT unnest([40, 160]) AS size), d AS (SELECT p.series, p.t, l.size, p.y, z.y AS zy, z.n, sqrt((p.e0 - z.e0) * (p.e0 - z.e0) + (p.e1 - z.e1) * (p.e1 - z.e1)) AS d FROM e p, l JOIN e z ON z.series = p.series AND z.n <= l.size AND abs(z.n - p.n) > 4),
r AS (SELECT *, row_number() OVER w AS r, greatest(min(d) OVER (PARTITION BY series, size, t), 1e-12) AS d1 FROM d WINDOW w AS (PARTITION BY series, size, t ORDER BY d, n)), f AS (SELECT series, size, t, max(y) AS y, sum(exp(-d / d1) * zy) / sum(exp(-d / d1)) AS p FROM r WHERE r <= 3 GROUP BY ALL)
SELECT series, size, corr(p, y) AS skill, count(*) AS n FROM f GROUP BY ALL""", "skill:6")
def _(s, d):
    return E.cross_map_skill(pair_weekly(s, d), by=["series"], index="t", source="v", target="y", dim=2, library=[40, 160], exclusion=4)


def _three_weekly(s, d):
    return weekly(s, d).groupBy("t").agg(*[F.max(F.when(F.col("series") == p, F.col("v"))).alias(n) for p, n in (("1-URGENT", "a"), ("2-HIGH", "b"), ("5-LOW", "c"))]).dropna()


@query("information_flow")
def _(s, d):
    w = _three_weekly(s, d)
    r = w.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    return E.information_flow(w.withColumn("half", (F.col("t") > (r.lo + r.hi) / 2).cast("int")), by=["half"], index="t", names=["a", "b", "c"])


@query("information_flow_rolling")
def _(s, d):
    w = _three_weekly(s, d)
    r = w.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    x = E.sliding_windows(w, index="t", width=104, step=4, first=r.lo, last=r.hi)
    return E.information_flow(x, by=["win"], index="t", names=["a", "b", "c"])


# Cramer's rule for the flow between two series: a = (C^-1 X)' - I, T[i <- j] = a_ij C_ij / C_ii.
@query("information_flow_pair", f"""WITH {WK}, z AS (SELECT a.series, y.v AS u0, y1.v AS u1, a.v AS v0, a1.v AS v1 FROM wk a JOIN wk y ON y.series = '1-URGENT' AND y.t = a.t JOIN wk a1 ON a1.series = a.series AND a1.t = a.t + 1 JOIN wk y1 ON y1.series = '1-URGENT' AND y1.t = a.t + 1 WHERE a.series <> '1-URGENT'),
m AS (SELECT series, count(*) AS n, var_pop(u0) AS cu, var_pop(v0) AS cv, covar_pop(u0, v0) AS c, covar_pop(u0, u1) AS uu, covar_pop(v0, u1) AS vu, covar_pop(u0, v1) AS uv, covar_pop(v0, v1) AS vv FROM z GROUP BY series)
SELECT series, 'v' AS source, 'u' AS target, (cu * vu - c * uu) / (cu * cv - c * c) * c / cu AS flow, n FROM m UNION ALL
SELECT series, 'u', 'v', (cv * uv - c * vv) / (cu * cv - c * c) * c / cv, n FROM m""", "flow:7")
def _(s, d):
    w = weekly(s, d)
    one = w.where("series = '1-URGENT'").select("t", F.col("v").alias("u"))
    x = w.where("series <> '1-URGENT'").select("series", "t", "v").join(one, "t")
    f = E.information_flow(x, by=["series"], index="t", names=["u", "v"])
    return f.where("source <> target").select("series", "source", "target", "flow", "n")


@query("granger_f", f"""WITH {WK}, z AS (SELECT a.series, a.v - 0 AS x0, y.v AS y, x1.v AS x1, y1.v AS y1 FROM wk a JOIN wk y ON y.series = '1-URGENT' AND y.t = a.t JOIN wk x1 ON x1.series = a.series AND x1.t = a.t - 1 JOIN wk y1 ON y1.series = '1-URGENT' AND y1.t = a.t - 1 WHERE a.series <> '1-URGENT'),
m AS (SELECT series, count(*) AS n, var_pop(y1) AS a, var_pop(x1) AS b, covar_pop(y1, x1) AS c, covar_pop(y1, y) AS p, covar_pop(x1, y) AS q, var_pop(y) AS v FROM z GROUP BY series), r AS (SELECT *, v - p * p / a AS r0, v - (p * p * b - 2 * p * q * c + q * q * a) / (a * b - c * c) AS r1 FROM m) SELECT series, n, (r0 - r1) / (r1 / (n - 3)) AS f_stat FROM r""", "f_stat:6")
def _(s, d):
    return E.granger_f(pair_weekly(s, d), by=["series"], index="t", x="v", y="y")


GR = """gr AS (SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS BIGINT) AS y, CAST(floor(sum(l_quantity) / 600) AS INT) AS g1, CAST(floor(count(*) / 22e0) AS INT) AS g2, CAST(floor(sum(l_extendedprice * 1e0) / count(*) / 8e3) AS INT) AS o, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS flow FROM lineitem GROUP BY ALL)"""


def graded(s, d):
    grade = lambda c: F.floor(c).cast("int")
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("y")).agg(
        grade(F.sum("l_quantity") / 600).alias("g1"), grade(F.count(F.lit(1)) / 22.0).alias("g2"), grade(F.avg("l_extendedprice") / 8e3).alias("o"),
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100.0).alias("flow"))


@query("within_block_pairs", f"WITH {GR} SELECT a.y, a.g1 AS xa, b.g1 AS xb, count(*) FILTER (a.flow < b.flow) AS less, count(*) FILTER (a.flow = b.flow) AS tie, count(*) AS n FROM gr a JOIN gr b ON a.y = b.y AND a.g1 < b.g1 GROUP BY ALL")
def _(s, d):
    p = SM_.graded_pair_counts(graded(s, d), block=["y"], x="g1", y="flow")
    return p.where("n > 0")


@query("concordance", f"WITH {GR} SELECT a.y, avg(CASE WHEN a.flow < b.flow THEN 1e0 WHEN a.flow = b.flow THEN 5e-1 ELSE 0e0 END) AS concordance, count(*) AS n_pairs FROM gr a JOIN gr b ON a.y = b.y AND a.g1 < b.g1 GROUP BY ALL", "concordance:7")
def _(s, d):
    return SM_.concordance(graded(s, d), block=["y"], x="g1", y="flow")


@query("concordance_continuous", "WITH g AS (SELECT l_suppkey AS entity, year(l_shipdate) AS y, avg(l_discount) AS x, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), r AS (SELECT y, round(x, 9) AS x, v FROM g) SELECT CAST(a.y AS BIGINT) AS y, avg(CASE WHEN a.v < b.v THEN 1e0 WHEN a.v = b.v THEN 5e-1 ELSE 0e0 END) AS concordance, count(*) AS n_pairs FROM r a JOIN r b ON a.y = b.y AND a.x < b.x GROUP BY a.y", "concordance:7")
def _(s, d):
    g = table(s, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("y")).agg(F.round(F.avg("l_discount"), 9).alias("x"), F.sum("l_quantity").alias("v"))
    return SM_.concordance(g, block=["y"], x="x", y="v")


def _newton_sql(x: str, y: str, source: str) -> str:
    """Newton steps on all pairs: the difference of x, and 1, 1/2 or 0 for the order of y."""
    return f"""pr AS (SELECT (b.{x} - a.{x}) * 1e0 AS z, CASE WHEN a.{y} < b.{y} THEN 1e0 WHEN a.{y} = b.{y} THEN 5e-1 ELSE 0e0 END AS s, a.entity AS ea, b.entity AS eb, a.y FROM {source} a JOIN {source} b ON a.y = b.y AND a.{x} < b.{x}),
fit AS (SELECT 0 AS i, 0e0 AS beta UNION ALL SELECT i + 1, beta + (SELECT sum(z * (s - 1 / (1 + exp(-beta * z)))) / sum(z * z / (1 + exp(-beta * z)) / (1 + exp(beta * z))) FROM pr) FROM fit WHERE i < 25),
be AS (SELECT beta FROM fit WHERE i = 25), u AS (SELECT pr.*, z * (s - 1 / (1 + exp(-beta * z))) AS u, z * z / (1 + exp(-beta * z)) / (1 + exp(beta * z)) AS w FROM pr, be),
rw AS (SELECT y, e, sum(u) AS s FROM (SELECT y, ea AS e, u FROM u UNION ALL SELECT y, eb, u FROM u) GROUP BY ALL)"""


# graded and continuous columns go the same way
@query("pim_fit", f"WITH RECURSIVE {GR}, {_newton_sql('g2', 'o', 'gr')} SELECT beta, (SELECT sum(w) FROM u) AS information FROM be", "beta:7 information:4")
def _(s, d):
    return s.createDataFrame([PR.pim_fit(graded(s, d), block=["y"], x="g2", y="o")], "beta double, information double")


@query("pim_vcov", f"WITH RECURSIVE {YR}, yc AS (SELECT entity, y, disc / n AS x, flow FROM yr), {_newton_sql('x', 'flow', 'yc')} SELECT beta, (SELECT sum(w) FROM u) AS information, ((SELECT sum(s * s) FROM rw) - (SELECT sum(u * u) FROM u)) / pow((SELECT sum(w) FROM u), 2) AS variance FROM be", "beta:7 information:4 variance:8")
def _(s, d):
    v = PR.pim_vcov(yearly(s, d).withColumn("x", F.col("disc") / F.col("n")), block=["y"], x="x", y="flow")
    return s.createDataFrame([v], "beta double, information double, variance double")


DOM = "a.g1 <= b.g1 AND a.g2 <= b.g2 AND (a.g1 < b.g1 OR a.g2 < b.g2)"


@query("dominance_join", f"WITH {GR}, c AS (SELECT y, g1, g2, count(*) AS n FROM gr GROUP BY ALL) SELECT b.y, b.g1, b.g2, b.n, coalesce((SELECT sum(a.n) FROM c a WHERE a.y = b.y AND {DOM}), 0)::BIGINT AS below, coalesce((SELECT sum(a.n) FROM c a WHERE a.y = b.y AND a.g1 >= b.g1 AND a.g2 >= b.g2 AND (a.g1 > b.g1 OR a.g2 > b.g2)), 0)::BIGINT AS above FROM c b")
def _(s, d):
    return PR.dominance_counts(graded(s, d), block=["y"], axes=["g1", "g2"]).select("y", *[F.col(g).cast("int").alias(g) for g in ("g1", "g2")], "n", "below", "above")


@query("dominance_summary", f"WITH {GR}, p AS (SELECT b.y, count(*) AS dp, avg(CASE WHEN b.o < a.o THEN 1e0 WHEN b.o = a.o THEN 5e-1 ELSE 0e0 END) AS c FROM gr a JOIN gr b ON a.y = b.y AND {DOM} GROUP BY ALL) SELECT y, (SELECT count(*) FROM gr WHERE gr.y = p.y) AS n, dp AS dominance_pairs, 2e0 * dp / ((SELECT count(*) FROM gr WHERE gr.y = p.y) * ((SELECT count(*) FROM gr WHERE gr.y = p.y) - 1)) AS comparable_share, c AS concordance FROM p", "comparable_share:7 concordance:7")
def _(s, d):
    return PR.dominance_summary(graded(s, d), block=["y"], axes=["g1", "g2"], outcome="o").where("dominance_pairs > 0")


CDOM = "a.stock <= b.stock AND a.r <= b.r AND (a.stock < b.stock OR a.r < b.r)"
CY2 = f"{YR}, yx AS (SELECT entity, CAST(y AS INT) AS y, stock, flow / n AS r, disc / n AS o, stock / 1e3 + flow / n / 1e5 AS c FROM yr)"


def _ungraded(s, d):
    x = yearly(s, d).withColumns({"r": F.col("flow") / F.col("n"), "o": F.col("disc") / F.col("n")})
    return x.withColumn("c", F.col("stock") / 1e3 + F.col("r") / 1e5)


# continuous axes and outcome; a composite that rises with both axes orders the incomparable pairs
@query("dominance_summary_continuous", f"WITH {CY2}, p AS (SELECT a.y, ({CDOM}) AS d, CASE WHEN b.o < a.o THEN 1e0 WHEN b.o = a.o THEN 5e-1 ELSE 0e0 END AS g FROM yx a JOIN yx b ON a.y = b.y AND a.c < b.c), m AS (SELECT y, count(*) AS n FROM yx GROUP BY y) SELECT y, any_value(n) AS n, count(*) FILTER (d) AS dominance_pairs, 2e0 * count(*) FILTER (d) / (any_value(n) * (any_value(n) - 1)) AS comparable_share, avg(g) FILTER (d) AS concordance, count(*) FILTER (NOT d) AS incomparable_pairs, avg(g) FILTER (NOT d) AS incomparable_agreement FROM p JOIN m USING (y) GROUP BY y", "comparable_share:7 concordance:7 incomparable_agreement:7")
def _(s, d):
    return PR.dominance_summary(_ungraded(s, d), block=["y"], axes=["stock", "r"], outcome="o", composite="c")


@query("average_rank_continuous", f"WITH {CY2}, c AS (SELECT b.entity, b.y, count(*) FILTER ({CDOM}) AS below, count(*) FILTER (a.stock >= b.stock AND a.r >= b.r AND (a.stock > b.stock OR a.r > b.r)) AS above, count(*) AS n FROM yx b JOIN yx a ON a.y = b.y GROUP BY ALL) SELECT entity, y, below, above, n - 1 - below - above AS incomparable, (below + 1) * (n + 1) / (2e0 + below + above) AS avg_rank FROM c", "avg_rank:7")
def _(s, d):
    return PR.average_rank_local(_ungraded(s, d), block=["y"], axes=["stock", "r"], entity="entity").select("entity", "y", "below", "above", "incomparable", "avg_rank")


@query("dominance_transitions", f"""WITH {GR}, b2 AS (SELECT a.y, a.entity, a.g1, a.g2, n.g1 AS h1, n.g2 AS h2 FROM gr a JOIN gr n ON a.entity = n.entity AND n.y = a.y + 1), p AS (SELECT a.y, ({DOM}) AS now, (a.h1 <= b.h1 AND a.h2 <= b.h2 AND (a.h1 < b.h1 OR a.h2 < b.h2)) AS up, (a.h1 >= b.h1 AND a.h2 >= b.h2 AND (a.h1 > b.h1 OR a.h2 > b.h2)) AS down FROM b2 a JOIN b2 b ON a.y = b.y)
SELECT y, count(*) FILTER (now AND up) AS kept, count(*) FILTER (now AND down) AS flipped, count(*) FILTER (now AND NOT up AND NOT down) AS lost, count(*) FILTER (up) - count(*) FILTER (now AND up) - count(*) FILTER (now AND down) AS gained FROM p GROUP BY y""")
def _(s, d):
    return SM_.dominance_transitions(graded(s, d), entity="entity", year="y", axes=["g1", "g2"])


@query("average_rank_local", f"WITH {GR}, c AS (SELECT b.entity, b.y, count(*) FILTER ({DOM}) AS below, count(*) FILTER (a.g1 >= b.g1 AND a.g2 >= b.g2 AND (a.g1 > b.g1 OR a.g2 > b.g2)) AS above, count(*) AS n FROM gr b JOIN gr a ON a.y = b.y GROUP BY ALL) SELECT entity, y, below, above, n - 1 - below - above AS incomparable, (below + 1) * (n + 1) / (n + 1 - (n - 1 - below - above)) AS avg_rank FROM c", "avg_rank:7")
def _(s, d):
    return PR.average_rank_local(graded(s, d), block=["y"], axes=["g1", "g2"], entity="entity").select("entity", "y", "below", "above", "incomparable", "avg_rank")


@query("composite_score", f"WITH {YR}, z AS (SELECT entity, y, {', '.join(f'({v} - avg({v}) OVER w) / nullif(stddev_pop({v}) OVER w, 0) AS {v}' for v in VARS)} FROM yr WINDOW w AS (PARTITION BY y)) SELECT entity, y, (flow + stock + n + disc) / 4 AS composite FROM z", "composite:7")
def _(s, d):
    return SM_.composite_score(yearly(s, d), block=["y"], values=VARS).select("entity", "y", "composite")


@query("composite_first_component")
def _(s, d):
    z = SM_.composite_score(yearly(s, d), block=["y"], values=VARS)
    return SM_.first_component(z, values=[f"z_{v}" for v in VARS], sign_of="composite").select("entity", "y", "composite", "pc1")


SUP = "su AS (SELECT s_suppkey, s_nationkey AS nat, n_regionkey AS reg, s_acctbal / 1e3 AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def hierarchy(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("nat"), F.col("n_regionkey").alias("reg"))
    return table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nat"), (F.col("s_acctbal") / 1e3).alias("v")).join(n, "nat")


@query("peer_z", f"WITH {SUP} SELECT s_suppkey, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS z FROM su WINDOW w AS (PARTITION BY reg)", "z:7")
def _(s, d):
    return standardise(hierarchy(s, d), by=["reg"], value="v").select("s_suppkey", "z")


NB = "sum(w * b.{v}) / nullif(sum(w), 0)"
NBJ = "FROM {t} a JOIN (SELECT * FROM {t}) b ON a.s_suppkey <> b.s_suppkey CROSS JOIN LATERAL (SELECT CASE WHEN a.nat = b.nat THEN 1e0 WHEN a.reg = b.reg THEN 5e-1 ELSE 0e0 END AS w) GROUP BY a.s_suppkey, a.{v}"


@query("neighbour_gap", f"WITH {SUP} SELECT a.s_suppkey, {NB.format(v='v')} AS neighbour_mean, a.v - {NB.format(v='v')} AS gap {NBJ.format(t='su', v='v')}", "neighbour_mean:9 gap:9")
def _(s, d):
    return SM_.neighbour_gap(hierarchy(s, d), levels=["nat", "reg"], weights=[1.0, 0.5], value="v").select("s_suppkey", "neighbour_mean", "gap")


ZS = f"{SUP}, zs AS (SELECT *, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM su), nb AS (SELECT a.s_suppkey, a.z, {NB.format(v='z')} AS m {NBJ.format(t='zs', v='z')})"


@query("local_moran", f"WITH {ZS} SELECT s_suppkey, z, z * m AS local_i FROM nb", "z:7 local_i:7")
def _(s, d):
    return SM_.local_moran(hierarchy(s, d), levels=["nat", "reg"], weights=[1.0, 0.5], value="v").select("s_suppkey", "z", "local_i")


@query("global_moran", f"WITH {ZS} SELECT sum(z * m) / sum(z * z) AS moran_i, count(*) AS n FROM nb WHERE m IS NOT NULL", "moran_i:7")
def _(s, d):
    return SM_.global_moran(SM_.local_moran(hierarchy(s, d), levels=["nat", "reg"], weights=[1.0, 0.5], value="v"))


@query("anova_r2", "WITH t AS (SELECT o_orderpriority AS f, o_totalprice / 1e5 AS v FROM orders), m AS (SELECT avg(v) AS g FROM t), b AS (SELECT f, count(*) AS n, avg(v) AS a FROM t GROUP BY f) SELECT (SELECT sum(n * (a - g) * (a - g)) FROM b, m) / (SELECT sum((v - g) * (v - g)) FROM t, m) AS r2, (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM b) AS n_groups", "r2:8")
def _(s, d):
    return SM_.anova_r2(table(s, d, "orders").select(F.col("o_orderpriority").alias("f"), (F.col("o_totalprice") / 1e5).alias("v")), factor="f", value="v")


TFIDF_COSINE = 0.4
TD = r"""w AS (SELECT min(doc_id) AS c, count(*) AS copies, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents GROUP BY coalesce(text, '')),
tm AS (SELECT c, copies, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS term FROM w),
f AS (SELECT c, copies, term, count(*) AS tf FROM tm GROUP BY ALL),
d AS (SELECT term, sum(copies) AS df FROM f GROUP BY term HAVING sum(copies) >= 2),
x AS (SELECT c, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS x FROM f JOIN d USING (term)),
u AS (SELECT c, term, x / sqrt(sum(x * x) OVER (PARTITION BY c)) AS x FROM x),
p AS (SELECT a.c AS a, b.c AS b, sum(a.x * b.x) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.c < b.c GROUP BY ALL HAVING sum(a.x * b.x) >= 0.4)"""


def _text_pairs(s, d):
    docs = spread(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    classes = TJ.text_classes(docs, id="doc_id", text="text")
    return docs, classes, TJ.cosine_join(classes, threshold=TFIDF_COSINE)


@query("tfidf_pairs", f"WITH {TD} SELECT a, b, cosine FROM p", "cosine:7")
def _(s, d):
    return _text_pairs(s, d)[2]


@query("tfidf_neighbours", f"""WITH {TD}, e AS (SELECT a AS class_id, b AS other, cosine FROM p UNION ALL SELECT b, a, cosine FROM p), g AS (SELECT class_id, count(*) AS n_links, max(round(cosine, 9)) AS cosine FROM e GROUP BY ALL),
h AS (SELECT class_id, min(other) AS neighbour FROM e JOIN g USING (class_id) WHERE round(e.cosine, 9) = g.cosine GROUP BY ALL)
SELECT doc_id, c AS class_id, copies, coalesce(n_links, 0) AS n_links, neighbour, g.cosine FROM documents JOIN w ON coalesce(text, '') = t LEFT JOIN g ON c = g.class_id LEFT JOIN h ON c = h.class_id""", "cosine:7")
def _(s, d):
    docs, classes, pairs = _text_pairs(s, d)
    return TJ.nearest_texts(docs, cut_lineage(pairs, "text-pairs"), classes, id="doc_id", text="text")

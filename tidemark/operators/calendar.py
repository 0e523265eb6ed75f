"""Per-entity operators along the calendar.

Input is a panel with at most one row per (entity, period): an entity's group is bounded
by the number of calendar periods, whatever the size of the raw facts, because the facts
were summed map-side before.  A lag is a lookup at ``period - k`` and never a row shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import log_ratio, ratio
from tidemark.session import cut_lineage


def _by(entity: str, period: str):
    return Window.partitionBy(entity).orderBy(period)


def lag_at(value: str | Column, k: int, entity: str = "entity", period: str = "q") -> Column:
    """Value at exactly ``period - k`` (k < 0 looks ahead); a gap gives NULL."""
    v = F.col(value) if isinstance(value, str) else value
    return F.max(v).over(_by(entity, period).rangeBetween(-k, -k))


def calendar_lag(df: DataFrame, *, value: str, lags: list[int], entity="entity", period="q") -> DataFrame:
    name = lambda k: f"{value}_lag{k}" if k >= 0 else f"{value}_lead{-k}"
    return df.withColumns({name(k): lag_at(value, k, entity, period) for k in lags})


def running_ytd(df: DataFrame, *, value: str, out: str = "ytd", entity="entity", period="q") -> DataFrame:
    """Calendar-year-to-date sum of a flow."""
    w = Window.partitionBy(entity, F.floor(F.col(period) / 4)).orderBy(period)
    return df.withColumn(out, F.sum(value).over(w))


def decumulate(df: DataFrame, *, value: str = "ytd", out: str = "flow_q", entity="entity", period="q") -> DataFrame:
    """YTD -> quarterly flow.

    Q1 is the value itself; later quarters subtract the previous quarter of the same year
    only if it exists and is not NULL, else the flow is NULL and ``missing_prior`` is set."""
    prev = lag_at(value, 1, entity, period)
    first = F.pmod(F.col(period), F.lit(4)) == 0
    return df.withColumns(
        {
            out: F.when(first, F.col(value)).otherwise(F.col(value) - prev),
            "missing_prior": ~first & prev.isNull(),
        }
    )


def entrant_rule(df: DataFrame, *, ytd: str = "ytd", flow: str = "flow_q", out: str = "flow_b", entity="entity", period="q") -> DataFrame:
    """An entity's first-ever filing counts its YTD as the flow of that quarter."""
    first = F.min(F.when(F.col(ytd).isNotNull(), F.col(period))).over(Window.partitionBy(entity))
    return df.withColumn(out, F.when(F.col(period) == first, F.coalesce(F.col(flow), F.col(ytd))).otherwise(F.col(flow)))


def ytd_reset_guard(df: DataFrame, *, guard: str, flows: list[str], entity="entity", period="q") -> DataFrame:
    """NULL every flow in a row whose guard YTD fell against the previous quarter of the same year."""
    prev = lag_at(guard, 1, entity, period)
    reset = F.coalesce((F.pmod(F.col(period), F.lit(4)) > 0) & (F.col(guard) < prev), F.lit(False))
    return df.withColumn("ytd_reset_flag", reset).withColumns(
        {f: F.when(~F.col("ytd_reset_flag"), F.col(f)) for f in flows}
    )


def discontinuity_flags(df: DataFrame, *, flow: str, entity="entity", period="q") -> DataFrame:
    """Negative flow; negative flow after an all-positive year to date."""
    year = F.floor(F.col(period) / 4)
    w = Window.partitionBy(entity, year).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.count(F.lit(1)).over(w)
    pos = F.sum(F.when(F.col(flow) > 0, 1).otherwise(0)).over(w)
    neg = F.coalesce(F.col(flow) < 0, F.lit(False))
    return df.withColumns({"negative_flow": neg, "sign_break": neg & (seen > 0) & (F.coalesce(pos, F.lit(0)) == seen)})


def row_lag_lead(df: DataFrame, *, value: str, lag: int = 1, lead: int = 1, entity="entity", period="q") -> DataFrame:
    """Row shifts, for series that are already on a complete grid."""
    w = _by(entity, period)
    return df.withColumns({f"{value}_prev": F.lag(value, lag).over(w), f"{value}_next": F.lead(value, lead).over(w)})


def pct_change_k(df: DataFrame, *, value: str, ks: list[int] = [1], entity="entity", period="q") -> DataFrame:
    """Growth over k rows within entity; NULLs are not padded, a zero base gives NULL."""
    w = _by(entity, period)
    return df.withColumns({f"{value}_g{k}": ratio(F.col(value), F.lag(value, k).over(w)) - 1 for k in ks})


def log_growth(df: DataFrame, *, value: str, k: int = 1, out: str = "g", entity="entity", period="q") -> DataFrame:
    """Log difference against ``period - k``, only when both are positive."""
    return df.withColumn(out, log_ratio(F.col(value), lag_at(value, k, entity, period)))


def rolling_stat(df: DataFrame, *, value: str, n: int, stat: str, min_periods: int | None = None, out: str | None = None, entity="entity", period="q") -> DataFrame:
    """Rolling sum / mean / max / median over the last n rows, NULL under ``min_periods`` values."""
    w = _by(entity, period).rowsBetween(-(n - 1), 0)
    fn = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "median": lambda c: F.percentile(c, F.lit(0.5))}[stat]
    agg = fn(value).over(w)
    need = n if min_periods is None else min_periods
    return df.withColumn(out or f"{value}_{stat}{n}", F.when(F.count(value).over(w) >= need, agg))


def trailing_median_ratio(df: DataFrame, *, value: str, n: int = 26, min_periods: int = 20, out: str = "ratio", entity="entity", period="q") -> DataFrame:
    """Value over the median of the previous n values (the current one excluded)."""
    w = _by(entity, period).rowsBetween(-n, -1)
    med = F.when(F.count(value).over(w) >= min_periods, F.percentile(value, F.lit(0.5)).over(w))
    return df.withColumn(out, ratio(F.col(value), med))


def local_maximum(df: DataFrame, *, value: str, half: int = 4, out: str = "is_peak", entity="entity", period="q") -> DataFrame:
    w = _by(entity, period).rowsBetween(-half, half)
    return df.withColumn(out, F.col(value) == F.max(value).over(w))


def cumcount_age(df: DataFrame, *, out: str = "age", entity="entity", period="q") -> DataFrame:
    return df.withColumn(out, F.row_number().over(_by(entity, period)) - 1)


def topk_per_group(df: DataFrame, *, by: str, value: str, k: int, tie: str = "entity") -> DataFrame:
    """First k per group by (value desc, tie asc).

    Catalyst plans the row_number filter as a group limit, so every task forwards at most
    k rows per group and a hot group does not travel."""
    w = Window.partitionBy(by).orderBy(F.col(value).desc_nulls_last(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nlargest(df: DataFrame, *, value: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(value).desc_nulls_last(), F.col(tie).asc()).limit(n)


def standardise(df: DataFrame, *, by: list[str], value: str, ddof: int = 1, out: str = "z") -> DataFrame:
    """z-score inside a group; the moments are aggregated first and joined back."""
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    m = df.groupBy(*by).agg(F.avg(value).alias("_m"), sd(value).alias("_s"))
    return df.join(m, by).withColumn(out, ratio(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


@F.udf(T.ArrayType(T.DoubleType()), useArrow=True)
def _smoothed(values, alpha):
    """Levels of one ordered series, in one pass."""
    out, level = [], None
    for v in values:
        if v is not None:
            level = v if level is None else alpha * v + (1 - alpha) * level
        out.append(level)
    return out


def exp_smoothing(df: DataFrame, *, value: str, alpha: float | str = 0.3, out: str = "level", entity: str | list[str] = "entity", period="q") -> DataFrame:
    """l = alpha x + (1 - alpha) l, started at the first observed value, unchanged on a missing one.

    ``alpha`` is a number or one of the ``entity`` columns.  The ordered array of one entity is bounded by the
    calendar and walked once."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    series = F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col(value).cast("double").alias("v"))))
    gain = F.col(alpha) if isinstance(alpha, str) else F.lit(float(alpha))
    packed = df.groupBy(*keys).agg(series.alias("_a")).withColumn("_l", _smoothed(F.col("_a.v"), gain))
    points = F.arrays_zip(F.col("_a.p").alias("p"), F.col("_l").alias("l"))
    lev = packed.select(*keys, F.explode(points).alias("_e")).select(*keys, F.col("_e.p").alias(period), F.col("_e.l").alias(out))
    return df.join(lev, [*keys, period])


def expanding_mean(df: DataFrame, *, value: str, out: str = "climatology", by: list[str], order: str, min_periods: int = 1) -> DataFrame:
    """Mean of all strictly earlier values."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.when(F.count(value).over(w) >= min_periods, F.avg(value).over(w)))


def gap_interpolate(df: DataFrame, *, value: str, out: str | None = None, entity="entity", period="q") -> DataFrame:
    """Fill a single missing value that has both neighbours with their mean; longer runs keep one fill
    at their left end only (limit 1, inside)."""
    w = _by(entity, period)
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    pos = F.row_number().over(w)
    df = df.withColumn("_i", pos).withColumn("_iv", F.when(F.col(value).isNotNull(), F.col("_i")))
    left, right = F.last(value, True).over(back), F.first(value, True).over(ahead)
    li, ri = F.last("_iv", True).over(back), F.first("_iv", True).over(ahead)
    fill = F.when(F.col("_i") - li == 1, left + (right - left) / (ri - li))
    return df.withColumn(out or value, F.coalesce(F.col(value), fill)).drop("_i", "_iv")


def calendar_mask_interpolate(df: DataFrame, *, value: str, mask: str, out: str, entity="entity", period="q") -> DataFrame:
    """Blank the masked rows, then draw a straight line through every inside run."""
    w = _by(entity, period)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_v", F.when(~F.col(mask), F.col(value))).withColumn("_i", F.row_number().over(w))
    df = df.withColumn("_iv", F.when(F.col("_v").isNotNull(), F.col("_i")))
    left, right = F.last("_v", True).over(back), F.first("_v", True).over(ahead)
    li, ri = F.last("_iv", True).over(back), F.first("_iv", True).over(ahead)
    line = left + (right - left) * (F.col("_i") - li) / F.nullif(ri - li, F.lit(0))
    return df.withColumn(out, F.coalesce(F.col("_v"), line)).drop("_v", "_i", "_iv")


def forward_fill_limit(df: DataFrame, *, value: str, limit: int = 2, out: str | None = None, entity="entity", period="q") -> DataFrame:
    w = _by(entity, period).rowsBetween(-limit, 0)
    return df.withColumn(out or value, F.last(value, True).over(w))


def running_max_step(df: DataFrame, *, keys: list[str], x: str, y: str, out: str = "ceiling") -> DataFrame:
    """Cumulative maximum of y ordered by x, one row per distinct x, split over slices of x."""
    from tidemark.operators.ranks import slice_bounds, slice_of

    base = cut_lineage(df.groupBy(*keys, x).agg(F.max(y).alias("_y")), "distinct")
    cuts = slice_bounds(base, x)
    base = base.withColumn("_s", slice_of(F.col(x).cast("double"), cuts))
    wk = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    off = (
        base.groupBy(*keys, "_s").agg(F.max("_y").alias("_m"))
        .select(*keys, "_s", F.max("_m").over(wk.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)).alias("_o"))
    )
    inner = Window.partitionBy(*keys, "_s").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    return (
        base.join(off, [*keys, "_s"])
        .select(*keys, x, F.greatest(F.max("_y").over(inner), F.col("_o")).alias(out))
    )


def cyclic_shift(df: DataFrame, *, by: list[str], index: str, value: str, shift: int, n: int, out: str = "shifted") -> DataFrame:
    """Rotate a complete series of length n: row i receives the value of row i - shift."""
    moved = df.select(*by, F.pmod(F.col(index) + shift, F.lit(n)).alias(index), F.col(value).alias(out))
    return df.join(moved, [*by, index])

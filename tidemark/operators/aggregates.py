"""Grouped reductions.  All are partial-aggregated map-side; medians and quantiles go
through ``ranks.exact_quantiles`` when the group size is not bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators.ranks import exact_quantiles, group_medians, prefix_totals


def filtered_share(df: DataFrame, *, by: list[str], value: str, cond: Column, out: str = "share") -> DataFrame:
    """Sum over a subset divided by the sum over all."""
    return df.groupBy(*by).agg(
        F.sum(value).alias("total"),
        F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0)).alias("part"),
    ).withColumn(out, ratio("part", "total"))


def min_count_sum(value: str | Column, n: int) -> Column:
    """Sum that is NULL unless at least n values are present."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(c) >= n, F.sum(c))


def latest_per_key(df: DataFrame, *, keys: list[str], time: str, tie: str | None = None) -> DataFrame:
    """Last row per key by (time, tie): a partial max_by of the row struct, no sort."""
    cols = [c for c in df.columns if c not in keys]
    order = F.struct(time, tie) if tie else F.col(time)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(*keys, "_r.*")


def first_per_key(df: DataFrame, *, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in a stated order."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def mode_by_value(df: DataFrame, *, by: list[str], item: str, weight: Column, out: str = "top") -> DataFrame:
    """Item with the largest total; the smallest item wins a tie."""
    t = df.groupBy(*by, item).agg(weight.alias("_w"))
    return t.groupBy(*by).agg(F.min_by(item, F.struct((-F.col("_w")).alias("a"), F.col(item).alias("b"))).alias(out), F.max("_w").alias(f"{out}_weight"))


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    ok = v.isNotNull()
    return F.try_divide(F.sum(F.when(ok, v * w)).cast("double"), F.sum(F.when(ok, w)).cast("double"))


def share_of_total(df: DataFrame, *, by: list[str], value: str, out: str = "share") -> DataFrame:
    """Part over group total; totals are aggregated and joined, so no group sits in one window."""
    t = df.groupBy(*by).agg(F.sum(value).alias("_t"))
    return df.join(t, by).withColumn(out, ratio(value, "_t")).drop("_t")


def hhi(df: DataFrame, *, by: list[str], item: str, value: str, out: str = "hhi") -> DataFrame:
    """Sum of squared shares from two sums: sum(x^2) / sum(x)^2."""
    t = df.groupBy(*by, item).agg(F.sum(value).cast("double").alias("_x"))
    return t.groupBy(*by).agg(ratio(F.sum(F.col("_x") * F.col("_x")), F.sum("_x") * F.sum("_x")).alias(out), F.count(F.lit(1)).alias("n_items"))


def resample_calendar(df: DataFrame, *, label: Column, by: list[str], time: str, value: str, how: str = "mean", out: str = "value") -> DataFrame:
    """Daily -> weekly / month-end / quarter by a label expression; mean, sum or last."""
    agg = {"mean": F.avg(value), "sum": F.sum(value), "last": F.max_by(value, time)}[how]
    return df.groupBy(*by, label.alias("label")).agg(agg.alias(out), F.count(value).alias("n_obs"))


def quarter_volatility(df: DataFrame, *, label: Column, by: list[str], time: str, value: str, log: bool = True, avail: str | None = None, asof: Column | None = None) -> DataFrame:
    """Mean level and sample sd of daily (log) changes inside the period; the as-of form keeps
    only observations that were public by the period's availability date."""
    w = Window.partitionBy(*by).orderBy(time)
    prev = F.lag(value).over(w)
    ch = (F.log(F.col(value)) - F.log(prev)) if log else (F.col(value) - prev)
    x = df.withColumn("_ch", ch)
    if avail is not None and asof is not None:
        x = x.where(F.col(avail) <= asof)
    return x.groupBy(*by, label.alias("label")).agg(F.avg(value).alias("level"), F.stddev_samp("_ch").alias("vol"), F.count("_ch").alias("n_changes"))


def weekly_bucket_mix(
    obs: DataFrame, *, kind: str, date: str, bucket: str, amount: str, count: str, buckets: list[str],
    week: Column, min_days: int = 3, min_count: int = 100, all_weeks: bool = True,
) -> DataFrame:
    """Sums by (type, week, bucket), days observed, usability rule, shares; every week of the span present."""
    daily = obs.groupBy(kind, date, bucket).agg(F.sum(amount).alias("_d"), F.sum(count).alias("_n"))
    daily = daily.withColumn("week", week)
    arr = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col(bucket) == b, F.col(c))), F.lit(0)) for b in buckets])
    g = daily.groupBy(kind, "week").agg(
        F.count_distinct(date).alias("valid_days"), arr("_d").alias("D"), arr("_n").alias("N")
    )
    if all_weeks:
        lo, wall = daily.agg(F.min("week")).scalar(), daily.agg(F.max(date)).scalar()
        span = F.sequence(lo, F.greatest(lo, wall), F.expr("interval 7 days"))
        spine = obs.select(kind).distinct().select(kind, F.explode(span).alias("week")).where(F.col("week") <= wall)
        zero = F.transform(F.array(*[F.lit(b) for b in buckets]), lambda _: F.lit(0))
        g = spine.join(g, [kind, "week"], "left").select(
            kind, "week",
            F.coalesce("valid_days", F.lit(0)).alias("valid_days"),
            F.coalesce("D", zero.cast(g.schema["D"].dataType)).alias("D"),
            F.coalesce("N", zero.cast(g.schema["N"].dataType)).alias("N"),
        )
    tot = lambda c: F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    usable = (F.col("valid_days") >= min_days) & (tot("N") >= min_count) & (tot("D") > 0)
    g = g.withColumn("usable", usable)
    return g.withColumn("mix", F.when(F.col("usable"), F.transform("D", lambda x: x / tot("D"))))


def partial_week_mix(obs: DataFrame, *, asof, date: str, kind: str, week: Column, **kw) -> DataFrame:
    """Observed mix of the unfinished week of ``asof``; provisional and never usable."""
    monday = F.date_sub(F.lit(asof).cast("date"), F.weekday(F.lit(asof).cast("date")))
    part = obs.where((F.col(date) >= monday) & (F.col(date) <= F.lit(asof).cast("date")))
    g = weekly_bucket_mix(part, kind=kind, date=date, week=week, all_weeks=False, **kw)
    tot = F.aggregate(F.col("D").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return (
        g.withColumn("meets_rule_so_far", F.col("usable"))
        .withColumn("mix", F.when(tot > 0, F.transform("D", lambda x: x / tot)))
        .withColumn("usable", F.lit(False))
        .withColumn("provisional", F.lit(True))
    )


def year_columns(df: DataFrame, *, key: str, year: str, measures: list[str], first: int, second: int) -> DataFrame:
    """Chosen years of several measures side by side, and their difference."""
    aggs = []
    for m in measures:
        for y in (first, second):
            aggs.append(F.max(F.when(F.col(year) == y, F.col(m))).alias(f"{m}_{y}"))
    out = df.where(F.col(year).isin(first, second)).groupBy(key).agg(*aggs)
    return out.withColumns({f"{m}_change": F.col(f"{m}_{second}") - F.col(f"{m}_{first}") for m in measures})


def coverage_report(df: DataFrame, *, by: str, columns: list[str], flags: list[str], rank_value: str, k: int = 50, tie: str = "entity") -> DataFrame:
    """Rows, non-null counts and flag counts per period, and the cut-off of the top k."""
    from tidemark.operators.calendar import topk_per_group

    base = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.sum(F.col(f).cast("long")).alias(f"n_{f}") for f in flags],
    )
    cut = topk_per_group(df.where(F.col(rank_value).isNotNull()), by=by, value=rank_value, k=k, tie=tie).groupBy(by).agg(F.min(rank_value).alias("topk_cutoff"))
    return base.join(cut, by, "left")


def trailing_origins(df: DataFrame, *, index: str, span: int, out: str = "origin") -> DataFrame:
    """Every row once for each origin whose trailing ``span`` periods hold it, up to the last period of the table."""
    last = df.agg(F.max(index)).scalar()
    return df.withColumn(out, F.explode(F.sequence(F.col(index), F.least(F.col(index) + span - 1, last))))


def mad_scale(
    df: DataFrame, *, keys: list[str], value: str, min_obs: int = 12, floor_q: float | None = 0.10, out: str = "scale", floor_by: list[str] = []
) -> DataFrame:
    """1.4826 x median absolute deviation, NULL under ``min_obs`` values, floored at a quantile of the population
    (of each ``floor_by`` group).

    Groups are bounded series (a window of periods), so the built-in exact percentile is used."""
    med = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.median(value).alias("_m"), F.count(value).alias("n_obs"))
    dev = df.join(med, keys).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    raw = dev.groupBy(*keys).agg(F.first("n_obs").alias("n_obs"), (1.4826 * F.median("_d")).alias("raw"))
    raw = raw.withColumn("raw", F.when(F.col("n_obs") >= min_obs, F.col("raw")))
    if floor_q is None:
        return raw.withColumnRenamed("raw", out)
    if floor_by:
        floors = exact_quantiles(raw.where(F.col("raw").isNotNull()), floor_by, "raw", [floor_q], "_f").drop("tau")
        floored = raw.join(floors, floor_by, "left")
        return floored.withColumn(out, F.when(F.col("raw").isNotNull(), F.greatest("raw", "_f"))).drop("_f")
    floor = exact_quantiles(raw, [], "raw", [floor_q], "_f").select("_f").scalar()
    return raw.withColumn(out, F.when(F.col("raw").isNotNull(), F.greatest(F.col("raw"), floor)))


def histogram_bins(df: DataFrame, *, value: str, bins: int = 10, by: list[str] = [], weight: str | None = None) -> DataFrame:
    """Counts (or sums of ``weight``) over equal bins of [0, 1], the last bin closed."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(F.col(value).between(0, 1)).groupBy(*by, b.alias("bin")).agg(n.alias("n"))


def crosstab_share(df: DataFrame, *, row: str, col: str) -> DataFrame:
    """Row-normalised cross table in long form."""
    t = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    return share_of_total(t, by=[row], value="n")


def argmin_tie_low(df: DataFrame, *, keys: list[str], loss: str, order: str) -> DataFrame:
    """Row with the smallest loss; the smallest ``order`` wins a tie."""
    cols = [c for c in df.columns if c not in keys]
    b = df.where(F.col(loss).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(loss, order)).alias("_b"))
    return b.select(*keys, F.col(f"_b.{order}"), F.col(f"_b.{loss}"))


def quantile_outlier_filter(df: DataFrame, *, values: list[str], level: float = 0.9999) -> DataFrame:
    """Keep rows where every |value| is strictly below its whole-table quantile."""
    out = df
    for v in values:
        cut = exact_quantiles(df.select(F.abs(F.col(v)).alias("_a")), [], "_a", [level], "_q").select("_q").scalar()
        out = out.where(F.abs(F.col(v)) < cut)
    return out


def trim_top_quantile(df: DataFrame, *, values: list[str], level: float = 0.98) -> DataFrame:
    """Drop rows above the quantile of any listed column."""
    out = df
    for v in values:
        cut = exact_quantiles(df.select(v), [], v, [level], "_q").select("_q").scalar()
        out = out.where(F.col(v) <= cut)
    return out

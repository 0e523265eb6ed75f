"""Ranks, running totals and exact quantiles that do not need a whole group in one task.

A plain ``Window.partitionBy(key)`` sends a group that holds a third of all rows to one
task.  Here the rows are first reduced to one row per distinct (key, value); the value
axis is cut at B global quantiles; each (key, slice) is summed on its own, and the totals
of the earlier slices (at most B rows per key) are added as an offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

SLICES = 32


def slice_bounds(df: DataFrame, order: str, slices: int = SLICES) -> list[float]:
    """Cut points on the order axis: one small job, at most ``slices - 1`` numbers returned.

    They become literals of the plan, so a retried task cuts at the same places."""
    probs = [i / slices for i in range(1, slices)]
    got = df.select(F.col(order).cast("double").alias("v")).approxQuantile("v", probs, 0.005)
    return sorted(set(got))


def slice_of(order, bounds: list[float]):
    """Index of the slice that a value falls in: the number of cut points below it (a balanced
    tree of comparisons, so five tests for 31 cut points)."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(order > F.lit(float(bounds[mid])), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def _sliced(df: DataFrame, keys: list[str], order: str, measures: list[str], bounds: list[float] | None):
    """(rows reduced to distinct (keys, order) with their slice, offsets and totals per (keys, slice))."""
    # written once: the cut points, the slice totals and the rows all read this reduced table
    base = cut_lineage(df.groupBy(*keys, order).agg(*[F.sum(m).alias(m) for m in measures]), "distinct")
    cuts = slice_bounds(base, order) if bounds is None else bounds
    base = base.withColumn("_s", slice_of(F.col(order).cast("double"), cuts))
    per = base.groupBy(*keys, "_s").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    wk = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = wk.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    off = per.select(
        *keys,
        "_s",
        *[f"_t_{m}" for m in measures],
        *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(wk).alias(f"total_{m}") for m in measures],
    )
    return base, off


def prefix_totals(
    df: DataFrame,
    keys: list[str],
    order: str,
    measures: list[str],
    bounds: list[float] | None = None,
) -> DataFrame:
    """Sums over all strictly smaller values of ``order`` within ``keys``.

    One row per distinct (keys, order): the summed ``measures``, ``before_<m>`` and
    ``total_<m>`` of the whole group.
    """
    base, off = _sliced(df, keys, order, measures, bounds)
    off = off.drop(*[f"_t_{m}" for m in measures])
    inner = (
        Window.partitionBy(*keys, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = base.join(off, [*keys, "_s"])
    for m in measures:
        out = out.withColumn(
            f"before_{m}", F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(inner), F.lit(0))
        ).drop(f"_o_{m}")
    return out.drop("_s")


def rank_average(df: DataFrame, keys: list[str], value: str, out: str = "rank", pct: str | None = None, ties: str = "average") -> DataFrame:
    """Average ranks for ties, or with ``ties`` = "min" the smallest; ``pct`` adds the plotting position (rank - 0.5) / n.

    Ranks are joined back on the value, so it is written once: sums of doubles differ in the last digit when computed again."""
    df = cut_lineage(df, "ranked")
    counts = prefix_totals(
        df.where(F.col(value).isNotNull()).select(*keys, value).withColumn("_n", F.lit(1).cast("long")),
        keys,
        value,
        ["_n"],
    )
    rk = F.col("before__n") + (F.lit(1) if ties == "min" else (F.col("_n") + 1) / 2.0)
    cols = [*keys, value, rk.alias(out)]
    if pct:
        cols.append(((rk - 0.5) / F.col("total__n")).alias(pct))
    return df.join(counts.select(*cols), [*keys, value], "left")


def row_positions(df: DataFrame, keys: list[str], order: str, tie: str, out: str = "pos", bounds=None, heavy_ties: bool = False) -> DataFrame:
    """1-based position by (order, tie) within keys, and the group size ``n_<out>``.

    Rows are numbered inside one (key, slice of ``order``).  With ``heavy_ties`` (for columns of few distinct
    values and a numeric ``tie``) a slice is cut again by value and by slices of ``tie``, so that
    rows tied on ``order`` spread too."""
    if bounds is None:
        df = cut_lineage(df, "positions")  # read for the cut points, the slice counts and the rows
    cuts = slice_bounds(df, order) if bounds is None else bounds
    tagged = df.withColumn("_s", slice_of(F.col(order).cast("double"), cuts))  # uniform hashes need no data pass
    cell = ["_s"]
    if heavy_ties:
        tagged = tagged.withColumn("_u", F.col(order)).withColumn("_v", slice_of(F.col(tie).cast("double"), slice_bounds(df, tie)))
        cell = ["_s", "_u", "_v"]
    per = tagged.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("_t"))
    if heavy_ties:
        # offsets of the cells of a slice within it, then of the slices
        low = Window.partitionBy(*keys, "_s").orderBy("_u", "_v").rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("_i", F.coalesce(F.sum("_t").over(low), F.lit(0)))
    wk = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    slices = per.groupBy(*keys, "_s").agg(F.sum("_t").alias("_t"))
    off = slices.select(
        *keys,
        "_s",
        F.coalesce(F.sum("_t").over(wk.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
        F.sum("_t").over(wk).alias(f"n_{out}"),
    )
    if heavy_ties:
        off = per.drop("_t").join(off, [*keys, "_s"]).withColumn("_o", F.col("_o") + F.col("_i")).drop("_i")
    inner = Window.partitionBy(*keys, *cell).orderBy(order, tie)
    return (
        tagged.join(off, [*keys, *cell])
        .withColumn(out, (F.col("_o") + F.row_number().over(inner)).cast("long"))
        .drop(*cell, "_o")
    )


def quintile_symbols(df: DataFrame, keys: list[str], value: str, tie: str, k: int = 5, out: str = "symbol") -> DataFrame:
    """k equal-count classes by rank, earlier rows first among ties (the first n % k classes hold one more)."""
    p = row_positions(df.where(F.col(value).isNotNull()), keys, value, tie, "_p", heavy_ties=isinstance(df.schema[tie].dataType, T.NumericType))
    n, i = F.col("n__p"), F.col("_p") - 1
    small = F.floor(n / k)
    big = n % k
    sym = F.when(i < big * (small + 1), F.floor(i / (small + 1))).otherwise(big + F.floor((i - big * (small + 1)) / F.greatest(small, F.lit(1))))
    return p.withColumn(out, (sym + 1).cast("int")).drop("_p", "n__p")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, levels: list[float], out: str = "qv") -> DataFrame:
    """Type-7 quantiles per group, exact at any group size: one row per (keys, tau).

    Running counts give every distinct value the order statistics it covers; only the
    two values around each level are kept, so nothing group-sized is ever held."""
    src = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    base, off = _sliced(src.withColumn("_n", F.lit(1).cast("long")), keys, "_v", ["_n"], None)
    lev = F.array(*[F.lit(float(t)) for t in levels])
    pos = lambda t: t * (F.col("total__n") - 1)
    side = lambda t, k, p: F.struct(t.alias("tau"), F.lit(k).alias("side"), p.alias("p"), (pos(t) - F.floor(pos(t))).alias("w"))
    both = F.concat(F.transform(lev, lambda t: side(t, 0, F.floor(pos(t)))), F.transform(lev, lambda t: side(t, 1, F.ceil(pos(t)))))
    # each slice carries only the order statistics that fall inside it
    inside = lambda e: (e["p"] >= F.col("_o__n")) & (e["p"] < F.col("_o__n") + F.col("_t__n"))
    off = off.withColumn("_want", F.filter(both, inside)).where(F.size("_want") > 0)
    run = Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    c = base.join(off.select(*keys, "_s", "_o__n", "_want"), [*keys, "_s"])
    c = c.withColumn("_b", F.col("_o__n") + F.coalesce(F.sum("_n").over(run), F.lit(0)))
    hit = c.select(*keys, "_v", F.explode(F.filter("_want", lambda e: (e["p"] >= F.col("_b")) & (e["p"] < F.col("_b") + F.col("_n")))).alias("h"))
    agg = hit.groupBy(*keys, F.col("h.tau").alias("tau")).agg(
        F.max(F.when(F.col("h.side") == 0, F.col("_v"))).alias("lo"),
        F.max(F.when(F.col("h.side") == 1, F.col("_v"))).alias("hi"),
        F.max("h.w").alias("w"),
    )
    return agg.select(*keys, "tau", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias(out))


def group_medians(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5], out).drop("tau")

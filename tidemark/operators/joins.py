"""Point-in-time, calendar and interval joins.

Equi keys everywhere: an as-of or interval join is cut into time buckets first, so a hot
key spreads over its buckets instead of landing in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows of an as-of join that one task sorts.
PART_ROWS = 500_000


def left_join_flag(left: DataFrame, right: DataFrame, keys: list[str], value: str, default: Column, flag: str = "fallback") -> DataFrame:
    """Left join; where the right side is absent use ``default`` and set the flag."""
    r = right.select(*keys, F.col(value).alias("_v"), F.lit(True).alias("_hit"))
    out = left.join(r, keys, "left")
    return out.withColumn(flag, F.col("_hit").isNull()).withColumn(value, F.coalesce(F.col("_v"), default)).drop("_v", "_hit")


#: A key is hot if it holds more than 1 / HOT_KEYS of all rows; there are fewer than HOT_KEYS of these.
HOT_KEYS = 1000


def join_totals(rows: DataFrame, keys: list[str], totals: DataFrame, n: str) -> DataFrame:
    """``rows`` inner-joined with ``totals``, which has one row per key and its number of rows in ``n``.

    Rows of hot keys meet their total by a broadcast of fewer than ``HOT_KEYS`` rows and are not moved; the others by a
    shuffle in which no key is large.  Keys hold no nulls."""
    limit = float(totals.agg(F.sum(n)).first()[0] or 0) / HOT_KEYS
    hot, cold = totals.where(F.col(n) > limit), totals.where(F.col(n) <= limit)
    left = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    near = left.where("_hot").drop("_hot").join(F.broadcast(hot), keys)
    return near.unionByName(left.where("_hot is null").drop("_hot").join(cold, keys))


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """Join that fails when the declared key uniqueness does not hold."""
    from tidemark.operators.quality import assert_unique_key

    if validate in ("many_to_one", "one_to_one"):
        right = assert_unique_key(right, keys)
    if validate == "one_to_one":
        left = assert_unique_key(left, keys)
    return left.join(right, keys, how)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    on: str,
    right_on: str,
    cols: list[str],
    by: list[str] | None = None,
    bucket: str = "month",
    order_tie: str | None = None,
    salts: int | None = None,
) -> DataFrame:
    """For every left row the latest right row with ``right_on <= on`` (inclusive), by key or globally.

    Both sides are cut into (key, calendar bucket).  The last right row of the earlier buckets is a row at the start of a
    bucket (one per key and bucket), so one sort inside the bucket finds the latest right row so far.
    No range join, no nested loop, and a hot key is spread over its buckets.  Left rows of a bucket are spread over
    ``salts`` parts more (16 without a key, else 1), each of which gets the right rows of the bucket.  The sort is dealt out to as many
    parts as hold ``PART_ROWS`` rows each, whatever the session's number of shuffle partitions."""
    keys = by or []
    salts = salts or (1 if keys else 16)
    fields = [F.col(c) for c in cols]
    tie = F.col(order_tie) if order_tie else F.lit(0)
    start = F.date_trunc(bucket, F.col("_t"))
    lt = left.select("*", F.col(on).alias("_t"), F.lit(1).alias("_side"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int").alias("_z")).withColumn("_b", start)
    r = right.select(*keys, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), tie.alias("_tie"), F.struct(*fields).alias("_r")).where(F.col("_t").isNotNull()).withColumn("_b", start)
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((lt.count() + salts * r.count()) / PART_ROWS))
    # every bucket of either side with its last right row; a bucket without one takes none.  With keys there are too many
    # buckets to reduce them where they lie: one split of a small table may be exploded to all of them
    cells = lt.where("_b is not null").select(*keys, "_b")
    cells = (cells if keys else cells.distinct()).withColumns({"_r": F.lit(None).cast(r.schema["_r"].dataType), "_at": F.lit(None).cast(T.StructType([T.StructField("_t", r.schema["_t"].dataType), T.StructField("_tie", r.schema["_tie"].dataType)]))})
    spine = cells.unionByName(r.select(*keys, "_b", "_r", F.struct("_t", "_tie").alias("_at")))
    spine = (spine.repartition(parts, *keys, "_b") if keys else spine).groupBy(*keys, "_b").agg(F.max_by("_r", "_at").alias("_lastr"))
    spine = spine.repartition(parts, *keys) if keys else spine
    wk = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    carried = F.last("_lastr", True).over(wk.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carry = spine.select(*keys, "_b", F.lit(-1).alias("_side"), carried.alias("_r")).where("_r is not null")
    here = r.unionByName(carry, allowMissingColumns=True).withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    u = lt.unionByName(here, allowMissingColumns=True).repartition(parts, *keys, "_b", "_z")
    # the row that is carried in has no time and comes first
    w = Window.partitionBy(*keys, "_b", "_z").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = u.withColumn("_m", F.last("_r", True).over(w)).where(F.col("_side") == 1)
    return out.select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in cols])


def asof_join_shifted(left, right, *, on, right_on, col, shift_days: int, out: str, **kw) -> DataFrame:
    """Change of an as-of value over ``shift_days``: value at the cutoff minus value at the cutoff - shift."""
    now = asof_join(left, right.withColumnRenamed(col, "_now"), on=on, right_on=right_on, cols=["_now"], **kw)
    moved = right.withColumn(right_on, F.date_add(F.col(right_on), shift_days)).withColumnRenamed(col, "_then")
    both = asof_join(now, moved, on=on, right_on=right_on, cols=["_then"], **kw)
    return both.withColumn(out, F.col("_now") - F.col("_then")).withColumnRenamed("_now", col).drop("_then")


def period_shift_join(left: DataFrame, right: DataFrame, *, keys: list[str], period: str, k: int, cols: dict[str, str], how: str = "left") -> DataFrame:
    """Bring columns of the row at ``period + k`` onto the row at ``period`` (k = 1 is next period)."""
    r = right.select(*keys, (F.col(period) - k).alias(period), *[F.col(c).alias(a) for c, a in cols.items()])
    return left.join(r, [*keys, period], how)


def key_resolution_join(facts: DataFrame, crosswalk: DataFrame, *, key: str, level: str, preference: list[str], target: str, tie: str) -> DataFrame:
    """Join through a crosswalk that may list several targets per key: best level first, then ``tie``."""
    order = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(level))
    best = crosswalk.groupBy(key).agg(
        F.min_by(F.struct(F.col(target), F.col(level)), F.struct(order.alias("o"), F.col(tie).alias("t"))).alias("_b")
    )
    return facts.join(best.select(key, F.col(f"_b.{target}").alias(target), F.col(f"_b.{level}").alias(level)), key, "left")


def outer_composition_join(prev: DataFrame, cur: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join of two vintages; the presence flags say which side holds the key."""
    a = prev.select(*keys, F.col(value).alias(f"{value}_prev"), F.lit(True).alias("in_prev"))
    b = cur.select(*keys, F.col(value).alias(f"{value}_cur"), F.lit(True).alias("in_cur"))
    return a.join(b, keys, "full_outer").fillna(False, ["in_prev", "in_cur"])


def month_before_join(left: DataFrame, right: DataFrame, *, cutoff: str, month: str, keys: list[str], cols: list[str]) -> DataFrame:
    """Monthly feature of the month strictly before the cutoff's month (an equi join)."""
    lt = left.withColumn("_m", F.add_months(F.trunc(F.col(cutoff), "month"), -1))
    r = right.select(*keys, F.col(month).alias("_m"), *cols)
    return lt.join(r, [*keys, "_m"], "left").drop("_m")


def interval_join_events(
    a: DataFrame, b: DataFrame, *, time: str, tol: int, tau: int = 0, keys: list[str] | None = None, out: str = "n_hits"
) -> DataFrame:
    """For each A row the number of B rows with time in [t - tau - tol, t - tau].

    Counting, not pairing: B is reduced to one count per (key, tick); every tick is entered
    into the window buckets it can serve (at most two), and a range frame inside the
    (key, bucket) sums it."""
    ks = keys or []
    width = tol + 1
    span = max(width, 1) * 64
    bb = b.groupBy(*ks, F.col(time).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    bb = bb.withColumn("_e", F.col("_t") + tau)
    # an A row at t needs B ticks with shifted time in [t - tol, t]; that reaches at most one bucket back
    bb = bb.withColumn("_k", F.explode(F.array_distinct(F.array(F.floor(F.col("_e") / span), F.floor((F.col("_e") + tol) / span)))))
    aa = a.select(*ks, F.col(time).alias("_t")).distinct().withColumn("_e", F.col("_t")).withColumn("_k", F.floor(F.col("_t") / span))
    u = bb.select(*ks, "_k", "_e", "_n", F.lit(None).cast("long").alias("_a")).unionByName(
        aa.select(*ks, "_k", F.col("_e"), F.lit(0).cast("long").alias("_n"), F.col("_t").cast("long").alias("_a"))
    )
    w = Window.partitionBy(*ks, "_k").orderBy(F.col("_e").cast("long")).rangeBetween(-tol, 0)
    hits = u.withColumn(out, F.sum("_n").over(w)).where(F.col("_a").isNotNull()).select(*ks, F.col("_a").alias(time), out)
    return a.join(hits, [*ks, time], "left")


def cross_join_grid(df: DataFrame, *, entity: str, period: str, fill: dict | None = None) -> DataFrame:
    """Complete entity x period grid between the first and last period of the table.

    The periods are a calendar sequence carried as one array literal per entity, so the grid
    is a map-side explode and not a Cartesian product."""
    lo = df.agg(F.min(period)).scalar()
    hi = df.agg(F.max(period)).scalar()
    ptype = df.schema[period].dataType
    grid = df.select(entity).distinct().select(entity, F.explode(F.sequence(lo, hi).cast(T.ArrayType(ptype))).alias(period))
    out = grid.join(df, [entity, period], "left")
    return out.fillna(fill) if fill else out


def leave_one_out_peer(df: DataFrame, *, by: list[str], value: str, out: str = "peer") -> DataFrame:
    """Mean of the others in the group: (sum - own) / (count - own present), moments joined back."""
    m = df.groupBy(*by).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    own = F.col(value).isNotNull().cast("int")
    return (
        df.join(m, by, "left")
        .withColumn(out, F.try_divide(F.col("_s") - F.coalesce(F.col(value), F.lit(0.0)), (F.col("_n") - own).cast("double")))
        .drop("_s", "_n")
    )


def split_by_cutoff(df: DataFrame, *, cutoff: str, ranges: list[tuple[str, str, str]], out: str = "split") -> DataFrame:
    """Name the inclusive date range that holds the cutoff; outside every range it is NULL."""
    c = F.lit(None).cast("string")
    for name, lo, hi in reversed(ranges):
        c = F.when(F.col(cutoff).between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi))), F.lit(name)).otherwise(c)
    return df.withColumn(out, c)

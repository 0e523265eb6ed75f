"""Checks and reconciliations.  A failed assertion stops the query that depends on it."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import ratio


def assert_unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pass the frame through; fail if any key combination occurs more than once.

    The check is one aggregation read back as a scalar, so it is part of the same query."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)))
    msg = f"duplicate key in ({', '.join(keys)})"
    return df.where(F.when(dup.scalar() == 0, True).otherwise(F.raise_error(F.lit(msg)).cast("boolean")))


def accounting_identity(df: DataFrame, *, total: str, parts: Column, by: list[str], tol: float) -> DataFrame:
    """Gap between a stored total and the sum of its parts: largest, and share within tolerance."""
    gap = F.abs(F.col(total) - parts)
    return df.groupBy(*by).agg(
        F.count(gap).alias("n_checked"),
        F.max(gap).alias("max_abs_gap"),
        F.avg(F.when(gap.isNotNull(), (gap <= tol).cast("double"))).alias("share_within"),
    )


def completeness_check(df: DataFrame, *, by: list[str], item: str, expected: int) -> DataFrame:
    """Groups that hold some but not all expected items (all-or-nothing rule)."""
    g = df.groupBy(*by).agg(F.count_distinct(item).alias("n_items"))
    return g.withColumn("complete", F.col("n_items") == expected)


def known_gap_check(expected: DataFrame, present: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """Missing keys, split into listed and anomalous ones."""
    miss = expected.join(present.select(*keys).distinct(), keys, "left_anti")
    return miss.join(known.select(*keys, F.lit(True).alias("_k")), keys, "left").select(
        *keys, F.coalesce("_k", F.lit(False)).alias("known")
    )


def cross_source_check(a: DataFrame, b: DataFrame, keys: list[str], value: str, tol: float = 0.0) -> DataFrame:
    """Key by key agreement of two sources: only_a, only_b, equal, different."""
    x = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ina"))
    y = b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_inb"))
    j = x.join(y, keys, "full_outer")
    status = (
        F.when(F.col("_inb").isNull(), "only_a")
        .when(F.col("_ina").isNull(), "only_b")
        .when(F.abs(F.col("_a") - F.col("_b")) <= tol, "equal")
        .otherwise("different")
    )
    return j.select(*keys, F.col("_a").alias("value_a"), F.col("_b").alias("value_b"), status.alias("status"))


def multiset_check(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Do both sources hold the same multiset of values per key, when one lost the level that tells them apart.

    Counted per (key, value) with opposite signs, so no list of a group's values is built."""
    signed = a.select(*keys, value, F.lit(1).alias("_s")).unionByName(b.select(*keys, value, F.lit(-1).alias("_s")))
    per = signed.groupBy(*keys, value).agg(F.sum("_s").alias("_d"))
    return per.groupBy(*keys).agg((F.sum(F.abs("_d")) == 0).alias("same"), F.sum(F.abs("_d")).alias("n_unmatched"))


def vintage_diff(prev: DataFrame, cur: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Added, removed, appeared / vanished values, changed and unchanged keys between two vintages."""
    from tidemark.operators.joins import outer_composition_join

    j = outer_composition_join(prev, cur, keys, value)
    p, c = F.col(f"{value}_prev"), F.col(f"{value}_cur")
    kind = (
        F.when(~F.col("in_prev"), "added")
        .when(~F.col("in_cur"), "removed")
        .when(p.isNull() & c.isNotNull(), "filled")
        .when(p.isNotNull() & c.isNull(), "blanked")
        .when(~p.eqNullSafe(c), "changed")
        .otherwise("same")
    )
    return j.withColumn("kind", kind).withColumn("delta", c - p)


def join_coverage(facts: DataFrame, lookup: DataFrame, *, on: list[str], weight: str, source: str, target: str) -> DataFrame:
    """Matched / total / share, by row and by weight, for one source pair."""
    hit = lookup.select(*on).distinct().withColumn("_m", F.lit(1))
    pre = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"))
    j = pre.join(hit, on, "left")
    m = F.coalesce("_m", F.lit(0))
    return j.agg(
        F.coalesce(F.sum(F.col("_n") * m), F.lit(0)).alias("rows_matched"),
        F.sum("_n").alias("rows_total"),
        F.coalesce(F.sum(F.col("_w") * m), F.lit(0.0)).alias("weight_matched"),
        F.sum("_w").alias("weight_total"),
    ).select(
        F.lit(source).alias("source"),
        F.lit(target).alias("target"),
        "*",
        ratio("rows_matched", "rows_total").alias("row_share"),
        ratio("weight_matched", "weight_total").alias("weight_share"),
    )


def rebuild_parity(stored: DataFrame, rebuilt: DataFrame, keys: list[str], value: str) -> DataFrame:
    j = stored.select(*keys, F.col(value).alias("_a")).join(rebuilt.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.agg(
        F.sum(both.cast("long")).alias("n_matched"),
        F.sum((~both).cast("long")).alias("n_unmatched"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff"),
    )


def merger_flags(df: DataFrame, *, asset: str, thr: float = 0.15, events: DataFrame | None = None, entity="entity", period="q") -> DataFrame:
    """Asset jump above ``thr`` against the adjacent earlier quarter, or a listed event."""
    from tidemark.operators.calendar import lag_at

    prev = lag_at(asset, 1, entity, period)
    out = df.withColumn("jump", F.coalesce(F.abs(ratio(F.col(asset), prev) - 1) > thr, F.lit(False)))
    if events is not None:
        out = out.join(events.select(entity, period, F.lit(True).alias("_e")), [entity, period], "left")
        out = out.withColumn("listed", F.coalesce("_e", F.lit(False))).drop("_e")
        return out.withColumn("merger_flag", F.col("jump") | F.col("listed"))
    return out.withColumn("merger_flag", F.col("jump"))


def max_gap_days(df: DataFrame, *, by: list[str], date: str) -> DataFrame:
    """Largest distance in days between neighbouring observations."""
    w = Window.partitionBy(*by).orderBy(date)
    d = df.select(*by, date).distinct()
    gap = F.datediff(F.col(date), F.lag(date).over(w))
    return d.withColumn("_g", gap).groupBy(*by).agg(F.max("_g").alias("max_gap"), F.count(F.lit(1)).alias("n_days"))


#: What the first record of a chain names as its predecessor.
CHAIN_START = "0" * 64


def record_hash(previous: Column, fields: list[Column]) -> Column:
    """Hash of a record together with its predecessor's hash; an edit breaks every later record."""
    return F.sha2(F.concat_ws("|", previous, *[f.cast("string") for f in fields]), 256)


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _chain(contents):
    """The hashes of a chain from the joined fields of its records, in order."""
    out, last = [], CHAIN_START
    for c in contents:
        last = hashlib.sha256(f"{last}|{c}".encode()).hexdigest()
        out.append(last)
    return out


def chain_ledger(df: DataFrame, *, by: list[str], order: str, fields: list[str]) -> DataFrame:
    """Attach ``prev_hash`` and ``hash``.  A chain is sequential, so each one is walked within its key."""
    record = F.struct(F.col(order).alias("_o"), F.concat_ws("|", *[F.col(f).cast("string") for f in fields]).alias("_f"), F.struct(*df.columns).alias("_r"))
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(record)).alias("_c")).withColumn("_h", _chain(F.col("_c._f")))
    before = F.concat(F.array(F.lit(CHAIN_START)), F.slice("_h", F.lit(1), F.size("_h") - 1))
    out = rows.select(F.explode(F.arrays_zip(F.col("_c._r").alias("r"), F.col("_h").alias("h"), before.alias("p"))).alias("_e"))
    return out.select("_e.r.*", F.col("_e.h").alias("hash"), F.col("_e.p").alias("prev_hash"))


def ledger_chain_verify(df: DataFrame, *, by: list[str], order: str, fields: list[str], made: str, due: str, key: list[str]) -> DataFrame:
    """Per row: the hash covers content and predecessor, the link holds, made before due; duplicate keys counted."""
    w = Window.partitionBy(*by).orderBy(order)
    held = F.coalesce(F.col("hash") == record_hash(F.col("prev_hash"), [F.col(f) for f in fields]), F.lit(False)) & F.col("prev_hash").isNotNull()
    x = df.withColumn("hash_ok", held).withColumn(
        "link_ok", F.col("prev_hash").eqNullSafe(F.coalesce(F.lag("hash").over(w), F.lit(CHAIN_START)))
    ).withColumn("time_ok", F.col(made) <= F.col(due))
    dups = x.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return x.join(dups, key).withColumn("key_ok", F.col("_n") == 1).drop("_n")

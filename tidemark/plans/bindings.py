"""The driver tables seen as panels, with matching SQL for the oracles.

Money is summed as exact integers, so both engines start from identical values.
Each panel is aggregated once, map-side first; afterwards an entity has at most one
row per calendar quarter, which is what bounds every per-entity window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.periods import quarter_index

SQ = "CAST(year({d}) * 4 + quarter({d}) - 1 AS BIGINT)"
CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def line_units():
    """Revenue of a line in 1e-4 currency units, as an exact integer."""
    return F.round(F.col("l_extendedprice") * 100).cast("long") * (
        100 - F.round(F.col("l_discount") * 100).cast("long")
    )


def supplier_panel(spark: SparkSession, d: str) -> DataFrame:
    """entity = supplier, q = ship quarter, flow, stock, n."""
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("entity"), quarter_index("l_shipdate").alias("q"))
        .agg(
            (F.sum(line_units()).cast("double") / 10000.0).alias("flow"),
            F.sum("l_quantity").alias("stock"),
            F.count(F.lit(1)).alias("n"),
        )
    )


SP = f"""sp AS (
  SELECT l_suppkey AS entity, {SQ.format(d='l_shipdate')} AS q,
         CAST(sum({CENTS}) AS DOUBLE) / 1e4 AS flow,
         sum(l_quantity) AS stock, count(*) AS n
  FROM lineitem GROUP BY ALL)"""


def customer_panel(spark: SparkSession, d: str) -> DataFrame:
    """entity = customer, q = order quarter, flow, n; quarters without orders are absent."""
    return (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("entity"), quarter_index("o_orderdate").alias("q"))
        .agg(
            (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100.0).alias("flow"),
            F.count(F.lit(1)).alias("n"),
        )
    )


CP = f"""cp AS (
  SELECT o_custkey AS entity, {SQ.format(d='o_orderdate')} AS q,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS flow,
         count(*) AS n
  FROM orders GROUP BY ALL)"""


def customer_ytd(spark: SparkSession, d: str) -> DataFrame:
    """Customer panel with the flow restated as calendar-year-to-date."""
    from tidemark.operators.calendar import running_ytd

    return running_ytd(customer_panel(spark, d), value="flow", out="ytd").select("entity", "q", "ytd", "n")


CY = f"""{CP}, cy AS (
  SELECT entity, q, n,
         sum(flow) OVER (PARTITION BY entity, q // 4 ORDER BY q) AS ytd
  FROM cp)"""


def daily_events(spark: SparkSession, d: str) -> DataFrame:
    """series = event type, date, value = mean, n, total; one row per type and day."""
    cents = F.round(F.col("value") * 100).cast("long")
    return (
        table(spark, d, "events")
        .groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("date"))
        .agg(
            (F.sum(cents).cast("double") / 100.0).alias("total"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("value", F.col("total") / F.col("n"))
    )


DE = """de AS (
  SELECT event_type AS series, CAST(ts AS DATE) AS date,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS total,
         count(*) AS n,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 1e2 / count(*) AS value
  FROM events GROUP BY ALL)"""


def brand_mix(spark: SparkSession, d: str) -> DataFrame:
    """period, part = brand, amount: the composition panel.

    The part dimension is joined after the lines are reduced to one row per
    (part key, quarter), so the shuffled side is far smaller than the fact table.
    """
    per_part = (
        table(spark, d, "lineitem")
        .groupBy("l_partkey", quarter_index("l_shipdate").alias("period"))
        .agg(F.sum(line_units()).alias("u"))
    )
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("part"))
    return (
        per_part.join(brands, "l_partkey")
        .groupBy("period", "part")
        .agg((F.sum("u").cast("double") / 10000.0).alias("amount"))
    )


BM = f"""bm AS (
  SELECT {SQ.format(d='l_shipdate')} AS period, p_brand AS part,
         CAST(sum({CENTS}) AS DOUBLE) / 1e4 AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def segment_mix(spark: SparkSession, d: str) -> DataFrame:
    """period, part = market segment, amount (five parts)."""
    per_cust = customer_panel(spark, d)
    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("part"))
    return (
        per_cust.join(seg, "entity")
        .groupBy(F.col("q").alias("period"), "part")
        .agg((F.sum(F.round(F.col("flow") * 100).cast("long")).cast("double") / 100.0).alias("amount"))
    )


SM = f"""{CP}, sm AS (
  SELECT q AS period, c_mktsegment AS part,
         CAST(sum(CAST(round(flow * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS amount
  FROM cp JOIN customer ON entity = c_custkey GROUP BY ALL)"""

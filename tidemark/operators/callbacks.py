"""User callbacks: models and item expanders supplied as Python functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def register_forecaster(df: DataFrame, fn: Callable, *, origins: list[int], value: str, entity="entity", period="q") -> DataFrame:
    """Run ``fn(history) -> float`` on each (entity, origin), where history holds only rows up to the origin.

    An entity's rows move once, whatever the number of origins; they are its calendar, so a group is bounded.  Only user
    models take this path."""
    x = df.where(F.col(period).isNotNull()).select(entity, period, F.col(value).cast("double").alias("value"))
    kt = df.schema[entity].dataType.simpleString()
    at = sorted(set(origins))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        every = pdf.sort_values(period)
        held = every[period].searchsorted(at, side="right")
        seen, made = [], []
        for o, n in zip(at, held):
            if n:
                # a copy: a model that writes to its history does not reach those of other origins
                seen.append(o)
                made.append(fn(every.iloc[:n].assign(origin=o)))
        return pd.DataFrame({entity: [key[0]] * len(seen), "origin": seen, "forecast": made})

    # few bytes, much work: dealt out by number, or small partitions would be put together
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return x.repartition(parts, entity).groupBy(entity).applyInPandas(run, f"`{entity}` {kt}, origin int, forecast double")

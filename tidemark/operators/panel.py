"""Row-level panel rules: masks, training windows, pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def presample_mask(df: DataFrame, *, values: list[str], keep: list[str], last: int, period: str = "q") -> DataFrame:
    """NULL every value up to ``last``, except the kept columns in the last pre-sample period itself."""
    q = F.col(period)
    return df.withColumns({v: F.when((q > last) | ((q == last) & F.lit(v in keep)), F.col(v)) for v in values})


def train_restriction(df: DataFrame, *, origins: list[int], first: dict[int, int], exclude: list[int], denominator: str, period: str = "q") -> DataFrame:
    """Training rows of every origin: first period by origin, excluded periods, positive denominator.

    The short origin list is an array literal that each row is tested against, so a row is
    copied only to the origins that may use it."""
    spec = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(first[o]).alias("f")) for o in origins])
    hit = F.filter(spec, lambda s: (F.col(period) <= s["o"]) & (F.col(period) >= s["f"]))
    return (
        df.where((F.col(denominator) > 0) & ~F.col(period).isin(*exclude))
        .select("*", F.explode(hit).alias("_s"))
        .withColumn("origin", F.col("_s.o"))
        .drop("_s")
    )

"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of one batch of rows that goes to Python.
ARROW_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands rows to Python in batches of at most about ``ARROW_BYTES``, so that long texts do
    not add up in a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str) -> Column:
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later jobs read files, also after an executor is lost."""
    return cut_lineage(df, f"llm-{name}")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

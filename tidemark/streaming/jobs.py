"""Structured Streaming forms of the incremental behaviours.

Each function takes a streaming DataFrame and returns a streaming DataFrame (or starts a
``foreachBatch`` writer).  State is bounded by a watermark everywhere.  ``drain`` runs a
stream over what is available now into a Parquet table of the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.session import scratch_path


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def time_slices(df: DataFrame, name: str, time: str, slices: int = 5) -> str:
    """Writes ``df`` as one file per range of event time and dates the files in that order, so that a file stream over the
    folder with ``max_files`` = 1 meets one range a batch.  More data need more slices, not larger ones."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.repartitionByRange(slices, time).sortWithinPartitions(time).write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(str(f.getPath()) for f in store.listStatus(hadoop.Path(path)) if f.getPath().getName().startswith("part-"))
    for k, f in enumerate(files):  # part numbers follow the ranges
        store.setTimes(hadoop.Path(f), 1_000_000_000_000 + 1000 * k, -1)
    return path


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available, append the results to a table, read it back."""
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    q = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{root}/data").option("checkpointLocation", f"{root}/ckpt")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def drain_batches(stream: DataFrame, name: str, write, mode: str = "update") -> str:
    """Process everything available through ``write(batch, batch_id, root)``; returns the root folder.

    A batch writes to a path that carries its id, so a replayed batch overwrites itself."""
    root = scratch_path(stream.sparkSession, name)
    q = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/ckpt")
        .foreachBatch(lambda b, i: write(b, i, root)).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return root


def weekly_mix(stream: DataFrame, *, time: str, kind: str, bucket, amount: str, delay: str = "1 day") -> DataFrame:
    """Bucket sums per type and week ending Friday.  In append mode a week appears once, when the
    watermark has passed its end: only completed weeks reach a consumer."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, "7 days", "7 days", "2 days").alias("w"), F.col(kind).alias("kind"), bucket.alias("bucket"))
        .agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("n"))
        .select("kind", "bucket", F.date_sub(F.col("w.end").cast("date"), 1).alias("week"), "amount", "n")
    )


def provisional_weeks(stream: DataFrame, name: str, **kw) -> DataFrame:
    """The same sums in update mode: latest state per key, flagged provisional and never usable."""

    def write(batch, i, root):
        batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{root}/data/b={i}")

    mix = weekly_mix(stream, **kw)
    root = drain_batches(mix, name, write)
    out = mix.sparkSession.read.schema(mix.schema.add("batch", "long")).parquet(f"{root}/data/b=*")
    last = out.groupBy("kind", "bucket", "week").agg(F.max_by(F.struct("amount", "n"), "batch").alias("r"))
    return last.select("kind", "bucket", "week", "r.*", F.lit(True).alias("provisional"), F.lit(False).alias("usable"))


def dedup_revisions(stream: DataFrame, name: str, *, keys: list[str], time: str, period: str, vintage: str, value: str, delay: str = "2 days") -> DataFrame:
    """Last vintage wins per key and ``period`` of event time: a max_by state in update mode, one table of changes per
    batch.  The period is part of the key, so its state goes when the watermark has passed it."""
    span = F.window(time, period)
    agg = stream.withWatermark(time, delay).groupBy(*keys, span.alias("w")).agg(F.max(vintage).alias("vintage"), F.max_by(value, vintage).alias("value"))
    agg = agg.select(*keys, F.col("w.start").alias("start"), "vintage", "value")

    def write(batch, i, root):
        batch.write.mode("overwrite").parquet(f"{root}/data/b={i}")

    root = drain_batches(agg, name, write)
    out = stream.sparkSession.read.schema(agg.schema).parquet(f"{root}/data/b=*")
    return out.groupBy(*keys, "start").agg(F.max("vintage").alias("vintage"), F.max_by("value", "vintage").alias("value"))


def event_coincidence(a: DataFrame, b: DataFrame, *, key: str, time: str, tick: str = "1 hour", tol: int = 1, delay: str = "2 hours") -> DataFrame:
    """Ticks of A that have a B tick of the same key in [t - tol, t].

    Both sides are reduced to one row per (key, tick) and B is copied to the tol + 1 ticks it can
    serve, so the stream-stream join matches on equality and emits at most one row per A tick."""
    sec = int(pd.Timedelta(tick).total_seconds())
    at = lambda i: F.timestamp_seconds((F.floor(F.unix_timestamp(time) / sec) + i) * sec)
    la = a.select(F.col(key), at(F.lit(0)).alias("tick")).withWatermark("tick", delay).dropDuplicates([key, "tick"])
    steps = F.explode(F.array(*[F.lit(i) for i in range(tol + 1)]))
    lb = b.select(F.col(key).alias("bkey"), time, steps.alias("i")).select("bkey", at(F.col("i")).alias("btick"))
    lb = lb.withWatermark("btick", delay).dropDuplicates(["bkey", "btick"])
    return la.join(lb, (F.col(key) == F.col("bkey")) & (F.col("tick") == F.col("btick"))).select(key, "tick")


def rolling_rate(stream: DataFrame, *, time: str, kind: str, hit, width: str, step: str, delay: str = "1 day") -> DataFrame:
    """Sliding-window share of rows that satisfy a condition."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, width, step).alias("w"), F.col(kind).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("rate"))
        .select("kind", F.col("w.start").alias("start"), "n", "rate")
    )


def smooth(values: np.ndarray, level: float | None, alpha: float, width: int = 64) -> np.ndarray:
    """Exponential smoothing from ``level`` on; missing values leave it as it is, and before the first value it is missing.

    A block of values is one triangular product: weights of a block are the same for every block."""
    out = np.full(len(values), np.nan)
    seen = np.flatnonzero(~np.isnan(values))
    if not len(seen):
        return out if level is None else np.full(len(values), level)
    x, start = values[seen], level
    if start is None:
        start = x[0]  # the first value is the first level
    lags = np.arange(width)[:, None] - np.arange(width)[None, :]
    weights = np.where(lags >= 0, alpha * (1 - alpha) ** np.maximum(lags, 0), 0.0)
    levels = np.empty(len(x))
    for lo in range(0, len(x), width):
        block = x[lo : lo + width]
        n = len(block)
        levels[lo : lo + n] = weights[:n, :n] @ block + start * (1 - alpha) ** np.arange(1, n + 1)
        start = levels[lo + n - 1]
    at = np.searchsorted(seen, np.arange(len(values)), side="right")
    out[at > 0] = levels[at[at > 0] - 1]
    if level is not None:
        out[at == 0] = level
    return out


class Smoother(StatefulProcessor):
    """Level of a key, with an event-time timer that forgets it after ``idle`` without a row."""

    def __init__(self, order: str, value: str, alpha: float, idle_ms: int):
        self.order, self.value, self.alpha, self.idle = order, value, alpha, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("level", "level double, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        f = pd.concat(frames).sort_values(self.order)  # rows of one key in one micro-batch
        level, before = self.state.get() if self.state.exists() else (None, None)
        levels = smooth(f[self.value].to_numpy(float), level, self.alpha)
        if not np.isnan(levels[-1]):
            last = max(int(pd.Timestamp(f[self.order].iloc[-1]).timestamp() * 1000), before or 0)
            if before is not None:
                self.handle.deleteTimer(before + self.idle)
            self.state.update((float(levels[-1]), last))
            self.handle.registerTimer(last + self.idle)
        yield pd.DataFrame({"key": [key[0]] * len(f), "ord": f[self.order].to_numpy(), "level": levels})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def exp_smoothing(stream: DataFrame, name: str, *, key: str, order: str, value: str, alpha: float, delay: str = "7 days", idle: str = "400 days") -> DataFrame:
    """(key, ord, level) of every row, drained: keyed state = current level, unchanged on a missing value, started at the first
    observed one.

    ``order`` is the event time.  A key that stays silent for ``idle`` of event time loses its level; rows behind the watermark
    are dropped.  The state lives in the RocksDB store, which timers need; the session's own choice is put back."""
    spark = stream.sparkSession
    keep = int(pd.Timedelta(idle).total_seconds() * 1000)
    kt, ot = stream.schema[key].dataType.simpleString(), stream.schema[order].dataType.simpleString()
    rows = stream.withWatermark(order, delay).groupBy(key).transformWithStateInPandas(
        Smoother(order, value, alpha, keep), outputStructType=f"key {kt}, ord {ot}, level double", outputMode="Append", timeMode="EventTime")
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return drain(rows, name)
    finally:
        spark.conf.set(STORE, before)


def late_data_audit(stream: DataFrame, name: str, *, stamped: str, deadline) -> tuple[DataFrame, DataFrame]:
    """Rows stamped after their deadline go to a side table with the reason; the rest pass on."""
    bad = F.col(stamped) > deadline

    def write(batch, i, root):
        b = batch.withColumn("reason", F.when(bad, "stamped after the deadline"))
        b.where(bad).write.mode("overwrite").parquet(f"{root}/rejected/b={i}")
        b.where(~bad).drop("reason").write.mode("overwrite").parquet(f"{root}/accepted/b={i}")

    root = drain_batches(stream, name, write, mode="append")
    r = stream.sparkSession.read
    sch = stream.schema
    return r.schema(sch).parquet(f"{root}/accepted/b=*"), r.schema(type(sch)(sch.fields).add("reason", "string")).parquet(f"{root}/rejected/b=*")


def storm_sessions(stream: DataFrame, *, time: str, kind: str, gap: str, delay: str = "1 day") -> DataFrame:
    """Neighbouring peaks merge into one storm when they are closer than ``gap``."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("s"), F.col(kind).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n_peaks"), F.max("value").alias("peak_value"))
        .select("kind", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_peaks", "peak_value")
    )

"""Streams over several batches against plain loops."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.streaming import jobs as J


def day(i, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=i, hours=hour)


def test_blocks_of_smoothing_equal_a_loop():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 400):
        x = rng.normal(size=n)
        x[rng.random(n) < 0.2] = np.nan
        for start in (None, 2.5):
            level, want = start, []
            for v in x:
                if v == v:
                    level = v if level is None else 0.3 * v + 0.7 * level
                want.append(np.nan if level is None else level)
            assert np.allclose(J.smooth(x, start, 0.3), want, equal_nan=True)


def replay(spark, df, time, slices):
    return J.file_stream(spark, J.time_slices(df, "replay", time, slices), df.schema, max_files=1)


def test_smoothing_keeps_its_state_over_batches(spark):
    rows = [(k, day(i), None if (i + k) % 5 == 0 else float((i * 7 + k) % 11)) for k in range(3) for i in range(24)]
    df = spark.createDataFrame(rows, "key int, ord timestamp, v double")
    got = J.exp_smoothing(replay(spark, df, "ord", 4), "multi", key="key", order="ord", value="v", alpha=0.3).toPandas()
    assert len(got) == len(rows)
    for k in range(3):
        have, level = got[got.key == k].set_index("ord").level, None
        for kk, o, v in rows:
            if kk == k:
                level = level if v is None else v if level is None else 0.3 * v + 0.7 * level
                assert (level is None and np.isnan(have[o])) or np.isclose(have[o], level)


def test_a_silent_key_is_forgotten_and_late_rows_are_dropped(spark):
    steady = [("b", day(i), 1.0) for i in range(60)]
    rows = [("a", day(0), 10.0), *steady, ("a", day(50), 2.0), ("a", day(51), 4.0)]
    df = spark.createDataFrame(rows, "key string, ord timestamp, v double")
    got = J.exp_smoothing(replay(spark, df, "ord", 6), "idle", key="key", order="ord", value="v", alpha=0.5, delay="1 day", idle="20 days").where("key = 'a'").orderBy("ord").collect()
    assert [r["level"] for r in got] == [10.0, 2.0, 3.0]
    # a file with old rows that comes last: they are behind the watermark
    path = J.time_slices(spark.createDataFrame(steady, df.schema), "late", "ord", 3)
    spark.createDataFrame([("b", day(1, 5), 99.0)], df.schema).coalesce(1).write.mode("append").parquet(path)
    st = J.file_stream(spark, path, df.schema, max_files=1)
    assert J.exp_smoothing(st, "late", key="key", order="ord", value="v", alpha=0.5, delay="1 day").count() == 60


def test_slices_are_read_in_order_of_time(spark):
    rows = [(day(i % 50, i % 24), i) for i in range(500)]
    df = spark.createDataFrame(rows, "ts timestamp, v int").repartition(7)
    seen = []

    def note(batch, i, root):
        r = batch.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        if r["n"]:
            seen.append((r["lo"], r["hi"], r["n"]))

    J.drain_batches(replay(spark, df, "ts", 5), "order", note, mode="append")
    assert len(seen) == 5 and sum(s[2] for s in seen) == 500
    assert all(a[1] <= b[0] for a, b in zip(seen, seen[1:]))


def test_weeks_over_batches_equal_one_batch(spark):
    rows = [(day(i // 3, i % 24), "x" if i % 2 else "y", i) for i in range(180)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, cents int")
    mix = lambda st: {tuple(r) for r in J.drain(J.weekly_mix(st, time="ts", kind="kind", bucket=F.lit(0), amount="cents"), "weeks").collect()}
    many, one = mix(replay(spark, df, "ts", 6)), mix(replay(spark, df, "ts", 1))
    assert many == one and len(many) > 8

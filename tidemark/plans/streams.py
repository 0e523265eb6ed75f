"""Section 2.16 queries: the events table replayed through the file source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.bindings import DE, daily_events, table
from tidemark.plans.registry import query
from tidemark.streaming import jobs as J


def bands():
    return F.floor(F.least(F.col("value"), F.lit(299.0)) / 50).cast("int")


def cents():
    return F.round(F.col("value") * 100).cast("long")


BSQL = "CAST(floor(least(value, 299) / 50) AS INT)"
WM = "(SELECT max(ts) FROM events)"


#: Batches of a replay.
SLICES = 5


def events(s, d):
    """The whole events table as a stream of several batches, in order of time."""
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.file_stream(s, J.time_slices(e, "events", "ts", SLICES), e.schema, max_files=1)


def ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("stream_weekly_mix", f"""WITH w AS (SELECT event_type AS kind, {BSQL} AS bucket, CAST(ts AS DATE) + CAST((12 - isodow(ts)) % 7 AS INT) AS week, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS amount, count(*) AS n FROM events GROUP BY ALL)
SELECT kind, bucket, CAST(week AS VARCHAR) AS week, amount, n FROM w WHERE CAST(week + 1 AS TIMESTAMP) <= {WM} - INTERVAL 1 DAY""")
def _(s, d):
    e = events(s, d).withColumn("cents", cents())
    return J.drain(J.weekly_mix(e, time="ts", kind="event_type", bucket=bands(), amount="cents"), "weekly").withColumn("week", F.col("week").cast("string"))


@query("stream_weekly_provisional", f"""SELECT event_type AS kind, {BSQL} AS bucket, CAST(CAST(ts AS DATE) + CAST((12 - isodow(ts)) % 7 AS INT) AS VARCHAR) AS week, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS amount, count(*) AS n, 1 AS provisional, 0 AS usable FROM events GROUP BY ALL""")
def _(s, d):
    e = events(s, d).withColumn("cents", cents())
    out = J.provisional_weeks(e, "provisional", time="ts", kind="event_type", bucket=bands(), amount="cents")
    return out.select("kind", "bucket", F.col("week").cast("string"), "amount", "n", F.col("provisional").cast("int"), F.col("usable").cast("int"))


@query("stream_dedup_revisions", "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, max(event_id) AS vintage, arg_max(value, event_id) AS value FROM events GROUP BY ALL", "value:2")
def _(s, d):
    r = J.dedup_revisions(events(s, d), "revisions", keys=["user_id"], time="ts", period="1 day", vintage="event_id", value="value")
    return r.select("user_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "vintage", "value")


@query("stream_event_coincidence", """WITH a AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS tick FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS tick FROM events WHERE event_type IN ('view', 'click'))
SELECT user_id, strftime(tick, '%Y-%m-%d %H:%M:%S') AS tick FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.tick BETWEEN a.tick - INTERVAL 3 HOUR AND a.tick)""")
def _(s, d):
    e = events(s, d)
    a = e.where("event_type = 'purchase'").select("user_id", "ts")
    b = events(s, d).where("event_type IN ('view', 'click')").select("user_id", "ts")
    return J.drain(J.event_coincidence(a, b, key="user_id", time="ts", tol=3), "coincidence").withColumn("tick", ts("tick"))


@query("stream_rolling_rate", f"""WITH w AS (SELECT event_type AS kind, s.s AS start, value FROM events JOIN (SELECT unnest(generate_series(TIMESTAMP '2023-12-20', (SELECT max(ts) FROM events), INTERVAL 1 DAY)) AS s) s ON ts >= s.s AND ts < s.s + INTERVAL 7 DAY)
SELECT kind, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, avg((value > 50)::INT) AS rate FROM w WHERE start + INTERVAL 7 DAY <= {WM} - INTERVAL 1 DAY GROUP BY kind, start""", "rate:7")
def _(s, d):
    r = J.rolling_rate(events(s, d), time="ts", kind="event_type", hit=F.col("value") > 50, width="7 days", step="1 day")
    return J.drain(r, "rolling").withColumn("start", ts("start"))


@query("stream_exp_smoothing", f"""WITH {DE}, o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS j FROM de) SELECT a.series AS key, CAST(a.date AS VARCHAR) AS ord, sum(b.value * CASE WHEN b.j = 1 THEN pow(0.7e0, a.j - 1) ELSE 0.3e0 * pow(0.7e0, a.j - b.j) END) AS level FROM o a JOIN o b ON a.series = b.series AND b.j <= a.j GROUP BY ALL""", "level:7")
def _(s, d):
    daily = daily_events(s, d).select("series", F.col("date").cast("timestamp").alias("date"), "value")
    st = J.file_stream(s, J.time_slices(daily, "daily", "date", SLICES), daily.schema, max_files=1)
    levels = J.exp_smoothing(st, "smoothing", key="series", order="date", value="value", alpha=0.3)
    return levels.withColumn("ord", F.date_format("ord", "yyyy-MM-dd"))


@query("stream_late_data_audit", """WITH e AS (SELECT event_type, ts + to_hours(CAST(event_id % 9 AS INT)) > date_trunc('day', ts) + INTERVAL 24 HOUR AS bad FROM events) SELECT event_type, CASE WHEN bad THEN 'rejected' ELSE 'accepted' END AS side, count(*) AS n FROM e GROUP BY ALL""")
def _(s, d):
    e = events(s, d).withColumn("stamp", F.timestamp_seconds(F.col("ts").cast("double") + (F.col("event_id") % 9) * 3600))
    ok, bad = J.late_data_audit(e, "late", stamped="stamp", deadline=F.date_trunc("day", F.col("ts")) + F.expr("INTERVAL 24 HOURS"))
    cnt = lambda x, side: x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.lit(side).alias("side"), "n")
    return cnt(ok, "accepted").unionByName(cnt(bad, "rejected"))


@query("stream_storm_sessions", f"""WITH p AS (SELECT event_type AS kind, ts, value FROM events WHERE value > 60), g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS nw FROM p WINDOW w AS (PARTITION BY kind ORDER BY ts)), i AS (SELECT *, sum(nw) OVER (PARTITION BY kind ORDER BY ts, value) AS s FROM g),
r AS (SELECT kind, min(ts) AS st, max(ts) + INTERVAL 2 HOUR AS en, count(*) AS n_peaks, max(value) AS peak_value FROM i GROUP BY kind, s) SELECT kind, strftime(st, '%Y-%m-%d %H:%M:%S') AS start, strftime(en, '%Y-%m-%d %H:%M:%S') AS "end", n_peaks, peak_value FROM r WHERE en <= (SELECT max(ts) FROM p) - INTERVAL 1 DAY""", "peak_value:2")
def _(s, d):
    st = J.storm_sessions(events(s, d).where("value > 60"), time="ts", kind="event_type", gap="2 hours")
    return J.drain(st, "storms").select("kind", ts("start").alias("start"), ts("end").alias("end"), "n_peaks", "peak_value")

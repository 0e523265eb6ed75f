"""Correspondence analysis by the calendar's side of the table, its walk-forward clock and the significance of its order.

A table of periods and parts has few periods and many parts.  With H the sum over parts of x x' / sum(x), x a part's amounts by
period, the rows' axes come from H and the row totals alone: S S' = D^-1/2 (H / n) D^-1/2 - sqrt(r r').  A part is one packed row,
tasks add up H, and the driver or a task sees periods x periods numbers however many parts there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Parts whose totals are handed to the tasks that shuffle tables.
MOST_PARTS = 200_000


def packed_parts(df: DataFrame, *, period: str, part: str, amount: str) -> tuple[list, DataFrame]:
    """(periods in order, one row per part with its amounts by period, 0 where it has none).  Nulls are absent."""
    rows = df.where(F.col(period).isNotNull() & F.col(amount).isNotNull()).groupBy(F.col(part).alias("part"), F.col(period).alias("t")).agg(F.sum(F.col(amount).cast("double")).alias("v"))
    rows = cut_lineage(rows, "mix")
    times = [r["t"] for r in rows.select("t").distinct().orderBy("t").collect()]
    keys = F.array(*[F.lit(t) for t in times])
    named = rows.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m"))
    x = F.transform(keys, lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0)))
    return times, cut_lineage(named.select("part", x.alias("x")).where("aggregate(x, 0D, (a, v) -> a + v) > 0"), "parts") if times else named.select("part", F.array().cast("array<double>").alias("x")).limit(0)


def profile_moments(x: np.ndarray) -> np.ndarray:
    """H of rows of amounts by period (parts x periods)."""
    total = x.sum(axis=1)
    x, total = x[total > 0], total[total > 0]
    return (x / total[:, None]).T @ x


def row_axes(h: np.ndarray, totals: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left vectors, singular values, inertia shares) from H and the row totals; in each axis the largest entry is positive."""
    n = totals.sum()
    r = totals / n
    root = np.sqrt(r)
    lam, u = np.linalg.eigh(h / n / np.outer(root, root) - np.outer(root, root))
    lam, u = np.maximum(lam[::-1], 0.0), u[:, ::-1]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(len(lam))])
    return u[:, :k], np.sqrt(lam[:k]), lam[:k] / lam.sum() if lam.sum() > 0 else lam[:k]


def table_moments(parts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(H, row totals) of packed parts over ``n`` periods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, t = np.zeros((n, n)), np.zeros(n)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, n)
                h += profile_moments(x)
                t += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(h.tolist(), pa.list_(pa.float64())), pa.array(t)], ["i", "h", "t"])

    cells = parts.select("x").mapInArrow(run, "i int, h array<double>, t double")
    sums = cells.select("i", "t", F.posexplode("h").alias("j", "h")).groupBy("i", "j").agg(F.sum("h").alias("h"), F.sum("t").alias("t"))
    h, t = np.zeros((n, n)), np.zeros(n)
    for r in sums.collect():
        h[r["i"], r["j"]], t[r["i"]] = r["h"], r["t"]
    return h, t


def correspondence_axes(df: DataFrame, *, period: str, part: str, amount: str, axes: int = 2) -> tuple[DataFrame, DataFrame, list[float]]:
    """Row coordinates, column coordinates and inertia shares.  Columns are projected in Spark from the rows' axes."""
    spark = df.sparkSession
    times, parts = packed_parts(df, period=period, part=part, amount=amount)
    names = [f"axis{k + 1}" for k in range(axes)]
    h, totals = table_moments(parts, len(times))
    u, s, share = row_axes(h, totals, axes)
    r = totals / totals.sum()
    coords = u * s / np.sqrt(r)[:, None]
    kind = df.schema[period].dataType.simpleString()
    rows = spark.createDataFrame([(t, *map(float, c)) for t, c in zip(times, coords)], f"`{period}` {kind}, " + ", ".join(f"{a} double" for a in names))
    # a column's coordinate is the mean of the rows' left vectors over its profile, scaled back
    weight = (u / np.sqrt(r)[:, None]).T
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    mean = lambda w: F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) / total
    cols = parts.select(F.col("part").alias(part), *[mean(w).alias(a) for a, w in zip(names, weight)])
    return rows, cols, [float(v) for v in share]


def mix_clock(df: DataFrame, *, period: str, part: str, amount: str, axes: int = 2, min_train: int = 8) -> DataFrame:
    """Dates of mixes, walked forward: (period, fit, last): for each period from the ``min_train``-th on, axes and the
    regression of dates on them come from earlier periods only, the new mix is projected on these axes as a
    supplementary row, and its fitted date stands beside the naive one, the last period before it.

    Each origin's H counts a part by its total up to that origin, so a part's row adds a matrix an origin; the
    solves of all origins run side by side on one row of moments each."""
    times, parts = packed_parts(df, period=period, part=part, amount=amount)
    n = len(times)
    first = max(min_train, axes + 2)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.zeros((n, n, n))
        t = np.zeros(n)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, n)
            t += x.sum(axis=0)
            upto = np.cumsum(x, axis=1)
            for o in range(first, n):  # periods before o are known
                known = upto[:, o - 1] > 0
                h[o] += (x[known] / upto[known, o - 1, None]).T @ x[known]
        for o in range(first, n):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, o, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(h[o].tolist(), pa.list_(pa.float64())), pa.array(t)], ["o", "i", "h", "t"])

    cells = parts.select("x").mapInArrow(moments, "o int, i int, h array<double>, t double")
    sums = cells.select("o", "i", "t", F.posexplode("h").alias("j", "h")).groupBy("o", "i", "j").agg(F.sum("h").alias("h"), F.sum("t").alias("t"))
    packed = sums.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("i", "j", "h", "t"))).alias("c"))
    dates = np.array([float(t) for t in times])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for o, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = c.values
                h, t = v.field("h").to_numpy().reshape(n, n), v.field("t").to_numpy().reshape(n, n)[:, 0]
                u, s, _ = row_axes(h[:o, :o], t[:o], axes)
                r = t[:o] / t[:o].sum()
                keep = s > 1e-9
                known = np.column_stack([np.ones(o), (u * s / np.sqrt(r)[:, None])[:, keep]])
                beta = np.linalg.lstsq(known, dates[:o], rcond=None)[0]
                mass = h[o, :o].sum()  # what the new mix has in parts that are known
                profile = h[o, :o] / mass - r if mass > 0 else np.zeros(o)
                place = (profile / np.sqrt(r)) @ u[:, keep] / s[keep]
                out.append((o, float(np.append(1.0, place) @ beta)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([f for _, f in out], pa.float64())], ["o", "fit"])

    fits = packed.mapInArrow(solve, "o int, fit double")
    at = F.array(*[F.lit(t) for t in times]) if times else F.array()
    return fits.select(F.element_at(at, F.col("o") + 1).alias(period), "fit", F.element_at(at, F.col("o")).alias("last"))


def local_maxima(x: np.ndarray) -> int:
    """Modes of the columns of a table: values above both neighbours, a plateau counts once; summed over columns."""
    total = 0
    for column in x.T:
        run = column[np.append(True, column[1:] != column[:-1])]
        if len(run) == 1:
            continue  # a constant column has no mode
        up = np.append(True, run[1:] > run[:-1])
        down = np.append(run[:-1] > run[1:], True)
        total += int((up & down).sum())
    return total


def seriated_maxima(x: np.ndarray) -> int:
    """Local maxima of a table of periods and parts after its rows are put in the order of the first axis."""
    totals = x.sum(axis=1)
    u, s, _ = row_axes(profile_moments(x.T), totals, 1)
    return local_maxima(x[np.argsort(u[:, 0] / np.sqrt(totals), kind="stable")])


def seriation_significance(df: DataFrame, *, period: str, part: str, count: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """One row: how few modes the seriated table has against tables with the same margins.

    ``count`` is a whole number.  A draw deals every row's items without replacement from what earlier rows have left of the
    columns, which makes each table as likely as r x c arrangements of single items; it is seriated and counted in its task, and depends on
    seed and draw alone.  coefficient = (maximum - observed) / (maximum - expected); p is the share of draws
    with at most the observed modes.  Tasks get the margins, never the table: one number a period and a part."""
    spark = df.sparkSession
    times, parts = packed_parts(df, period=period, part=part, amount=count)
    n = len(times)
    h, totals = table_moments(parts, n)
    u, _, _ = row_axes(h, totals, 1)
    order = np.argsort(u[:, 0] / np.sqrt(totals), kind="stable")

    def modes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, n)
                yield pa.RecordBatch.from_arrays([pa.array([local_maxima(x[:, order].T)], pa.int64()), pa.array([batch.num_rows], pa.int64())], ["m", "n"])

    observed, n_parts = parts.select("x").mapInArrow(modes, "m long, n long").agg(F.sum("m"), F.sum("n")).first()
    if n_parts > MOST_PARTS:
        raise ValueError(f"{n_parts} parts are too many to shuffle in one task: group them first")
    columns = np.array([int(round(r["v"])) for r in parts.select("part", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("v")).orderBy("part").collect()], np.int64)
    by_row = np.rint(totals).astype(np.int64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rep in batch.column(0).to_pylist():
                rng, left = np.random.Generator(np.random.Philox(key=[seed, rep])), columns.copy()
                x = np.zeros((n, len(columns)))
                for i, k in enumerate(by_row):
                    x[i] = rng.multivariate_hypergeometric(left, k, method="marginals") if i < n - 1 else left
                    left = left - x[i].astype(np.int64)
                out.append(seriated_maxima(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["rep", "m"])

    random = spark.range(draws).select(F.col("id").alias("rep")).mapInArrow(draw, "rep long, m long")
    most = n_parts * ((n + 1) // 2)
    got = random.agg(F.avg("m").alias("expected"), F.avg((F.col("m") <= int(observed)).cast("double")).alias("p"), F.count(F.lit(1)).alias("draws"))
    return got.select(F.lit(int(observed)).cast("long").alias("observed"), "expected", F.lit(most).cast("long").alias("maximum"), ((most - int(observed)) / (most - F.col("expected"))).alias("coefficient"), "p", "draws")

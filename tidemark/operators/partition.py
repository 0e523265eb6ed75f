"""Trees of association tests and change points shared by few of many series."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import prefix_totals
from tidemark.session import cut_lineage

# ------------------------------------------------------------------ association trees

SPLIT = "node long, depth int, n long, mean double, feature string, t double, p_adj double, cut double, gain double"


def _strongest(row, xs: list[str]) -> tuple[str, float, float]:
    """(feature, t, adjusted p) of the candidate most associated with the outcome in a node; the first of equals."""
    best = (xs[0], 0.0, 1.0)
    for x in xs:
        r, n = row[f"r_{x}"], row["n"]
        if r is None or math.isnan(r) or n < 3:
            continue
        t = math.copysign(math.inf, r) if abs(r) >= 1 else r * math.sqrt((n - 2) / (1 - r * r))
        if abs(t) > abs(best[1]):
            best = (x, t, min(1.0, len(xs) * math.erfc(abs(t) / math.sqrt(2))))
    return best


def _corr(x: str) -> Column:
    """Correlation with the outcome; null where either is constant in a node."""
    return F.try_divide(F.covar_pop("_y", x), F.sqrt(F.var_pop("_y") * F.var_pop(x)))


def association_tree(df: DataFrame, *, y: str, xs: list[str], depth: int = 3, alpha: float = 0.05, min_bucket: int = 24) -> tuple[DataFrame, DataFrame]:
    """Recursive partitioning, a level of nodes at a time.  Returns (rows with their leaf as ``node``, nodes).

    Every row knows its node from the cuts so far, which are literals.  One aggregation tests all candidates in all open
    nodes: the correlation's t, a normal two-sided p, Bonferroni over candidates; a node whose least p is not below ``alpha`` is a
    leaf.  The cut of the chosen candidate leaves the smallest residual sum of squares with at least ``min_bucket`` rows on
    both sides, from running sums by (node, value) that are spread over slices of the value, so no task holds a node.
    A node's children are 2 node (up to the cut) and 2 node + 1.  Rows with a null in the outcome or a candidate take no
    part.  The driver sees at most 2 ** depth nodes."""
    spark = df.sparkSession
    base = df.dropna(subset=[y, *xs])
    slim = cut_lineage(base.select(F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(x) for x in xs]), "tree")
    where: dict[int, Column] = {1: F.lit(True)}
    closed: list[tuple] = []
    node_of = lambda nodes: reduce(lambda c, k: c.when(where[k], F.lit(k)), nodes[1:], F.when(where[nodes[0]], F.lit(nodes[0]))).cast("long")
    open_nodes = [1]
    for level in range(depth + 1):
        if not open_nodes:
            break
        now = slim.withColumn("_node", node_of(open_nodes)).where("_node is not null")
        tests = now.groupBy("_node").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), *[_corr(x).alias(f"r_{x}") for x in xs]).collect()
        chosen, rows = {}, {r["_node"]: r for r in tests}
        for k, r in rows.items():
            feature, t, p = _strongest(r, xs)
            if level < depth and p < alpha and r["n"] >= 2 * min_bucket:
                chosen[k] = (feature, t, p)
        cuts = {}
        if chosen:
            keys = list(chosen)
            value = reduce(lambda c, k: c.when(F.col("_node") == k, F.col(chosen[k][0])), keys[1:], F.when(F.col("_node") == keys[0], F.col(chosen[keys[0]][0])))
            asked = now.where(F.col("_node").isin(keys)).select("_node", value.alias("_v"), F.lit(1).cast("long").alias("n"), F.col("_y").alias("s"))
            c = prefix_totals(asked, ["_node"], "_v", ["n", "s"])
            nl, sl = F.col("before_n") + F.col("n"), F.col("before_s") + F.col("s")
            nr, sr = F.col("total_n") - nl, F.col("total_s") - sl
            gain = sl * sl / nl + sr * sr / nr - F.col("total_s") ** 2 / F.col("total_n")
            best = c.where((nl >= min_bucket) & (nr >= min_bucket)).groupBy("_node").agg(F.max(F.struct(gain.alias("gain"), (-F.col("_v")).alias("v"))).alias("b"))
            cuts = {r["_node"]: (-r["b"]["v"], r["b"]["gain"]) for r in best.collect()}
        following = []
        for k in sorted(rows):
            r = rows[k]
            if k in cuts:
                (feature, t, p), (cut, gain) = chosen[k], cuts[k]
                closed.append((k, level, r["n"], r["mean"], feature, t, p, cut, gain))
                low = F.col(feature).cast("double") <= F.lit(cut)
                where[2 * k], where[2 * k + 1] = where[k] & low, where[k] & ~low
                following += [2 * k, 2 * k + 1]
            else:
                closed.append((k, level, r["n"], r["mean"], None, None, None, None, None))
        open_nodes = following
    leaves = [c[0] for c in closed if c[4] is None]
    rows = base.withColumn("node", node_of(leaves) if leaves else F.lit(1).cast("long"))
    return rows, spark.createDataFrame(closed, SPLIT)


# ------------------------------------------------------------------ sparse change points


def _scaled(x: np.ndarray) -> np.ndarray | None:
    """A series over its noise level, the median absolute deviation of its steps; None if it never moves."""
    d = np.diff(x)
    s = 1.4826 * np.median(np.abs(d - np.median(d))) / math.sqrt(2)
    if not s > 0:
        s = d.std(ddof=1) / math.sqrt(2) if len(d) > 1 else 0.0
    return x / s if s > 0 else None


def cusum_transform(x: np.ndarray) -> np.ndarray:
    """Standardised difference of means before and after each time but the last."""
    n = len(x)
    t = np.arange(1, n)
    left = np.cumsum(x)[:-1]
    return np.sqrt(t * (n - t) / n) * ((x.sum() - left) / (n - t) - left / t)


def _softened(z: np.ndarray, lam: float) -> np.ndarray:
    c = cusum_transform(z)
    return np.sign(c) * np.maximum(np.abs(c) - lam, 0.0)


def _leading(gram: np.ndarray, steps: int = 10_000) -> np.ndarray:
    """Leading eigenvector by power iteration from the heaviest column."""
    u = gram[:, int(np.argmax(np.diag(gram)))].copy()
    u /= np.linalg.norm(u)
    for _ in range(steps):
        new = gram @ u
        new /= np.linalg.norm(new)
        if np.abs(new - u).max() < 1e-14:
            break
        u = new
    return new


def sparse_changepoint(df: DataFrame, *, series: str, index: str, value: str, lam: float | None = None) -> tuple[dict, DataFrame]:
    """The change in mean that a few of many series share: (summary, loadings).

    Each series is scaled by its noise and turned into its CUSUM row; rows are softened by ``lam``, which leaves the
    few that move.  The leading direction over time comes from power iteration on the rows' products, times x times,
    which tasks add up; a series' loading is its row along that direction.  The change is where the CUSUM of the loaded sum
    of the series is largest.  Only series with a value at every time take part (nulls are absent); a series is one packed row, times are
    on the calendar.  ``lam`` is sqrt(ln(p ln n) / 2) for p series and n times by default."""
    spark = df.sparkSession
    rows = df.where(F.col(value).isNotNull() & F.col(index).isNotNull()).select(F.col(series).alias("s"), F.col(index).alias("t"), F.col(value).cast("double").alias("v"))
    packed = rows.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("a"))
    times = [r["t"] for r in rows.select("t").distinct().orderBy("t").collect()]
    n = len(times)
    packed = cut_lineage(packed.where(F.size("a") == n).select("s", F.col("a.v").alias("x")), "packed")
    p = packed.count()
    empty = spark.createDataFrame([], f"s {packed.schema['s'].dataType.simpleString()}, loading double").withColumnRenamed("s", series)
    if n < 3 or p == 0:
        return {"split_at": None, "stat": 0.0, "n": n, "p": p, "lam": lam}, empty
    lam = math.sqrt(max(math.log(p * math.log(n)), 0.0) / 2) if lam is None else lam

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n - 1, n - 1))
        for batch in batches:
            for x in batch.column(0):
                z = _scaled(np.asarray(x.values))
                if z is not None:
                    c = _softened(z, lam)
                    total += np.outer(c, c)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "g"])

    gram = np.zeros((n - 1, n - 1))
    for r in packed.select("x").mapInArrow(products, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        gram[r["i"], r["j"]] = r["g"]
    if not gram.any():
        return {"split_at": None, "stat": 0.0, "n": n, "p": p, "lam": lam}, empty
    u = _leading(gram)
    u = u / math.sqrt(u @ gram @ u)

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, zs = [], []
            for x in batch.column(1):
                x = np.asarray(x.values)
                z = _scaled(x)
                out.append(0.0 if z is None else float(_softened(z, lam) @ u))
                zs.append((x if z is None else z).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(zs, pa.list_(pa.float64()))], ["s", "loading", "z"])

    kind = packed.schema["s"].dataType.simpleString()
    with_loadings = cut_lineage(packed.mapInArrow(loaded, f"s {kind}, loading double, z array<double>"), "loadings")
    total = np.zeros(n)
    for r in with_loadings.where("loading <> 0").select("loading", F.posexplode("z").alias("k", "z")).groupBy("k").agg(F.sum(F.col("loading") * F.col("z")).alias("v")).collect():
        total[r["k"]] = r["v"]
    c = np.abs(cusum_transform(total))
    k = int(c.argmax())
    return {"split_at": times[k], "stat": float(c[k]), "n": n, "p": p, "lam": lam}, with_loadings.select(F.col("s").alias(series), "loading")


def sparse_segmentation(df: DataFrame, *, series: str, index: str, value: str, threshold: float, min_size: int = 5, lam: float | None = None) -> DataFrame:
    """Shared change points one after another: each segment of times is searched for its own, until the statistic is at most
    ``threshold``.  One row per change; segments are as many as the calendar allows at most."""
    spark = df.sparkSession
    found, todo = [], [(None, None)]
    while todo:
        lo, hi = todo.pop()
        part = df
        if lo is not None:
            part = part.where(F.col(index) > F.lit(lo))
        if hi is not None:
            part = part.where(F.col(index) <= F.lit(hi))
        got, _ = sparse_changepoint(part, series=series, index=index, value=value, lam=lam)
        if got["n"] >= 2 * min_size and got["split_at"] is not None and got["stat"] > threshold:
            found.append((got["split_at"], got["stat"], got["n"], got["p"]))
            todo += [(lo, got["split_at"]), (got["split_at"], hi)]
    kind = df.schema[index].dataType.simpleString()
    return spark.createDataFrame(found, f"split_at {kind}, stat double, n_times int, n_series int")

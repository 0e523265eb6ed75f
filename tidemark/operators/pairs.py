"""Statistics of all pairs inside blocks on continuous columns, without forming the pairs.

Two tools.  Sums of a smooth function of the difference x_j - x_i over all pairs need the rows only as moments
about the centres of narrow cells: the function is expanded in its Taylor series about the difference of two centres, and cells
meet by correlation of their moments.  Counts of the rows that lie below a row on two axes come from cells of quantile
slices of both axes; what shares a slice is counted by merging inside it.  Values that hold more than a slice
are a slice of their own, in which nothing needs to be merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators.joins import join_totals
from tidemark.operators.ranks import prefix_totals, slice_of
from tidemark.session import cut_lineage

#: Cells on the range of x, and the order of the expansions.
CELLS, ORDER = 1024, 8
#: Largest |beta| * cell width; the error of an expansion is about (step / pi) ** ORDER of its value.
STEP = 0.2
#: More cells than this on a range mean that outliers stretch it.
MOST_CELLS = 1 << 17
#: Rows of one value slice that one task merges, and the most slices.
SLICE_ROWS, MOST_SLICES = 20_000, 512


# ------------------------------------------------------------------ slices


def value_slices(df: DataFrame, value: str, n_rows: int) -> Column:
    """Slice number of a value: even numbers between cut points, odd ones for the cut points themselves.

    A value that holds more rows than a slice is a cut point, so an odd slice holds one value only."""
    k = int(min(MOST_SLICES, max(16, n_rows // SLICE_ROWS)))
    cuts = sorted(set(df.approxQuantile(value, [i / k for i in range(1, k)], 0.25 / k)))
    if not cuts:
        return F.lit(0)
    s = slice_of(F.col(value), cuts)
    at = F.element_at(F.array(*[F.lit(c) for c in cuts]), s + 1)
    return 2 * s + F.when((s < len(cuts)) & (F.col(value) == at), 1).otherwise(0)


# ------------------------------------------------------------------ smooth functions of differences


def _tanh_taylor(z: np.ndarray, beta: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Taylor coefficients in z of t = tanh(beta z / 2) and of 1 - t ** 2, from t' = 1 - t ** 2."""
    a = np.zeros((order + 2, len(z)))
    a[0] = np.tanh(beta * z / 2)
    for n in range(order + 1):
        a[n + 1] = ((n == 0) - sum(a[i] * a[n - i] for i in range(n + 1))) / (n + 1)
    scale = (beta / 2) ** np.arange(order + 1)[:, None]
    return a[:-1] * scale, a[1:] * np.arange(1, order + 2)[:, None] * scale


def _times_z(c: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Coefficients of z * f from those of f."""
    out = c * z
    out[1:] += c[:-1]
    return out


def _kernels(k: np.ndarray, h: float, beta: float) -> dict[str, np.ndarray]:
    """Coefficients about k cells' distance, in units of a cell, of the score's, the information's and the pair term's function."""
    z = k * h
    t, s = _tanh_taylor(z, beta, ORDER)
    units = (h ** np.arange(ORDER + 1))[:, None]
    return {"score": _times_z(t, z) / 2 * units, "info": _times_z(_times_z(s, z), z) / 4 * units, "pair": _times_z(_times_z(t, z), z) * units}


def _correlate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of a[m + k] * b[m] for all shifts k from -(n - 1) to n - 1."""
    if len(a) <= 4096:
        return np.correlate(a, b, "full")
    n = 1 << (2 * len(a) - 1).bit_length()
    out = np.fft.irfft(np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n)), n)
    return np.concatenate([out[-(len(a) - 1) :], out[: len(a)]])


def _differences(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Moments of x_j - x_i less the distance of the cells, by that distance, for i in ``left`` and j in ``right``."""
    out = np.zeros((ORDER + 1, 2 * left.shape[1] - 1))
    for q in range(ORDER + 1):
        for r in range(q + 1):
            out[q] += math.comb(q, r) * (-1) ** r * _correlate(right[q - r], left[r])
    return out


class Cells:
    """Cells on the range of x: column expressions for the rows and arrays for the tasks."""

    def __init__(self, lo: float, hi: float, n: int):
        self.lo, self.n, self.h = lo, n, (hi - lo) / n if hi > lo else 1.0

    def columns(self, x: Column) -> tuple[Column, Column]:
        """Cell and offset from its centre, in units of a cell."""
        u = (x - self.lo) / self.h
        cell = F.least(F.floor(u), F.lit(self.n - 1)).cast("int")
        return cell, u - cell - 0.5

    def moments(self, df: DataFrame, keys: list[str], x: str) -> DataFrame:
        cell, offset = self.columns(F.col(x))
        rows = df.select(*keys, cell.alias("_cell"), offset.alias("_d"))
        return rows.groupBy(*keys, "_cell").agg(*[F.sum(F.pow("_d", F.lit(float(q)))).alias(f"m{q}") for q in range(ORDER + 1)])

    def dense(self, g: pd.DataFrame, prefix: str = "m") -> np.ndarray:
        out = np.zeros((ORDER + 1, self.n))
        out[:, g["_cell"].to_numpy()] = g[[f"{prefix}{q}" for q in range(ORDER + 1)]].to_numpy().T
        return out

    def of(self, x: np.ndarray) -> np.ndarray:
        """Moments of values in memory."""
        u = (x - self.lo) / self.h
        cell = np.minimum(u.astype(np.int64), self.n - 1)
        d, out, p = u - cell - 0.5, np.empty((ORDER + 1, self.n)), np.ones(len(x))
        for q in range(ORDER + 1):
            out[q] = np.bincount(cell, p, self.n)
            p = p * d
        return out

    @property
    def shifts(self) -> np.ndarray:
        return np.arange(-(self.n - 1), self.n)


def difference_table(df: DataFrame, cells: Cells, block: list[str], x: str) -> np.ndarray:
    """Moments of x_j - x_i over all ordered pairs of a block, by distance of cells, summed over blocks.

    A task holds the cells of one block; the driver gets a row per distance."""
    names = [f"m{q}" for q in range(ORDER + 1)]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        m = cells.dense(g)
        out = pd.DataFrame(_differences(m, m).T, columns=names)
        out.insert(0, "k", cells.shifts)
        return out

    kinds = "k int, " + ", ".join(f"{c} double" for c in names)
    rows = cells.moments(df, block, x).groupBy(*block).applyInPandas(one, kinds).groupBy("k").agg(*[F.sum(c).alias(c) for c in names])
    out = np.zeros((ORDER + 1, 2 * cells.n - 1))
    for r in rows.collect():
        out[:, r["k"] + cells.n - 1] = r[1:]
    return out


# ------------------------------------------------------------------ probabilistic index model


def _pair_rows(df: DataFrame, block: list[str], x: str, y: str) -> tuple[DataFrame, dict]:
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*block, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    s = rows.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    mid = (s["lo"] + s["hi"]) / 2 if s["n"] else 0.0
    rows = cut_lineage(rows.withColumn("_x", F.col("_x") - mid), "pairs")
    return rows, {"lo": (s["lo"] or 0.0) - mid, "hi": (s["hi"] or 0.0) - mid, "n": s["n"]}


def _order_totals(rows: DataFrame, block: list[str]) -> DataFrame:
    """Per (block, distinct y): rows and sum of x at, below and above it."""
    t = prefix_totals(rows.select(*block, "_y", F.col("_x").alias("sx"), F.lit(1).cast("long").alias("n")), block, "_y", ["n", "sx"])
    return t.withColumns({"above_n": F.col("total_n") - F.col("before_n") - F.col("n"), "above_sx": F.col("total_sx") - F.col("before_sx") - F.col("sx")})


def _fit(rows: DataFrame, stats: dict, block: list[str], order: DataFrame) -> tuple[float, float, Cells]:
    """(beta, information, cells): Newton steps on the score, which is exact in y and expanded in x."""
    favour = F.col("n") * (F.col("above_sx") + 0.5 * F.col("sx")) - F.col("sx") * (F.col("above_n") + 0.5 * F.col("n"))
    data = float(order.agg(F.sum(favour)).first()[0] or 0.0) / 2
    n = CELLS
    while True:
        cells = Cells(stats["lo"], stats["hi"], n)
        table = difference_table(rows, cells, block, "_x")
        beta = info = 0.0
        for _ in range(100):
            k = _kernels(cells.shifts, cells.h, beta)
            info = float((k["info"] * table).sum()) / 2
            if info <= 0:
                break
            step = (data - float((k["score"] * table).sum()) / 2) / info
            beta += step
            if abs(step) <= 1e-14 * max(1.0, abs(beta)):
                break
        if abs(beta) * cells.h <= STEP or info <= 0:
            return beta, info, cells
        n *= 8
        if n > MOST_CELLS:
            raise ValueError("the slope is too steep for the range of x: trim outliers or take ranks")


def pim_fit(df: DataFrame, *, block: list[str], x: str, y: str) -> dict[str, float]:
    """Probabilistic index model logit P(y_i < y_j) + P(y_i = y_j) / 2 = beta (x_j - x_i) over all pairs of a block.

    z P = z / 2 + z tanh(beta z / 2) / 2, and both the second term and the information are smooth, even functions of the
    difference, so that moments of cells are enough whatever values x takes."""
    rows, stats = _pair_rows(df, block, x, y)
    beta, info, _ = _fit(rows, stats, block, cut_lineage(_order_totals(rows, block), "order"))
    return {"beta": beta, "information": info}


def _ordered_sum(x: np.ndarray, y: np.ndarray, cells: Cells, beta: float, kernel: np.ndarray, leaf: int = 1024) -> float:
    """Sum of z ** 2 tanh(beta z / 2) over pairs with y_i < y_j: halves of y meet by their cells, small parts directly."""
    rank = np.unique(y, return_inverse=True)[1]
    order = np.argsort(rank, kind="stable")
    x, rank = x[order], rank[order]
    total, todo = 0.0, [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2 or rank[lo] == rank[hi - 1]:
            continue
        if hi - lo <= leaf:
            z = x[None, lo:hi] - x[lo:hi, None]
            total += float((z * z * np.tanh(beta * z / 2))[rank[lo:hi, None] < rank[None, lo:hi]].sum())
            continue
        mid = lo + int(np.searchsorted(rank[lo:hi], (rank[lo] + rank[hi - 1]) // 2, "right"))
        total += float((kernel * _differences(cells.of(x[lo:mid]), cells.of(x[mid:hi]))).sum())
        todo += [(lo, mid), (mid, hi)]
    return total


def _pair_sum(rows: DataFrame, stats: dict, block: list[str], cells: Cells, beta: float) -> float:
    """Sum of z ** 2 tanh(beta z / 2) over pairs of a block with y_i < y_j: slices of y against all lower ones by cells, and
    inside a slice by merging; a slice of one value of y has no such pair."""
    kernel = _kernels(cells.shifts, cells.h, beta)["pair"]
    sliced = cut_lineage(rows.withColumn("_s", value_slices(rows, "_y", stats["n"])), "slices")
    names = [f"m{q}" for q in range(ORDER + 1)]
    own = cut_lineage(cells.moments(sliced, [*block, "_s"], "_x"), "slice-cells")
    # every slice of a block needs the lower slices' moments in all cells of the block
    grid = own.select(*block, "_s").distinct().join(own.select(*block, "_cell").distinct(), block) if block else own.select("_s").distinct().join(own.select("_cell").distinct(), F.lit(True))
    full = grid.join(own, [*block, "_s", "_cell"], "left").fillna(0.0, names)
    lower = Window.partitionBy(*block, "_cell").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    full = full.select("*", *[F.coalesce(F.sum(c).over(lower), F.lit(0.0)).alias(f"b{c}") for c in names])

    def across(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"w": [float((kernel * _differences(cells.dense(g, "bm"), cells.dense(g))).sum())]})

    def inside(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"w": [_ordered_sum(g["_x"].to_numpy(), g["_y"].to_numpy(), cells, beta, kernel)]})

    parts = full.groupBy(*block, "_s").applyInPandas(across, "w double")
    parts = parts.unionByName(sliced.where("_s % 2 = 0").groupBy(*block, "_s").applyInPandas(inside, "w double"))
    return float(parts.agg(F.sum("w")).first()[0] or 0.0)


def pim_vcov(df: DataFrame, *, block: list[str], x: str, y: str) -> dict[str, float]:
    """Slope and its observation-clustered sandwich variance.

    A row's score over all its pairs is a sum over the order of y, from running totals, less a smooth function of its x, which is
    a polynomial in its cell.  The squares of single pairs, which two rows' scores both hold, are taken away: they split into moments
    of x and the ordered pair sum."""
    rows, stats = _pair_rows(df, block, x, y)
    order = cut_lineage(_order_totals(rows, block), "order")
    beta, info, cells = _fit(rows, stats, block, order)
    kernel = _kernels(cells.shifts, cells.h, beta)["score"]
    coef = [f"e{r}" for r in range(ORDER + 1)]

    def polynomials(g: pd.DataFrame) -> pd.DataFrame:
        m = cells.dense(g)
        out = np.zeros((ORDER + 1, cells.n))
        for q in range(ORDER + 1):
            for r in range(q + 1):
                padded = np.concatenate([np.zeros(cells.n - 1), m[q - r], np.zeros(cells.n - 1)])
                out[r] += math.comb(q, r) * (-1) ** r * (np.correlate(padded, kernel[q], "valid") if cells.n <= 4096 else _far(m[q - r], kernel[q]))
        at = g["_cell"].to_numpy()
        return pd.concat([g[[*block, "_cell", "rows"]].reset_index(drop=True), pd.DataFrame(out[:, at].T, columns=coef)], axis=1)

    kinds = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in block) + "_cell int, rows long, " + ", ".join(f"{c} double" for c in coef)
    poly = cells.moments(rows, block, "_x").withColumn("rows", F.round("m0").cast("long")).groupBy(*block).applyInPandas(polynomials, kinds)
    cell, offset = cells.columns(F.col("_x"))
    met = join_totals(rows, [*block, "_y"], order, "n").withColumns({"_cell": cell, "_d": offset})
    met = join_totals(met, [*block, "_cell"], cut_lineage(poly, "polynomials"), "rows")
    smooth = F.lit(0.0)
    for c in reversed(coef):
        smooth = smooth * F.col("_d") + F.col(c)
    own = F.col("above_sx") + 0.5 * F.col("sx") - F.col("_x") * (F.col("above_n") + 0.5 * F.col("n"))
    score = own - 0.5 * (F.col("total_sx") - F.col("total_n") * F.col("_x")) - smooth
    meat = float(met.agg(F.sum(score * score)).first()[0] or 0.0)
    spread = lambda keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("s"), F.sum(F.col("_x") ** 2).alias("ss")).agg(F.sum(2 * (F.col("n") * F.col("ss") - F.col("s") ** 2))).first()[0] or 0.0
    squares, tied = float(spread(block)), float(spread([*block, "_y"]))
    pair = ((squares - tied) - 4 * _pair_sum(rows, stats, block, cells, beta) + (squares - 8 * info)) / 8
    return {"beta": beta, "variance": (meat - pair) / info**2 if info > 0 else float("nan"), "information": info}


def _far(m: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sums of kernel[b - a] * m[b] for every cell a, by transforms."""
    n = len(m)
    size = 1 << (3 * n).bit_length()
    out = np.fft.irfft(np.fft.rfft(m, size) * np.fft.rfft(kernel[::-1], size), size)
    return out[n - 1 : 2 * n - 1]


# ------------------------------------------------------------------ orthogonal range sums


def _merged_sums(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each point the weights of the points with a' <= a and b' <= b, by halving the ranks of a.

    All halves of one level are met at once: points stay sorted by b, equal ones by a, inside the ranks that agree above a bit, and those with the
    bit set take the running total of those without."""
    rank = np.unique(a, return_inverse=True)[1]
    n = len(rank)
    got, order = np.zeros(n, w.dtype), np.lexsort((rank, b))
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        r = rank[order]
        low = (r >> bit) & 1 == 0
        starts = np.flatnonzero(np.diff(r >> (bit + 1), prepend=-1))
        group = np.repeat(starts, np.diff(np.append(starts, n)))
        run = np.append(0, np.cumsum(np.where(low, w[order], 0)))
        high = ~low
        got[order[high]] += (run[1:] - run[group])[high]
        # stable: those without the bit first
        zeros = np.append(0, np.cumsum(low))
        size = np.repeat(np.diff(np.append(zeros[starts], zeros[-1])), np.diff(np.append(starts, n)))
        before = zeros[:-1] - zeros[group]
        to = np.where(low, group + before, size + np.arange(n) - before)
        moved = np.empty_like(order)
        moved[to] = order
        order = moved
    # one value of a, sorted by b: equal points take each other
    r, y = rank[order], b[order]
    run = np.append(0, np.cumsum(w[order]))
    starts = np.flatnonzero(np.diff(r, prepend=-1))
    first = np.repeat(starts, np.diff(np.append(starts, n)))
    ends = np.flatnonzero(np.append((r[1:] != r[:-1]) | (y[1:] != y[:-1]), True)[:n])
    last = np.repeat(ends, np.diff(np.append(-1, ends))) + 1
    got[order] += run[last] - run[first]
    return got


def _block_sums(g: pd.DataFrame, block: list[str], a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``_merged_sums`` inside each block of ``g``, for all blocks at once: blocks rise on one axis and fall on the other, so
    points of two blocks are never below each other."""
    code = g.groupby(block, sort=False, dropna=False).ngroup().to_numpy() if block else np.zeros(len(g), np.int64)
    x, y = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    return _merged_sums(code * len(g) + x, y - code * len(g), w)


def below_sums(df: DataFrame, *, block: list[str], a: str, b: str, weights: list[str]) -> DataFrame:
    """Per distinct (block, a, b): the summed ``weights`` (whole numbers) there, and as ``below_<w>`` over all points of the block that
    are no larger on either axis, the point included.

    Of a point's lower neighbours those in lower slices of both axes come from the cells of the grid of slices, those in
    its slice of one axis from a merge inside that slice, of all blocks together, and those in an odd slice (one value) from the
    cells along it."""
    pts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*block, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"), *weights)
    pts = cut_lineage(pts.groupBy(*block, "_a", "_b").agg(*[F.sum(w).cast("long").alias(w) for w in weights]), "points")
    n = pts.count()
    pts = cut_lineage(pts.withColumns({"_s": value_slices(pts, "_a", n), "_t": value_slices(pts, "_b", n)}), "points")
    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in block)
    keep = [*block, "_a", "_b"]

    def inside_a(g: pd.DataFrame) -> pd.DataFrame:
        out = g[keep].copy()
        for w in weights:
            out[w] = _block_sums(g, block, g["_a"].to_numpy(), g["_b"].to_numpy(), g[w].to_numpy(np.int64))
        return out

    def inside_b(g: pd.DataFrame) -> pd.DataFrame:  # lower slices of a only: points of one slice are counted there
        out = g[keep].copy()
        for w in weights:
            v = g[w].to_numpy(np.int64)
            low = _block_sums(g, block, g["_s"].to_numpy(), g["_b"].to_numpy(), v)
            out[w] = low - _block_sums(g, [*block, "_s"], np.zeros(len(g)), g["_b"].to_numpy(), v)
        return out

    schema = kinds + "_a double, _b double, " + ", ".join(f"{w} long" for w in weights)
    parts = pts.where("_s % 2 = 0").groupBy("_s").applyInPandas(inside_a, schema)
    parts = parts.unionByName(pts.where("_t % 2 = 0").groupBy("_t").applyInPandas(inside_b, schema))
    # inside a cell of an odd slice of a only the order of b is left
    line = Window.partitionBy(*block, "_s", "_t").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.unionByName(pts.where("_s % 2 = 1").select(*keep, *[F.sum(w).over(line).alias(w) for w in weights]))
    got = parts.groupBy(*keep).agg(*[F.sum(w).alias(f"_p_{w}") for w in weights])

    def lower_cells(g: pd.DataFrame) -> pd.DataFrame:
        """Cells lower on both axes; in an odd slice also those along it."""
        s, t = g["_s"].to_numpy(), g["_t"].to_numpy()
        out = g[[*block, "_s", "_t", "_n"]].copy()
        twice = pd.concat([g[block], g[block]], ignore_index=True)
        for w in weights:
            v = g[w].to_numpy(np.int64)
            low = _block_sums(twice, block, np.append(s, s - 1 + s % 2), np.append(t, t - 1 + t % 2), np.append(v, np.zeros_like(v)))[len(g) :]
            out[f"_g_{w}"] = low - np.where((s % 2 == 1) & (t % 2 == 1), v, 0)
        return out

    # whole blocks in each group; a block has at most as many cells as there are pairs of slices
    cells = cut_lineage(pts.groupBy(*block, "_s", "_t").agg(*[F.sum(w).alias(w) for w in weights], F.count(F.lit(1)).alias("_n")), "cells")
    deal = F.pmod(F.xxhash64(*block), F.lit(max(16, n // SLICE_ROWS))) if block else F.lit(0)
    carried = cells.groupBy(deal).applyInPandas(lower_cells, kinds + "_s int, _t int, _n long, " + ", ".join(f"_g_{w} long" for w in weights))
    rows = join_totals(pts, [*block, "_s", "_t"], cut_lineage(carried, "carried"), "_n").join(got, keep)
    total = {f"below_{w}": F.col(f"_g_{w}") + F.col(f"_p_{w}") for w in weights}
    return rows.select(*block, F.col("_a").alias(a), F.col("_b").alias(b), *weights, *[c.alias(k) for k, c in total.items()])


# ------------------------------------------------------------------ dominance on two axes


def _up_to(df: DataFrame, block: list[str], axes: list[str], weights: list[str]) -> DataFrame:
    return below_sums(df, block=block, a=axes[0], b=axes[1], weights=weights)


def dominance_counts(df: DataFrame, *, block: list[str], axes: list[str]) -> DataFrame:
    """Per distinct (block, two axes): rows there, strictly below (no larger on either axis, smaller on one) and strictly above."""
    rows = df.dropna(subset=axes).select(*block, *[F.col(c).cast("double").alias(c) for c in axes], F.lit(1).cast("long").alias("n"))
    low = _up_to(rows, block, axes, ["n"]).withColumn("below", F.col("below_n") - F.col("n"))
    turned = rows.select(*block, *[(-F.col(c)).alias(c) for c in axes], "n")
    high = _up_to(turned, block, axes, ["n"]).select(*block, *[(0 - F.col(c)).alias(c) for c in axes], (F.col("below_n") - F.col("n")).alias("above"))
    return low.select(*block, *axes, "n", "below").join(high, [*block, *axes])


def _dense_ranks(rows: DataFrame, block: list[str], value: str) -> DataFrame:
    """Per distinct (block, value): how many smaller values the block has."""
    each = rows.select(*block, value).distinct().withColumn("_one", F.lit(1).cast("long"))
    return prefix_totals(each, block, value, ["_one"]).select(*block, value, F.col("before__one").alias("_r"))


def dominance_summary(df: DataFrame, *, block: list[str], axes: list[str], outcome: str, composite: str | None = None) -> DataFrame:
    """Comparable share, and among dominance pairs the share where the upper row has the smaller outcome, ties at one half.

    Pairs with the larger outcome below are split by the first bit in which the ranks of their outcomes differ: the
    ranks that agree above a bit are a block, those with the bit set count for those without, so each pair is counted on two axes in one block.
    With ``composite``, a column that rises with both axes, also the incomparable pairs and the share of them where the row of larger
    composite has the smaller outcome."""
    from tidemark.operators.similarity import rank_pair_counts

    names = [*axes, outcome] + ([composite] if composite else [])
    rows = cut_lineage(df.dropna(subset=names).select(*block, *[F.col(c).cast("double").alias(c) for c in names]), "dominance")
    one = F.lit(1).cast("long")
    strictly = lambda i, j: F.sum(F.col(j) * (F.col(f"below_{i}") - F.col(i)))
    pairs = _up_to(rows.withColumn("n", one), block, axes, ["n"]).groupBy(*block).agg(strictly("n", "n").alias("dominance_pairs"), F.sum("n").alias("n"))
    ranked = cut_lineage(rows.join(_dense_ranks(rows, block, outcome), [*block, outcome]), "outcome-ranks")
    same = _up_to(ranked.withColumn("n", one), [*block, "_r"], axes, ["n"]).groupBy(*block).agg(strictly("n", "n").alias("_eq"))
    top = ranked.agg(F.max("_r")).first()[0] or 0
    bits = max(1, int(top).bit_length())
    split = ranked.select(*block, *axes, "_r", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("_bit"))
    # ranks that agree above the bit; a shift by more than the bits of a long would wrap
    split = split.select(*block, *axes, "_bit", F.expr("shiftright(_r, _bit + 1)").alias("_up"), F.expr("shiftright(_r, _bit) & 1L").alias("_hi"))
    split = split.withColumn("_lo", 1 - F.col("_hi"))
    less = _up_to(split, [*block, "_bit", "_up"], axes, ["_hi", "_lo"]).groupBy(*block).agg(strictly("_hi", "_lo").alias("_lt"))
    j = pairs.join(same, block).join(less, block).withColumn("_c", F.col("_lt") + 0.5 * F.col("_eq"))
    out = [*block, "n", "dominance_pairs", ratio(2 * F.col("dominance_pairs"), F.col("n") * (F.col("n") - 1)).alias("comparable_share"), ratio("_c", "dominance_pairs").alias("concordance")]
    if composite:
        every = rank_pair_counts(rows, block=block, x=composite, y=outcome).select(*block, F.col("n").alias("_all"), (F.col("n") - F.col("less") - 0.5 * F.col("tie")).alias("_agree"))
        j = j.join(every, block)
        out += [(F.col("_all") - F.col("dominance_pairs")).alias("incomparable_pairs"), ratio(F.col("_agree") - F.col("_c"), F.col("_all") - F.col("dominance_pairs")).alias("incomparable_agreement")]
    return j.select(*out)


def average_rank_local(df: DataFrame, *, block: list[str], axes: list[str], entity: str) -> DataFrame:
    """Approximate average rank (below + 1)(n + 1) / (n + 1 - incomparable) of every row."""
    c = cut_lineage(dominance_counts(df, block=block, axes=axes), "dominance")
    t = c.groupBy(*block).agg(F.sum("n").alias("_t"))
    inc = F.col("_t") - 1 - F.col("below") - F.col("above")
    c = c.join(t, block).select(*block, *[F.col(a).alias(f"_{a}") for a in axes], "n", "below", "above", inc.alias("incomparable"), ((F.col("below") + 1) * (F.col("_t") + 1) / (F.col("_t") + 1 - inc)).alias("avg_rank"))
    rows = df.dropna(subset=axes).select(entity, *block, *axes, *[F.col(a).cast("double").alias(f"_{a}") for a in axes])
    return join_totals(rows, [*block, *[f"_{a}" for a in axes]], c, "n").drop("n", *[f"_{a}" for a in axes])

"""Profiles, graded dominance, interstructure, hierarchy autocorrelation."""

from __future__ import annotations

import itertools
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import arr_sum
from tidemark.functions.scalars import ratio
from tidemark.session import cut_lineage


def _series(df: DataFrame, n: int, entity: str, index: str, value: str) -> DataFrame:
    """One packed row per entity: the n points in order, complete series only."""
    g = df.groupBy(entity).agg(*[F.max(F.when(F.col(index) == i, F.col(value))).alias(f"v{i}") for i in range(n)])
    return g.dropna().select(entity, F.array(*[F.col(f"v{i}") for i in range(n)]).alias("x"))


def _likeness(x: Column, profile: list[float]) -> Column:
    """Correlation of a packed series with a constant profile, to nine decimals; null where either does not vary."""
    n = len(profile)
    middle = sum(profile) / n
    offsets = [p - middle for p in profile]
    length = math.sqrt(sum(v * v for v in offsets))
    if length == 0:
        return F.lit(None).cast("double")
    along = sum((F.element_at(x, k) * (v / length) for k, v in enumerate(offsets, 1)), F.lit(0.0))
    spread = arr_sum(F.transform(x, lambda e: e * e)) - arr_sum(x) * arr_sum(x) / n
    return F.round(F.when(spread > 0, along / F.sqrt(spread)), 9)


def _assign(series: DataFrame, profiles: dict[str, list[float]]) -> DataFrame:
    """Each series with the profiles it is most like, in equal parts; a series that is like none has no row."""
    scored = series.withColumn("_c", F.array(*[F.struct(_likeness(F.col("x"), p).alias("r"), F.lit(k).alias("p")) for k, p in profiles.items()]))
    highest = F.array_max(F.col("_c")["r"])
    first = F.filter("_c", lambda e: e["r"] == highest)
    each = scored.withColumn("_t", first).select("*", F.explode("_t").alias("_e"))
    return each.withColumns({"profile": F.col("_e.p"), "weight": 1.0 / F.size("_t")})


def profile_assign(df: DataFrame, profiles: dict[str, list[float]], *, entity: str, index: str, value: str) -> DataFrame:
    """Each series to the model profile it correlates with best; ties split equally."""
    n = len(next(iter(profiles.values())))
    s = _series(df, n, entity, index, value)
    s = s.withColumn("x", F.transform("x", lambda v: v - F.element_at("x", 1)))
    return _assign(s, profiles).groupBy("profile").agg(F.sum("weight").alias("assigned"))


def profile_significance(df: DataFrame, profiles: dict[str, list[float]], *, entity: str, index: str, value: str) -> DataFrame:
    """Assigned and expected counts (mean over all column permutations of the n points) and the exact
    binomial upper tail of the assigned count.

    The permutations are one constant array that every packed row runs through, so the series are read once."""
    from tidemark.operators.events import binomial_tail

    n = len(next(iter(profiles.values())))
    s = _series(df, n, entity, index, value)
    perms = list(itertools.permutations(range(1, n + 1)))
    each = F.from_json(F.lit(json.dumps(perms)), "array<array<int>>")
    moved = F.transform(each, lambda q: F.transform(q, lambda i: F.element_at("x", i) - F.element_at("x", F.element_at(q, 1))))
    e = _assign(s.select(entity, F.explode(moved).alias("x")), profiles).groupBy("profile").agg((F.sum("weight") / len(perms)).alias("expected"))
    a = profile_assign(df, profiles, entity=entity, index=index, value=value)
    total = s.agg(F.count(F.lit(1))).scalar()
    j = e.join(a, "profile", "left").fillna(0.0, ["assigned"]).withColumn("n", total)
    # ties split one series over profiles: the count is rounded up but for rounding noise
    tail = binomial_tail(F.ceil(F.col("assigned") - 1e-9).cast("int"), F.col("n").cast("int"), F.col("expected") / F.col("n"))
    return j.select("profile", "assigned", "expected", tail.alias("p_upper"))


# ------------------------------------------------------------------ pairs without pairing


def grade_values(df: DataFrame, x: str, limit: int = 64) -> list:
    """The distinct grades of a graded column; a column with more than ``limit`` values is not graded."""
    got = [r[0] for r in df.select(x).where(F.col(x).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(got) > limit:
        raise ValueError(f"{x} has more than {limit} distinct values: grade it first (for example with quintile_symbols)")
    return sorted(got)


def graded_cells(df: DataFrame, *, block: list[str], x: str, y: str, grades: list) -> DataFrame:
    """Per (block, distinct y): rows of every grade at y, below y and in the block.

    Running totals over y give, for each row, how many rows of each grade lie below it: the
    statistics of all pairs inside a block follow without forming one pair."""
    from tidemark.operators.ranks import prefix_totals

    cols = [f"_n{k}" for k in range(len(grades))]
    src = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *block, F.col(y).cast("double").alias("_y"), *[(F.col(x) == F.lit(g)).cast("long").alias(c) for g, c in zip(grades, cols)])
    return prefix_totals(src, block, "_y", cols)


def graded_pair_counts(df: DataFrame, *, block: list[str], x: str, y: str) -> DataFrame:
    """For grades a < b: pairs (i in a, j in b) of one block, those with y_i < y_j, and ties."""
    grades = grade_values(df, x)
    c = graded_cells(df, block=block, x=x, y=y, grades=grades)
    one = []
    for ia, a in enumerate(grades):
        for ib, b in enumerate(grades):
            if ia < ib:
                one.append(F.struct(F.lit(a).alias("xa"), F.lit(b).alias("xb"), (F.col(f"_n{ib}") * F.col(f"before__n{ia}")).alias("less"), (F.col(f"_n{ib}") * F.col(f"_n{ia}")).alias("tie"), (F.col(f"_n{ib}") * F.col(f"total__n{ia}")).alias("n")))
    e = c.select(*block, F.explode(F.array(*one)).alias("e")).select(*block, "e.*")
    return e.groupBy(*block, "xa", "xb").agg(F.sum("less").alias("less"), F.sum("tie").alias("tie"), F.sum("n").alias("n"))


def _cross_counts(x, y) -> tuple[int, int]:
    """Pairs with x_i < x_j and y_i < y_j, and those with y_i = y_j, by halving the ranks of x."""
    import numpy as np

    rank = np.unique(x, return_inverse=True)[1]
    order = np.argsort(rank, kind="stable")
    rank, y = rank[order], np.asarray(y)[order]
    less = tie = 0
    todo = [(0, len(rank))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2 or rank[lo] == rank[hi - 1]:
            continue
        mid = lo + int(np.searchsorted(rank[lo:hi], (rank[lo] + rank[hi - 1]) // 2, "right"))
        left = np.sort(y[lo:mid])
        below = np.searchsorted(left, y[mid:hi], "left")
        less += int(below.sum())
        tie += int((np.searchsorted(left, y[mid:hi], "right") - below).sum())
        todo += [(lo, mid), (mid, hi)]
    return less, tie


def rank_pair_counts(df: DataFrame, *, block: list[str], x: str, y: str) -> DataFrame:
    """Per block: pairs with x_i < x_j (``n``), those of them with y_i < y_j (``less``) and with y_i = y_j (``tie``).

    Any columns will do, graded or continuous.  Both axes are cut at quantiles.  A pair in different slices of both is
    counted on the grid of slices; a pair in one slice of x, or in one of y only, is counted inside that slice by
    merging, so no task holds a block and no pair is formed."""
    import numpy as np

    from tidemark.operators.ranks import slice_bounds, slice_of

    src = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*block, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    src = cut_lineage(src, "pairs")
    rows = src.withColumns({"_s": slice_of(F.col("_x"), slice_bounds(src, "_x")), "_t": slice_of(F.col("_y"), slice_bounds(src, "_y"))})
    kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in block) + ", less long, tie long"

    def one(first: pd.DataFrame, less: int, tie: int) -> pd.DataFrame:
        return pd.DataFrame([[*first[block].iloc[0], less, tie]], columns=[*block, "less", "tie"])

    def within_x(g: pd.DataFrame) -> pd.DataFrame:
        return one(g, *_cross_counts(g["_x"], g["_y"]))

    def within_y(g: pd.DataFrame) -> pd.DataFrame:
        return one(g, *_cross_counts(g["_s"], g["_y"]))

    def grid(g: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros((g["_s"].max() + 1, g["_t"].max() + 1), np.int64)
        n[g["_s"], g["_t"]] = g["n"]
        lower = np.zeros_like(n)
        lower[1:, 1:] = n.cumsum(axis=0).cumsum(axis=1)[:-1, :-1]
        return one(g, int((n * lower).sum()), 0)

    cells = rows.groupBy(*block, "_s", "_t").agg(F.count(F.lit(1)).alias("n"))
    parts = rows.groupBy(*block, "_s").applyInPandas(within_x, kinds)
    parts = parts.unionByName(rows.groupBy(*block, "_t").applyInPandas(within_y, kinds)).unionByName(cells.groupBy(*block).applyInPandas(grid, kinds))
    alike = src.groupBy(*block, "_x").agg(F.count(F.lit(1)).alias("k")).groupBy(*block).agg(F.sum("k").alias("m"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("same"))
    n = (F.col("m") * (F.col("m") - 1) / 2 - F.col("same")).cast("long")
    return parts.groupBy(*block).agg(F.sum("less").alias("less"), F.sum("tie").alias("tie")).join(alike, block).select(*block, "less", "tie", n.alias("n"))


def concordance(df: DataFrame, *, block: list[str], x: str, y: str) -> DataFrame:
    """Share of concordant pairs within block among pairs with different x, ties at one half."""
    p = rank_pair_counts(df, block=block, x=x, y=y).where("n > 0")
    return p.select(*block, ratio(F.col("less") + 0.5 * F.col("tie"), F.col("n")).alias("concordance"), F.col("n").alias("n_pairs"))


# ------------------------------------------------------------------ graded dominance


def _cumulate(grid: DataFrame, keys: list[str], axes: list[tuple[str, bool]], value: str, out: str) -> DataFrame:
    """Running sum along each axis in turn (up = towards larger grades); the grid is dense and small."""
    names = [a for a, _ in axes]
    x = grid.withColumn(out, F.col(value))
    for a, up in axes:
        others = [n for n in x.columns if n in keys or (n in names and n != a)]
        w = Window.partitionBy(*others).orderBy(F.col(a).asc() if up else F.col(a).desc()).rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn(out, F.sum(out).over(w))
    return x


def dense_grid(df: DataFrame, *, block: list[str], axes: list[str]) -> DataFrame:
    """Counts on the full product of the grades: an explode of literal grade lists per block."""
    g = df.dropna(subset=axes).groupBy(*block, *axes).agg(F.count(F.lit(1)).alias("n"))
    d = df.select(*block).distinct()
    for a in axes:
        d = d.withColumn(a, F.explode(F.array(*[F.lit(v) for v in grade_values(df, a)])))
    return d.join(g, [*block, *axes], "left").fillna(0, ["n"])


def dominance_counts(df: DataFrame, *, block: list[str], axes: list[str]) -> DataFrame:
    """Per graded cell: rows strictly below (no larger on any axis, smaller on one) and strictly above."""
    g = dense_grid(df, block=block, axes=axes)
    g = _cumulate(g, block, [(a, True) for a in axes], "n", "_b")
    g = _cumulate(g, block, [(a, False) for a in axes], "n", "_a")
    return g.select(*block, *axes, "n", (F.col("_b") - F.col("n")).alias("below"), (F.col("_a") - F.col("n")).alias("above"))


def dominance_transitions(df: DataFrame, *, entity: str, year: str, axes: list[str]) -> DataFrame:
    """Year-to-year fate of dominance pairs among entities present in both years: kept, flipped, lost, gained.

    The pairs of two years are counted on the product grid of both years' grades."""
    a = df.select(entity, year, *axes)
    b = df.select(entity, (F.col(year) - 1).alias(year), *[F.col(x).alias(f"{x}_n") for x in axes])
    nx = [f"{x}_n" for x in axes]
    g = dense_grid(a.join(b, [entity, year]).drop(entity), block=[year], axes=[*axes, *nx])
    up_a, up_b, dn_b = [(x, True) for x in axes], [(x, True) for x in nx], [(x, False) for x in nx]
    g = _cumulate(g, [year], up_a + up_b, "n", "_k4")
    g = _cumulate(g, [year], up_a + dn_b, "n", "_f4")
    g = _cumulate(g, [year, *nx], up_a, "n", "_a2")
    g = _cumulate(g, [year, *axes], up_b, "n", "_b2")
    g = _cumulate(g, [year, *axes], dn_b, "n", "_d2")
    n = F.col("n")
    kept = n * (F.col("_k4") - F.col("_a2") - F.col("_b2") + n)
    flip = n * (F.col("_f4") - F.col("_a2") - F.col("_d2") + n)
    s = g.groupBy(year).agg(F.sum(kept).alias("kept"), F.sum(flip).alias("flipped"))
    both = a.join(b, [entity, year])
    now = dominance_counts(both, block=[year], axes=axes).groupBy(year).agg(F.sum(F.col("n") * F.col("below")).alias("_now"))
    nxt = dominance_counts(both, block=[year], axes=nx).groupBy(year).agg(F.sum(F.col("n") * F.col("below")).alias("_nxt"))
    j = s.join(now, year).join(nxt, year)
    return j.select(year, "kept", "flipped", (F.col("_now") - F.col("kept") - F.col("flipped")).alias("lost"), (F.col("_nxt") - F.col("kept") - F.col("flipped")).alias("gained"))


# ------------------------------------------------------------------ interstructure, composites, hierarchy


def rank_correlation_matrix(df: DataFrame, *, block: str, entity: str, values: list[str]) -> DataFrame:
    """Spearman matrix per block in long form (i <= j both ways included)."""
    from tidemark.operators.ranks import rank_average

    long = df.dropna(subset=values).select(block, entity, *[F.col(v).cast("double").alias(v) for v in values]).unpivot([block, entity], values, "var", "v")
    r = rank_average(long, [block, "var"], "v", "r")
    wide = r.groupBy(block, entity).agg(*[F.max(F.when(F.col("var") == v, F.col("r"))).alias(v) for v in values])
    cells = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), (F.corr(a, b) if a != b else F.lit(1.0)).alias("c")) for a in values for b in values]
    return wide.groupBy(block).agg(F.array(*cells).alias("m")).select(block, F.explode("m").alias("e")).select(block, "e.*")


def double_center(m: DataFrame, *, block: str) -> DataFrame:
    """Subtract row and column means of each V x V matrix, add the grand mean."""
    r = Window.partitionBy(block, "i")
    c = Window.partitionBy(block, "j")
    g = Window.partitionBy(block)
    return m.withColumn("c", F.col("c") - F.avg("c").over(r) - F.avg("c").over(c) + F.avg("c").over(g))


def rv_coefficient(m: DataFrame, *, block: str, modified: bool = False) -> DataFrame:
    """RV between every two blocks' matrices (blocks are calendar years): sums of entry products."""
    x = m.where("i <> j") if modified else m
    a = x.select(F.col(block).alias("b1"), "i", "j", F.col("c").alias("c1"))
    b = x.select(F.col(block).alias("b2"), "i", "j", F.col("c").alias("c2"))
    p = a.join(b, ["i", "j"]).groupBy("b1", "b2").agg(F.sum(F.col("c1") * F.col("c2")).alias("s"))
    own = p.where("b1 = b2")
    o1 = own.select("b1", F.col("s").alias("s1"))
    o2 = own.select(F.col("b1").alias("b2"), F.col("s").alias("s2"))
    return p.where("b1 < b2").join(o1, "b1").join(o2, "b2").select("b1", "b2", (F.col("s") / F.sqrt(F.col("s1") * F.col("s2"))).alias("rv"))


def _first_directions(table: dict[tuple, float], labels: list, k: int) -> tuple[list[list[float]], list[float]]:
    """Leading unit vectors and values of a small symmetric table of pairs, the first with a positive sum."""
    import numpy as np

    values, vectors = np.linalg.eigh([[table.get((p, q), table.get((q, p), 0.0)) for q in labels] for p in labels])
    top = [vectors[:, -1 - d] for d in range(min(k, len(labels)))]
    return [(v if v.sum() >= 0 else -v).tolist() for v in top], [float(values[-1 - d]) for d in range(len(top))]


def _largest_values(entries: DataFrame, block: str) -> DataFrame:
    """Largest eigenvalue of every block's table, each solved in the task that holds its row."""
    import numpy as np

    rows = entries.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("i", "j", "c"))).alias("t"))
    flat = rows.select(block, F.transform("t", lambda e: e["c"]).alias("t"))

    def solve(column: pd.Series) -> pd.Series:
        return column.map(lambda t: float(np.linalg.eigvalsh(np.reshape(t, (round(len(t) ** 0.5), -1))).max()))

    return flat.select(block, F.pandas_udf(solve, "double")("t").alias("scale"))


def statis_compromise(m: DataFrame, *, block: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table that blocks agree on most: (blocks, compromise, movement).

    Tables are centred, scaled to a largest eigenvalue of one and weighted by the leading direction of their RV table.
    ``blocks`` has each block's weight, its RV with the compromise and its distance from it; ``movement`` has for each variable how far
    its place in the first two directions of the compromise moves, summed over blocks.  Entries stay in Spark; the driver sees the
    RV of pairs of blocks and the compromise, blocks x blocks and variables x variables numbers."""
    spark = m.sparkSession
    kind = m.schema[block].dataType.simpleString()
    entries = cut_lineage(double_center(m, block=block), "centred")
    alike = {(r["b1"], r["b2"]): r["rv"] for r in rv_coefficient(entries, block=block).collect()}
    labels = sorted(r[0] for r in entries.select(block).distinct().collect())
    alike |= {(b, b): 1.0 for b in labels}
    direction = _first_directions(alike, labels, 1)[0][0]
    total = sum(direction)
    weights = F.broadcast(spark.createDataFrame([(b, v / total) for b, v in zip(labels, direction)], f"`{block}` {kind}, weight double"))
    scaled = entries.join(_largest_values(entries, block), block).select(block, "i", "j", (F.col("c") / F.col("scale")).alias("c")).join(weights, block)
    scaled = cut_lineage(scaled, "scaled")
    agreed = cut_lineage(scaled.groupBy("i", "j").agg(F.sum(F.col("weight") * F.col("c")).alias("compromise")), "compromise")
    both = scaled.join(agreed, ["i", "j"])
    product = lambda p, q: F.sum(F.col(p) * F.col(q))
    rv = product("c", "compromise") / F.sqrt(product("c", "c") * product("compromise", "compromise"))
    gap = F.col("c") - F.col("compromise")
    blocks = both.groupBy(block).agg(F.first("weight").alias("weight"), rv.alias("rv"), F.sqrt(F.sum(gap * gap)).alias("distance"))

    cells = {(r["i"], r["j"]): r["compromise"] for r in agreed.collect()}
    names = sorted({i for i, _ in cells})
    axes, values = _first_directions(cells, names, 2)
    # a table's places are its rows along the directions, each over the root of its value
    places = [(n, [axes[d][k] / math.sqrt(values[d]) for d in range(len(axes)) if values[d] > 1e-12]) for k, n in enumerate(names)]
    along = F.broadcast(spark.createDataFrame(places, "j string, w array<double>"))
    moved = both.withColumn("gap", gap).join(along, "j").select(block, "i", F.posexplode(F.transform("w", lambda w: w * F.col("gap"))).alias("d", "v"))
    steps = moved.groupBy(block, "i", "d").agg(F.sum("v").alias("v")).groupBy(block, "i").agg(F.sqrt(product("v", "v")).alias("step"))
    return blocks, agreed, steps.groupBy(F.col("i").alias("variable")).agg(F.sum("step").alias("movement"))


def composite_score(df: DataFrame, *, block: list[str], values: list[str], out: str = "composite") -> DataFrame:
    """Equal-weight mean of population z-scores inside the block."""
    m = df.groupBy(*block).agg(*[F.avg(v).alias(f"_m_{v}") for v in values], *[F.stddev_pop(v).alias(f"_s_{v}") for v in values])
    z = [ratio(F.col(v) - F.col(f"_m_{v}"), F.col(f"_s_{v}")) for v in values]
    return df.join(m, block).withColumns({**{f"z_{v}": c for v, c in zip(values, z)}, out: sum(z[1:], z[0]) / len(values)}).drop(*[f"_m_{v}" for v in values], *[f"_s_{v}" for v in values])


def first_component(df: DataFrame, *, values: list[str], sign_of: str, out: str = "pc1") -> DataFrame:
    """First principal component of standardised columns, signed like ``sign_of``."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=values, outputCol="_v").transform(df.dropna(subset=values))
    p = PCA(k=1, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn(out, vector_to_array("_p")[0])
    s = p.agg(F.signum(F.corr(out, sign_of))).scalar()
    return p.withColumn(out, F.col(out) * s).drop("_v", "_p")


def neighbour_gap(df: DataFrame, *, levels: list[str], weights: list[float], value: str) -> DataFrame:
    """Value minus the weighted mean of its relatives in a label hierarchy (levels from near to far).

    Relatives at a level are those that share that label but not the nearer one; their means come
    from group sums, so no n x n weight matrix is formed."""
    x = df
    for k, lv in enumerate(levels):
        g = df.groupBy(*levels[k:]).agg(F.sum(value).alias(f"_s{k}"), F.count(value).alias(f"_n{k}"))
        x = x.join(g, levels[k:])
    num, den = F.lit(0.0), F.lit(0.0)
    for k, w in enumerate(weights):
        s_in = F.col(value) if k == 0 else F.col(f"_s{k - 1}")
        n_in = F.lit(1) if k == 0 else F.col(f"_n{k - 1}")
        num = num + F.lit(w) * (F.col(f"_s{k}") - s_in)
        den = den + F.lit(w) * (F.col(f"_n{k}") - n_in)
    x = x.withColumn("neighbour_mean", ratio(num, den))
    return x.withColumn("gap", F.col(value) - F.col("neighbour_mean")).drop(*[f"_{p}{k}" for k in range(len(levels)) for p in "sn"])


def local_moran(df: DataFrame, *, levels: list[str], weights: list[float], value: str) -> DataFrame:
    """Local index z_i x (weighted mean of the relatives' z)."""
    m = df.agg(F.struct(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))).scalar()
    z = df.withColumn("_k", m).withColumn("z", (F.col(value) - F.col("_k.m")) / F.col("_k.s")).drop("_k")
    n = neighbour_gap(z, levels=levels, weights=weights, value="z")
    return n.withColumn("local_i", F.col("z") * F.col("neighbour_mean"))


def global_moran(local: DataFrame) -> DataFrame:
    return local.where("neighbour_mean IS NOT NULL").agg((F.sum("local_i") / F.sum(F.col("z") * F.col("z"))).alias("moran_i"), F.count(F.lit(1)).alias("n"))


def anova_r2(df: DataFrame, *, factor: str, value: str) -> DataFrame:
    """Between-group over total sum of squares from group sums."""
    g = df.groupBy(factor).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("ss"))
    t = g.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") ** 2 / F.col("n")).alias("b"), F.count(F.lit(1)).alias("n_groups"))
    c = F.col("s") ** 2 / F.col("n")
    return t.select(((F.col("b") - c) / (F.col("ss") - c)).alias("r2"), "n", "n_groups")

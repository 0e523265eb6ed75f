"""Null distributions and bootstraps from hashed draws.

Every draw is a function of (seed, replicate, id), so a retried task and any partitioning
give the same numbers.  Statistics are built from sufficient sums per replicate, and the
rank of a draw inside a block uses the uniform hash itself to cut the block into slices, so
a hot block is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import draw_int, draw_unit
from tidemark.functions.scalars import ratio
from tidemark.operators.ranks import row_positions
from tidemark.session import cut_lineage

HASH_BOUNDS = [i / 16 * 4294967296.0 for i in range(1, 16)]


def replicate(df: DataFrame, reps: int, out: str = "rep") -> DataFrame:
    """Copy each row once per replicate (a map-side explode of a constant range)."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def hashed_positions(df: DataFrame, *, block: list[str], ids: list[str], seed: int, rep: str = "rep", out: str = "pos") -> DataFrame:
    """1-based position by hash within (rep, block)."""
    x = df.withColumn("_h", draw_int(seed, F.col(rep), *[F.col(i) for i in ids]).cast("double"))
    tie = F.concat_ws("|", *[F.col(i).cast("string") for i in ids])
    x = x.withColumn("_tie", tie)
    return row_positions(x, [rep, *block], "_h", "_tie", out, bounds=HASH_BOUNDS).drop("_h", "_tie")


def within_block_permutation(df: DataFrame, *, block: list[str], ids: list[str], value: str, seed: int, reps: int, out: str = "permuted") -> DataFrame:
    """Permute ``value`` inside each block: rows in id order receive values in hash order."""
    x = replicate(cut_lineage(df.select(*block, *ids, value), "permute"), reps)
    give = hashed_positions(x, block=block, ids=ids, seed=seed, out="pos").select("rep", *block, "pos", F.col(value).alias(out))
    take = hashed_positions(x, block=block, ids=ids, seed=seed + 1, out="pos").select("rep", *block, *ids, "pos", value)
    return take.join(give, ["rep", *block, "pos"]).drop("pos")


def pooled_permutation(df: DataFrame, *, ids: list[str], value: str, seed: int, reps: int, out: str = "permuted") -> DataFrame:
    """Permute across all rows: one block, cut into hash slices."""
    return within_block_permutation(df, block=[], ids=ids, value=value, seed=seed, reps=reps, out=out)


def permutation_correlation(df: DataFrame, *, block: list[str], ids: list[str], x: str, y: str, seed: int, reps: int) -> DataFrame:
    """Observed correlation and its within-block permutation p (two-sided): five sums per replicate."""
    base = cut_lineage(df.select(*block, *ids, x, y), "pairs")
    obs = base.agg(F.corr(x, y)).scalar()
    perm = within_block_permutation(base, block=block, ids=ids, value=y, seed=seed, reps=reps).drop(y)
    null = perm.join(base.drop(y), [*block, *ids]).groupBy("rep").agg(F.corr(x, "permuted").alias("r"))
    n = null.withColumn("obs", obs)
    return n.agg(F.first("obs").alias("observed"), F.avg("r").alias("null_mean"), ((1 + F.sum((F.abs("r") >= F.abs("obs") - 1e-12).cast("long"))) / (1 + F.count("r"))).alias("p"))


def cyclic_shift_null(df: DataFrame, *, by: list[str], index: str, n: int, u: str, v: str, smin: int = 4) -> DataFrame:
    """Exact two-sided p of rho = 2 cov / (var + var) over all rotations s in [smin, n - smin].

    Only the cross product depends on the shift; it is an equi join on the rotated index of a
    calendar-bounded series."""
    s = F.explode(F.sequence(F.lit(smin), F.lit(n - smin)))
    a = df.select(*by, index, F.col(u).alias("_u"))
    b = df.select(*by, F.col(index).alias("_j"), F.col(v).alias("_v"))
    m = df.groupBy(*by).agg(F.covar_samp(u, v).alias("_c"), F.var_samp(u).alias("_vu"), F.var_samp(v).alias("_vv"), F.avg(u).alias("_mu"), F.avg(v).alias("_mv"))
    rot = b.withColumn("s", s).withColumn(index, F.pmod(F.col("_j") + F.col("s"), F.lit(n)))
    cross = rot.join(a, [*by, index]).groupBy(*by, "s").agg(F.sum(F.col("_u") * F.col("_v")).alias("_x"), F.count(F.lit(1)).alias("_n"))
    one = F.struct("_c", "_vu", "_vv", "_mu", "_mv")
    j = cross.join(m, by) if by else cross.withColumn("_m1", m.select(one).scalar()).select("*", "_m1.*")
    den = F.col("_vu") + F.col("_vv")
    null = 2 * (F.col("_x") - F.col("_n") * F.col("_mu") * F.col("_mv")) / (F.col("_n") - 1) / den
    j = j.withColumns({"_null": null, "obs": 2 * F.col("_c") / den})
    return j.groupBy(*by).agg(F.max("obs").alias("observed"), ((1 + F.sum((F.abs("_null") >= F.abs("obs") - 1e-12).cast("long"))) / (1 + F.count(F.lit(1)))).alias("p"), F.count(F.lit(1)).alias("n_shifts"))


def cluster_bootstrap(sums: DataFrame, *, unit: str, num: str, den: str, n_units: int, seed: int, reps: int, by: list[str] = [], level: float = 0.95) -> DataFrame:
    """Percentile interval of sum(num) / sum(den) when whole units are redrawn with replacement.

    ``sums`` holds one row per (unit, by).  A replicate redraws n_units slots: slot k takes the unit
    whose index is hash(seed, rep, k) mod n_units, so the draw table is joined once on the unit index."""
    from tidemark.operators.ranks import exact_quantiles

    spark = sums.sparkSession
    # index the units 0..n-1 in unit order without a single-task sort of the rows
    ix = row_positions(sums.select(unit).distinct(), [], unit, unit, "_i").select(unit, (F.col("_i") - 1).alias("_i"))
    slots = spark.range(n_units).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    draws = slots.select("rep", (draw_int(seed, F.col("rep"), F.col("id")) % n_units).alias("_i")).groupBy("rep", "_i").agg(F.count(F.lit(1)).alias("_w"))
    j = sums.join(ix, unit).join(draws, "_i")
    r = j.groupBy("rep", *by).agg(ratio(F.sum(F.col(num) * F.col("_w")), F.sum(F.col(den) * F.col("_w"))).alias("stat"))
    a = (1 - level) / 2
    q = exact_quantiles(r, by, "stat", [a, 0.5, 1 - a])
    at = lambda t: F.max(F.when(F.abs(F.col("tau") - t) < 1e-9, F.col("qv")))
    return q.groupBy(*by).agg(at(a).alias("lower"), at(0.5).alias("median"), at(1 - a).alias("upper"))


def row_bootstrap(df: DataFrame, *, block: list[str], ids: list[str], seed: int, reps: int) -> DataFrame:
    """Redraw rows with replacement inside each block: (rep, block, slot) -> row.

    Slots and rows are numbered per block in slices; slot k takes row hash mod n."""
    x = row_positions(df.withColumn("_k", draw_int(seed, *[F.col(i) for i in ids]).cast("double")).withColumn("_t", F.concat_ws("|", *[F.col(i).cast("string") for i in ids])), block, "_k", "_t", "_p", bounds=HASH_BOUNDS).drop("_k", "_t")
    slots = replicate(x.select(*block, "_p", "n__p"), reps)
    pick = slots.withColumn("_w", draw_int(seed + 1, F.col("rep"), *[F.col(b) for b in block], F.col("_p")) % F.col("n__p") + 1).select("rep", *block, F.col("_p").alias("slot"), F.col("_w").alias("_p"))
    return pick.join(x.drop("n__p"), [*block, "_p"]).drop("_p")


def block_bootstrap(index: DataFrame, *, n: int, length: int, seed: int, reps: int, position: str = "pos") -> DataFrame:
    """Fixed-length blocks: block b of a replicate starts at hash mod (n - length + 1).

    Returns (rep, slot, position) with n slots per replicate."""
    import math

    k = math.ceil(n / length)
    spark = index.sparkSession
    b = spark.range(k).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    b = b.withColumn("_s", draw_int(seed, F.col("rep"), F.col("id")) % (n - length + 1))
    e = b.select("rep", (F.col("id") * length).alias("_b"), "_s", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("_o"))
    slot = e.select("rep", (F.col("_b") + F.col("_o")).alias("slot"), (F.col("_s") + F.col("_o")).alias(position)).where(F.col("slot") < n)
    return slot.join(index, position)


def geometric_block_bootstrap(index: DataFrame, *, n: int, mean_length: int, seed: int, reps: int, position: str = "pos") -> DataFrame:
    """Stationary bootstrap: a slot starts a new block with probability 1 / mean_length, else it
    continues the previous block (wrapping at the end)."""
    spark = index.sparkSession
    s = spark.range(n).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    new = (F.col("id") == 0) | (draw_unit(seed, F.col("rep"), F.col("id")) < 1.0 / mean_length)
    s = s.withColumn("_start", F.when(new, F.struct(F.col("id").alias("at"), (draw_int(seed + 1, F.col("rep"), F.col("id")) % n).alias("from"))))
    w = Window.partitionBy("rep").orderBy("id")
    s = s.withColumn("_b", F.last("_start", True).over(w))
    out = s.select("rep", F.col("id").alias("slot"), ((F.col("_b.from") + F.col("id") - F.col("_b.at")) % n).alias(position))
    return out.join(index, position)


def sign_flip_null(df: DataFrame, *, value: str, seed: int, reps: int, period="period", part="part") -> DataFrame:
    """Flip the sign of each period's whole increment and re-cumulate from the first point."""
    w = Window.partitionBy(part).orderBy(period)
    x = df.withColumns({"_d": F.col(value) - F.lag(value).over(w), "_v0": F.first(value).over(w)})
    r = replicate(x, reps).withColumn("_s", F.when(draw_int(seed, F.col("rep"), F.col(period)) % 2 == 0, 1.0).otherwise(-1.0))
    run = Window.partitionBy("rep", part).orderBy(period)
    return r.select("rep", period, part, (F.col("_v0") + F.sum(F.coalesce(F.col("_d") * F.col("_s"), F.lit(0.0))).over(run)).alias("flipped"))


def split_half(df: DataFrame, *, block: list[str], ids: list[str], seed: int, out: str = "half") -> DataFrame:
    """First floor(n / 2) rows by hash against the rest, per block."""
    p = hashed_positions(df.withColumn("rep", F.lit(0)), block=block, ids=ids, seed=seed, out="_p")
    return p.withColumn(out, (F.col("_p") > F.floor(F.col("n__p") / 2)).cast("int")).drop("rep", "_p", "n__p")


def day_split(date: Column) -> Column:
    """0 for Monday, Wednesday, Friday; 1 for Tuesday and Thursday."""
    return F.weekday(date) % 2


def exact_relabel(pairs: DataFrame, *, k: int, m: int, i: str = "i", j: str = "j", value: str = "v", observed: int) -> DataFrame:
    """Within-minus-between mean of a similarity over all C(k, m) assignments of k periods to two eras.

    Assignments are bit masks of a k-bit counter (k is a number of calendar years); the similarity
    table has k (k - 1) / 2 rows and rides along as one packed array."""
    spark = pairs.sparkSession
    arr = pairs.agg(F.collect_list(F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(value).alias("v")))).scalar()
    mask = spark.range(1 << k).where(F.bit_count("id") == m).withColumn("_a", arr)
    bit = lambda p: F.col("id").bitwiseAND(F.shiftleft(F.lit(1).cast("long"), p)) if isinstance(p, int) else F.expr("0")
    e = mask.select("id", F.explode("_a").alias("e"))
    side = lambda c: F.getbit(F.col("id"), c.cast("int"))
    same = side(F.col("e.i")) == side(F.col("e.j"))
    d = e.groupBy("id").agg((F.avg(F.when(same, F.col("e.v"))) - F.avg(F.when(~same, F.col("e.v")))).alias("stat"))
    o = d.where(F.col("id") == observed).select("stat").scalar()
    return d.withColumn("_o", o).agg(F.max("_o").alias("observed"), F.avg((F.col("stat") >= F.col("_o") - 1e-12).cast("double")).alias("p"), F.count(F.lit(1)).alias("n_assignments"), F.sum((F.col("stat") > F.col("_o") + 1e-12).cast("long")).alias("n_better"))


def kfold(ids: list[str], k: int, seed: int) -> Column:
    """Fold 0..k-1 by hash."""
    return (draw_int(seed, *[F.col(i) for i in ids]) % k).cast("int")


def leave_one_out_fits(df: DataFrame, *, held: str, x: str, y: str) -> DataFrame:
    """Slope and intercept without each held-out group: totals minus the group's own sums."""
    s = df.groupBy(held).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    t = s.agg(F.struct(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])).scalar()
    z = s.withColumn("_t", t)
    d = {c: F.col(f"_t.{c}") - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")}
    b = ratio(d["n"] * d["sxy"] - d["sx"] * d["sy"], d["n"] * d["sxx"] - d["sx"] * d["sx"])
    return z.select(held, b.alias("slope"), ((d["sy"] - b * d["sx"]) / d["n"]).alias("intercept"), d["n"].cast("long").alias("n_train"))


def random_set_null(df: DataFrame, *, unit: str, value: str, size: int, observed: float | Column, seed: int, reps: int) -> DataFrame:
    """Mean of a matched-size random set of units against an observed group mean."""
    r = hashed_positions(replicate(df.select(unit, value), reps), block=[], ids=[unit], seed=seed, out="_p").where(F.col("_p") <= size)
    m = r.groupBy("rep").agg(F.avg(value).alias("stat")).withColumn("_o", observed if isinstance(observed, Column) else F.lit(float(observed)))
    return m.agg(F.max("_o").alias("observed"), F.avg("stat").alias("null_mean"), ((1 + F.sum((F.col("stat") >= F.col("_o") - 1e-12).cast("long"))) / (1 + F.count("stat"))).alias("p"))

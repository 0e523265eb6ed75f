"""A ladder of baseline models with intervals: one table of predictions, one joint bootstrap of its entities.

Every rung writes its score of each validation row into the same table.  A bootstrap replicate gives an entity
a Poisson(1) weight that depends on (seed, replicate, entity) alone, so all rungs see the same draw, differences between them are
paired, and no draw table is joined.  Replicate 0 has weight one everywhere: the point estimate.

A weighted AUC needs the negatives below each positive.  Scores are cut into slices per rung; a task turns the rows of a slice
into one number per replicate (positives, negatives, ordered pairs inside), all replicates at once; slices then
meet as running sums over at most slices x replicates rows, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.pairs import value_slices
from tidemark.session import cut_lineage

#: Cumulative Poisson(1) probabilities.
_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800)])
#: Parts over which rows of one tied score, or of one rung's errors, are spread.
PARTS = 16


def poisson_weights(entity: np.ndarray, seed: int, reps: int) -> np.ndarray:
    """Weights (entities x replicates) from 64-bit hashes of the entities; column 0 is one."""
    with np.errstate(over="ignore"):
        z = entity.astype(np.int64).view(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * (np.arange(reps, dtype=np.uint64) + np.uint64((seed * 1_000_003) % (1 << 63)))[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)
    w = np.searchsorted(_POISSON, u, side="right").astype(float)
    w[:, 0] = 1.0
    return w


def _prepared(task: DataFrame, label: str, split: str, keep: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    s = [c for c in task.columns if c.startswith("s_")]
    r = [c for c in task.columns if c.startswith("r_")]
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    t = task.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), F.col(split).alias("split"), *keep, *[finite(c).alias(c) for c in s + r])
    return t, s, r


def ladder_predictions(task: DataFrame, *, kind: str, entity: str, naive: Column, row_id: str = "row_id", label: str = "label", split: str = "split", last: Column | None = None, iters: int = 20, seed: int = 5) -> DataFrame:
    """(row_id, entity, model, label, score) of every validation row under every rung, stored.

    ``kind`` is ``clf`` (score orders rows by risk) or ``reg`` (score is the forecast).  Rungs: ``naive``, an expression of the task's own
    columns; ``last`` likewise for ``reg``, with the training median beside it; linear and boosted models on the own (s_) and on
    all (s_ and r_) features.  Medians that fill gaps, scales and models come from training rows only."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    flagged = task.withColumn("_naive", naive.cast("double"))
    if last is not None:
        flagged = flagged.withColumn("_last", last.cast("double"))
    extra = ["_naive"] + (["_last"] if last is not None else [])
    t, s, r = _prepared(flagged.withColumn("_id", F.col(row_id).cast("string")).withColumn("_entity", F.col(entity).cast("string")), label, split, ["_id", "_entity", *extra])
    t = cut_lineage(t, "ladder")
    train, val = t.where("split = 'train'"), t.where("split = 'val'")
    of = lambda df, name, score: df.select(F.col("_id").alias("row_id"), F.col("_entity").alias("entity"), F.lit(name).alias("model"), "label", score.cast("double").alias("score"))
    zero = F.lit(0.0)
    out = of(val, "naive", F.coalesce("_naive", zero))
    if kind == "reg":
        middle = train.agg(F.percentile("label", F.lit(0.5))).first()[0]
        out = out.unionByName(of(val, "train_median", F.lit(middle)))
        if last is not None:
            out = out.unionByName(of(val, "naive_last", F.coalesce("_last", zero)))
    for name, cols, boosted in (("linear_own", s, False), ("linear_relational", s + r, False), ("boosted_own", s, True), ("boosted_relational", s + r, True)):
        # a column without any training value carries nothing
        seen = train.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
        cols = [c for c in cols if seen[c]]
        prep = [Imputer(inputCols=cols, outputCols=[f"i_{c}" for c in cols], strategy="median"), VectorAssembler(inputCols=[f"i_{c}" for c in cols], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
        if kind == "clf":
            model = GBTClassifier(maxIter=iters, stepSize=0.1, seed=seed) if boosted else LogisticRegression(elasticNetParam=0.0, regParam=0.01)
            score = vector_to_array("probability")[1]
        else:
            model = GBTRegressor(maxIter=iters, stepSize=0.1, lossType="absolute", seed=seed) if boosted else LinearRegression(elasticNetParam=0.0, regParam=0.01)
            score = F.col("prediction")
        out = out.unionByName(of(Pipeline(stages=[*prep, model]).fit(train).transform(val), name, score))
    return cut_lineage(out, "predictions")


def _replicates(partials: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Arrays over replicates, added up: (keys, rep, sums)."""
    zipped = F.arrays_zip(*[F.col(c) for c in sums])
    return partials.select(*keys, F.posexplode(zipped).alias("rep", "z")).select(*keys, "rep", "z.*").groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in sums])


def auc_replicates(preds: DataFrame, *, reps: int, seed: int = 11) -> DataFrame:
    """(model, rep, value): AUC of each rung under each replicate's weights, ties at one half.  Labels are 0 and 1."""
    rows = preds.where("label IS NOT NULL AND score IS NOT NULL").groupBy("model", "score", F.xxhash64("entity").alias("e")).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    rows = cut_lineage(rows, "scores")
    sizes = {r["model"]: r["k"] for r in rows.groupBy("model").agg(F.count(F.lit(1)).alias("k")).collect()}
    sliced = None
    for m, k in sorted(sizes.items()):
        one = rows.where(F.col("model") == m)
        one = one.withColumn("s", value_slices(one, "score", k))
        sliced = one if sliced is None else sliced.unionByName(one)
    if sliced is None:
        return preds.sparkSession.createDataFrame([], "model string, rep int, value double")
    # an odd slice holds one score: only its sums matter, so it is spread
    sliced = sliced.withColumn("part", F.when(F.col("s") % 2 == 1, F.pmod("e", F.lit(PARTS))).otherwise(F.lit(0)).cast("int"))

    def one_slice(g: pd.DataFrame) -> pd.DataFrame:
        w = poisson_weights(g["e"].to_numpy(), seed, reps)
        code = np.unique(g["score"].to_numpy(), return_inverse=True)[1]
        k = code.max() + 1
        pos, neg = np.zeros((k, reps)), np.zeros((k, reps))
        np.add.at(pos, code, w * g["p"].to_numpy(float)[:, None])
        np.add.at(neg, code, w * g["n"].to_numpy(float)[:, None])
        inside = (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0) if g["s"].iloc[0] % 2 == 0 else np.zeros(reps)
        return pd.DataFrame({"model": [g["model"].iloc[0]], "s": [int(g["s"].iloc[0])], "p": [pos.sum(axis=0)], "n": [neg.sum(axis=0)], "c": [inside]})

    parts = sliced.groupBy("model", "s", "part").applyInPandas(one_slice, "model string, s int, p array<double>, n array<double>, c array<double>")
    per = _replicates(parts, ["model", "s"], ["p", "n", "c"])
    below = Window.partitionBy("model", "rep").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    c = F.col("c") + F.when(F.col("s") % 2 == 1, F.col("p") * F.col("n") / 2).otherwise(0.0) + F.col("p") * F.coalesce(F.sum("n").over(below), F.lit(0.0))
    per = per.select("model", "rep", "p", "n", c.alias("c"))
    return per.groupBy("model", "rep").agg(F.try_divide(F.sum("c"), F.sum("p") * F.sum("n")).alias("value"))


def mae_replicates(preds: DataFrame, *, reps: int, seed: int = 11) -> DataFrame:
    """(model, rep, value): mean absolute error of each rung under each replicate's weights."""
    rows = preds.where("label IS NOT NULL AND score IS NOT NULL").groupBy("model", F.xxhash64("entity").alias("e")).agg(F.sum(F.abs(F.col("label") - F.col("score"))).alias("a"), F.count(F.lit(1)).cast("double").alias("n"))

    def weighted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for model, g in f.groupby("model"):
                a, n = np.zeros(reps), np.zeros(reps)
                for lo in range(0, len(g), 4096):
                    w = poisson_weights(g["e"].to_numpy()[lo : lo + 4096], seed, reps)
                    a += g["a"].to_numpy()[lo : lo + 4096] @ w
                    n += g["n"].to_numpy()[lo : lo + 4096] @ w
                yield pd.DataFrame({"model": [model], "a": [a], "n": [n]})

    per = _replicates(rows.mapInPandas(weighted, "model string, a array<double>, n array<double>"), ["model"], ["a", "n"])
    return per.select("model", "rep", F.try_divide("a", "n").alias("value"))


def ladder_scores(preds: DataFrame, *, kind: str, pairs: list[tuple[str, str]], reps: int = 200, seed: int = 11, level: float = 0.95) -> DataFrame:
    """(model, value, lower, upper): each rung's score and each pair's difference with percentile intervals of the joint bootstrap."""
    r = cut_lineage((auc_replicates if kind == "clf" else mae_replicates)(preds, reps=reps + 1, seed=seed), "replicates")
    a, b = r.select(F.col("model").alias("a"), "rep", F.col("value").alias("va")), r.select(F.col("model").alias("b"), "rep", F.col("value").alias("vb"))
    wanted = preds.sparkSession.createDataFrame(pairs, "a string, b string") if pairs else None
    if wanted is not None:
        d = a.join(F.broadcast(wanted), "a").join(b, ["b", "rep"])
        r = r.unionByName(d.select(F.concat_ws(" - ", "a", "b").alias("model"), "rep", (F.col("va") - F.col("vb")).alias("value")))
    q = lambda p: F.percentile(F.when(F.col("rep") > 0, F.col("value")), F.lit(p))  # noqa: E731  # at most ``reps`` numbers
    tail = (1 - level) / 2
    return r.groupBy("model").agg(F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("value"), q(tail).alias("lower"), q(1 - tail).alias("upper"))

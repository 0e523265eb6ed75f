"""Forest search: recall and exactness against brute force, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_and_scores(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0).toPandas()
    rows = df.orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -s[others]))][:20]
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21))
        assert np.abs(mine.score - s[np.searchsorted(ids, mine.vec_id)]).max() < 1e-12
        hits += len(set(ids[best]) & set(mine.vec_id))
        total += 20
    assert hits / total >= (0.95 if sf == "sf0.1" else 1.0)


def test_only_candidates_are_multiplied():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8192, 64))
    seen = ann.Forest(x).candidates(x[:40], max(ann.LEAST, int(ann.SHARE * len(x))))
    assert seen.sum(axis=1).min() >= ann.SHARE * len(x) and seen.sum(axis=1).mean() < 0.4 * len(x)


def test_ties_nulls_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20 * k, [1.0, 0.0], 0) for k in range(30)] + [(1, None, 0), (2, [0.0, 0.0], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [1.0, None], 0), (6, [], 0), (7, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (0, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0).collect()
    mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 40)
    assert mine == [(k + 1, v) for k, v in enumerate([20 * j for j in range(22) if j != 2][:20])]
    assert len(got) == 600
    assert ann.neighbours(df.filter("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0

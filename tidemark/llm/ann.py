"""Approximate nearest neighbours with a forest of hash prefixes.

A tree gives every vector a long hash string: the vector is turned by a random rotation, and the symbols
are the axes it leans to most, with their signs, strongest first.  A tree is the sorted array of its strings, so
the vectors that share a prefix are a range of it.  A query descends every tree to its longest prefix;
then all trees ascend together, one symbol at a time, and every level adds the ranges of the
shorter prefix, until the query has seen ``share`` of the vectors, at least ``LEAST`` (a shard of fewer is searched whole).
Only candidates are multiplied with the query, and ranked by their exact inner product.

Rows are spread over shards of bounded size by a hash of their id.  A shard keeps a forest of its own and
is searched for its share, so equal and near-equal vectors spread evenly; queries visit all shards in
blocks, and the best k of each are merged.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows without an
id take no part; only vectors of equal length meet; rows that repeat an id count once (the smallest vector);
equal products go to the smaller id; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES, SYMBOLS, SHARE, K = 56, 3, 0.15, 20
#: Candidates of a query in a shard at least.
LEAST = 1024
#: Floats of one shard or block of queries.
SHARD_FLOATS = 1 << 19


def valid(vector: str) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(tree: int, dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, tree, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def hash_strings(x: np.ndarray, turn: np.ndarray, symbols: int) -> np.ndarray:
    """Strings as integers: the first symbol is the most significant digit, in base 2 * dim."""
    y = x @ turn
    size, base = np.abs(y), 2 * x.shape[1]
    out, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(symbols):
        axis = size.argmax(axis=1)
        out = out * base + 2 * axis + (y[rows, axis] > 0)
        size[rows, axis] = -1
    return out


class Forest:
    """Sorted arrays of hash strings, one per tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES, symbols: int = SYMBOLS, seed: int = 7):
        dim = x.shape[1]
        self.x, self.n = x, len(x)
        self.symbols = max(1, min(symbols, dim, int(60 / np.log2(2 * dim))))
        self.base = 2 * dim
        self.turns = [rotation(t, dim, seed) for t in range(trees)]
        self.order, self.keys = [], []
        for turn in self.turns:
            key = hash_strings(x, turn, self.symbols)
            order = np.argsort(key, kind="stable")
            self.order.append(order)
            self.keys.append(key[order])

    def candidates(self, queries: np.ndarray, wanted: int) -> np.ndarray:
        """For each query a mask over the vectors."""
        seen = np.zeros((len(queries), self.n), bool)
        strings = [hash_strings(queries, turn, self.symbols) for turn in self.turns]
        open_ = np.arange(len(queries))
        for level in range(self.symbols, 0, -1):
            width = self.base ** (self.symbols - level)
            for order, keys, s in zip(self.order, self.keys, strings):
                low = s[open_] // width * width
                a, b = np.searchsorted(keys, low), np.searchsorted(keys, low + width)
                ends = np.cumsum(b - a)
                place = np.repeat(b - ends, b - a) + np.arange(ends[-1])
                seen[np.repeat(open_, b - a), order[place]] = True
            open_ = open_[seen[open_].sum(axis=1) < wanted]
            if not len(open_):
                return seen
        seen[open_] = True  # the root of every tree
        return seen


def search(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, share: float, trees: int, symbols: int):
    """(position of the query, id, score) of each query's best k in this shard.  ``ids`` ascend."""
    forest = Forest(x, trees, symbols)
    wanted = min(len(x), max(k + 1, LEAST, int(np.ceil(share * len(x)))))
    at, found, scores = [], [], []
    step = max(1, (1 << 21) // len(x))
    for first in range(0, len(queries), step):
        q = queries[first : first + step]
        seen = forest.candidates(q, wanted) & (ids[None, :] != query_ids[first : first + step, None])
        for i in range(len(q)):
            c = np.flatnonzero(seen[i])
            near = x[c]
            rough = near @ q[i]
            if len(c) > k:
                # products of equal vectors may differ in the last bit of a matrix product: take near ties, then rank exactly
                least = np.partition(rough, -k)[-k]
                keep = rough >= least - 1e-9 * max(1.0, abs(least))
                c, near = c[keep], near[keep]
            exact = (near * q[i]).sum(axis=1)
            best = np.lexsort((ids[c], -exact))[:k]
            at.append(np.full(len(best), first + i))
            found.append(ids[c[best]])
            scores.append(exact[best])
    return np.concatenate(at), np.concatenate(found), np.concatenate(scores)


def neighbours(
    vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE, trees: int = TREES, symbols: int = SYMBOLS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query row among all others."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & valid("v")).withColumn("dim", F.size("v"))
    stats = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("nq"))
    per = F.greatest(F.lit(64), F.floor(F.lit(SHARD_FLOATS) / F.col("dim")))
    stats = stats.select("dim", F.ceil(F.col("n") / per).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("nq") / per)).cast("int").alias("blocks"))
    rows = rows.join(stats, "dim")
    mine = F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")
    block = F.pmod(F.xxhash64(F.lit(1), F.col("id")), F.col("blocks")).cast("int")
    data = rows.select("dim", mine.alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v")
    asks = rows.filter("q").groupBy("id", "dim").agg(F.min("v").alias("v"), F.first("shards").alias("shards"), F.first("blocks").alias("blocks"))
    asks = asks.select(F.col("dim").alias("qdim"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("qshard"), block.alias("qblock"), F.col("id").alias("qid"), F.col("v").alias("qv"))

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column(3).to_numpy()
        flat = pa.concat_arrays([c.flatten() for c in t.column(4).chunks]).to_numpy()
        x = flat.reshape(len(ids), -1)
        order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
        ids, x = ids[order], x[order]
        first = np.append(True, ids[1:] != ids[:-1])
        return ids[first], np.ascontiguousarray(x[first])

    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        if not queries.num_rows or not shard.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        qids, q = arrays(queries)
        ids, x = arrays(shard)
        at, found, score = search(q, qids, x, ids, k, share, trees, symbols)
        return pa.table({"query_id": qids[at], "vec_id": found, "score": score})

    best = asks.groupBy("qdim", "qshard", "qblock").cogroup(data.groupBy("dim", "shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

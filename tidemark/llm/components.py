"""Connected components of a table of links, by alternating large-star and small-star steps.

Links are first contracted inside each task (a union-find over the task's rows leaves a spanning forest
of at most one link per vertex), then the steps run over shuffles until nothing changes.  The driver sees
one number per round.  Every round is written to the shared folder.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links of a task: every vertex that is not its smallest one, with that one."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    keys = list(parent)
    for k in range(0, len(keys), 1 << 16):
        some = keys[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(list(map(root, some)), pa.int64())], ["a", "b"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component): the smallest vertex that each linked vertex reaches.  Vertices are longs."""
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").mapInArrow(forest, "a long, b long")
    edges = written(edges.filter("a <> b").repartition("b"), "forest")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    before = None
    while True:
        # large star: every larger neighbour is tied to the smallest neighbour or the vertex itself
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the vertex and its smaller neighbours are tied to the smallest of them
        low = large.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        met = large.join(low, F.col("a") == F.col("v"))
        small = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges = written(small, "stars")
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))

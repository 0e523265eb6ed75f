"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits are grouped into partitions so that correlated bits sit together.  If thresholds t_1..t_m of a
fingerprint sum to distance - m + 1, every fingerprint within the distance agrees with it in some
partition up to t_i bits; -1 means that a partition is not probed at all.  A dynamic program gives each
fingerprint its own thresholds: it avoids partitions whose value is frequent and probes rare ones further.
Probes meet the index in buckets by key, and pairs are verified by their differing bits; a bucket gives at
most one link for each of its members, enough to tie what its pairs tie.

A bucket that is crowded is cut again: its fingerprints agree in the bits of the key, so the remaining
bits are split into distance + 1 parts of which one must agree; keys grow until buckets are small.  No
link is lost and no bucket is expanded into pairs.  Equal fingerprints are one vertex, so copies never meet
each other.

Edge cases: null, empty and blank texts have no words and fingerprint zero, which is linked like any
other; texts of fewer words than a shingle hash as one sequence; repeated rows and ids are kept; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written
from .components import components, forest

BITS = 64
#: A bucket with more fingerprints than this is cut by further bits.
CROWD = 4096
#: So is one with so many times more that ask for it.
ASKS = 32


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles of a text; fewer words than a shingle hash as one sequence, no words as none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < shingle:
        return np.array([digest(line, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1).tolist()
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text: the majority of each bit over the XXH64 of its word shingles."""
    return majority(shingle_hashes(text, shingle, seed))


def majority(hashes: np.ndarray) -> int:
    count = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per document; ``fp`` is the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for t in batch.column(1):
                b = t.as_buffer()
                fps.append(fingerprint(b.to_pybytes() if b is not None else b"", shingle, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return small_batches(docs).select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(make, schema)


def bit_groups(fps: DataFrame, m: int = 3) -> list[list[int]]:
    """Bits in ``m`` groups of nearly equal size; a group starts at a free bit and takes the free bits that
    are most correlated with it.  Moments are summed in the tasks: the driver sees 64 x 64 numbers."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            v = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            x = np.ones((len(v), BITS + 1))
            x[:, :BITS] = (v[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["k", "x"])

    rows = fps.select("fp").mapInArrow(moments, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    s = np.zeros((BITS + 1) ** 2)
    for r in rows:
        s[r.k] = r.x
    s = s.reshape(BITS + 1, BITS + 1)
    n = max(s[BITS, BITS], 1.0)
    mean = s[BITS, :BITS] / n
    cov = s[:BITS, :BITS] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov) / np.outer(sd, sd)
    free, groups = set(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        group = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        free.discard(group[0])
        while len(group) < size:
            b = max(free, key=lambda b: (corr[b, group].mean(), -b))
            group.append(b)
            free.discard(b)
        groups.append(sorted(group))
    return groups


def mask(bits: list[int]) -> int:
    """The bits as a signed long."""
    v = sum(1 << b for b in bits)
    return v - (1 << 64) if v >> 63 else v


def allocate(counts: np.ndarray, widths: list[int], total: int, distance: int) -> np.ndarray:
    """Thresholds of fingerprints (rows) in partitions (columns), by dynamic programming on estimated candidates.

    ``counts``: how many fingerprints share a row's value in each partition.  A partition at -1 costs nothing;
    at t it costs its own bucket, one probe for every value within t bits, and an average bucket for each
    flipped value.  The thresholds of a row sum to distance - partitions + 1 at the least total cost."""
    n, m = counts.shape
    goal, levels = distance - m + 1, range(-1, distance + 1)

    def cost(i: int, t: int) -> np.ndarray:
        if t < 0:
            return np.zeros(n)
        probes = sum(math.comb(widths[i], k) for k in range(t + 1))
        return counts[:, i] + probes + (probes - 1) * total / 2.0 ** widths[i]

    costs = [{t: cost(i, t) for t in levels} for i in range(m)]
    best, picks = {0: np.zeros(n)}, []
    for i in range(m):
        after = m - i - 1
        grown: dict[int, np.ndarray] = {}
        pick: dict[int, np.ndarray] = {}
        for at, so_far in best.items():
            for t in levels:
                to = at + t
                if not to - after <= goal <= to + after * distance:
                    continue
                c = so_far + costs[i][t]
                if to not in grown:
                    grown[to], pick[to] = c, np.full(n, t)
                else:
                    better = c < grown[to]
                    pick[to] = np.where(better, t, pick[to])
                    grown[to] = np.minimum(c, grown[to])
        best = grown
        picks.append(pick)
    out, at = np.empty((n, m), np.int64), np.full(n, goal)
    for i in range(m - 1, -1, -1):
        for to, pick in picks[i].items():
            here = at == to
            out[here, i] = pick[here]
        at = at - out[:, i]
    return out


def flips(bits: list[int], most: int) -> np.ndarray:
    """All masks of at most ``most`` of the bits, by number of bits: row t holds where the masks of t + 1 bits begin."""
    masks = [0]
    for k in range(1, most + 1):
        masks += [sum(1 << b for b in c) for c in itertools.combinations(bits, k)]
    return np.array(masks, np.uint64)


def probe_rows(planned: DataFrame, groups: list[list[int]], total: int, distance: int) -> DataFrame:
    """(fp, path, key): each fingerprint with every value that it probes in each partition (path)."""
    m, widths = len(groups), [len(g) for g in groups]
    masks = np.array([sum(1 << b for b in g) for g in groups], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            counts = np.column_stack([np.asarray(c) for c in batch.columns[1:]]).astype(float)
            t = allocate(counts, widths, total, distance)
            for i in range(m):
                for level in range(int(t[:, i].max(initial=-1)) + 1):
                    mine = fps[t[:, i] == level]
                    change = flips(groups[i], level)
                    step = max(1, (1 << 19) // len(change))
                    for k in range(0, len(mine), step):
                        some = mine[k : k + step]
                        keys = (some & masks[i])[:, None] ^ change[None, :]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(some, len(change)).view(np.int64)), pa.array(np.full(keys.size, i, np.int32)), pa.array(keys.ravel().view(np.int64))], ["fp", "path", "key"]
                        )

    return planned.mapInArrow(run, "fp long, path int, key long")


def linked(x: np.ndarray, y: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie together what pairs within ``distance`` tie together, at most one for each of ``x`` and ``y``.

    The table of pairs is walked in blocks of rows, again until no label changes."""
    top = len(y)
    label, step = np.arange(top), max(1, (1 << 21) // max(top, 1))
    of_x = np.full(len(x), top)
    while True:
        fresh = label.copy()
        for k in range(0, len(x), step):
            near = np.bitwise_count(x[k : k + step, None] ^ y[None, :]) <= distance
            mine = np.where(near, fresh[None, :], top).min(axis=1, initial=top)
            of_x[k : k + step] = mine
            np.minimum(fresh, np.where(near, mine[:, None], top).min(axis=0, initial=top), out=fresh)
        if (fresh == label).all():
            break
        label = fresh
    has = of_x < top
    a, b = np.concatenate([x[has], y]), np.concatenate([y[of_x[has]], y[label]])
    return a[a != b], b[a != b]


def bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    """(a, b): links of buckets; each row holds the fingerprints that ask and those that are there.

    A task gives a spanning forest of all that its buckets tie, at most one link for each fingerprint it holds."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asks, there in zip(batch.column(0), batch.column(1)):
                x, y = (np.unique(np.asarray(v.values).astype(np.int64)).view(np.uint64) for v in (asks, there))
                a, b = linked(x, y, distance)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return rows.select("asks", "there").mapInArrow(lambda batches: forest(links(batches)), "a long, b long")


def near_links(fps: DataFrame, distance: int = 2, m: int | None = None, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): every pair that differs in at most ``distance``
    bits is tied, directly or over other links, and no link ties what such pairs do not."""
    m = m or max(3, (distance + 1) // 2)
    groups = bit_groups(fps, m)
    total = fps.count()
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(mask(g))) for g in groups])).alias("path", "key"))
    count = keyed.groupBy("path", "key").agg(F.count("*").alias("n"))
    # every fingerprint with the size of its bucket in each partition
    per = keyed.join(count, ["path", "key"]).groupBy("fp").agg(*[F.max(F.when(F.col("path") == i, F.col("n"))).alias(f"n{i}") for i in range(m)])
    asks, index = written(probe_rows(per, groups, total, distance), "probes"), keyed.select("fp", "path", "key")
    order, paths, found = [b for g in groups for b in g], {i: set(g) for i, g in enumerate(groups)}, []
    while True:
        both = asks.withColumn("ask", F.lit(True)).unionByName(index.withColumn("ask", F.lit(False)))
        size = both.groupBy("path", "key").agg(F.count(F.when(~F.col("ask"), 1)).alias("there"), F.count(F.when(F.col("ask"), 1)).alias("asks"))
        # what is left of a path with fewer free bits than parts holds few values and is met as it is
        free = [k for k, fixed in paths.items() if BITS - len(fixed) > distance]
        many = (F.col("there") > crowd) | ((F.col("there") > 0) & (F.col("asks") > ASKS * crowd))
        hot = written(size.filter(many & F.col("path").isin(free)).select("path", "key"), "crowded")
        met = both.join(hot, ["path", "key"], "left_anti").groupBy("path", "key")
        buckets = met.agg(F.collect_list(F.when(F.col("ask"), F.col("fp"))).alias("asks"), F.collect_list(F.when(~F.col("ask"), F.col("fp"))).alias("there"))
        # a fingerprint alone in its bucket asks itself only
        buckets = buckets.filter((F.size("there") > 0) & (F.size("asks") > 0) & (F.size(F.array_union("asks", "there")) > 1))
        found.append(written(bucket_links(buckets, distance), "links"))
        if hot.isEmpty():
            break
        # One row per way of cutting: it depends on the bits that are used up, never on the data.
        cuts, deeper = [], {}
        for path, fixed in paths.items():
            rest = [b for b in order if b not in fixed]
            for j in range(distance + 1):
                part = rest[j :: distance + 1]
                deeper[len(deeper)] = fixed | set(part)
                cuts.append((path, len(deeper) - 1, mask(part)))
        cuts, paths = fps.sparkSession.createDataFrame(cuts, "path int, next int, part long"), deeper

        def cut(rows: DataFrame, hot=hot, cuts=cuts) -> DataFrame:
            rows = rows.join(hot, ["path", "key"], "left_semi").join(F.broadcast(cuts), "path")
            key = F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("part")))
            return rows.select("fp", F.col("next").alias("path"), key.alias("key"))

        asks, index = written(cut(asks), "probes"), written(cut(index), "index")
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): one row per document; ``component_id`` is the smallest id that its
    fingerprint reaches over links, its own included."""
    rows = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    parts = components(near_links(fps, distance))
    joined = fps.join(parts, fps["fp"] == parts["vertex"], "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    of = joined.join(smallest, "component").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

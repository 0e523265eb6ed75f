"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns.

A document may belong to several sources.  Documents are aggregated by the set of their sources (the
pattern); a flow network routes each pattern's words to the quotas of its sources.  The arc from the
origin to a pattern has one layer per repetition, and layer k costs k a word, so a document is repeated
only when no fresh words can be routed.  The network has a node per pattern and source, never per
document.  Documents are then drawn in seeded hash order: every pattern is cut at the word positions of
its flows, and a cut becomes a hash threshold that each document compares itself with, so no document is
shuffled for the draw and reruns agree.

Edge cases: a null or empty membership is the pattern of the null source; null text has size 0 and takes
0 words; rows that agree in id and text share one draw and stand or fall together; an empty table gives
an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

WEIGHTS = (3, 1, 2)
BUCKET_BITS = 12
RESULT = ("source_size", "target", "routes", "copies", "taken")


def water_fill(sizes: list[int], weights: list[float], total: float, max_repeats: int = 2) -> list[float]:
    """Targets by weight that sum to ``total``; none above ``max_repeats`` times its size, the excess
    goes to the others by weight until none is above."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > max_repeats * sizes[i]}
        for i in full or open_:
            targets[i] = float(max_repeats * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(targets[i] for i in full)
        open_ -= full
    return targets


def route(patterns: list[tuple[tuple, int]], quotas: dict, max_repeats: int = 2) -> dict[tuple[int, object], int]:
    """Min-cost max-flow of words from patterns to source quotas: {(pattern index, source): words}.

    Only the arcs into patterns cost anything and the cost rises with the layer, so shortest augmenting
    paths use up layer k before k+1: augment to a maximum with the capacity of each layer in turn.
    """
    flow = {(p, s): 0 for p, (members, _) in enumerate(patterns) for s in members}
    used, room = [0] * len(patterns), dict(quotas)
    takers: dict = {}
    for p, (members, _) in enumerate(patterns):
        for s in members:
            takers.setdefault(s, []).append(p)

    def path(p: int):
        """Breadth first from pattern p to a source with room, over forward and backward arcs."""
        seen, back, todo = {p}, {}, deque([p])
        while todo:
            q = todo.popleft()
            for s in patterns[q][0]:
                if s in back:
                    continue
                back[s] = q
                if room[s] > 0:
                    return True, s, back
                for r in takers[s]:
                    if r not in seen and flow[r, s] > 0:
                        seen.add(r)
                        back[("p", r)] = s
                        todo.append(r)
        return False, None, back

    for layer in range(1, max_repeats + 1):
        for p, (_, size) in enumerate(patterns):
            while used[p] < layer * size:
                reached, end, back = path(p)
                if not reached:
                    break
                steps, s, amount = [], end, min(room[end], layer * size - used[p])
                while True:
                    q = back[s]
                    steps.append((q, s, 1))
                    if q == p:
                        break
                    s = back[("p", q)]
                    steps.append((q, s, -1))
                    amount = min(amount, flow[q, s])
                for q, t, sign in steps:
                    flow[q, t] += sign * amount
                room[end] -= amount
                used[p] += amount
    return flow


def source_plan(docs: DataFrame, members: str, size: str, weights=WEIGHTS, share: float = 1.5, max_repeats: int = 2):
    """Patterns with their sizes, size and target of every source, and the patterns' keys.  Sources are taken in code-point
    order, null last, with ``weights`` repeating; targets share ``share`` times all words.

    The driver receives one row per pattern, not per document."""
    rows = docs.groupBy(pattern_key(members)).agg(F.sum(size).alias("n")).collect()
    named = sorted(((tuple(json.loads(r["__m"])), int(r.n or 0), r["__m"]) for r in rows), key=lambda x: [(s is None, s or "") for s in x[0]])
    patterns, keys = [x[:2] for x in named], [x[2] for x in named]
    sources = sorted({s for m, _ in patterns for s in m}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for m, n in patterns if s in m) for s in sources]
    w = [weights[i % len(weights)] for i in range(len(sources))]
    targets = water_fill(sizes, w, share * sum(n for _, n in patterns), max_repeats)
    return patterns, dict(zip(sources, sizes)), dict(zip(sources, targets)), keys


def pattern_key(members: str) -> Column:
    """A set of sources as text, by which tables meet; a null source is told apart from one of that name."""
    held = F.col(members)
    return F.to_json(F.when(held.isNull() | (F.size(held) == 0), F.array(F.lit(None).cast("string"))).otherwise(held)).alias("__m")


def membership(*sources: Column) -> Column:
    """The sorted set of a row's sources, null last; an array column can be passed through this too."""
    return F.array_distinct(F.array_sort(F.array(*sources)))


def mix(
    docs: DataFrame, members: str, size: str, draw: list[str], weights=WEIGHTS, share: float = 1.5, max_repeats: int = 2, seed: int = 17
) -> DataFrame:
    """``docs`` with ``copies`` (times the mix takes the document), ``taken`` (words, repeats counted),
    ``routes`` (the source that each copy counts for), ``source_size`` and ``target`` (of the first source).

    ``docs`` is read several times; pass a table or thin columns.  A column with the name of a result gives way to it.
    ``draw`` names the columns whose hash with ``seed`` orders the draw.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in RESULT if c not in (members, size, *draw)])
    patterns, sizes, targets, keys = source_plan(docs, members, size, weights, share, max_repeats)
    flow = route(patterns, {s: round(t) for s, t in targets.items()}, max_repeats)
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in draw])
    rows = docs.select(pattern_key(members), F.col(size).alias("__n"), h.alias("__h"))

    # Where each source's run of words ends, as (pattern, layer, words into the layer, source, last of its pattern).
    cuts = []
    for p, (m, n) in enumerate(patterns):
        at, end = 0, sum(flow[p, s] for s in m)
        for s in m:
            at += flow[p, s]
            if flow[p, s]:
                cuts.append((p, keys[p], (at - 1) // n, at - (at - 1) // n * n, n, s, at == end))
    part = spark.createDataFrame([(k, c[1], c[3]) for k, c in enumerate(cuts) if c[3] < c[4]], "cut int, m string, rest long")

    bucket = F.shiftright("__h", 64 - BUCKET_BITS)
    hist = rows.groupBy("__m", bucket.alias("__b")).agg(F.sum("__n").alias("n"))
    cum = F.sum("n").over(_by(["__m"], "__b"))
    hist = hist.withColumn("hi", cum).withColumn("lo", F.col("hi") - F.col("n"))
    at = hist.join(F.broadcast(part), (hist["__m"] == part["m"]) & (F.col("rest") >= F.col("lo")) & (F.col("rest") < F.col("hi")))
    at = at.select("__m", "__b", "cut", (F.col("rest") - F.col("lo")).alias("need"))
    # Only rows of the bucket that a cut falls in are put in order.
    near = rows.withColumn("__b", bucket).join(F.broadcast(at), ["__m", "__b"])
    near = near.withColumn("c", F.sum("__n").over(_by(["cut"], "__h", True)))
    out_of = F.min(F.when(F.col("c") > F.col("need"), F.col("__h")))
    held = F.coalesce(F.max(F.when(F.col("c") <= F.col("need"), F.col("c"))), F.lit(0))
    ends = {}
    for r in near.groupBy("cut").agg(out_of.alias("h"), (F.max("need") - held).alias("short")).collect() if cuts else []:
        p, _, layer, _, _, s, last = cuts[r["cut"]]
        ends[p, s] = (layer, r.h, last, r.short)

    # The words still missing at the end of a pattern go to the one document left whose size is nearest.
    wanted = [(p, keys[p], e[1], e[3]) for (p, s), e in ends.items() if e[2] and e[3] > 0]
    extra = {}
    if wanted:
        want = spark.createDataFrame(wanted, "p int, m string, h long, short long")
        left = rows.join(F.broadcast(want), (rows["__m"] == want["m"]) & (F.col("__h") >= F.col("h")) & (F.col("__n") > 0))
        best = left.groupBy("p").agg(F.min(F.struct(F.abs(F.col("__n") - F.col("short")).alias("off"), F.col("__h").alias("h"), F.col("short"))).alias("b"))
        extra = {r.p: r.b.h for r in best.collect() if r.b.off < r.b.short}

    plan = []
    for p, (m, n) in enumerate(patterns):
        runs = []
        for c in (c for c in cuts if c[0] == p):
            layer, h_end, _, _ = ends.get((p, c[5]), (c[2], None, None, None))
            runs.append((layer, h_end, c[5]))
        deep = max((layer for layer, _, _ in runs), default=-1)
        plan.append((keys[p], sizes[m[0]], targets[m[0]], runs, extra.get(p), deep, runs[-1][2] if runs else None))
    kind = "m string, source_size long, target double, runs array<struct<layer:int,h:long,source:string>>, extra long, deep int, tail string"
    plan = spark.createDataFrame(plan, kind)
    out = docs.select("*", h.alias("__h"), pattern_key(members)).join(F.broadcast(plan), F.col("__m") == plan["m"], "left")

    def run_of(layer: Column) -> Column:
        """The first run that reaches past this document in this layer."""
        past = F.filter("runs", lambda r: (r["layer"] > layer) | ((r["layer"] == layer) & (r["h"].isNull() | (F.col("__h") < r["h"]))))
        tail = F.struct(layer.alias("layer"), F.lit(None).cast("long").alias("h"), F.col("tail").alias("source"))
        last = (F.size(past) == 0) & (F.col("__h") == F.col("extra")) & (layer == F.col("deep"))
        return F.when(F.size(past) > 0, F.element_at(past, 1)).when(last, tail)

    layers = [run_of(F.lit(k)) for k in range(max_repeats)]
    routes = F.transform(F.filter(F.array(*layers), lambda r: r.isNotNull()), lambda r: r["source"])
    out = out.withColumn("routes", routes).withColumn("copies", F.size("routes").cast("long"))
    out = out.withColumn("taken", F.col("copies") * F.col(size))
    return out.drop("__h", "__m", "m", "runs", "extra", "deep", "tail")


def _by(keys: list[str], order: str, ranged: bool = False):
    w = Window.partitionBy(*keys).orderBy(order)
    return w.rangeBetween(Window.unboundedPreceding, 0) if ranged else w.rowsBetween(Window.unboundedPreceding, 0)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies.  Only thin columns are kept."""
    thin = docs.select(
        F.col(id_col).alias("doc_id"),
        membership(F.col(source_col).cast("string")).alias("members"),
        word_count(text_col).alias("size"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    )
    return mix(written(thin, "mix"), "members", "size", ["doc_id", "text_hash"])


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` itself with the columns of :func:`mix`; the table is scanned and never shuffled."""
    named = docs.select(
        "*",
        membership(F.col(source_col).cast("string")).alias("members"),
        word_count(text_col).alias("size"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    )
    return mix(named, "members", "size", [id_col, "text_hash"])

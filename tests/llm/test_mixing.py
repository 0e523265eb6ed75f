"""Targets, min-cost flow against cuts, and the seeded draw."""

import itertools
import random

from pyspark.sql import functions as F

from tidemark.llm import mixing as M


def test_water_fill():
    t = M.water_fill([10, 1000, 1000], [3, 1, 2], 1500)
    assert t[0] == 20 and abs(sum(t) - 1500) < 1e-9 and abs(t[2] - 2 * t[1]) < 1e-9
    assert M.water_fill([0, 0], [1, 1], 0) == [0, 0] and M.water_fill([], [], 0) == []
    assert M.water_fill([100, 0], [1, 1], 150) == [150, 0]


def least_cut(patterns, quotas, layers):
    best = None
    names = list(quotas)
    for n in range(len(names) + 1):
        for t in itertools.combinations(names, n):
            cut = sum(q for s, q in quotas.items() if s not in t) + sum(layers * size for m, size in patterns if set(m) & set(t))
            best = cut if best is None else min(best, cut)
    return best


def test_flow_is_greatest_and_repeats_least():
    r = random.Random(1)
    for _ in range(80):
        names = "abcd"[: r.randrange(1, 5)]
        found = {tuple(sorted(r.sample(names, r.randrange(1, len(names) + 1)))) for _ in range(5)}
        patterns = [(m, r.randrange(0, 40)) for m in sorted(found)]
        quotas = {s: r.randrange(0, 60) for s in {s for m, _ in patterns for s in m}}
        flow = M.route(patterns, quotas, 2)
        used = [sum(flow[p, s] for s in m) for p, (m, _) in enumerate(patterns)]
        assert all(v >= 0 for v in flow.values())
        assert all(u <= 2 * size for u, (_, size) in zip(used, patterns))
        assert all(sum(v for (_, t), v in flow.items() if t == s) <= q for s, q in quotas.items())
        assert sum(used) == least_cut(patterns, quotas, 2)
        assert sum(min(u, size) for u, (_, size) in zip(used, patterns)) == least_cut(patterns, quotas, 1)


def test_documents(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randrange(1, 60)), r.choice(["big", "big", "big", "x", "y", None]), "t") for i in range(3000)]
    rows += [(5000, None, "x", "t"), (5001, "", "x", "t"), (5002, "a b", "tiny", "t"), (None, "no id", "y", "t"), (7, "again again", "x", "t"), (7, "again again", "x", "t"), (8, "long " * 4000, "big", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string").repartition(5)
    got = M.mix_documents(df).cache()
    assert got.count() == len(rows)
    by = got.groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.sum("size").alias("n")).collect()
    assert len(by) == 5
    for x in by:
        assert x.n == x.source_size and abs(x.taken - x.target) <= max(5, 0.01 * x.target)
    total = sum(x.source_size for x in by)
    assert abs(sum(x.target for x in by) - 1.5 * total) < 1e-6
    assert got.filter("taken > 2 * size or copies not in (0, 1, 2)").count() == 0
    again = M.mix_documents(df.repartition(11)).orderBy("doc_id", "size", "taken").collect()
    assert again == got.orderBy("doc_id", "size", "taken").collect()
    assert M.mix_documents(df.limit(0)).count() == 0
    assert M.mix_documents(df.filter("doc_id = 5000")).collect()[0].taken == 0


def test_overlapping_sources(spark):
    r = random.Random(3)
    rows = [(i, sorted(r.sample(["a", "b", "c"], r.randrange(1, 4))), r.randrange(1, 30)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, members array<string>, size long")
    got = M.mix(df, "members", "size", ["doc_id"], weights=(5, 1, 1), share=0.6).collect()
    patterns, sizes, targets, _ = M.source_plan(df, "members", "size", (5, 1, 1), 0.6)
    taken = dict.fromkeys(sizes, 0)
    for x in got:
        assert set(x.routes) <= set(x.members) and x.copies == len(x.routes) <= 2
        for s in x.routes:
            taken[s] += x.size
    flow = M.route(patterns, {s: round(t) for s, t in targets.items()})
    for s in sizes:
        want = sum(v for (_, t), v in flow.items() if t == s)
        assert abs(taken[s] - want) <= 30 * len(patterns)

"""SimHash links and components against brute force over all pairs."""

import itertools
import math
import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import components


def brute(fps, distance):
    fps = sorted(set(fps))
    return {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance}


def signed(v):
    return v - 2**64 if v >> 63 else v


def groups(links):
    """The partition that links make, without single vertices."""
    of = {}
    for a, b in links:
        x, y = of.get(a, {a}), of.get(b, {b})
        for v in x | y:
            of[v] = x | y
        both = x | y
        for v in both:
            of[v] = both
    return {frozenset(g) for g in of.values()}


@pytest.mark.parametrize("distance,crowd", [(2, 8), (2, 256), (9, 128)])
def test_links_tie_what_close_pairs_tie(spark, distance, crowd):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(60)]
    for start, most in ((r.getrandbits(64), 4), (r.getrandbits(64), 12)):
        for _ in range(200):  # a dense ball and a looser one
            v = start
            for b in r.sample(range(64), r.randint(0, most)):
                v ^= 1 << b
            fps.append(v)
    fps = sorted({signed(v) for v in fps})
    df = spark.createDataFrame([(v,) for v in fps], "fp long")
    got = {(x.a, x.b) for x in simhash.near_links(df, distance, crowd=crowd).collect()}
    assert groups(got) == groups(brute(fps, distance))


def test_thresholds_sum_to_the_goal_at_the_least_cost():
    r = np.random.default_rng(1)
    counts, widths = r.integers(1, 200, (50, 4)).astype(float), [16, 16, 16, 16]
    t = simhash.allocate(counts, widths, 5000, 5)
    assert (t.sum(axis=1) == 2).all() and t.min() >= -1

    def cost(row, ts):
        total = 0.0
        for c, w, x in zip(row, widths, ts):
            if x >= 0:
                p = sum(math.comb(w, k) for k in range(x + 1))
                total += c + p + (p - 1) * 5000 / 2.0**w
        return total

    for row, ts in zip(counts, t):
        least = min(cost(row, v) for v in itertools.product(range(-1, 6), repeat=4) if sum(v) == 2)
        assert abs(cost(row, ts) - least) < 1e-9


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = dict((x.vertex, x.component) for x in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {k: v for k, v in got.items() if v != k} == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 130)}}


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_documents(spark):
    rows = [
        (1, "a b c d e f g h", "x"),
        (2, "A B  c d\te f g H", "x"),
        (3, None, None),
        (4, "", "y"),
        (5, "Ä one", "y"),
        (5, "Ä one", "y"),
        (None, "z", "y"),
        (9, "word " * 30000 + "Ende", "y"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] or -1, signed(slow_fingerprint(r[1]))) for r in rows)
    assert sorted((x.doc_id or -1, x.fp) for x in got) == want
    comp = {x.doc_id: x.component_id for x in got}
    assert comp[1] == comp[2] == 1 and comp[3] == comp[4] == 3 and comp[5] == 5 and comp[None] is None
    assert simhash.near_duplicates(df.limit(0)).count() == 0

"""Code lengths against a recursive coder, and held-out accuracy."""

import math
import random

import numpy as np

from tidemark.llm import langid


def test_code_lengths_equal_a_recursive_coder():
    r = random.Random(5)
    training, text = [r.choice([0, 0, 1, 2]) for _ in range(60)], [r.randrange(4) for _ in range(30)]
    counts = np.zeros(4**3)
    g = langid.grams(np.array(training, np.uint8), 2, 4)
    for k in g:
        counts[k] += 1
    table = langid.code_lengths(counts, 2, 4, 1)
    assert abs(np.exp2(-table.reshape(-1, 4)).sum(axis=1) - 1).max() < 1e-5

    def full(text):
        def p(ctx, s):
            if ctx is None:
                return 0.25
            n = {}
            for i in range(2, len(training)):
                if tuple(training[i - len(ctx) : i]) == ctx:
                    n[training[i]] = n.get(training[i], 0) + 1
            low = ctx[1:] if ctx else None
            if not n:
                return p(low, s)
            total, kinds = sum(n.values()), len(n)
            if s in n:
                return n[s] / (total if kinds == 4 else total + kinds)
            return kinds / (total + kinds) * p(low, s) / (1 - sum(p(low, u) for u in n))

        return -sum(math.log2(p(tuple(text[i - 2 : i]), text[i])) for i in range(2, len(text)))

    assert abs(table[langid.grams(np.array(text, np.uint8), 2, 4)].sum() - full(text)) < 1e-3


def test_score_is_the_same_in_blocks(monkeypatch):
    model = {"order": 2, "symbols": 5, "classes": np.arange(256).astype(np.uint8) % 5, "langs": ["a", "b"]}
    table = np.random.default_rng(1).random((125, 2)).astype(np.float32)
    text = bytes(random.Random(2).randrange(256) for _ in range(1000))
    whole = langid.score(text, table, model)
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert np.allclose(whole, langid.score(text, table, model))


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    rows = [(1, "the cat and the dog", "en", 1), (2, "le chat et la souris", "fr", 1), (3, None, "en", 1), (4, "", None, 1), (5, "123 !", "en", 1), (6, "the end", None, 1), (None, "x", "en", 1), (6, "the end", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    got = langid.identify(df).collect()
    assert len(got) == 8 and {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(9, 1)).filter("doc_id = 4")).collect()} == {"und"}

"""Plans against best-fit decreasing piece by piece, ids against the tokenizer, and places without gaps."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= n
        else:
            free.append(capacity - n)
    return len(free)


def test_plan_uses_as_many_sequences_as_best_fit_piece_by_piece():
    r = random.Random(1)
    for _ in range(60):
        capacity = r.randrange(5, 60)
        lengths = [r.randrange(1, capacity + 1) for _ in range(r.randrange(0, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = P.best_fit(counts, capacity)
        places = {}
        for s in plan:
            for t in range(s.count):
                places.setdefault(s.first + t // s.per, []).append((s.offset + t % s.per * s.length, s.length))
        assert len(places) == plain_best_fit(lengths, capacity)
        for got in places.values():
            at = 0
            for offset, n in sorted(got):
                assert offset == at
                at += n
            assert at <= capacity
        for n, c in counts.items():
            ranks = sorted(x for s in plan if s.length == n for x in range(s.rank, s.rank + s.count))
            assert ranks == list(range(c))


ODD = ["", "  \t\n", "It's 123 we'll—ÀÉÎ ñ ß×÷ ÿ", "<|endoftext|> a<|startoftext|>b <| x", "é  x y \x1c z\x85", "İΣΑΣ ΌΣ ﬁ", "日本語 text\x00nul", "a" * 3000, "!!!???...---", "ªº²³ ́lead", "'S 'LL don'T"]


def test_ids_are_those_of_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    r = random.Random(2)
    texts = ODD + ["".join(r.choice("aàéZß'19 .,\n<|>îØ÷π́") for _ in range(r.randrange(200))) for _ in range(300)]
    enc = P.WordEncoder(PATH)
    for t in texts * 2:
        assert enc.encode(t.encode()).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_documents(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "a", "naïve", "x1"]) for _ in range(r.choice([3, 3, 3, 700, 2500])))) for i in range(120)]
    rows += [(900 + k, t) for k, t in enumerate(ODD)] + [(950, None), (951, None), (None, "x"), (7, "x"), (7, "x"), (960, "word " * 30_000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, offset int").repartition(4)
    got = P.pack_documents(df).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want.append((i, k // 2048, k, len(part), zlib.crc32(part.tobytes())))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got), key=key) == sorted(want, key=key)
    places = {}
    for x in got:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(places) == plain_best_fit([x[3] for x in want], 2048)
    assert P.pack_documents(df.limit(0)).count() == 0
